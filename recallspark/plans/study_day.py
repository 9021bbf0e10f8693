"""A review day: what to show, and what the day's grades leave behind."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.candidates import priority_scores
from ..operators.imports import new_log_rows
from ..operators.queue import daily_queue
from ..operators.reviews import apply_reviews
from ..session import settled
from ..settings import DAILY_LIMIT, WEIGHTS, ScoreWeights


@dataclass(frozen=True)
class StudyDay:
    queue: DataFrame
    log_rows: DataFrame


def plan_day(cards: DataFrame, subjects: DataFrame, logs: DataFrame, as_of: datetime,
             daily_limit: int = DAILY_LIMIT, weights: ScoreWeights = WEIGHTS, all_logs: DataFrame | None = None) -> StudyDay:
    """The cards to show for the rest of the day, best first, and their log rows.

    The queue is worked out once, so that it and its log rows agree. With ``logs`` of the
    day alone, ``all_logs`` is the whole table, from which only the largest id is read.
    """
    scored = priority_scores(cards, subjects, logs, as_of, weights)
    queue = settled(daily_queue(scored, logs, as_of, daily_limit)[0])
    return StudyDay(queue, new_log_rows(queue, logs, as_of, all_logs))


def close_day(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """The card table after the day's grades."""
    return apply_reviews(cards, reviews)
