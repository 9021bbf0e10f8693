"""Everything the overview shows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.candidates import priority_scores
from ..operators.dashboard import dashboard_totals, quota_line, subject_progress
from ..operators.queue import top_priority_cards
from ..settings import TOP_CARDS


@dataclass(frozen=True)
class Dashboard:
    totals: DataFrame
    progress: DataFrame
    top_cards: DataFrame
    quota: DataFrame


def dashboard(cards: DataFrame, subjects: DataFrame, logs: DataFrame, as_of: datetime, n: int = TOP_CARDS) -> Dashboard:
    scored = priority_scores(cards, subjects, logs, as_of)
    return Dashboard(
        totals=dashboard_totals(cards, as_of),
        progress=subject_progress(cards, subjects),
        top_cards=top_priority_cards(scored, logs, as_of, n),
        quota=quota_line(logs, as_of),
    )
