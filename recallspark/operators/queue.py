"""Daily quota, best cards, the day's queue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import clock
from ..settings import DAILY_LIMIT, MAX_MASTERY, TOP_CARDS
from .candidates import CARD_COLUMNS, learning_cards
from .imports import new_log_rows
from .ranges import with_positions


def best_first() -> list:
    """Highest score first; equal scores in id order."""
    return [F.desc("priority_score"), F.asc("id")]


def recommendations_on_day(logs: DataFrame, as_of: datetime) -> DataFrame:
    """One row: how many recommendations the day of ``as_of`` has seen."""
    today = logs.where(clock.on_day_filter(F.col("recommended_at"), as_of.date()))
    return today.agg(F.count("*").alias("today_recommended_count"))


def quota_status(logs: DataFrame, as_of: datetime, daily_limit: int = DAILY_LIMIT) -> DataFrame:
    """One row: the limit, what is used, what is left."""
    used = F.col("today_recommended_count")
    return recommendations_on_day(logs, as_of).select(
        F.lit(daily_limit).cast("long").alias("daily_limit"),
        used,
        F.greatest(F.lit(daily_limit) - used, F.lit(0)).alias("remaining"),
        (used >= daily_limit).alias("daily_limit_reached"),
    )


def _remaining(logs, as_of, daily_limit):
    return quota_status(logs, as_of, daily_limit).select("remaining").scalar()


def ranked_cards(scored: DataFrame) -> DataFrame:
    """All scored cards, best first, with their positions from 1."""
    return with_positions(scored, best_first())


def recommended_card(scored: DataFrame, logs: DataFrame, as_of: datetime, daily_limit: int = DAILY_LIMIT) -> DataFrame:
    """The best card, or no row once the limit is reached."""
    return (
        scored.where(_remaining(logs, as_of, daily_limit) > 0)
        .orderBy(*best_first()).limit(1)
        .select(*CARD_COLUMNS, "priority_score", "reason")
    )


def recommended_log_row(card: DataFrame, logs: DataFrame, as_of: datetime) -> DataFrame:
    """The log row of a card taken by ``recommended_card``; none if none was taken."""
    return new_log_rows(card.withColumn("position", F.lit(1)), logs, as_of)


def top_priority_cards(scored: DataFrame, logs: DataFrame, as_of: datetime, n: int = TOP_CARDS,
                       daily_limit: int = DAILY_LIMIT) -> DataFrame:
    """The best ``n`` cards: all of them while any quota is left, none afterwards. Logs nothing."""
    best = (
        scored.where(_remaining(logs, as_of, daily_limit) > 0)
        .select("id", "question", "subject_name", "priority_score")
        .orderBy(*best_first()).limit(n)
    )
    return _positions(best)


def _positions(limited: DataFrame) -> DataFrame:
    """Numbers 1..n on rows a limit has already cut to the top."""
    return limited.withColumn("position", F.row_number().over(Window.orderBy(*best_first())))


def card_lines(top: DataFrame) -> DataFrame:
    """Top cards as display lines: ``1. [subject] question``."""
    return top.select(
        "position",
        F.concat(F.col("position").cast("string"), F.lit(". ["), "subject_name", F.lit("] "), "question").alias("line"),
    )


def daily_queue(scored: DataFrame, logs: DataFrame, as_of: datetime,
                daily_limit: int = DAILY_LIMIT, all_logs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rest of the day's cards in order, and the log rows that record them.

    ``logs`` may hold the day's rows only; ``all_logs`` is then where new ids run on from.

    Taking the best card and logging it, again and again until the limit, takes
    exactly the best (limit - used) cards: logging only removes the card taken.
    After the log rows are appended, a second run the same day finds no quota left.
    """
    # Without quota no card is scored.
    allowed = scored.where(_remaining(logs, as_of, daily_limit) > 0)
    best = _positions(allowed.orderBy(*best_first()).limit(daily_limit))
    queue = (
        best.where(F.col("position") <= _remaining(logs, as_of, daily_limit))
        .select("position", *CARD_COLUMNS, "subject_name", "priority_score", "reason")
    )
    return queue, new_log_rows(queue, logs, as_of, all_logs)


def random_card(cards: DataFrame, seed: int | str, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """One live, unmastered card picked by a seeded hash order: same seed, same card."""
    return (
        learning_cards(cards, max_mastery)
        .orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), "id")
        .limit(1)
        .select(*CARD_COLUMNS)
    )
