"""Eligible cards and their scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import clock, scoring
from ..functions.predicates import is_learning, is_live
from ..settings import LABELS, LIMITS, MAX_MASTERY, WEIGHTS, ReasonLabels, ReasonLimits, ScoreWeights
from . import sizing
from .idsets import without_ids
from .sizing import measured_bytes, side_width

CARD_COLUMNS = [
    "id", "subject_id", "question", "answer", "created_at", "last_reviewed_at", "review_count", "mastery_level",
]


def live_cards(cards: DataFrame) -> DataFrame:
    return cards.where(is_live())


def learning_cards(cards: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Live cards below the top mastery."""
    return cards.where(is_learning(max_mastery) & is_live())


def _logged_today(logs, as_of):
    return logs.where(clock.on_day_filter(F.col("recommended_at"), as_of.date())).select(F.col("card_id").alias("id"))


def logged_cards(logs: DataFrame, as_of: datetime) -> DataFrame:
    """Ids of the cards already recommended on the day of ``as_of``."""
    return _logged_today(logs, as_of).distinct()


def eligible_cards(cards: DataFrame, logs: DataFrame, as_of: datetime, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Learning cards not yet recommended today."""
    logged = _logged_today(logs, as_of)
    return without_ids(learning_cards(cards, max_mastery), logged, measured_bytes(logged)[0])


def _eligible_with_subject(cards, subjects, subject_side, logs, as_of, max_mastery):
    """Eligible cards joined with ``subject_side``, one row per subject."""
    logged = _logged_today(logs, as_of)
    width = side_width(subject_side, subjects)
    logged_bytes, subject_bytes = measured_bytes(logged, subjects, widths=[1, width])
    side = F.broadcast(subject_side) if subject_bytes <= sizing.BROADCAST_BYTES else subject_side
    return without_ids(learning_cards(cards, max_mastery), logged, logged_bytes).join(side, "subject_id")


def review_candidates(cards: DataFrame, subjects: DataFrame, logs: DataFrame, as_of: datetime,
                      max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Eligible cards with their subject's columns; cards without a subject drop out."""
    side = subjects.select(
        F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), "ddl", "credits", "difficulty",
    )
    return (
        _eligible_with_subject(cards, subjects, side, logs, as_of, max_mastery)
        .select(*CARD_COLUMNS, "ddl", "credits", "difficulty", "subject_name")
    )


def subject_factors(subjects: DataFrame, as_of: datetime, weights: ScoreWeights = WEIGHTS,
                    labels: ReasonLabels = LABELS, limits: ReasonLimits = LIMITS) -> DataFrame:
    """What the score takes from the subject, worked out once per subject instead of per card."""
    days = clock.days_until(clock.deadline_date(F.col("ddl")), as_of)
    return (
        subjects
        .select(
            F.col("id").alias("subject_id"),
            F.col("name").alias("subject_name"),
            days.alias("_days"),
            scoring.importance(F.col("credits"), F.col("difficulty")).alias("importance"),
        )
        .select("*", scoring.urgency(F.col("_days")).alias("urgency"))
        .select(
            "subject_id", "subject_name", "urgency", "importance",
            scoring.days_left(F.col("_days")).alias("days_left"),
            (F.col("urgency") * weights.urgency + F.col("importance") * weights.importance).alias("_subject_score"),
            scoring.deadline_label(F.col("urgency"), F.col("_days"), labels, limits).alias("_deadline_label"),
            scoring.importance_label(F.col("importance"), labels, limits).alias("_importance_label"),
        )
    )


def priority_scores(cards: DataFrame, subjects: DataFrame, logs: DataFrame, as_of: datetime,
                    weights: ScoreWeights = WEIGHTS, max_mastery: int = MAX_MASTERY,
                    labels: ReasonLabels = LABELS, limits: ReasonLimits = LIMITS) -> DataFrame:
    """Every eligible card with its score, the factors behind it and the reason text.

    The sum is taken in a fixed order (urgency, importance, forgetting, mastery gap);
    its first two terms come from the subject.
    """
    factors = subject_factors(subjects, as_of, weights, labels, limits)
    moment = clock.review_moment(F.col("last_reviewed_at"))
    return (
        _eligible_with_subject(cards, subjects, factors, logs, as_of, max_mastery)
        .withColumn("_moment", moment)
        .withColumn("days_since_review", scoring.forgetting(clock.days_since(F.col("_moment"), as_of)))
        .withColumn("mastery_gap", F.lit(max_mastery) - F.col("mastery_level"))
        .withColumn(
            "priority_score",
            F.col("_subject_score")
            + F.col("days_since_review") * F.lit(weights.forgetting)
            + F.col("mastery_gap") * F.lit(weights.mastery),
        )
        .select(
            *CARD_COLUMNS, "subject_name", "days_left", "urgency", "importance", "days_since_review", "mastery_gap",
            "priority_score",
            scoring.reason(
                F.col("_deadline_label"), F.col("days_since_review"), F.col("mastery_level"),
                F.col("_importance_label"), labels, limits,
            ).alias("reason"),
        )
    )


def reason_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("reason").agg(F.count("*").alias("cards"))
