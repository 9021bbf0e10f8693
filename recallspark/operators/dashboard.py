"""Totals and progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import clock
from ..functions.predicates import is_live
from ..functions.text import round_to_cents
from ..settings import DAILY_LIMIT, MAX_MASTERY
from .queue import recommendations_on_day


def dashboard_totals(cards: DataFrame, as_of: datetime) -> DataFrame:
    """One row from one pass over three columns of the cards."""
    return (
        cards.where(is_live())
        .agg(
            F.count("*").alias("total_cards"),
            F.count_if(clock.on_day(F.col("last_reviewed_at"), as_of.date())).alias("today_reviews"),
            F.avg("mastery_level").alias("mean_mastery"),
        )
        .select(
            "total_cards", "today_reviews",
            F.coalesce(round_to_cents(F.col("mean_mastery")), F.lit(0.0)).alias("avg_mastery"),
            "mean_mastery",
        )
    )


def subject_progress(cards: DataFrame, subjects: DataFrame, count_missing: bool = True,
                     max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Mean mastery, live cards and progress of every subject.

    Cards are aggregated before the join, so a subject with very many cards sends
    one row per task. ``count_missing`` keeps the reference behaviour of counting
    1 for a subject that has no cards at all.
    """
    per_subject = cards.groupBy(F.col("subject_id").alias("id")).agg(
        F.avg(F.when(is_live(), F.col("mastery_level"))).alias("mean"),
        F.count_if(is_live()).alias("live"),
    )
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    return subjects.select("id", "name").join(per_subject, "id", "left").select(
        F.col("id").alias("subject_id"),
        "name",
        mean.alias("avg_mastery"),
        F.coalesce(F.col("live"), F.lit(1 if count_missing else 0)).cast("long").alias("card_count"),
        (mean / F.lit(float(max_mastery))).alias("progress"),
    )


# Partial sums of cards, which add up to the numbers above whatever parts the cards come in.
SUMMARY = "subject_id long, day string, cards long, live long, mastery_sum long, mastery_count long"


def card_summary(cards: DataFrame, *by: str) -> DataFrame:
    """Per subject and day of the last review (and ``by``): cards, live cards, sum and count of their masteries."""
    live = F.coalesce(is_live(), F.lit(False))
    mastery = F.when(live, F.col("mastery_level").cast("long"))
    return cards.groupBy(*by, "subject_id", clock.named_day(F.col("last_reviewed_at")).alias("day")).agg(
        F.count("*").alias("cards"), F.count_if(live).alias("live"), F.coalesce(F.sum(mastery), F.lit(0)).alias("mastery_sum"),
        F.count(mastery).alias("mastery_count"))


def totals_of(summary: DataFrame, as_of: datetime) -> DataFrame:
    """``dashboard_totals`` from summaries of parts of the cards."""
    return summary.agg(
        F.coalesce(F.sum("live"), F.lit(0)).alias("total_cards"),
        F.coalesce(F.sum(F.when(F.col("day") == as_of.date().isoformat(), F.col("live"))), F.lit(0)).alias("today_reviews"),
        (F.sum("mastery_sum") / F.nullif(F.sum("mastery_count"), F.lit(0))).alias("mean_mastery"),
    ).select(
        "total_cards", "today_reviews",
        F.coalesce(round_to_cents(F.col("mean_mastery")), F.lit(0.0)).alias("avg_mastery"),
        "mean_mastery",
    )


def progress_of(summary: DataFrame, subjects: DataFrame, count_missing: bool = True, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """``subject_progress`` from summaries of parts of the cards."""
    per_subject = summary.groupBy(F.col("subject_id").alias("id")).agg(
        (F.sum("mastery_sum") / F.nullif(F.sum("mastery_count"), F.lit(0))).alias("mean"),
        F.sum("live").alias("live"), F.sum("cards").alias("cards")).where("cards > 0")
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    return subjects.select("id", "name").join(per_subject, "id", "left").select(
        F.col("id").alias("subject_id"),
        "name",
        mean.alias("avg_mastery"),
        F.coalesce(F.col("live"), F.lit(1 if count_missing else 0)).cast("long").alias("card_count"),
        (mean / F.lit(float(max_mastery))).alias("progress"),
    )


def progress_lines(progress: DataFrame) -> DataFrame:
    """Display form: the heading of each subject and its bar, never past 1."""
    return progress.select(
        "subject_id",
        F.concat("name", F.lit(" ("), F.col("card_count").cast("int").cast("string"), F.lit(")")).alias("heading"),
        F.least(F.col("progress"), F.lit(1.0)).alias("bar"),
    )


def total_lines(totals: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Display form of the mean mastery: ``2.5 / 5.0``."""
    return totals.select(
        "total_cards", "today_reviews",
        F.concat(F.col("avg_mastery").cast("string"), F.lit(f" / {float(max_mastery)}")).alias("mastery_line"),
    )


def quota_line(logs: DataFrame, as_of: datetime, daily_limit: int = DAILY_LIMIT) -> DataFrame:
    """Display form of the quota: ``9 / 100``."""
    return recommendations_on_day(logs, as_of).select(
        F.concat(F.col("today_recommended_count").cast("string"), F.lit(f" / {daily_limit}")).alias("quota_line")
    )


def subject_imports(imported_files: DataFrame) -> DataFrame:
    """Distinct file names of each subject, sorted, joined by commas.

    Duplicates go first, spread over (subject, name), so what meets in one place is
    only what the resulting cell holds.
    """
    return (
        imported_files.select("subject_id", "file_name").distinct()
        .groupBy("subject_id")
        .agg(F.array_join(F.sort_array(F.collect_list("file_name")), ",").alias("imported_files"))
    )


def subjects_view(subjects: DataFrame, imported_files: DataFrame) -> DataFrame:
    """Subjects with their imported files, empty text where there are none."""
    imports = subject_imports(imported_files).withColumnRenamed("subject_id", "id")
    return subjects.join(imports, "id", "left").withColumn(
        "imported_files", F.coalesce(F.col("imported_files"), F.lit(""))
    )


def subject_names(subjects: DataFrame) -> DataFrame:
    """Id to name, for labels."""
    return subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
