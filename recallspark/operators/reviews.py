"""Folding self-grades into cards: every step, or only the end state.

Reviews are ordered in a card by (reviewed_at, review_id). State after a review is
the last mastery set outright plus the 1-grades since (see ``functions.grading``),
so running sums replace a sequential fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import grading
from ..functions.clock import moment_text
from ..session import settled
from ..settings import GRADE_AGAIN, MAX_MASTERY
from .sizing import small_side

# A card with more reviews than this is not sorted in one task.
HOT_REVIEWS = 5_000_000
HOT_SAMPLE = 1000


def grade_steps(cards: DataFrame, reviews: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """Each review applied on its own to the card as it stands. Unknown cards drop out."""
    start = cards.select(F.col("id").alias("card_id"), "mastery_level", "ignored")
    mastery, ignored = grading.grade_step(F.col("mastery_level"), F.col("ignored"), F.col("grade"), max_mastery)
    return reviews.join(start, "card_id").select(
        "review_id", "card_id", "grade", mastery.alias("new_mastery"), ignored.alias("new_ignored")
    )


def _start_state(cards):
    return cards.select(
        F.col("id").alias("card_id"),
        F.coalesce("mastery_level", F.lit(0)).alias("base_before"),
        F.lit(0).cast("long").alias("raises_before"),
        F.coalesce("ignored", F.lit(0)).alias("ignored_before"),
        F.col("review_count").alias("count_before"),
    )


def _running(reviews, keys, max_mastery):
    """Per review, what its group has done up to and including it. One sort per group."""
    so_far = (
        Window.partitionBy(*keys).orderBy("reviewed_at", "review_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    grade = F.col("grade")
    return (
        reviews
        .withColumn("reset", grading.reset_value(grade, max_mastery))
        .withColumn("n", F.count("*").over(so_far))
        .withColumn("raises", F.count_if(grade == GRADE_AGAIN).over(so_far))
        .withColumn("base", F.last("reset", ignorenulls=True).over(so_far))
        .withColumn("flag", F.last(grading.ignored_value(grade), ignorenulls=True).over(so_far))
        # The count of raises only grows, so its value at the last reset is the largest one at a reset.
        .withColumn("raises_at_reset", F.max(F.when(F.col("reset").isNotNull(), F.col("raises"))).over(so_far))
        .withColumn("raises_since", F.col("raises") - F.coalesce(F.col("raises_at_reset"), F.lit(0)))
    )


def _with_prefix(running, max_mastery):
    """Running values of a group, on top of the state before the group."""
    base = F.coalesce(F.col("base"), F.col("base_before"))
    raises = F.col("raises_since") + F.when(F.col("base").isNull(), F.col("raises_before")).otherwise(0)
    return running.select(
        "card_id", "review_id", "reviewed_at", "grade",
        grading.raised(base, raises, max_mastery).alias("mastery_level"),
        F.coalesce(F.col("flag"), F.col("ignored_before")).cast("int").alias("ignored"),
        (F.col("count_before") + F.col("n")).alias("review_count"),
    )


def review_history(cards: DataFrame, reviews: DataFrame, max_mastery: int = MAX_MASTERY,
                   hot_reviews: int | None = HOT_REVIEWS) -> DataFrame:
    """Every review of a known card with the card's state after it.

    Cards with up to ``hot_reviews`` reviews are sorted each in its task. The reviews
    of cards above that are cut into ranges of the global order, folded per range, and
    the folds chained, so no task ever holds one such card. ``None`` skips the check
    for input known to be even.
    """
    reviews = reviews.select("card_id", "review_id", "reviewed_at", "grade")
    hot = None
    if hot_reviews is not None:
        hot = settled_hot_cards(reviews, hot_reviews, cards.select(F.col("id").alias("card_id")))
    if hot is None:
        return _even_history(cards, reviews, max_mastery)
    ids = small_side(hot.select("card_id"))
    parts = 1 + hot.agg(F.sum("n")).first()[0] // hot_reviews
    return _even_history(cards, reviews.join(ids, "card_id", "left_anti"), max_mastery).unionByName(
        _ranged_history(cards, reviews.join(ids, "card_id", "left_semi"), parts, max_mastery)
    )


def settled_hot_cards(reviews: DataFrame, hot_reviews: int, known: DataFrame | None = None) -> DataFrame | None:
    """(card_id, n) of cards (``known`` ones if given) with more than ``hot_reviews`` reviews, None if there are none.

    This only chooses how cards are folded, never what comes out, so large inputs are
    judged by a sample in which a hot card shows up about a thousand times; half of
    that is taken as hot already.
    """
    if reviews.count() <= hot_reviews:
        return None
    share = min(1.0, HOT_SAMPLE / hot_reviews)
    seen = reviews.select("card_id") if share == 1.0 else reviews.select("card_id").sample(share, seed=1)
    limit = hot_reviews if share == 1.0 else HOT_SAMPLE // 2
    counted = seen.groupBy("card_id").agg(F.count("*").alias("seen")).where(F.col("seen") > limit)
    if known is not None:
        counted = counted.join(known, "card_id", "left_semi")
    hot = settled(counted.select("card_id", (F.col("seen") / F.lit(share)).cast("long").alias("n")))
    return None if hot.isEmpty() else hot


def _even_history(cards, reviews, max_mastery):
    """One shuffle and one sort of the reviews by card: the window goes by the join's order.

    The join comes first, so reviews of unknown cards are neither sorted in time nor folded.
    """
    return _with_prefix(_running(reviews.join(_start_state(cards), "card_id"), ["card_id"], max_mastery), max_mastery)


def _ranged_history(cards, reviews, parts, max_mastery):
    ranged = (
        reviews.repartitionByRange(parts, "card_id", "reviewed_at", "review_id")
        .withColumn("part", F.spark_partition_id())
    )
    # The written copy pins each review to its range: both uses below must agree on it.
    running = settled(_running(ranged, ["card_id", "part"], max_mastery))
    per_part = running.groupBy("card_id", "part").agg(
        F.max("n").alias("n"),
        F.max("raises").alias("raises"),
        F.max("raises_at_reset").alias("raises_at_reset"),
        F.max_by("base", "n").alias("base"),
        F.max_by("flag", "n").alias("flag"),
    )
    earlier = Window.partitionBy("card_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = per_part.join(_start_state(cards), "card_id")
    raises_total = F.coalesce(F.sum("raises").over(earlier), F.lit(0))
    chained = (
        start
        .withColumn("total_before", raises_total)
        .withColumn("at_reset", F.col("total_before") + F.col("raises_at_reset"))
        .select(
            "card_id", "part",
            F.coalesce(F.last("base", ignorenulls=True).over(earlier), F.col("base_before")).alias("base_before"),
            (F.col("total_before") - F.coalesce(F.max("at_reset").over(earlier), F.lit(0))).alias("raises_before"),
            F.coalesce(F.last("flag", ignorenulls=True).over(earlier), F.col("ignored_before")).alias("ignored_before"),
            (F.col("count_before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("count_before"),
        )
    )
    return _with_prefix(running.join(small_side(chained, per_part), ["card_id", "part"]), max_mastery)


def review_deltas(reviews: DataFrame, max_mastery: int = MAX_MASTERY, hot_reviews: int | None = HOT_REVIEWS) -> DataFrame:
    """Per card, what a batch of reviews does to it: (card_id, reviews, last_at, base, raises, flag).

    One scan, one shuffle and one sort of the reviews' four narrow columns; a card's last row
    says it all. Cards with more than ``hot_reviews`` reviews are gathered without being
    ordered. ``None`` skips the check for input known to be even.
    """
    reviews = reviews.select("card_id", "review_id", "reviewed_at", "grade").where(F.col("card_id").isNotNull())
    hot = None if hot_reviews is None else settled_hot_cards(reviews, hot_reviews)
    if hot is None:
        return _ordered_deltas(reviews, max_mastery)
    ids = small_side(hot.select("card_id"))
    return _ordered_deltas(reviews.join(ids, "card_id", "left_anti"), max_mastery).unionByName(
        _gathered_deltas(reviews.join(ids, "card_id", "left_semi"), max_mastery))


def _ordered_deltas(reviews, max_mastery):
    in_order = Window.partitionBy("card_id").orderBy("reviewed_at", "review_id")
    last = _running(reviews, ["card_id"], max_mastery).withColumn("more", F.lead(F.lit(True)).over(in_order)).where(F.col("more").isNull())
    return last.select("card_id", F.col("n").alias("reviews"), F.col("reviewed_at").alias("last_at"), "base",
                       F.col("raises_since").alias("raises"), "flag")


def _gathered_deltas(reviews: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """The same without ordering any card's reviews.

    Only the last reset matters, and after it at most ``max_mastery`` 1-grades. The
    latest ``max_mastery`` 1-grades of a card are kept by a row_number limit, which
    Spark applies in each task before the shuffle; everything else is a plain
    aggregate. A card with a third of all reviews sends a few rows per task.
    """
    grade = F.col("grade")
    at = F.struct("reviewed_at", "review_id")
    totals = reviews.groupBy("card_id").agg(
        F.count("*").alias("reviews"),
        F.max("reviewed_at").alias("last_at"),
        F.count_if(grade == GRADE_AGAIN).alias("raises"),
        F.max(F.when(grading.reset_value(grade, max_mastery).isNotNull(), F.struct(at.alias("at"), "grade"))).alias("reset"),
        F.max(F.when(grading.ignored_value(grade).isNotNull(), F.struct(at.alias("at"), "grade"))).alias("flagging"),
    )
    latest_first = Window.partitionBy("card_id").orderBy(F.desc("reviewed_at"), F.desc("review_id"))
    latest = (
        reviews.where(grade == GRADE_AGAIN)
        .select("card_id", "reviewed_at", "review_id", F.row_number().over(latest_first).alias("rank"))
        .where(F.col("rank") <= max_mastery)
        .groupBy("card_id").agg(F.collect_list(at).alias("latest_raises"))
    )
    since = F.size(F.filter("latest_raises", lambda r: r > F.col("reset.at")))
    return totals.join(latest, "card_id", "left").select(
        "card_id", "reviews", "last_at",
        grading.reset_value(F.col("reset.grade"), max_mastery).alias("base"),
        F.when(F.col("reset").isNull(), F.col("raises")).otherwise(F.greatest(F.coalesce(since, F.lit(0)), F.lit(0))).cast("long").alias("raises"),
        grading.ignored_value(F.col("flagging.grade")).alias("flag"),
    )


def apply_deltas(cards: DataFrame, deltas: DataFrame, max_mastery: int = MAX_MASTERY, how: str = "left") -> DataFrame:
    """``cards`` after ``deltas``: cards without a delta unchanged, or left out with ``how="inner"``."""
    reviewed = F.col("reviews").isNotNull()
    mastery = grading.raised(
        F.coalesce(F.col("base"), F.col("mastery_level"), F.lit(0)), F.col("raises"), max_mastery
    )
    changed = {
        "last_reviewed_at": F.when(reviewed, moment_text(F.col("last_at"))).otherwise(F.col("last_reviewed_at")),
        "review_count": F.when(reviewed, F.col("review_count") + F.col("reviews")).otherwise(F.col("review_count")),
        "mastery_level": F.when(reviewed, mastery).otherwise(F.col("mastery_level")),
        "ignored": F.when(reviewed, F.coalesce("flag", "ignored", F.lit(0))).otherwise(F.col("ignored")).cast("int"),
    }
    joined = cards.join(deltas, cards["id"] == deltas["card_id"], how)
    return joined.select(*[changed[c].alias(c) if c in changed else cards[c] for c in cards.columns])


def apply_reviews(cards: DataFrame, reviews: DataFrame, max_mastery: int = MAX_MASTERY,
                  hot_reviews: int | None = HOT_REVIEWS) -> DataFrame:
    """The card table after a batch of reviews: a new snapshot, cards without reviews unchanged.

    While the batch is small the deltas are broadcast and the cards are not shuffled. A
    larger batch is joined on the card id, unique on both sides, by which the deltas lie already.
    """
    deltas = small_side(review_deltas(reviews, max_mastery, hot_reviews), reviews.select("card_id"))
    return apply_deltas(cards, deltas, max_mastery)
