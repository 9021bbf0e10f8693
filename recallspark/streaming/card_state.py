"""Card state kept up to date from a stream of self-grades.

Each micro-batch is reduced to its deltas: per card the last grade that sets mastery, the 1-grades
since, the last flag, the count and the last time (``operators.reviews.review_deltas``). Deltas of
consecutive batches combine to the deltas of both, whatever the cards were before, so a
micro-batch is one shuffle of its own reviews: it reads neither the cards nor earlier batches, and
no state store holds a row per card. The cards meet the combined deltas when someone asks.

Reviews are applied in the order they arrive; within a micro-batch, by (reviewed_at, review_id). A
late review is therefore folded in when it comes, and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reviews import HOT_REVIEWS, apply_deltas, review_deltas
from ..session import subfolders
from ..settings import MAX_MASTERY

WRITTEN = "card_id long, reviews long, last_at timestamp_ntz, base int, raises long, flag int"


def write_deltas(reviews: DataFrame, out: str, checkpoint: str, max_mastery: int = MAX_MASTERY,
                 hot_reviews: int | None = HOT_REVIEWS, **trigger) -> StreamingQuery:
    """Write each micro-batch's deltas to its own folder; a replayed batch replaces its own."""
    graded = reviews.select(
        F.col("card_id").cast("long"), F.col("reviewed_at").cast("timestamp_ntz"),
        F.col("review_id").cast("long"), F.col("grade").cast("int"))

    def save(batch: DataFrame, batch_id: int) -> None:
        deltas = review_deltas(batch, max_mastery, hot_reviews)
        typed = deltas.select(*[F.col(c).cast(t).alias(c) for c, t in (f.strip().split(" ") for f in WRITTEN.split(","))])
        typed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        graded.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start()
    )


def _numbered_folders(spark, out, prefix):
    return sorted(int(f.removeprefix(prefix)) for f in subfolders(spark, out) or [] if f.startswith(prefix))


def _written(spark, out):
    """The last compaction and the batches after it: (frame with the number of the batch, last number)."""
    upto = max(_numbered_folders(spark, out, "upto="), default=-1)
    batches = [b for b in _numbered_folders(spark, out, "batch=") if b > upto]
    numbered = f"{WRITTEN}, batch long"
    frame = spark.createDataFrame([], numbered)
    if upto >= 0:
        frame = frame.unionByName(spark.read.schema(WRITTEN).parquet(f"{out}/upto={upto}").withColumn("batch", F.lit(upto).cast("long")))
    if batches:
        frame = frame.unionByName(spark.read.schema(numbered).option("basePath", out).parquet(*[f"{out}/batch={b}" for b in batches]))
    return frame, max([upto, *batches])


def _combined(deltas: DataFrame) -> DataFrame:
    """The deltas of all batches as those of one.

    A card has one row per batch, so what is listed per card is bounded by the batches since
    the last compaction.
    """
    resets, flags = F.col("base").isNotNull(), F.col("flag").isNotNull()
    summed = deltas.groupBy("card_id").agg(
        F.sum("reviews").alias("reviews"),
        F.max_by("last_at", "batch").alias("last_at"),
        F.max_by("base", F.when(resets, F.col("batch"))).alias("base"),
        F.max(F.when(resets, F.col("batch"))).alias("reset_batch"),
        F.max_by("flag", F.when(flags, F.col("batch"))).alias("flag"),
        F.collect_list(F.when(F.col("raises") > 0, F.struct("batch", "raises"))).alias("raising"),
    )
    since = F.filter("raising", lambda x: F.col("reset_batch").isNull() | (x["batch"] >= F.col("reset_batch")))
    return summed.select(
        "card_id", "reviews", "last_at", "base",
        F.aggregate(since, F.lit(0).cast("long"), lambda total, x: total + x["raises"]).alias("raises"), "flag")


def merged_deltas(spark: SparkSession, out: str) -> DataFrame:
    """What all batches so far do to each card: the last compaction and the batches since, combined."""
    return _combined(_written(spark, out)[0])


def compact_deltas(spark: SparkSession, out: str) -> None:
    """Writes the combined deltas of all batches so far as one table, which is read instead from then on.

    Run it now and then, not while a batch is being written; the batches it covers may be deleted.
    """
    written, last = _written(spark, out)
    if last >= 0 and last not in _numbered_folders(spark, out, "upto="):
        _combined(written).write.parquet(f"{out}/upto={last}")


def updated_cards(spark: SparkSession, out: str, cards: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """The card table after all batches so far. ``cards`` is the table as it was before the stream."""
    return apply_deltas(cards, merged_deltas(spark, out), max_mastery)


def latest_states(spark: SparkSession, out: str, cards: DataFrame, max_mastery: int = MAX_MASTERY) -> DataFrame:
    """One row per card of ``cards`` that has been reviewed: its state after the last batch it was in."""
    deltas = merged_deltas(spark, out)
    start = cards.select("id", "mastery_level", "ignored", "review_count", "last_reviewed_at")
    return apply_deltas(start, deltas, max_mastery, how="inner").withColumnRenamed("id", "card_id")
