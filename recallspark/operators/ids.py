"""Dense ids for appended rows, without numbering the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# 4 hex digits of a hash: 65,536 buckets of unique keys, even at any key distribution.
BUCKET_DIGITS = 4


def last_id(table: DataFrame, column: str = "id") -> Column:
    """The largest id in use, 0 for an empty table, as a scalar subquery."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("last_id")).scalar()


def numbered(df: DataFrame, key: str, after: Column | int = 0, ids_per_row: Column | int = 1,
             into: str = "id", bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """``df`` with the first of each row's consecutive ids in ``into``.

    Rows take ids in the order (hash bucket of ``key``, ``key``), starting past
    ``after``; ``key`` must be unique. Rows without one are spread over the buckets by a hash of
    their values. A row may claim several ids. The order depends on the rows alone, so a
    recomputed task gives the same ids, up to rows without a key that are equal. Only the
    bucket totals (a bounded number of rows) meet in one task.
    """
    after = F.lit(after) if isinstance(after, int) else after
    ids_per_row = F.lit(ids_per_row) if isinstance(ids_per_row, int) else ids_per_row
    other = F.xxhash64(F.lit(0), *[c for c in df.columns if c != key])
    bucket = F.left(F.md5(F.coalesce(F.col(key).cast("string"), other.cast("string"))), F.lit(bucket_digits))
    weighted = df.withColumn("_other", F.when(F.col(key).isNull(), other)).withColumn("_bucket", bucket).withColumn("_ids", ids_per_row.cast("long"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        weighted.groupBy("_bucket").agg(F.sum("_ids").alias("_total"))
        .select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_bucket").orderBy(key, "_other").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        weighted.join(F.broadcast(offsets), "_bucket")
        .withColumn(into, after + F.col("_offset") + F.sum("_ids").over(within) - F.col("_ids") + 1)
        .drop("_bucket", "_ids", "_offset", "_other")
    )
