"""Strategy choices that rest on a measurement: what to broadcast, what to spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

BROADCAST_BYTES = 32 * 1024 * 1024
# What a text that a side makes itself is taken to measure, in fields of 8 bytes.
TEXT_FIELDS = 8


def _bytes(df, width=0):
    """One row: the bytes ``df`` takes as rows, a fixed part per field plus the text lengths; of ``width`` fields at least."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    fixed = F.count("*") * (64 + 8 * max(width, len(df.columns)))
    return df.agg(sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts), fixed).alias("bytes"))


def measured_bytes(*dfs: DataFrame, widths: list[int] | None = None) -> list[int]:
    """The sizes of several inputs, from one job; ``widths`` counts them with so many fields at least."""
    sizes = reduce(DataFrame.unionAll, [
        _bytes(df, widths[i] if widths else 0).select(F.lit(i).alias("i"), "bytes") for i, df in enumerate(dfs)
    ])
    return [row["bytes"] for row in sorted(sizes.collect())]


def side_width(side: DataFrame, basis: DataFrame) -> int:
    """Fields of a side; a text column that the basis lacks counts as so many fields more."""
    made = [f for f in side.schema if isinstance(f.dataType, StringType) and f.name not in basis.columns]
    return len(side.columns) + TEXT_FIELDS * len(made)


def small_sides(*sides: tuple[DataFrame, DataFrame], max_bytes: int | None = None) -> list[DataFrame]:
    """Join sides, each marked for broadcast if it measures small.

    A side comes with a basis that is cheap to read and has at least as many rows, so
    its size bounds the side's. A side above ``max_bytes`` is returned unmarked: its
    join is then shuffled, and adaptive execution splits the partitions of hot keys.
    """
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    widths = [side_width(side, basis) for side, basis in sides]
    sizes = measured_bytes(*[basis for _, basis in sides], widths=widths)
    return [F.broadcast(side) if size <= max_bytes else side for (side, _), size in zip(sides, sizes)]


def small_side(side: DataFrame, basis: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    return small_sides((side, side if basis is None else basis), max_bytes=max_bytes)[0]


def spread_over_cores(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if it fills so few partitions that cores would idle.

    Input of many files, the normal case at scale, is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("part")).distinct().limit(cores).count()
    return df if filled >= cores else df.repartition(cores)
