"""Rows without those of a set of ids, filtered where they lie as long as the set can be sent there.

A set of ids as rows is sent up to ``sizing.BROADCAST_BYTES``. A larger one is sent as exact bit
maps: a row of 4 KB stands for 32,768 neighbouring ids, so that a set of millions of ids takes a
hundredth of its size as rows. Only a set whose bit maps are above ``BITMAP_BYTES`` is joined by
shuffling both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settled
from . import sizing

# Bytes of one bit map with its bucket, and the most that are sent to every task.
MAP_BYTES = 4096 + 64
BITMAP_BYTES = 128 * 1024 * 1024


def bit_maps(ids: DataFrame) -> DataFrame:
    """(bucket, bits): the distinct values of the column ``id`` as bit maps, combined per task before the shuffle."""
    return ids.where(F.col("id").isNotNull()).groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _holds(bits: Column, number: Column) -> Column:
    """Is the bit of ``number`` set in the map of its bucket?"""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def without_ids(rows: DataFrame, ids: DataFrame, id_bytes: int) -> DataFrame:
    """``rows`` whose ``id`` is not among those of ``ids``, which take ``id_bytes`` as rows. A NULL id stays."""
    if id_bytes <= sizing.BROADCAST_BYTES:
        return rows.join(F.broadcast(ids.distinct()), "id", "left_anti")
    maps = settled(bit_maps(ids))
    if maps.count() * MAP_BYTES > BITMAP_BYTES:
        return rows.join(ids.distinct(), "id", "left_anti")
    held = rows.join(F.broadcast(maps.withColumnRenamed("bucket", "_bucket")), F.bitmap_bucket_number("id") == F.col("_bucket"), "left")
    return held.where(F.col("bits").isNull() | ~_holds(F.col("bits"), F.col("id"))).select(*[rows[c] for c in rows.columns])
