"""Small files that are created once: what only one of several writers may do.

Needs a store whose "create unless it exists" is atomic, as HDFS's is. An empty file is one whose
writer died at that moment: delete it.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import file_system

DIGITS = 12
# Entries of other writers that a reservation gives way to.
ATTEMPTS = 100


def entries(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the files in ``folder`` that have content."""
    system, path = file_system(spark, folder)
    if not system.exists(path):
        return []
    return sorted(int(s.getPath().getName()) for s in system.listStatus(path) if s.isFile() and s.getLen() > 0)


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/{number:0{DIGITS}}", wholetext=True).first()[0])


def create_entry(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Writes ``content`` as entry ``number``; False if there is one already."""
    system, path = file_system(spark, f"{folder}/{number:0{DIGITS}}")
    try:
        out = system.create(path, False)
    except Py4JJavaError:
        if not system.exists(path):
            raise
        return False
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return True


def reserve_ids(table: DataFrame, folder: str, name: str, count: int, column: str = "id") -> int:
    """Reserves ``count`` ids of a table for one writer and gives the id before the first of them.

    Reservations follow one another, whether or not their rows have been appended; the first
    follows the largest id that the table has. Writers at the same time get different ranges: who
    comes second to an entry takes the next one. Ids of a writer that never appends stay unused.
    """
    spark, place = table.sparkSession, f"{folder}/id_ledger/{name}"
    for _ in range(ATTEMPTS):
        numbers = entries(spark, place)
        last = entry(spark, place, numbers[-1])["last"] if numbers else 0
        after = max(last, table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])
        if create_entry(spark, place, len(numbers) + 1, {"first": after + 1, "last": after + count}):
            return after
    raise RuntimeError(f"an entry of {place} stays empty")


def reserved_ids(spark: SparkSession, folder: str, name: str) -> list[tuple[int, int]]:
    """The ranges reserved so far, first and last id, in order."""
    place = f"{folder}/id_ledger/{name}"
    return [(e["first"], e["last"]) for e in (entry(spark, place, n) for n in entries(spark, place))]


def id_count(rows: DataFrame, ids_per_row: Column | int = 1) -> int:
    """How many ids ``rows`` will take."""
    per_row = F.lit(ids_per_row) if isinstance(ids_per_row, int) else ids_per_row
    return rows.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("long")).first()[0]
