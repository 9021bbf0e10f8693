"""The study tables on storage.

Appends add files and never touch others. Files may have fewer columns than the table: each is
read with the columns it was written with, and what it lacks gets its default. Logs are
partitioned by day, with a partition of their own for texts that name no day.

A keyed update of the cards is a new snapshot, in versions:

- ``cards/``: appended files, of all times.
- ``card_snapshots/<name>/``: the rows of one snapshot, and the list of the appended files it holds.
- ``card_versions/<number>``: one small file per version, which names its snapshot.

Whoever reads the cards notes the version and the appended files that the read holds
(``CardVersion``); the cards are the snapshot's rows and every appended file that it does not
hold. Whoever writes a snapshot hands that note in: files appended meanwhile stay appended, and if
another snapshot was written meanwhile, the write fails (``SnapshotConflict``) and nothing
changes. A version is published by creating its file, which fails if the file exists (``ledger``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import CARD_DEFAULTS, TABLES, with_defaults
from ..session import file_system, subfolders
from . import ledger


class SnapshotConflict(RuntimeError):
    """The cards have another version than the one that the snapshot was made of."""


@dataclass(frozen=True)
class CardVersion:
    """What one read of the cards holds: a version, its snapshot, and appended files besides.

    ``number`` is 0 before the first snapshot; ``held`` are the appended files that the
    snapshot holds already, ``appended`` those read beside it.
    """

    number: int = 0
    run_id: str | None = None
    snapshot: str | None = None
    held: frozenset[str] = frozenset()
    appended: tuple[str, ...] = ()


class StudyTables(dict):
    """The tables by name; ``card_version`` tells what the cards among them hold."""

    def __init__(self, frames: dict[str, DataFrame], card_version: CardVersion):
        super().__init__(frames)
        self.card_version = card_version


def create_tables(spark: SparkSession, database: str = "default", card_buckets: int = 0) -> None:
    """Declare the tables that do not exist yet.

    With ``card_buckets`` the cards are stored bucketed and sorted by id, so that
    joins with reviews on the card id need not shuffle them.
    """
    for name, schema in TABLES.items():
        if spark.catalog.tableExists(f"{database}.{name}"):
            continue
        empty = spark.createDataFrame([], schema).write.format("parquet")
        if name == "cards" and card_buckets:
            empty = empty.bucketBy(card_buckets, "id").sortBy("id")
        empty.saveAsTable(f"{database}.{name}")


def save_cards(cards: DataFrame, table: str, buckets: int) -> None:
    """``cards`` as a new bucketed table."""
    cards.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)


def _files(spark, path):
    """Data files of a table's folder as paths below it: those directly in it, and those of each generation."""
    system, root = file_system(spark, path)
    found = []
    for pattern in ("*.parquet", "generation=*/*.parquet"):
        for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            where = status.getPath()
            parent = where.getParent().getName()
            found.append(f"{parent}/{where.getName()}" if "/" in pattern else where.getName())
    return sorted(found)


def _read(spark, path, name, files, path_column=None):
    """Some data files of a table's folder. Each is read with its own columns; a generation's files share theirs.

    ``path_column`` names a further column with the path of each row's file.
    """
    schema, defaults = TABLES[name], CARD_DEFAULTS if name == "cards" else None
    groups: dict[str, list[str]] = {}
    for file in files:
        groups.setdefault(file.rpartition("/")[0] or file, []).append(file)
    by_columns: dict[tuple, tuple[StructType, list[str]]] = {}
    for members in groups.values():
        own = spark.read.parquet(f"{path}/{members[0]}").schema
        by_columns.setdefault(tuple((f.name, f.dataType.simpleString()) for f in own), (own, []))[1].extend(members)
    frames = [spark.read.schema(own).parquet(*[f"{path}/{m}" for m in members]) for own, members in by_columns.values()]
    if not frames:
        return spark.createDataFrame([], schema)
    if path_column is None:
        return reduce(DataFrame.unionByName, [with_defaults(f, schema, defaults) for f in frames])
    more = StructType([*schema, StructField(path_column, StringType())])
    return reduce(DataFrame.unionByName, [with_defaults(f.withColumn(path_column, F.col("_metadata.file_path")), more, defaults) for f in frames])


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One study table, with its declared schema and old rows' gaps filled; the cards as of now."""
    if name == "recommendation_logs":
        return load_logs(spark, folder)
    if name == "cards":
        return load_cards(spark, folder, card_version(spark, folder))
    return _read(spark, f"{folder}/{name}", name, _files(spark, f"{folder}/{name}"))


def load_tables(spark: SparkSession, folder: str) -> StudyTables:
    version = card_version(spark, folder)
    return StudyTables(
        {name: load_cards(spark, folder, version) if name == "cards" else load_table(spark, folder, name) for name in TABLES}, version)


def _generation(schema):
    """A name for a set of columns."""
    return md5(",".join(schema.names).encode()).hexdigest()[:8]


def append_rows(rows: DataFrame, folder: str, name: str) -> None:
    """Add ``rows`` to a table; columns they lack get their default. Logs go by day."""
    if name == "recommendation_logs":
        append_logs(rows, folder)
        return
    complete = with_defaults(rows, TABLES[name], CARD_DEFAULTS if name == "cards" else None)
    complete.write.mode("append").parquet(f"{folder}/{name}/generation={_generation(TABLES[name])}")


def log_day(text: Column) -> Column:
    """The day that a log row's text names, as text; NULL for any other text."""
    first = F.left(text, F.lit(10))
    return F.when(first.rlike(r"^\d{4}-\d{2}-\d{2}\z") & first.try_cast("date").isNotNull(), first)


def append_logs(rows: DataFrame, folder: str) -> None:
    """Add recommendation log rows, partitioned by day for ``load_logs``; rows that name no day share a partition."""
    logs = with_defaults(rows, TABLES["recommendation_logs"])
    day = log_day(F.col("recommended_at")).alias("day")
    logs.select("*", day).write.mode("append").partitionBy("day").parquet(f"{folder}/recommendation_logs")


def load_logs(spark: SparkSession, folder: str, day: date | None = None) -> DataFrame:
    """Recommendation logs; with ``day``, only that day's partition is read.

    Whatever text a row holds, it comes back; a day's rows are those whose text begins with
    the day. New log rows need the largest id of all days: give ``load_logs(spark, folder)`` as
    ``all_logs`` beside a single day's.
    """
    path, schema = f"{folder}/recommendation_logs", TABLES["recommendation_logs"]
    # A table of no rows has no day.
    if not any(f.startswith("day=") for f in subfolders(spark, path) or []):
        return spark.createDataFrame([], schema)
    # Read as text, a partition of any name is readable.
    logs = spark.read.schema(StructType([*schema, StructField("day", StringType())])).parquet(path)
    if day is not None:
        logs = logs.where(F.col("day") == F.lit(day.isoformat()))
    return with_defaults(logs, TABLES["recommendation_logs"])


def _versions(folder):
    return f"{folder}/card_versions"


def card_version(spark: SparkSession, folder: str, number: int | None = None) -> CardVersion:
    """The current version of the cards with the files appended so far; or an earlier version as it was written."""
    numbers = ledger.entries(spark, _versions(folder))
    wanted = number if number is not None else max(numbers, default=0)
    version = CardVersion()
    if wanted:
        named = ledger.entry(spark, _versions(folder), wanted)
        held = spark.read.schema("path string").parquet(f"{folder}/card_snapshots/{named['snapshot']}/held").collect()
        version = CardVersion(wanted, named["run_id"], named["snapshot"], frozenset(r["path"] for r in held))
    if number is not None:
        return version
    appended = tuple(f for f in _files(spark, f"{folder}/cards") if f not in version.held)
    return CardVersion(version.number, version.run_id, version.snapshot, version.held, appended)


def load_cards(spark: SparkSession, folder: str, version: CardVersion, path_column: str | None = None) -> DataFrame:
    """The cards that ``version`` holds, whatever was written since; of appended files alone also their paths."""
    appended = _read(spark, f"{folder}/cards", "cards", version.appended, path_column)
    if version.snapshot is None:
        return appended
    base = spark.read.schema(TABLES["cards"]).parquet(f"{folder}/card_snapshots/{version.snapshot}/cards")
    return base.unionByName(appended) if version.appended else base


def write_snapshot(cards: DataFrame, folder: str, run_id: str, read: CardVersion) -> CardVersion:
    """``cards``, made of what ``read`` holds, as the cards from now on; gives the new version.

    Files appended since the read stay beside it. Raises SnapshotConflict if another version was
    published since: read again and make the cards anew. A run that is tried again with the
    same ``read`` after it had been published changes nothing.
    """
    spark = cards.sparkSession
    _check(spark, folder, run_id, read)
    name = uuid.uuid4().hex
    place = f"{folder}/card_snapshots/{name}"
    with_defaults(cards, TABLES["cards"], CARD_DEFAULTS).write.parquet(f"{place}/cards")
    held = sorted({*read.held, *read.appended})
    spark.createDataFrame([(f,) for f in held], "path string").coalesce(1).write.parquet(f"{place}/held")
    done = _check(spark, folder, run_id, read)
    if done is not None:
        return done
    if not ledger.create_entry(spark, _versions(folder), read.number + 1, {"run_id": run_id, "snapshot": name, "read": read.number}):
        raise SnapshotConflict(f"run {run_id} read version {read.number}, another run has published the next one")
    return CardVersion(read.number + 1, run_id, name, frozenset(held))


def _check(spark, folder, run_id, read):
    """The version that this run published from ``read`` before, None if there is nothing newer than ``read``."""
    newest = max(ledger.entries(spark, _versions(folder)), default=0)
    if newest == read.number:
        return None
    after = card_version(spark, folder, read.number + 1) if newest > read.number else CardVersion()
    if after.run_id != run_id:
        raise SnapshotConflict(f"run {run_id} read version {read.number}, the cards are at version {newest}")
    return after


def current_snapshot(spark: SparkSession, folder: str) -> str | None:
    """The run that wrote the current version, None before the first."""
    return card_version(spark, folder).run_id


def load_snapshot(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The cards as run ``run_id`` left them; the last time, if it wrote several versions."""
    for number in reversed(ledger.entries(spark, _versions(folder))):
        version = card_version(spark, folder, number)
        if version.run_id == run_id:
            return load_cards(spark, folder, version)
    raise ValueError(f"no snapshot of run {run_id}")
