"""The dashboard's sums kept per stored part of the cards, so that a look reads only what is new.

A snapshot and each appended file is a part that never changes. Its sums are worked out once and
written under ``card_summaries/part=<name>``; the cards of a version are the parts it holds, so
their sums are the sums of the parts. A snapshot replaces the parts before it by one.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dashboard import SUMMARY, card_summary
from ..session import settled, subfolders
from .tables import CardVersion, card_version, load_cards


def part_names(version: CardVersion) -> dict[str, CardVersion]:
    """The stored parts of a version by name, each as a version that holds nothing else."""
    found = {md5(f.encode()).hexdigest(): CardVersion(appended=(f,)) for f in version.appended}
    if version.snapshot is not None:
        found[version.snapshot] = CardVersion(version.number, version.run_id, version.snapshot, version.held)
    return found


def summarise_new(spark: SparkSession, folder: str, version: CardVersion) -> list[str]:
    """Works out and writes the sums of the version's parts that have none; gives their names.

    Appended files are read together and told apart by their paths. Whoever works at the same
    time writes the same rows to the same folders.
    """
    place = f"{folder}/card_summaries"
    known = {f.removeprefix("part=") for f in subfolders(spark, place) or []}
    missing = {name: part for name, part in part_names(version).items() if name not in known}
    appended = {part.appended[0]: name for name, part in missing.items() if part.appended}
    frames = [load_cards(spark, folder, part).withColumn("part", F.lit(name)) for name, part in missing.items() if part.snapshot]
    if appended:
        frames.append(load_cards(spark, folder, CardVersion(appended=tuple(appended)), path_column="_path"))
        names = spark.createDataFrame([(f, n) for f, n in appended.items()], "_file string, part string")
        # A file's place below the folder is the end of its path: its generation and name, or its name.
        short = F.regexp_extract("_path", r"(generation=[^/]*/)?[^/]*$", 0)
        frames[-1] = frames[-1].withColumn("_file", short).join(F.broadcast(names), "_file").drop("_file", "_path")
    if not missing:
        return []
    empty = spark.createDataFrame([(n, None, None, 0, 0, 0, 0) for n in missing], f"part string, {SUMMARY}")
    rows = empty
    for frame in frames:
        rows = rows.unionByName(card_summary(frame, "part").select(*empty.columns))
    # Small: a row per part, subject and day. One file per part.
    settled(rows).repartition("part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(place)
    return sorted(missing)


def stored_summary(spark: SparkSession, folder: str, version: CardVersion | None = None) -> DataFrame:
    """The sums of the cards of a version (now, if none is given), for ``dashboard.totals_of`` and ``progress_of``."""
    version = card_version(spark, folder) if version is None else version
    summarise_new(spark, folder, version)
    paths = [f"{folder}/card_summaries/part={name}" for name in part_names(version)]
    return spark.read.schema(SUMMARY).parquet(*paths) if paths else spark.createDataFrame([], SUMMARY)
