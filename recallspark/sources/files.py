"""Uploaded files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Extensions that may be uploaded.
UPLOAD_TYPES = ("pdf", "md", "markdown")


def read_files(spark: SparkSession, path: str, mime_types: DataFrame | None = None,
               types: tuple[str, ...] | None = UPLOAD_TYPES) -> DataFrame:
    """(doc_id, path, file_name, mime_type, content) for every file under ``path`` of one of the ``types``.

    ``doc_id`` is a hash of the whole path: the same file has the same id in every run.
    ``types`` are extensions, in either case; None takes every file. ``mime_types``
    (path, mime_type) adds what the uploader declared, if known.
    """
    files = as_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), types)
    return files if mime_types is None else files.drop("mime_type").join(
        mime_types.select("path", "mime_type").dropDuplicates(["path"]), "path", "left").select(files.columns)


def as_uploads(found: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    """(doc_id, path, file_name, mime_type, content) of read files of one of the ``types``."""
    if types is not None:
        found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*types))
    return found.select(
        F.xxhash64("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.lit(None).cast("string").alias("mime_type"), "content")
