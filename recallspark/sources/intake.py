"""Files taken in as they are dropped into a folder, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sizing import small_side
from ..session import settled, subfolders
from .files import UPLOAD_TYPES, as_uploads

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
TAKEN = "doc_id long, path string, file_name string, mime_type string, content binary, content_key string"


def file_stream(spark: SparkSession, path: str, types: tuple[str, ...] | None = UPLOAD_TYPES, **options) -> DataFrame:
    """The files under ``path``, as (doc_id, path, file_name, mime_type, content, content_key), as they come.

    ``content_key`` is the SHA-256 of the bytes. ``options`` are those of a file stream, such as
    maxFilesPerTrigger or pathGlobFilter.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    return as_uploads(reader.options(**options).load(path), types).withColumn("content_key", F.sha2("content", 256))


def take_in(files: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write files whose content has not come before to ``out``, a folder per micro-batch.

    Of equal contents in one batch the smallest path is taken. Which contents have come is
    looked up in the batches before, of which only the keys are read and only those that the
    new batch has move. A replayed batch replaces its own folder and looks at those before it
    only, so it writes the same again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = settled(batch.groupBy("content_key").agg(F.min("path").alias("path")))
        before = _taken(spark, out, batch_id)
        if before is not None:
            seen = before.select("content_key").join(small_side(keys.select("content_key")), "content_key", "left_semi").distinct()
            keys = keys.join(seen, "content_key", "left_anti")
        batch.join(small_side(keys), ["content_key", "path"], "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start()


def _taken(spark, out, before=None):
    numbers = sorted(int(f.removeprefix("batch=")) for f in subfolders(spark, out) or [] if f.startswith("batch="))
    paths = [f"{out}/batch={n}" for n in numbers if before is None or n < before]
    return spark.read.schema(TAKEN).parquet(*paths) if paths else None


def taken_in(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """The files taken in so far, or by one micro-batch, with the columns of ``file_stream``."""
    if batch is not None:
        return spark.read.schema(TAKEN).parquet(f"{out}/batch={batch}")
    found = _taken(spark, out)
    return spark.createDataFrame([], TAKEN) if found is None else found
