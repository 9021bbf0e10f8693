"""What the operators share: code for the workers, tables on the shared folder, row-wise maps, samples."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import work_dir

# Texts that a Python worker holds at a time: so many rows, or so many bytes.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 4 << 20
# The column that carries whole input rows past a function.
ROW = "_row"


@lru_cache
def _ship(context_id: str) -> None:
    spark = SparkSession.getActiveSession()
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="recallspark-code-")) / "recallspark_llm_code.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for file in sorted((root / "recallspark").rglob("*.py")):
            bundle.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    _ship(spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared work folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/recallspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, start: Callable[[], Callable], result: str) -> DataFrame:
    """One output row per input row: ``start()`` runs once per task and gives the function of a row's values.

    The function returns a tuple as ``result`` says. Rows are read and written in small
    Arrow batches, so neither many nor long texts pile up in a worker. A last column ROW is
    not given to the function but comes out again as it went in.
    """
    schema = schema_of(result)
    arrow = to_arrow_schema(schema)
    whole = df.columns[-1] == ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for part in slices(batch):
                columns = part.columns[:-1] if whole else part.columns
                out = record_batch([function(*values) for values in zip(*(c.to_pylist() for c in columns))], arrow)
                yield out.append_column(ROW, part.columns[-1]) if whole else out

    return df.mapInArrow(run, schema.add(ROW, df.schema[ROW].dataType) if whole else schema)


def record_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``ROWS_AT_ONCE`` rows and about ``BYTES_AT_ONCE`` bytes."""
    rows = batch.num_rows
    step = max(1, min(ROWS_AT_ONCE, rows * BYTES_AT_ONCE // max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def texts(docs: DataFrame, *more: Column, binary: bool = True, whole: bool = False) -> DataFrame:
    """(doc_id, text, ...) of ``docs``; a null text is an empty one. Other columns are not read.

    With ``whole`` a last column ROW holds the whole rows of ``docs``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    more = (*more, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)) if whole else more
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"), *more)


def fold(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def broadcast_object(spark: SparkSession, value):
    """A model of bounded size for all tasks."""
    return spark.sparkContext.broadcast(pickle.dumps(value))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """At most ``per_stratum`` rows of each value of ``stratum``, the same ones in every run.

    Rows are picked by a hash of the columns ``key``, so repeated rows count once. A first pass counts, the second reads only the share needed;
    no stratum is gathered in one task.
    """
    counts = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect() if r[stratum] is not None}
    if not counts:
        return rows.where(F.lit(False)).withColumn("_pick", F.lit(0).cast("long"))
    scale = 1 << 40
    pairs = [F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * 1.5 * (per_stratum + 20) / n)))]
    pick = F.pmod(F.xxhash64(*key), F.lit(scale))
    near = rows.withColumn("_pick", pick).where(F.col("_pick") < F.element_at(F.create_map(*pairs), F.col(stratum)))
    ranked = near.dropDuplicates([stratum, "_pick"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_pick")))
    return ranked.where(F.col("_rank") <= per_stratum).drop("_rank")
