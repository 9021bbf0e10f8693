"""Study tables derived from a star-schema parquet folder.

Deterministic rules turn suppliers into subjects, orders into cards, events into
reviews and recommendation logs, documents into imports and model output. They
serve the registered queries, the tests and the benchmark.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clock import moment_text
from ..functions.grading import GRADE_AGAIN, GRADE_FORGOT, GRADE_IGNORE, GRADE_KNOWN

AS_OF = datetime(2024, 1, 15, 10, 0, 0)
DAY = "DATE'2024-01-15'"
MIDNIGHT = "TIMESTAMP_NTZ'2024-01-15 00:00:00'"

# Stated schemas save a job per read that would only open a file to learn them.
COLUMNS = {
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string",
    "documents": "doc_id long, text string, lang string, source string",
    "conversations": "conv_id long, turn long, text string",
    "customer": "c_custkey long, c_name string, c_nationkey int",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def review_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events file as a stream."""
    return (
        spark.readStream.schema(COLUMNS["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)
    )


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 1 + (s_suppkey % 41) / CAST(10 AS DOUBLE) END AS difficulty",
        "(s_nationkey % 9) * CAST(0.5 AS DOUBLE) AS credits",
        f"""CASE s_suppkey % 20 WHEN 19 THEN NULL WHEN 18 THEN '' WHEN 17 THEN 'TBD'
            ELSE CAST(date_add({DAY}, CAST(s_suppkey % 45 - 10 AS INT)) AS STRING) END AS ddl""",
    )


@lru_cache
def _owning_subjects(spark: SparkSession, folder: str) -> int:
    """How many subjects may own cards: all but the last."""
    return _read(spark, folder, "supplier").count() - 1


def cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    owner = F.when(key % 97 == 0, F.lit(-1)).otherwise(F.col("o_custkey") % _owning_subjects(spark, folder))
    return _read(spark, folder, "orders").select(
        key.alias("id"),
        owner.cast("long").alias("subject_id"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(" is ____")).alias("question"),
        F.col("o_orderpriority").alias("answer"),
        moment_text(F.col("o_orderdate")).alias("created_at"),
        F.expr(f"""CASE o_orderkey % 50 WHEN 49 THEN NULL WHEN 48 THEN 'never' ELSE left(CAST(
            {MIDNIGHT} - make_dt_interval(CAST(o_orderkey % 40 AS INT))
            + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) AS STRING), 19) END""").alias("last_reviewed_at"),
        (key % 7).alias("review_count"),
        F.when(key % 31 != 30, (F.col("o_custkey") + key) % 6).cast("int").alias("mastery_level"),
        F.when((F.col("o_orderstatus") == "P") & (key % 11 == 0), 1)
        .when(F.col("o_orderstatus") == "O", None)
        .otherwise(0).alias("ignored"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews_of(_read(spark, folder, "events"))


def reviews_of(events: DataFrame) -> DataFrame:
    """Review grades from an events table or stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("review_id"),
        F.when(F.col("event_id") % 53 == 0, F.lit(-7)).otherwise(F.col("user_id") * 7 + F.col("event_id") % 10)
        .cast("long").alias("card_id"),
        F.col("ts").cast("timestamp_ntz").alias("reviewed_at"),
        F.when(kind == "purchase", GRADE_KNOWN).when(kind == "click", GRADE_AGAIN)
        .when(kind == "error", GRADE_FORGOT).when(kind == "signup", GRADE_IGNORE)
        .otherwise(9).alias("grade"),
    )


def recommendation_logs(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "events")
        .where((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0))
        .select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("card_id"),
            moment_text(F.col("ts")).alias("recommended_at"),
        )
    )


def imported_files(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % _owning_subjects(spark, folder)).cast("long").alias("subject_id"),
        F.concat("source", F.lit("-"), "lang", F.lit(".md")).alias("file_name"),
        F.lit("2024-01-15 09:00:00").alias("imported_at"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", "text")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploaded files: bytes (every third with two stray ones), name and MIME type."""
    doc = F.col("doc_id")
    content = F.encode("text", "UTF-8")
    stray = F.concat(F.unhex(F.lit("FF")), content, F.unhex(F.lit("C3")))
    name = F.concat("source", F.lit("-"), "lang", F.expr(
        "CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.pdf.txt' END"))
    return _read(spark, folder, "documents").select(
        doc,
        (doc % _owning_subjects(spark, folder)).cast("long").alias("subject_id"),
        name.alias("file_name"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'text/markdown' END").alias("mime_type"),
        F.when(doc % 3 == 0, stray).otherwise(content).alias("content"),
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """Stage-one model output in ten shapes, good and bad, made of the lines of each text."""
    return _read(spark, folder, "documents").withColumn("lines", F.expr("to_json(split(text, '\\n'))")).selectExpr(
        "doc_id", """CASE doc_id % 10
        WHEN 0 THEN concat('```json\\n{"points":', lines, '}\\n```')
        WHEN 1 THEN concat('{"n":1,"zz":', lines, ',"aa":["q"]}')
        WHEN 2 THEN lines
        WHEN 3 THEN text
        WHEN 4 THEN concat('{"points":"[x","k":', lines, '}')
        WHEN 5 THEN concat('  {"points":[1,2.0,0.25,true,', substring(to_json(array(text)), 2), '}')
        WHEN 6 THEN '```\\n{"points":[]}\\n```'
        WHEN 7 THEN concat('{"points":{"a":[1]},"b":', lines, '}')
        WHEN 8 THEN concat('{"points":', lines, '} and more')
        END AS raw""")


def pairs_completions(spark: SparkSession, folder: str) -> DataFrame:
    """Stage-two model output in six shapes, made of the lines of each text, with the subject and file it belongs to."""
    raw = F.expr("""CASE doc_id % 6
        WHEN 0 THEN concat('{"knowledge_points":', made, '}')
        WHEN 1 THEN concat('```json\\n{"knowledge_points":', made, '}\\n```')
        WHEN 2 THEN concat('{"knowledge_points":[{"q":', whole, ',"a":"A"},{"q":"no answer"}]}')
        WHEN 3 THEN concat('{"knowledge_points":[{"q":', whole, ',"a":"A"},"bare"]}')
        WHEN 4 THEN '{"knowledge_points":[]}'
        ELSE concat('{"n":2,"cards":[{"q":', whole, ',"a":2.0,"x":1}]}')
        END""")
    made = F.expr("to_json(transform(split(text, '\\n'), x -> named_struct('q', concat('____ ', x), 'a', substring_index(x, ' ', 1))))")
    whole = F.expr("substring(to_json(array(text)), 2, char_length(to_json(array(text))) - 2)")
    texts = _read(spark, folder, "documents").select("doc_id", "text")
    return (
        document_files(spark, folder).select("doc_id", "subject_id", "file_name").join(texts, "doc_id")
        .withColumns({"made": made, "whole": whole}).select("doc_id", "subject_id", "file_name", raw.alias("raw"))
    )


def offered_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects as entered in a form: customers, every tenth without a name."""
    key = F.col("c_custkey")
    return _read(spark, folder, "customer").select(
        key.alias("form_id"),
        F.when(key % 10 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        (1 + (key % 41) / F.lit(10.0)).alias("difficulty"),
        ((F.col("c_nationkey") % 9) * F.lit(0.5)).alias("credits"),
        F.expr(f"date_add({DAY}, CAST(c_custkey % 45 AS INT))").alias("ddl"),
    )
