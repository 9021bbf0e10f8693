"""Table schemas, and filling in columns that older data lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

SUBJECTS = StructType([
    StructField("id", LongType()),
    StructField("name", StringType()),
    StructField("difficulty", DoubleType()),
    StructField("credits", DoubleType()),
    StructField("ddl", StringType()),
])

CARDS = StructType([
    StructField("id", LongType()),
    StructField("subject_id", LongType()),
    StructField("question", StringType()),
    StructField("answer", StringType()),
    StructField("created_at", StringType()),
    StructField("last_reviewed_at", StringType()),
    StructField("review_count", LongType()),
    StructField("mastery_level", IntegerType()),
    StructField("ignored", IntegerType()),
])

IMPORTED_FILES = StructType([
    StructField("id", LongType()),
    StructField("subject_id", LongType()),
    StructField("file_name", StringType()),
    StructField("imported_at", StringType()),
])

RECOMMENDATION_LOGS = StructType([
    StructField("id", LongType()),
    StructField("card_id", LongType()),
    StructField("recommended_at", StringType()),
])

TABLES = {
    "subjects": SUBJECTS,
    "cards": CARDS,
    "imported_files": IMPORTED_FILES,
    "recommendation_logs": RECOMMENDATION_LOGS,
}

# Values for rows written before the column existed; others become NULL.
CARD_DEFAULTS = {"review_count": 0, "mastery_level": 0, "ignored": 0}


def with_defaults(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; absent ones get their default.

    A column that is there keeps its values, NULLs included.
    """
    defaults = defaults or {}
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema
    ])
