"""A training-data pipeline over ``documents``: language, near-duplicates, benchmark passages, secrets, tokens.

Every stage is a function of (spark, docs, sf_dir) whose result is written and read again as
the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.llm import byte_bpe, decontamination, language_id, minhash_dedup, secret_scan
from recallspark.llm.common import ROW, stored
from recallspark.operators.sizing import small_side

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# No stage but the second can be said in SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing ``lang`` becomes the recognised one.

    Texts without a letter go, and texts without ``lang`` whose language cannot be told from
    another's. The model learns from the documents that have a language; if none has, nothing
    can be recognised, and nothing is rejected.
    """
    model = language_id.train(docs)
    if model is None:
        return docs
    lang = F.col(f"{ROW}.lang")
    found = language_id.identify(docs, model, whole=True).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (lang.isNotNull() | ~F.col("ambiguous")))
    return _rows(found, docs, lang=F.coalesce(lang, F.col("lang_pred")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id, a null one last, then by a hash of the text.

    Rows are numbered, so that null and repeated ids are rows like others, and carried whole,
    so that a column of any name comes out as it went in. Texts without words are in no group.
    """
    first_of = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(first_of.alias("place"), F.monotonically_increasing_id().alias("number"), whole.alias(ROW)))
    found = minhash_dedup.near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col(f"{ROW}.text").alias("text")))
    groups = stored(found.select(F.col("doc_id").alias("number"), "component_id")
                    .join(rows.select("number", F.struct("place", "number").alias("place")), "number"))
    first = groups.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = stored(groups.join(small_side(stored(first)), "component_id").where("place != first").select("number"))
    return _rows(rows.join(small_side(gone), "number", "left_anti"), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows(decontamination.find_leaks(docs, benchmark, whole=True).where(~F.col("contaminated")), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in the text replaced by a mark; n_chars follows the text."""
    found = secret_scan.find_secrets(docs, secret_scan.train(docs), redact=True, whole=True)
    more = {"n_chars": F.coalesce(F.length("redacted").cast(docs.schema["n_chars"].dataType), F.col(f"{ROW}.n_chars"))} if "n_chars" in docs.columns else {}
    return _rows(found, docs, text=F.col("redacted"), **more)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    found = byte_bpe.encode_documents(
        docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True, whole=True)
    return found.select("doc_id", f"{ROW}.lang", f"{ROW}.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _rows(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The rows that ``found`` carries, with the columns of ``docs``, some of them changed."""
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` after all stages, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
