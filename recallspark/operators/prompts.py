"""Prompts for the two model steps, and running a user-supplied model over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.completions import resolved_pairs, resolved_points
from ..session import subfolders, written
from ..settings import PROMPT_CHARS

POINTS_INSTRUCTION = (
    "Turn the study text into separate statements, each one complete and clear. "
    'Answer with one JSON object: {"points": ["statement", ...]}.'
)
POINTS_REQUEST = "Study text:\n\n"
PAIRS_INSTRUCTION = (
    "Make fill-in-the-blank questions from the numbered statements. Replace only the part worth "
    'memorising by ____. Answer with one JSON object: {"knowledge_points": [{"q": "statement with ____", '
    '"a": "removed part"}, ...]}.'
)
PAIRS_REQUEST = "Statements:\n\n"


def point_prompts(documents: DataFrame, max_chars: int = PROMPT_CHARS) -> DataFrame:
    """Step one: the whole text, in pieces of at most ``max_chars`` characters, numbered from 0.

    A text without characters, or NULL, is one empty piece.
    """
    # Possessive: matching goes on without a stack, whatever characters the text has.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{max_chars}}}+"), 0)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    return documents.select("doc_id", F.posexplode(pieces).alias("part", "piece")).select(
        "doc_id", "part",
        F.lit(POINTS_INSTRUCTION).alias("system"),
        F.concat(F.lit(POINTS_REQUEST), "piece").alias("user"),
    )


def completion_points(completions: DataFrame) -> DataFrame:
    """Statements out of the step-one answers, an empty list for answers that hold none."""
    return completions.select("doc_id", *_part(completions), resolved_points(F.col("raw")).alias("points"))


def _part(df):
    return ["part"] if "part" in df.columns else []


def document_points(points: DataFrame) -> DataFrame:
    """(doc_id, points): the statements of a document's pieces, in the order of the pieces."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "points")))
    return points.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda p: p["points"])).alias("points"))


def numbered_points(points: DataFrame) -> DataFrame:
    """``1. first`` / ``2. second`` ... per document; documents without statements drop out."""
    lines = F.transform("points", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    return points.where(F.size("points") > 0).select("doc_id", F.array_join(lines, "\n").alias("points_text"))


def card_prompts(points: DataFrame) -> DataFrame:
    """Step two, per document with statements."""
    return numbered_points(points).select(
        "doc_id",
        F.lit(0).alias("part"),
        F.lit(PAIRS_INSTRUCTION).alias("system"),
        F.concat(F.lit(PAIRS_REQUEST), "points_text").alias("user"),
    )


def completion_cards(completions: DataFrame) -> DataFrame:
    """Question/answer pairs out of the step-two answers, all or nothing per document."""
    return completions.withColumn("pairs", resolved_pairs(F.col("raw"))).drop("raw", "part", "error")


def cards_json(pairs: DataFrame) -> DataFrame:
    """The pairs of each document that has any, as JSON text."""
    return pairs.where(F.size("pairs") > 0).select("doc_id", F.to_json("pairs").alias("cards_json"))


Model = Callable[[list[dict], bool], str]


def complete(prompts: DataFrame, open_model: Callable[[], Model], concurrency: int = 1) -> DataFrame:
    """Model answers for (doc_id, part, system, user) prompts: (doc_id, part, raw, error).

    ``open_model`` is called once per task and returns ``model(messages, json_mode)``; up to
    ``concurrency`` calls of a task run at a time. A call that fails in JSON mode is tried once
    more without it; a second failure leaves the answer NULL, which later steps read as no
    result, and says why in ``error``.
    """

    def answer(model, system, user):
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        failure = None
        for json_mode in (True, False):
            try:
                return model(messages, json_mode), None
            except Exception as error:
                failure = f"{type(error).__name__}: {error}"
        return None, failure

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        with ThreadPoolExecutor(max_workers=concurrency) as calls:
            for batch in batches:
                answers = list(calls.map(lambda asked: answer(model, *asked), zip(batch["system"], batch["user"])))
                texts = {name: pd.Series([a[i] for a in answers], dtype="object", index=batch.index) for i, name in enumerate(("raw", "error"))}
                yield pd.DataFrame({"doc_id": batch["doc_id"], "part": batch["part"], **texts})

    return prompts.select("doc_id", "part", "system", "user").mapInPandas(run, "doc_id long, part int, raw string, error string")


ANSWERS = "key string, raw string"


def prompt_key() -> Column:
    """What an answer is kept by: a hash of both texts of the prompt."""
    return F.sha2(F.to_json(F.struct("system", "user")), 256)


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """(key, raw) of the answers in a store; one for each key, whatever runs at the same time wrote."""
    if not subfolders(spark, store):
        return spark.createDataFrame([], ANSWERS)
    written = spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(store)
    return written.groupBy("key").agg(F.min("raw").alias("raw"))


def complete_kept(prompts: DataFrame, open_model: Callable[[], Model], store: str, concurrency: int = 1) -> DataFrame:
    """As ``complete``, asking only for what the folder ``store`` does not hold, and keeping every answer there.

    Equal prompts are asked once. Answers outlive the application: a second run over the
    same prompts makes no call, one after failures asks for those alone.
    """
    spark = prompts.sparkSession
    keyed = written(prompts.select("doc_id", "part", "system", "user", prompt_key().alias("key")))
    missing = keyed.select("key", "system", "user").dropDuplicates(["key"]).join(kept_answers(spark, store).select("key"), "key", "left_anti")
    # Numbers stand for the prompts while they are asked; written, so that every use sees the same.
    asked = written(missing.select(F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("part"), "key", "system", "user"))
    answers = written(complete(asked, open_model, concurrency)).join(asked.select("doc_id", "key"), "doc_id")
    # A folder per run: files of a run that broke off are never read as part of another's.
    answers.where(F.col("raw").isNotNull()).select("key", "raw").write.parquet(f"{store}/run={uuid.uuid4().hex}")
    failed = answers.where(F.col("raw").isNull()).select("key", "error")
    return keyed.select("doc_id", "part", "key").join(kept_answers(spark, store), "key", "left").join(failed, "key", "left").select(
        "doc_id", "part", "raw", "error")
