"""New rows for the study tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import as_of_text
from ..schemas import CARDS, IMPORTED_FILES, SUBJECTS
from .ids import last_id, numbered


def _typed(df, schema):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _after(table, after):
    """The id before the first new one: reserved (see ``sources.ledger``), or the table's largest."""
    return last_id(table) if after is None else after


def new_subjects(entries: DataFrame, subjects: DataFrame, key: str, after: int | None = None) -> DataFrame:
    """Rows to append to ``subjects``; entries without a name are refused."""
    named = entries.where(F.col("name") != "")
    return _typed(numbered(named, key, _after(subjects, after)), SUBJECTS)


def _fresh_cards(rows, as_of):
    """Card rows out of (id, subject_id, question, answer): both times ``as_of``, counters 0."""
    now = F.lit(as_of_text(as_of))
    fresh = {"created_at": now, "last_reviewed_at": now}
    fresh.update({name: F.lit(0) for name in ("review_count", "mastery_level", "ignored")})
    return _typed(rows.withColumns(fresh), CARDS)


def new_cards(pairs: DataFrame, cards: DataFrame, as_of: datetime, after: int | None = None) -> DataFrame:
    """Rows to append to ``cards`` from (doc_id, subject_id, pairs).

    Ids are claimed per document before its pairs become rows, so they run on within
    a document. A document without pairs claims none. Imports planned at the same time need
    an ``after`` of their own each.
    """
    first = numbered(pairs, "doc_id", _after(cards, after), F.size("pairs"), into="_first")
    rows = first.select("subject_id", "_first", F.posexplode("pairs").alias("_pos", "_pair")).select(
        (F.col("_first") + F.col("_pos")).alias("id"), "subject_id",
        F.col("_pair.q").alias("question"), F.col("_pair.a").alias("answer"),
    )
    return _fresh_cards(rows, as_of)


def new_cards_from_rows(rows: DataFrame, cards: DataFrame, as_of: datetime, after: int | None = None) -> DataFrame:
    """As ``new_cards``, from one row (doc_id, pos, subject_id, q, a) per card.

    Each row is numbered on its own, so a document of any number of cards is never
    gathered in one place.
    """
    keyed = rows.select(
        F.concat_ws(":", "doc_id", "pos").alias("_key"), "subject_id",
        F.col("q").alias("question"), F.col("a").alias("answer"),
    )
    return _fresh_cards(numbered(keyed, "_key", _after(cards, after)), as_of)


def new_import_rows(documents: DataFrame, imported_files: DataFrame, as_of: datetime, after: int | None = None) -> DataFrame:
    """Rows to append to ``imported_files`` for (doc_id, subject_id, file_name) that gave cards."""
    rows = documents.select("doc_id", "subject_id", "file_name")
    now = F.lit(as_of_text(as_of))
    return _typed(numbered(rows, "doc_id", _after(imported_files, after)).withColumn("imported_at", now), IMPORTED_FILES)


def new_log_rows(queue: DataFrame, logs: DataFrame, as_of: datetime, all_logs: DataFrame | None = None) -> DataFrame:
    """Rows to append to ``recommendation_logs`` for a queue with positions 1..n.

    Ids run on from the largest in ``all_logs``; only if ``logs`` is the whole table may it be left out.
    """
    return queue.select(
        (last_id(logs if all_logs is None else all_logs) + F.col("position")).cast("long").alias("id"),
        F.col("id").alias("card_id"),
        F.lit(as_of_text(as_of)).alias("recommended_at"),
    )


def card_counts(pairs: DataFrame) -> DataFrame:
    """(doc_id, card_count) from (doc_id, pairs)."""
    return pairs.select("doc_id", F.size("pairs").cast("long").alias("card_count"))


def import_report(documents: DataFrame, counts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per document: length of its text, number of cards it gave, with ``errors`` (doc_id, errors) what failed."""
    report = documents.join(counts.select("doc_id", "card_count"), "doc_id", "left")
    return (report if errors is None else report.join(errors, "doc_id", "left")).select(
        "doc_id",
        F.char_length("text").cast("long").alias("text_chars"),
        F.coalesce("card_count", F.lit(0)).alias("card_count"),
        *([] if errors is None else ["errors"]),
    )
