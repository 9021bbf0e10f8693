"""Uploaded files to cards, in two model steps or none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..operators.cloze import cloze_cards
from ..operators.documents import decode_documents, pages_to_text, route_documents
from ..operators.imports import card_counts, import_report, new_cards, new_cards_from_rows, new_import_rows
from ..operators.prompts import (
    Model, card_prompts, complete, complete_kept, completion_cards, completion_points, document_points, point_prompts,
)
from ..session import written
from ..sources.ledger import id_count, reserve_ids


@dataclass(frozen=True)
class DocumentImport:
    card_rows: DataFrame
    import_rows: DataFrame
    report: DataFrame


def document_texts(files: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """``files`` with their text: PDFs from their extracted pages ('' without any), all others from their bytes."""
    routed = route_documents(files)
    plain = decode_documents(routed.where(F.col("kind") == "text"))
    pdf = routed.where(F.col("kind") == "pdf").drop("content").join(pages_to_text(pdf_pages), "doc_id", "left")
    return plain.unionByName(pdf.withColumn("text", F.coalesce("text", F.lit(""))))


def extracted_pairs(documents: DataFrame, open_model: Callable[[], Model], answers: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, pairs) from the two model steps, and (doc_id, errors) of the calls that failed.

    Each step's answers are written before they are read on: model calls are costly
    and may not repeat, so neither a lost executor nor a second use may ask again. In the
    folder ``answers`` they outlive the application.
    """
    ask = complete if answers is None else partial(complete_kept, store=answers)
    first = written(ask(point_prompts(documents), open_model))
    second = written(ask(card_prompts(document_points(completion_points(first))), open_model))
    failed = first.select("doc_id", F.lit(1).alias("step"), "part", "error").unionAll(
        second.select("doc_id", F.lit(2), "part", "error")).where(F.col("error").isNotNull())
    errors = failed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("step", "part", "error"))).alias("errors"))
    # The answers are parsed once: numbering the cards reads the pairs twice.
    return written(completion_cards(second)), errors


def import_documents(documents: DataFrame, cards: DataFrame, imported_files: DataFrame, as_of: datetime,
                     open_model: Callable[[], Model] | None = None, answers: str | None = None,
                     reserve_in: str | None = None) -> DocumentImport:
    """Rows to append for (doc_id, subject_id, file_name, text). Without a model, cloze cards are made.

    With ``answers`` the model's answers are kept in that folder and looked up first. With
    ``reserve_in``, the folder of the tables, the ids of the new rows are reserved there, so that
    imports planned at the same time do not take the same ones. A document gives all its cards and its import row, or neither: both come from one
    written result.
    """
    owners = documents.select("doc_id", "subject_id", "file_name")
    errors = None
    if open_model is None:
        made = written(cloze_cards(documents.select("doc_id", "text")))
        card_rows = new_cards_from_rows(made.join(owners, "doc_id"), cards, as_of, _reserved(cards, reserve_in, "cards", made))
        counts = made.groupBy("doc_id").agg(F.count("*").alias("card_count"))
    else:
        pairs, errors = extracted_pairs(documents, open_model, answers)
        card_rows = new_cards(pairs.join(owners, "doc_id"), cards, as_of, _reserved(cards, reserve_in, "cards", pairs, F.size("pairs")))
        counts = card_counts(pairs)
    gave = counts.where(F.col("card_count") > 0)
    return DocumentImport(
        card_rows=card_rows,
        import_rows=new_import_rows(
            owners.join(gave, "doc_id"), imported_files, as_of, _reserved(imported_files, reserve_in, "imported_files", gave)),
        report=import_report(documents, counts, errors),
    )


def _reserved(table, folder, name, rows, ids_per_row=1):
    return None if folder is None else reserve_ids(table, folder, name, id_count(rows, ids_per_row))


def import_files(files: DataFrame, pdf_pages: DataFrame, cards: DataFrame, imported_files: DataFrame, as_of: datetime,
                 open_model: Callable[[], Model] | None = None, answers: str | None = None, reserve_in: str | None = None) -> DocumentImport:
    """Rows to append for uploaded files (doc_id, subject_id, file_name, mime_type, content) and the pages of the PDFs."""
    return import_documents(document_texts(files, pdf_pages), cards, imported_files, as_of, open_model, answers, reserve_in)
