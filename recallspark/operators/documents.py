"""Uploaded files to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import decode_utf8, document_kind


def route_documents(files: DataFrame) -> DataFrame:
    """``files`` with how each is to be read: ``pdf`` or ``text``."""
    return files.withColumn("kind", document_kind(F.col("file_name"), F.col("mime_type")))


def decode_documents(files: DataFrame) -> DataFrame:
    """``files`` with their bytes read as UTF-8 text, undecodable bytes left out."""
    return files.withColumn("text", decode_utf8(F.col("content"))).drop("content")


def pages_to_text(pages: DataFrame) -> DataFrame:
    """One text per document: its pages in order, a newline after each."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(
        F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit("\n")).alias("text")
    )
