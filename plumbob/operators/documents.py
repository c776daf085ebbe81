"""Document quality from extracted pages, and extracted-table cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.functions.columns import strip, word_count

MIN_CHARS = 50


def classify_pages(
    pages: DataFrame,
    min_chars: int = MIN_CHARS,
    ocr_enabled: bool = True,
    only_pages: Sequence[int] | None = None,
) -> DataFrame:
    """Per page: native or scanned, the effective text, and whether OCR was used.

    ``pages`` has ``doc_id, page_number, text`` and optionally ``ocr_text``. A
    page is native when its stripped text has ``min_chars`` characters. Page
    numbers that a document does not have select nothing.
    """
    if only_pages:
        pages = pages.where(F.col("page_number").isin(list(only_pages)))
    raw = F.coalesce("text", F.lit(""))
    native = F.length(strip(raw)) >= min_chars
    ocr = F.nullif(F.col("ocr_text"), F.lit("")) if ocr_enabled and "ocr_text" in pages.columns else F.lit(None)
    return pages.select(
        "doc_id",
        "page_number",
        F.when(native, "native").otherwise("scanned").alias("page_type"),
        F.when(native, raw).otherwise(F.coalesce(ocr, raw)).alias("text"),
        (~native & F.lit(ocr_enabled)).alias("is_ocr"),
    )


def profile_documents(classified: DataFrame) -> DataFrame:
    """One row per document; only counts are shuffled, not texts."""
    scanned = F.count_if(F.col("page_type") == "scanned")
    pages = F.count(F.lit(1))
    return (
        classified.select("doc_id", "page_type", "is_ocr", F.length("text").alias("chars"), word_count(F.col("text")).alias("words"))
        .groupBy("doc_id")
        .agg(
            F.when(scanned == 0, "native").when(scanned == pages, "scanned").otherwise("mixed").alias("doc_type"),
            pages.alias("page_count"),
            F.sum("chars").alias("total_chars"),
            F.sum("words").alias("word_count"),
            F.count_if(F.col("is_ocr")).alias("ocr_page_count"),
        )
    )


def table_cells(tables: DataFrame) -> DataFrame:
    """Cells of extracted tables as ``(doc_id, page_number, table_no, row_no, column_no, header, value)``.

    ``tables`` has ``doc_id, page_number, table_no, rows`` with rows an array of
    arrays of text. The first row is the header; an empty header is named
    ``col_{i}``; tables without a second row are dropped.
    """
    header = F.transform(
        F.element_at("rows", 1),
        lambda h, i: F.coalesce(F.nullif(h, F.lit("")), F.concat(F.lit("col_"), i.cast("string"))),
    )
    return (
        tables.where(F.size("rows") >= 2)
        .select(
            "doc_id",
            "page_number",
            "table_no",
            header.alias("headers"),
            F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row_no", "cells"),
        )
        .select("doc_id", "page_number", "table_no", "headers", "row_no", F.posexplode("cells").alias("column_no", "value"))
        .select(
            "doc_id",
            "page_number",
            "table_no",
            "row_no",
            "column_no",
            F.coalesce(F.get("headers", F.col("column_no")), F.concat(F.lit("col_"), F.col("column_no").cast("string"))).alias("header"),
            "value",
        )
    )
