"""Layout elements: records from what a parser gives, text of pages with their tables, counts by type and span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import tables
from folioscope.operators.chunking import element_type


def records(raw: DataFrame) -> DataFrame:
    """``doc_id, element_index, page_num, pages, multi_page, element_type, docling_label, text`` from ``doc_id, element_index, label, text, provenance``.

    ``provenance`` is the array of pages that a parser saw the element on, in any order and repeated; nulls are left out. The first page is where
    the element counts in chunking; one without a page has a null one.
    """
    pages = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("provenance", F.array().cast("array<int>")))))
    listed = raw.withColumn("pages", pages)
    return listed.select("doc_id", "element_index", F.get("pages", F.lit(0)).alias("page_num"), "pages", (F.size("pages") > 1).alias("multi_page"), element_type(F.col("label")).alias("element_type"), F.col("label").alias("docling_label"), F.coalesce("text", F.lit("")).alias("text"))


def grid_span(span: Column, start: Column, end: Column) -> Column:
    """Rows or columns that a cell covers: as given, else from its offsets, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(span, end - start, F.lit(1)))


def page_flat_texts(elements: DataFrame) -> DataFrame:
    """``doc_id, page_num, text``: each page's elements in order, tables as flat text, a line feed between; an element counts on every page it spans, empty ones give nothing."""
    own = F.when(F.col("element_type") == "table", F.coalesce(tables.flat(F.col("table")), F.col("text"))).otherwise(F.col("text"))
    each = elements.select("doc_id", "element_index", F.coalesce(own, F.lit("")).alias("text"), F.explode(F.coalesce("pages", F.array("page_num"))).alias("page_num")).where("page_num IS NOT NULL AND text <> ''")
    listed = each.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("element_index", "text"))).alias("_e"))  # of one page
    return listed.select("doc_id", "page_num", F.array_join(F.transform("_e", lambda e: e["text"]), "\n").alias("text"))


def span_counts(elements: DataFrame) -> DataFrame:
    """``element_type, spans, elements``: how many elements of each type lie on so many pages."""
    return elements.groupBy("element_type", F.size("pages").alias("spans")).agg(F.count("*").alias("elements"))
