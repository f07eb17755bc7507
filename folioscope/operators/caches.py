"""Keyed tables: the latest of repeated rows, what a cache lacks, metadata joined in, totals of a load."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.guards import require_empty


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by ``order`` (such as the time, descending), which should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id, the latest ingested; at the same time the first by text, company, form and year, nulls last."""
    return last_wins(chunks, ["chunk_id"], [F.col("ingested_at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("text", "company", "form_type", "fiscal_year", "doc_id", "page_num")]])


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key the cache lacks, one for each key."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def through_cache(wanted: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(result, additions): what the cache has for the keys, and ``compute`` of what it lacks; the additions are to be appended to it."""
    added = compute(misses(wanted, cache, key)).select(*cache.columns)
    return cache.join(wanted.select(key).distinct(), key, "left_semi").unionByName(added), added


def form_type(c: Column) -> Column:
    """Form in one spelling: ``10k`` is 10-K, ``10q`` is 10-Q, others in capitals."""
    low = F.lower(c)
    return F.when(low.isin("10k", "10-k"), "10-K").when(low.isin("10q", "10-q"), "10-Q").otherwise(F.upper(c))


def with_metadata(rows: DataFrame, filings: DataFrame, *, strict: bool = True) -> DataFrame:
    """Rows with company, ticker, year and form of their filing, which replace their own; with ``strict`` a filing that is missing raises.

    ``filings`` is unique in ``doc_id``. Where it is small Spark broadcasts it by its size.
    """
    fields = ["company", "ticker", "fiscal_year", "form_type"]
    meta = filings.select("doc_id", "company", "ticker", "fiscal_year", form_type(F.col("form_type")).alias("form_type"))
    bare = rows.drop(*fields)
    if strict:
        require_empty(bare.select("doc_id").distinct().join(meta, "doc_id", "left_anti"), "documents have no metadata")
    return bare.join(meta, "doc_id")


def with_tickers(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the ``ticker`` that ``known`` (``name, ticker``, names trimmed, in lower case and unique) has for their ``company``; a company it lacks raises."""
    named = rows.withColumn("name", F.lower(F.trim("company")))
    require_empty(named.select("name").distinct().join(known, "name", "left_anti"), "companies have no ticker")
    return named.join(known.select("name", "ticker"), "name").drop("name")


def load_totals(chunks: DataFrame) -> DataFrame:
    """One row: documents, pages, chunks, rows ingested again, and chunks per page and rows per chunk at three decimals (0 for an empty table)."""
    seen = chunks.groupBy("chunk_id").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id"), F.min("page_num").alias("page_num"))
    totals = seen.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "page_num").alias("pages"), F.count("*").alias("chunks"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("repeated"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return totals.withColumn("chunks_per_page", ratio("chunks", "pages")).withColumn("repeated_rate", ratio("repeated", "chunks"))
