"""Identities: content hashes and digests of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\x00"


def chunk_id(doc: Column, page: Column, offset: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``doc:page:offset``."""
    return F.substring(F.sha2(F.concat_ws(":", doc, page.cast("string"), offset.cast("string")), 256), 1, 16)


def table_chunk_id(doc: Column, page: Column, element: Column, part: Column) -> Column:
    """Like ``chunk_id`` for a part of a table: the offset is ``t{element}:{part}``."""
    return F.substring(F.sha2(F.concat_ws(":", doc, page.cast("string"), F.concat(F.lit("t"), element.cast("string")), part.cast("string")), 256), 1, 16)


def point_id(chunk: Column) -> Column:
    """The chunk id as an unsigned 64-bit number."""
    return F.conv(chunk, 16, 10).cast("decimal(20,0)")


def text_key(revision: str, text: Column) -> Column:
    """Cache key of a text under a model revision: SHA-256 of both with a NUL between; null counts as ''."""
    return F.sha2(F.concat(F.lit(revision + NUL), F.coalesce(text, F.lit(""))), 256)


def joined_key(*parts: Column) -> Column:
    """Cache key of several values: SHA-256 of them with NULs between; nulls count as ''."""
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint(df: DataFrame, *columns: str, name: str = "fingerprint") -> DataFrame:
    """One row: SHA-256 over the sorted values, each ended by NUL, as artifacts from elsewhere have it.

    It needs all values in one place, so it is for word lists and the ids of one filing; for a corpus of any size there is ``content_fingerprint``.
    """
    value = F.concat_ws(NUL, *[F.col(c).cast("string") for c in columns])
    return df.agg(F.sha2(F.coalesce(F.concat(F.array_join(F.array_sort(F.collect_list(value)), NUL), F.lit(NUL)), F.lit("")), 256).alias(name))


def _digest_sum(value: Column, at: int) -> Column:
    """Sum of fifteen hexadecimal digits of each value's SHA-256, from place ``at``."""
    return F.coalesce(F.sum(F.conv(F.substring(F.sha2(value, 256), at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def content_fingerprint(df: DataFrame, *columns: str, name: str = "content_fingerprint") -> DataFrame:
    """One row, ``rows`` and the digest of a table's rows as a multiset, whatever their order and place: parts of every row's SHA-256 added up, hashed with the rows' number.

    Every task adds up its own rows, so nothing is collected. Over ids and texts it changes when a text changes under its id; nulls differ from ''.
    """
    value = F.concat_ws(NUL, *[F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    sums = df.agg(F.count("*").alias("rows"), _digest_sum(value, 1).alias("a"), _digest_sum(value, 31).alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias(name))
