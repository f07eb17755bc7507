"""Chunks that never cross a page: recursive splitting and overlapping merging of prose, rows of tables packed into parts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.hashing import chunk_id, table_chunk_id
from folioscope.operators import tables

# Separators from coarse to fine (after them, single characters), the defaults, and the longest line that is a label.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SIZE, OVERLAP, UNIT, LABEL = 448, 64, "tokens", 120
#: What counts as a token where sizes are in tokens: a stand-in for a model's own tokenizer, which any function of the same shape replaces.
_TOKEN = re.compile(r"\w+|[^\w\s]")

Measure = Callable[[int, int], int]


def token_starts(text: str) -> list[int]:
    return [m.start() for m in _TOKEN.finditer(text)]


def measure(text: str, unit: str, starts: Callable[[str], list[int]] = token_starts) -> Measure:
    """Length of ``text[a:b]``: characters, or tokens that start in it."""
    if unit == "chars":
        return lambda a, b: b - a
    if unit != "tokens":
        raise ValueError(f"unit must be chars or tokens, not {unit!r}")
    at = starts(text)
    return lambda a, b: bisect_left(at, b) - bisect_left(at, a)


def pieces(text: str, size: int, length: Measure) -> Iterator[tuple[int, int]]:
    """Spans that tile the text, none longer than ``size`` unless it is one character.

    A stack holds what is still to be cut and the finest separator used on it; a span is cut at every
    occurrence of the next separator that it has, which stays at the tail of the piece before it.
    """
    todo = [(0, len(text), 0)]
    first = True
    while todo:
        a, b, level = todo.pop()
        if not first and length(a, b) <= size:
            yield a, b
            continue
        first = False
        level = next((i for i in range(level, len(SEPARATORS)) if text.find(SEPARATORS[i], a, b) >= 0), len(SEPARATORS))
        if level == len(SEPARATORS):
            yield from ((i, i + 1) for i in range(a, b))
            continue
        cuts, sep, at = [a], SEPARATORS[level], text.find(SEPARATORS[level], a, b)
        while at >= 0:
            cuts.append(at + len(sep))
            at = text.find(sep, cuts[-1], b)
        if cuts[-1] != b:
            cuts.append(b)
        todo += [(x, y, level + 1) for x, y in reversed([*pairwise(cuts)])]


def spans(text: str | None, size: int = SIZE, overlap: int = OVERLAP, unit: str = UNIT) -> list[tuple[int, int]]:
    """Chunks of one page as (start, end), in order; none for a null or blank page.

    Pieces are packed until the next would pass ``size``; then a tail of at most ``overlap`` goes
    into the next chunk, to which that piece is added without a further look, so a chunk may reach ``size + overlap``, and two
    chunks may start at the same place if the first is no longer than the overlap.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    if text is None or not text.strip():
        return []
    length, out = measure(text, unit), []
    tile = [*pieces(text, size, length)]
    sizes = [length(a, b) for a, b in tile]
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > size:
            out.append((tile[begin][0], tile[i - 1][1]))
            while begin < i and held > overlap:
                held -= sizes[begin]
                begin += 1
        held += n
    out.append((tile[begin][0], tile[-1][1]))
    return out


def span_column(text: Column, size: int = SIZE, overlap: int = OVERLAP, unit: str = UNIT) -> Column:
    """``spans`` of a column as ``array<struct<start:int,end:int>>``."""
    spans("", size, overlap, unit)
    measure("", unit)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t, size, overlap, unit)])

    return cut.asNondeterministic()(text)  # or exploding the result would make the plan cut a text twice


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, unit: str = UNIT) -> DataFrame:
    """``doc_id, page_num, ...`` with ``chunk_id, start, end, text`` for each chunk of each page; blank pages give none.

    Further columns of ``pages`` are kept. Ids hash document, page and start, so two chunks with one
    start share an id; ``folioscope.operators.caches.last_wins`` keeps the later, as an index does.
    """
    rest = [c for c in pages.columns if c not in ("doc_id", "page_num", "text")]
    cut = pages.where(F.col("text").rlike(r"\S")).withColumn("_all", span_column(F.col("text"), size, overlap, unit)).withColumn("_s", F.explode("_all"))
    start, end = F.col("_s.start"), F.col("_s.end")
    return cut.select("doc_id", "page_num", *rest, chunk_id(F.col("doc_id"), F.col("page_num"), start).alias("chunk_id"), start.alias("start"), end.alias("end"), F.substring(F.col("text"), start + 1, end - start).alias("text"))


def pages_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, page_num, text``: the lines of a document as its pages, from 1, blank ones kept; a null text has none."""
    return documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_num"), "text")


# --- pages made of layout elements -----------------------------------------------------------------


def element_type(label: Column) -> Column:
    """heading, list, table, text or other, of a layout label."""
    return (
        F.when(label.isin("title", "section_header"), "heading")
        .when(label == "list_item", "list")
        .when(label == "table", "table")
        .when(label.isin("text", "paragraph", "caption", "footnote", "code", "formula"), "text")
        .otherwise("other")
    )


def pack_rows(base: str, rows: list[str], size: int, unit: str) -> list[str]:
    """Rows under a base that every part repeats, as many in a part as fit; a row that doesn't fit alone is a part of its own."""
    out, part = [], ""
    for row in rows:
        longer = f"{part}\n{row}" if part else f"{base}\n{row}" if base else row
        if part and measure(longer, unit)(0, len(longer)) > size:
            out.append(part)
            longer = f"{base}\n{row}" if base else row
        part = longer
    return [*out, part] if rows else out


def table_parts(prefix: str, header: list[str], rows: list[str], plain: str, size: int, overlap: int, unit: str) -> list[str]:
    """Texts of one table: whole if it fits, else rows packed under prefix and header; a part still too long is cut like prose."""
    base = "\n".join(x for x in [prefix, *header] if x)
    if not header and not rows:
        whole = "\n".join(x for x in (prefix, plain.strip()) if x)
        made = [whole] if whole else []
    else:
        whole = "\n".join(x for x in [base, *rows] if x)
        made = [whole] if not rows or measure(whole, unit)(0, len(whole)) <= size else pack_rows(base, rows, size, unit)
    out = []
    for part in made:
        long = measure(part, unit)(0, len(part)) > size
        out += ([part[a:b] for a, b in spans(part, size, overlap, unit)] if long else []) or [part]
    return out


def chunk_elements(elements: DataFrame, mode: str = "flat", size: int = SIZE, overlap: int = OVERLAP, unit: str = UNIT) -> DataFrame:
    """``doc_id, page_num, chunk_id, text`` of pages given as layout elements.

    ``elements`` has ``doc_id, element_index, page_num, element_type, text, table``; elements without a page are left out.
    ``flat`` renders tables as plain text among the prose. ``markdown`` and ``linearized`` make each table chunks of its own,
    under its caption and the nearest heading or short line before it on the page, beside the chunks of the prose.
    """
    if mode not in ("flat", "markdown", "linearized"):
        raise ValueError(f"unknown table mode {mode!r}")
    placed = elements.where(F.col("page_num").isNotNull()).withColumn("element_index", F.coalesce("element_index", F.lit(0)))
    is_table = F.coalesce(F.col("element_type") == "table", F.lit(False))
    strip = lambda c: tables.strip(F.coalesce(c, F.lit("")))
    prose = strip(F.when(is_table, tables.flat(F.col("table"))).otherwise(F.col("text"))) if mode == "flat" else strip(F.col("text"))
    lines = placed if mode == "flat" else placed.where(~is_table)
    listed = lines.select("doc_id", "page_num", F.struct("element_index", prose.alias("t")).alias("e")).where("e.t <> ''")
    # one page's elements are what is collected
    joined = listed.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), "\n\n").alias("text"))
    chunks = chunk_pages(joined, size, overlap, unit).select("doc_id", "page_num", "chunk_id", "text")
    if mode == "flat":
        return chunks
    label = (F.col("element_type") == "heading") | ((F.col("element_type") == "text") & (F.length(strip(F.col("text"))) <= LABEL) & ~strip(F.col("text")).contains("\n"))
    before = Window.partitionBy("doc_id", "page_num").orderBy("element_index").rowsBetween(Window.unboundedPreceding, -1)
    context = F.last(F.when(label & (strip(F.col("text")) != "") & ~is_table, strip(F.col("text"))), ignorenulls=True).over(before)
    seen = placed.withColumn("_context", context).where(is_table)
    prefix = F.array_join(F.array_distinct(F.filter(F.array(strip(F.col("table.caption")), F.coalesce("_context", F.lit(""))), lambda x: x != "")), "\n")
    header, rows = tables.markdown(F.col("table")) if mode == "markdown" else (F.array().cast("array<string>"), tables.linearized(F.col("table")))

    listed = seen.select("doc_id", "page_num", "element_index", prefix.alias("prefix"), header.alias("header"), rows.alias("rows"), F.coalesce("text", F.lit("")).alias("plain"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(*at, i, text) for *at, p, h, r, t in pdf.itertuples(index=False) for i, text in enumerate(table_parts(p or "", [*h], [*r], t, size, overlap, unit))]
            yield pd.DataFrame(made, columns=["doc_id", "page_num", "element_index", "part", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in elements.schema}
    made = listed.mapInPandas(parts, f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, element_index {kinds['element_index']}, part int, text string")
    own = made.select("doc_id", "page_num", table_chunk_id(F.col("doc_id"), F.col("page_num"), F.col("element_index"), F.col("part")).alias("chunk_id"), "text")
    return chunks.unionByName(own)
