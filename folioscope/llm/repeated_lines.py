"""Lines repeated across one source's documents: found by heavy-hitter summaries, verified, removed.

A line stands for its key: the hash of its reading form in lower case, with white space collapsed
and every run of digits taken as one sign. Blank lines have no key.
"""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.readingform import reading_form
from folioscope.llm.shared import having, is_small, written

#: Counters of one source's summary, a power of two, and sources whose summaries a task holds at once before it gives the oldest out.
COUNTERS, HELD = 1 << 15, 256
#: A counter stops here; a line is frequent from far less.
FULL = 255

_DIGITS = re.compile(r"\d+")


def line_key(line: str) -> int | None:
    """Signed 64-bit key of a line, None for a blank one."""
    plain = _DIGITS.sub("0", " ".join(reading_form(line).lower().split()))
    return int(np.uint64(xxhash.xxh3_64_intdigest(plain)).astype(np.int64)) if plain else None


def _keys(text: str) -> list[int | None]:
    return [line_key(x) for x in text.split("\n")]


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text in order, null where a line is blank; null for a null text."""

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(_keys, na_action="ignore")

    return keys.asNondeterministic()(text)  # or exploding the result would make the plan key a text twice


def cell(key: Column, counters: int) -> Column:
    """Counter of a key: its lowest bits."""
    return key.bitwiseAND(F.lit(counters - 1)).cast("int")


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(packed)), dtype=np.uint8)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint16) + b, FULL).astype(np.uint8)


def _summaries(counters: int):
    """Summaries of the sources in one task: rows (source, counts).

    A line adds to the counter that its key names, once for each row of ``source, place, keys``, so a counter is never less than
    the number of places of any line that it counts. A summary has the same size whatever its source has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict = OrderedDict()
        columns = ["source", "counts"]
        for pdf in batches:
            out = []
            for source, keys in zip(pdf["source"], pdf["keys"]):
                counts = held.get(source)
                if counts is None:
                    if len(held) >= HELD:
                        out.append((lambda s: (s[0], _packed(s[1])))(held.popitem(last=False)))
                    counts = held[source] = np.zeros(counters, dtype=np.uint8)
                at, n = np.unique(np.asarray(keys, dtype=np.int64) & (counters - 1), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, FULL)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(s, _packed(c)) for s, c in held.items()], columns=columns)

    return run


def _merged(counters: int, at_least: int):
    """Adds the summaries of each source, sorted by it, and gives the counters that reach ``at_least``: rows (source, cell)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(counters, dtype=np.uint8)

        def heavy() -> pd.DataFrame:
            cells = np.flatnonzero(total >= at_least).astype(np.int32)
            return pd.DataFrame({"source": pd.Series([at] * len(cells), dtype=object), "cell": cells})

        for pdf in batches:
            out = []
            for source, counts in zip(pdf["source"], pdf["counts"]):
                if source != at:
                    out.append(heavy())
                    at, total = source, np.zeros(counters, dtype=np.uint8)
                total = _added(total, _unpacked(counts))
            yield pd.concat(out, ignore_index=True) if out else heavy().iloc[:0]
        yield heavy()

    return run


def heavy_cells(keyed: DataFrame, at_least: int, *, counters: int = COUNTERS) -> DataFrame:
    """From ``source, place, keys``: the (source, cell) whose counter reaches ``at_least``, as a written table.

    Every task makes one summary of fixed size for each source it sees; summaries are merged by adding, first
    in parts, so that no task merges all of a source's, then whole. No line that stands on ``at_least`` places is in a
    counter that is missing here; one that stands on fewer may be in one that is not.
    """
    if not 0 < at_least <= FULL or counters & (counters - 1):
        raise ValueError(f"at_least must be 1 to {FULL}, and counters a power of two")
    kind = keyed.schema["source"].dataType.simpleString()
    usable = _placed(keyed).select("source", F.array_distinct(F.array_compact("keys")).alias("keys")).where(F.size("keys") > 0)
    made = usable.mapInPandas(_summaries(counters), f"source {kind}, counts binary").withColumn("part", F.spark_partition_id() % 64)
    parts = made.repartition("source", "part").sortWithinPartitions("source", "part").select("source", "counts")
    once = parts.mapInPandas(_partly(counters), f"source {kind}, counts binary")
    whole = once.repartition("source").sortWithinPartitions("source")
    return written(whole.mapInPandas(_merged(counters, at_least), f"source {kind}, cell int"), "heavy-cells")


def _partly(counters: int):
    """Adds the summaries of each source in a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for pdf in batches:
            out = []
            for source, counts in zip(pdf["source"], pdf["counts"]):
                if total is None or source != at:
                    if total is not None:
                        out.append((at, _packed(total)))
                    at, total = source, _unpacked(counts)
                else:
                    total = _added(total, _unpacked(counts))
            yield pd.DataFrame(out, columns=["source", "counts"])
        yield pd.DataFrame([] if total is None else [(at, _packed(total))], columns=["source", "counts"])

    return run


def _placed(keyed: DataFrame) -> DataFrame:
    return keyed.where(F.col("source").isNotNull() & F.col("place").isNotNull())


def candidates(keyed: DataFrame, at_least: int, *, counters: int = COUNTERS) -> DataFrame:
    """``source, place, key`` of the lines whose counter is heavy, once for each row."""
    heavy = heavy_cells(keyed, at_least, counters=counters)
    lines = _placed(keyed).select("source", "place", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    return having(lines.withColumn("cell", cell(F.col("key"), counters)), heavy, ["source", "cell"]).drop("cell")


def repeated_lines(keyed: DataFrame, at_least: int, *, counters: int = COUNTERS) -> DataFrame:
    """(source, key, places) of the lines on at least ``at_least`` different places of their source.

    ``keyed`` has ``source, place, keys`` and should be a written table, as it is read twice. First
    come the summaries, then exact counts of the lines in heavy counters alone; other lines never leave their
    task. A source so rich that all its counters are heavy has every line counted. Rows without source or place do not count.
    """
    exact = candidates(keyed, at_least, counters=counters).distinct().groupBy("source", "key").agg(F.count("*").alias("places"))
    return exact.where(F.col("places") >= at_least)


def keyed_rows(df: DataFrame, key: str, source: str, place: str, text: str) -> DataFrame:
    """``key, source, place, keys`` as a written table; a null text has no lines, further columns are ignored."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key_of_row"), F.col(source).alias("source"), F.col(place).alias("place"), line_keys(F.col(text)).alias("keys"))
    return written(rows, "line-keys")


def found_lines(keyed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``key_of_row, line_no`` of every confirmed line, once also where rows are repeated."""
    lines = keyed.select("key_of_row", "source", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    return having(lines, confirmed.select("source", "key"), ["source", "key"]).select("key_of_row", (F.col("at") + 1).alias("line_no")).distinct()


def without_lines(df: DataFrame, confirmed: DataFrame, source: str, text: str, *, text_as: str = "clean_text", removed_as: str = "lines_removed") -> DataFrame:
    """``df`` with the text without its source's confirmed lines, and how many were removed.

    Every row stays, repeated ones too; a text with nothing left becomes '', a null one stays null
    with 0 lines removed, and a row without a source keeps all lines. ``confirmed`` is a written table. While it is small
    (``is_small``) the sets of all sources are broadcast and lines are keyed and dropped in one pass. Beyond that the positions to drop are found
    by a join on source and key, once for each different text of a source, and joined to the rows.
    """
    sets = confirmed.select("source", "key")
    if is_small(sets):
        known: dict[object, set[int]] = {}
        for r in sets.collect():
            known.setdefault(r["source"], set()).add(r["key"])
        shared = df.sparkSession.sparkContext.broadcast(known)

        @F.pandas_udf("clean string, removed int")
        def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            none: set[int] = set()
            for sources, texts in batches:
                out = []
                for s, t in zip(sources, texts):
                    drop = shared.value.get(s, none) if s is not None and t is not None else none
                    lines = t.split("\n") if drop else []
                    kept = [x for x in lines if line_key(x) not in drop]
                    out.append(("\n".join(kept), len(lines) - len(kept)) if drop else (t, 0))
                yield pd.DataFrame(out, columns=["clean", "removed"])

        done = df.withColumn("_clean", cleaned(F.col(source), F.col(text)))
        return done.select(*[df[c] for c in df.columns], F.col("_clean.clean").alias(text_as), F.col("_clean.removed").alias(removed_as))
    identity = [F.xxhash64(F.lit(seed), F.col(text)).alias(name) for seed, name in enumerate(("_text_a", "_text_b"))]
    rows = df.select("*", *identity)
    texts = rows.where(F.col(source).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(source).alias("_source"), "_text_a", "_text_b").agg(F.first(text).alias("_text"))
    lines = texts.select("_source", "_text_a", "_text_b", F.posexplode(line_keys(F.col("_text"))).alias("_at", "_key")).where("_key IS NOT NULL")
    dropped = lines.join(sets.select(F.col("source").alias("_source"), F.col("key").alias("_key")), ["_source", "_key"], "left_semi")
    positions = dropped.groupBy("_source", "_text_a", "_text_b").agg(F.collect_set("_at").alias("_drop"))  # of one text's lines
    named = positions.withColumnsRenamed({"_text_a": "_a", "_text_b": "_b"})
    joined = rows.join(named, (rows[source] == named["_source"]) & (rows["_text_a"] == named["_a"]) & (rows["_text_b"] == named["_b"]), "left")
    kept = F.filter(F.split(df[text], "\n", -1), lambda _, i: ~F.array_contains("_drop", i))
    clean = F.when(F.col("_drop").isNull(), df[text]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[df[c] for c in df.columns], clean.alias(text_as), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).alias(removed_as))
