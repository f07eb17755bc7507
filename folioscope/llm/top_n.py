"""Top N items within every group, by mergeable bounded heaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from pyspark.sql.internal import InternalFunction

    _collect_top_k = InternalFunction.collect_top_k
except (ImportError, AttributeError):  # not a public name
    _collect_top_k = None

#: Rows that a task looks at together for its first cut.
ROWS = 65_536
#: Types whose order is the same here and in the JVM.
_ORDERED = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def _first_cut(groups: int, items: int, n: int):
    """Of some ten thousand rows at a time: the best score of each item, and of those each group's ``n`` best, vectorised."""

    def cut(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        names = table.column_names
        best = table.group_by(names[:-1], use_threads=False).aggregate([(names[-1], "max")]).select([*names[:-1], f"{names[-1]}_max"]).rename_columns(names)
        order = [(c, "ascending") for c in names[:groups]] + [(names[-1], "descending")] + [(c, "ascending") for c in names[groups : groups + items]]
        best = best.take(pa.compute.sort_indices(best, order, null_placement="at_start")).combine_chunks()
        new = np.zeros(len(best), dtype=bool)
        new[:1] = True
        for c in names[:groups]:
            codes = best[c].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        at = np.arange(len(best))
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        kept = best.filter(pa.array(rank < n)).combine_chunks()
        return kept.cast(table.schema).to_batches()[0] if len(kept) else table.slice(0, 0).to_batches(max_chunksize=1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ROWS:
                yield cut(held)
                held, rows = [], 0
        if held:
            yield cut(held)

    return run


def _heaps(entry: Column, n: int) -> Column:
    """The ``n`` least entries of a group, in order: kept as a heap of ``n`` in every task, which are merged."""
    if _collect_top_k is not None:
        return F.array_sort(_collect_top_k(entry, n, True))
    return F.slice(F.array_sort(F.collect_list(entry)), 1, n)  # after a cut to n by rank


def top_n_per_group(df: DataFrame, group: Sequence[str], item: Sequence[str], score: str, n: int, *, score_as: str = "top_score", rank_as: str = "top_rank") -> DataFrame:
    """The ``n`` best items of each group, the score of an item being the highest of its rows.

    Returns ``group, item, score_as, rank_as`` (1 is best), at most ``n`` rows for each group. Equal
    scores are ordered by the columns of ``item``, smaller first, which makes the order total; null
    scores and NaN do not count, infinite ones do, and a group without a score that counts does not come
    out. Nulls in ``group`` or ``item`` are values like others (null first). Repeated rows change
    nothing; columns of other names, also of those used inside, are ignored. An empty table gives none.

    Every task first keeps ``n`` items of each group of the rows that it reads together: an item that is not among the best ``n``
    different ones there is not among them anywhere. What is left meets by item, spread over all keys, so a
    group of any size is split. Then every task keeps one heap of ``n`` entries for each group it
    sees, and only heaps cross the second shuffle and are merged: a task never holds more of a group than
    ``n`` entries from each heap in turn.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [*[f"_g{k}" for k in range(len(group))], *[f"_i{k}" for k in range(len(item))]]
    counted = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*[F.col(c).alias(a) for c, a in zip([*group, *item], names)], F.col(score).cast("double").alias("_s"))
    if all(isinstance(counted.schema[a].dataType, _ORDERED) for a in names):
        counted = counted.mapInArrow(_first_cut(len(group), len(item), n), counted.schema)
    best = counted.groupBy(*names).agg(F.max("_s").alias("_s"))
    own, items = names[: len(group)], names[len(group) :]
    entry = F.struct((-F.col("_s")).alias("_least"), *items)
    if _collect_top_k is None:
        from pyspark.sql import Window

        best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("_s"), *items))).where(F.col("_r") <= n)
    heaps = best.groupBy(*own).agg(_heaps(entry, n).alias("_heap"))
    entries = heaps.select(*own, F.posexplode("_heap").alias("_p", "_e"))
    return entries.select(
        *[F.col(a).alias(c) for c, a in zip(group, own)],
        *[F.col(f"_e.{a}").alias(c) for c, a in zip(item, items)],
        (-F.col("_e._least") + 0.0).alias(score_as),
        (F.col("_p") + 1).alias(rank_as),
    )
