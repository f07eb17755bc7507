"""The k best of every query over the batches of one task, kept as they come."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """For each query its ``k`` best (score, key): by score at ``digits`` decimals, highest first, then by key; NaN is the highest.

    Entries are put aside and cut for all queries at once, when they have doubled. However many batches a task sees, it gives ``k`` entries of a
    query, and holds few times as many. ``floor`` is the rounded score that each query's k-th had at the last cut: lower ones can't come in.
    """

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.floor = np.full(queries, -np.inf)
        self.slack = 10.0**-digits
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, place in the keys, score
        self.keys: list[pa.Array] = []
        self.held, self.seen, self.start, self.after = 0, 0, 0, 0

    def _rounded(self, scores: np.ndarray) -> np.ndarray:
        rounded = np.round(scores, self.digits) + 0.0
        return np.where(np.isnan(rounded), np.inf, rounded)

    def first(self, scores: np.ndarray) -> np.ndarray:
        """Places of the ``k`` highest, of equal ones those that come first."""
        rounded = self._rounded(scores)
        n = len(rounded)
        if n <= self.k:
            return np.arange(n)
        least = np.partition(rounded, n - self.k)[n - self.k]
        above, equal = np.flatnonzero(rounded > least), np.flatnonzero(rounded == least)
        return np.concatenate([above, equal[: self.k - len(above)]])

    def batch(self, keys: pa.Array) -> None:
        """Takes the keys of a batch, to whose places the entries put next refer."""
        if self.held > self.after:
            self.cut()
        self.start = self.seen
        self.keys.append(keys)
        self.seen += len(keys)

    def put(self, queries: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        """Entries of the batch."""
        if len(queries):
            self.parts.append((queries, places + self.start, scores))
            self.held += len(queries)

    def add(self, query: int, keys: np.ndarray, scores: np.ndarray) -> None:
        """Scores of one query for a batch's keys, which are sorted."""
        self.batch(pa.array(keys))
        at = self.first(scores)
        self.put(np.full(len(at), query), at, scores[at])

    def cut(self) -> None:
        """Leaves the ``k`` best of each query, in order, and the keys that they have."""
        if not self.parts:
            return
        q, at, scores = (np.concatenate(x) for x in zip(*self.parts))
        used, place = np.unique(at, return_inverse=True)
        keys = pa.chunked_array(self.keys).take(pa.array(used)).combine_chunks()
        by_key = np.empty(len(used), dtype=np.int64)
        by_key[pc.sort_indices(keys).to_numpy()] = np.arange(len(used))
        rounded = self._rounded(scores)
        order = np.lexsort((by_key[place], -rounded, q))
        q, place, scores, rounded = q[order], place[order], scores[order], rounded[order]
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
        self.floor[q[nth == self.k - 1]] = rounded[nth == self.k - 1]
        kept = nth < self.k
        self.parts = [(q[kept], place[kept], scores[kept])]
        self.keys, self.seen, self.held = [keys], len(keys), int(kept.sum())
        self.after = 2 * self.held

    def table(self) -> tuple[np.ndarray, pa.Array | None, np.ndarray]:
        """(query, key, score) of all that are kept, keys as they came; None for keys where there are none."""
        self.cut()
        if not self.parts:
            return np.zeros(0, dtype=int), None, np.zeros(0)
        q, at, scores = self.parts[0]
        return q, self.keys[0].take(pa.array(at)), scores

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of all that are kept."""
        q, keys, scores = self.table()
        return q, np.zeros(0, dtype=object) if keys is None else keys.to_numpy(zero_copy_only=False).astype(object), scores


def each(q: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among all, entry) for entries of groups ``q``, once for each member of the group, where group ``g`` has the places from ``ends[g]`` to before ``ends[g + 1]``."""
    sizes = np.diff(ends)[q]
    entry = np.repeat(np.arange(len(q)), sizes)
    return np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes - ends[q], sizes), entry


def grid(queries: int, most: int, cores: int) -> tuple[int, int]:
    """(queries in a block, parts that a block's scan is joined to): two tasks for each core, in few parts, as each gives ``k`` entries of a query; never one, as Spark runs a union of single partitions as one task."""
    block = max(1, min(most, max(1_000, math.ceil(queries / cores))))
    return block, max(2, math.ceil(2 * cores / max(1, math.ceil(queries / block))))


def joined(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``rows`` rows or more."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def growing(batches: Iterable[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """The same rows, the first batch in parts of ``first`` rows, then three times as many as before each: most of it already meets a floor."""
    for n, b in enumerate(batches):
        at, size = 0, first if n == 0 else b.num_rows
        while at < b.num_rows:
            yield b.slice(at, size)
            at, size = at + size, 3 * (at + size)
