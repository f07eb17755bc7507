"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.best import Best, each, grid, growing
from folioscope.operators.bm25 import top_k

#: Query vectors that one task scores against the vectors it reads, and up to how many are sent out that way, in how many bytes.
QUERY_BLOCK, BROADCAST_QUERIES, BROADCAST_BYTES = 16_384, 262_144, 256 << 20
#: Vectors in a block, where blocks of vectors meet blocks of queries; queries and vectors in a tile, whose scores stay in a core's cache.
VECTOR_BLOCK, TILE = 50_000, (512, 1_000)
#: Vectors that a task meets first, so that later ones meet each query's k-th.
FIRST = 1_000


def _add(best: Best, unit: np.ndarray, keys: pa.Array, vectors: pa.Array) -> None:
    """Cosines of a batch's vectors to the queries, the rows of unit length.

    Scores in single precision, whose error is bounded, tell which pairs can't be among the best; the others are scored in double.
    """
    d = unit.shape[1]
    good = np.flatnonzero(pc.equal(pc.list_value_length(vectors), d).fill_null(False).to_numpy(zero_copy_only=False))
    if not len(good):
        return
    keys, vectors = keys.take(pa.array(good)), vectors.take(pa.array(good))
    order = pc.sort_indices(keys)
    keys = keys.take(order)
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), d)[order.to_numpy()]
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(length == 0, 1, length)
    best.batch(keys)
    floor = best.floor
    cold, warm = np.flatnonzero(floor == -np.inf), np.flatnonzero(floor > -np.inf)
    for at in range(0, len(cold), 64):  # a few queries at a time, so that the scores stay small
        own = cold[at : at + 64]
        for q, score in zip(own, unit[own] @ m.T):
            first = best.first(score)
            best.put(np.full(len(first), q), first, score[first])
    # the error of a product of two unit vectors in single precision, and of rounding
    least = (floor - best.slack - (d + 8) * 1.2e-7).astype(np.float32)
    small = m.astype(np.float32)
    for at in range(0, len(warm), TILE[0]):
        own = warm[at : at + TILE[0]]
        near, bound = unit[own].astype(np.float32), least[own][:, None]
        for v in range(0, len(m), TILE[1]):
            product = near @ small[v : v + TILE[1]].T
            some = np.flatnonzero(~(product.max(axis=1) < bound[:, 0]))  # NaN stays in
            if not len(some):
                continue
            hit, at_place = np.nonzero(~(product[some] < bound[some]))
            q, place = own[some[hit]], v + at_place
            if len(hit) > 16 * best.k * len(own):  # many equal scores
                for one in np.unique(q):
                    places = place[q == one]
                    score = m[places] @ unit[one]
                    first = best.first(score)
                    best.put(np.full(len(first), one), places[first], score[first])
            else:
                best.put(q, place, np.einsum("ij,ij->i", unit[q], m[place]))


def _entries(best: Best, who: pa.Array, ends: np.ndarray, self_too: bool) -> Iterator[pa.RecordBatch]:
    q, keys, scores = best.table()
    if keys is None:
        return
    own, entry = each(q, ends)
    got = pa.table({"q": who.take(own), "key": keys.take(entry), "score": scores[entry]})
    if not self_too:
        own = pd.Series(got["q"].to_numpy(zero_copy_only=False)) != pd.Series(got["key"].to_numpy(zero_copy_only=False))
        got = got.filter(pa.array(own.to_numpy()))
    yield from got.combine_chunks().to_batches(max_chunksize=50_000)


def _unit(vectors: pa.Array, size: int) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def _alike(part: pa.Table, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Queries in groups with one vector, the ends of the groups, and a unit vector for each: equal vectors have one ranking."""
    m = np.ascontiguousarray(_unit(part["v"].combine_chunks(), size))
    if not size:
        return part["q"].combine_chunks(), np.arange(len(m) + 1), m
    _, first, group = np.unique(m.view(np.dtype((np.void, m.itemsize * size))).ravel(), return_index=True, return_inverse=True)
    return part["q"].combine_chunks().take(np.argsort(group, kind="stable")), np.r_[0, np.cumsum(np.bincount(group))], m[first]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", qid: str = "qid", vector: str = "vector", exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """``qid, key, score, rank``: the ``k`` vectors nearest to each query by cosine, ties at ``digits`` decimals by key.

    Null vectors and such of another length than the query's are left out, a zero vector has score 0 to all; a
    query with a null vector doesn't come out. Up to ``BROADCAST_QUERIES`` queries go out as matrices, in blocks; a task
    meets all vectors, or a part of them where blocks are few, with one block, so that few more than the ``k`` best of each query are shuffled.
    ``vectors`` should be a written table, as every block reads it. Beyond that, each block of
    vectors meets each block of queries in a group of its own, and the driver holds neither.
    """
    kinds = queries.schema[qid].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    schema = f"q {kinds[0]}, key {kinds[1]}, score double"
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("q"), F.col(vector).alias("v"))
    n, values = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if n <= BROADCAST_QUERIES and 8 * values <= BROADCAST_BYTES:
        out = _broadcast(rows, asked, k, schema, digits, exclude_self)
    else:
        out = _blocks(rows, asked, k, schema, digits, exclude_self)
    return top_k(out.withColumnsRenamed({"q": qid, "key": key}), k, partition=(qid,), key=key, digits=digits)


def _broadcast(rows: DataFrame, asked: DataFrame, k: int, schema: str, digits: int, exclude_self: bool) -> DataFrame:
    spark, out = rows.sparkSession, None
    held = asked.orderBy("q").toArrow().combine_chunks()
    sizes = pc.list_value_length(held["v"])
    for size in sorted(pc.unique(sizes).to_pylist()):
        who, ends, unit = _alike(held.filter(pc.equal(sizes, size)), size)
        block, parts = grid(len(unit), QUERY_BLOCK, spark.sparkContext.defaultParallelism)
        for at in range(0, len(unit), block):
            own = ends[at : at + block + 1]
            shared = spark.sparkContext.broadcast((who.slice(own[0], own[-1] - own[0]), own - own[0], unit[at : at + block]))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                who, ends, unit = shared.value
                best = Best(len(unit), k + exclude_self, digits)
                for b in growing(batches, FIRST):
                    _add(best, unit, b.column(0), b.column(1))
                yield from _entries(best, who, ends, not exclude_self)

            scored = rows.coalesce(parts).mapInArrow(run, schema)
            out = scored if out is None else out.unionByName(scored)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(rows: DataFrame, asked: DataFrame, k: int, schema: str, digits: int, exclude_self: bool) -> DataFrame:
    n, m = max(1, math.ceil(rows.count() / VECTOR_BLOCK)), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = rows.withColumn("i", own("key", n)).withColumn("j", every(m))
    right = asked.withColumn("j", own("q", m)).withColumn("i", every(n)).withColumn("size", F.size("v"))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        for size in pc.unique(queries["size"]).to_pylist():
            part = queries.filter(pc.equal(queries["size"], size)).combine_chunks()
            best = Best(part.num_rows, k + exclude_self, digits)
            for b in vectors.to_batches():
                _add(best, _unit(part["v"].combine_chunks(), size), b["key"], b["v"])
            parts += _entries(best, part["q"].combine_chunks(), np.arange(part.num_rows + 1), not exclude_self)
        none = pa.table({"q": queries["q"].slice(0, 0), "key": vectors["key"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches(parts) if parts else none

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)
