"""Okapi BM25 over chunks: index tables, scores and top-k rankings for many questions at once."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.lineage import written
from folioscope.operators.best import Best, each, grid, growing, joined

TOKEN = "[A-Za-z0-9]+"
#: Questions whose terms are sent out at once, for which the chunks are read into terms, and those that one task scores.
BLOCK, SCORED = 200_000, 25_000
#: Share of the chunks that a frequent term is in, and how many such terms are held as a value for each of the ``ROWS`` chunks that are scored at once.
OFTEN, WIDE, ROWS = 0.03, 256, 32_768
#: Sums of rarer terms, one for a chunk, that a task holds at once for questions that share them; chunks that a task scores first, so that later ones meet a question's k-th.
HELD, FIRST = 4_000_000, 1_024


@dataclass(frozen=True)
class Bm25:
    """Parameters; ``k`` many chunks are kept of each question. Ranks go by the score at ``digits`` decimals, then by the chunk's id."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    stopwords: tuple[str, ...] = ()
    digits: int = 9


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased runs of ASCII letters and digits, without stopwords; [] for null."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))
    if not stopwords:
        return found
    words = F.array(*[F.lit(w) for w in sorted(stopwords)])
    return F.filter(found, lambda t: ~F.array_contains(words, t))


def postings(chunks: DataFrame, p: Bm25 = Bm25(), key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, term, tf, dl``: how often each term stands in each chunk, and the chunk's length."""
    listed = chunks.select(key, tokens(F.col(text), p.stopwords).alias("_t"))
    each = listed.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


@dataclass(frozen=True)
class Statistics:
    """What scores need of a corpus: its chunks ``n``, their mean length, and ``df``, a written table of ``term, df``."""

    n: int
    avgdl: float
    df: DataFrame


def statistics(chunks: DataFrame, p: Bm25 = Bm25(), text: str = "text") -> Statistics:
    """Counts of all terms and chunks in one pass, combined in each task; chunks without terms count."""
    listed = chunks.select(tokens(F.col(text), p.stopwords).alias("_t")).select(F.size("_t").alias("dl"), F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit("")))).alias("term"))
    counted = listed.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl"))
    table = written(counted, "term-counts")
    every = table.where("term = ''").first()  # the term that every chunk has
    n = every["df"] if every else 0
    return Statistics(n, every["dl"] / n if n else 0.0, table.where("term <> ''").select("term", "df"))


def idf(s: Statistics, p: Bm25 = Bm25()) -> DataFrame:
    """``term, df, idf``; a negative idf becomes epsilon times the mean over all terms, negative ones included."""
    raw = s.df.withColumn("raw", F.log(F.lit(float(s.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(p.epsilon * mean)).otherwise(F.col("raw")).alias("idf"))


def asked_terms(questions: DataFrame, p: Bm25 = Bm25(), qid: str = "qid", question: str = "question") -> DataFrame:
    """``qid, term, qtf``: how often each term stands in each question."""
    return questions.select(qid, F.explode(tokens(F.col(question), p.stopwords)).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qtf"))


def scores_by_postings(chunks: DataFrame, questions: DataFrame, p: Bm25 = Bm25(), key: str = "chunk_id", qid: str = "qid", question: str = "question", stats: Statistics | None = None) -> DataFrame:
    """``qid, key, score`` of every chunk that shares a term with a question, by joining postings on terms: for rare terms, or where all scores are wanted; ``retrieve`` is for rankings."""
    s = stats or statistics(chunks, p)
    asked = asked_terms(questions, p, qid, question)
    gain = F.col("idf") * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.lit(s.avgdl)))
    weighted = postings(chunks, p, key).join(asked.select("term").distinct(), "term", "left_semi").join(idf(s, p), "term").select("term", key, gain.alias("gain"))
    return weighted.join(asked, "term").groupBy(qid, key).agg(F.sum(F.col("gain") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, k: int, *, partition: Sequence[str] = ("qid",), key: str = "chunk_id", score: str = "score", digits: int = 9) -> DataFrame:
    """Adds ``rank`` from 1 and keeps the first ``k`` of each partition: by score at ``digits`` decimals, highest first, then by key."""
    order = Window.partitionBy(*partition).orderBy(F.round(F.col(score), digits).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _counted(chunks: DataFrame, places: dict[str, int], p: Bm25, key: str) -> DataFrame:
    """``key, terms, tfs, dl``: of each chunk the terms that have a place, how often each stands there, and how many terms the chunk has."""
    stop, find = frozenset(p.stopwords), re.compile(TOKEN).findall
    shared = chunks.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            terms, tfs, ends, lengths = [], [], [0], []
            for text in b.column(1).to_pylist():
                found = find((text or "").lower())
                if stop:
                    found = [t for t in found if t not in stop]
                for t, n in Counter(found).items():
                    if (w := at.get(t)) is not None:
                        terms.append(w)
                        tfs.append(n)
                ends.append(len(terms))
                lengths.append(len(found))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), listed(terms), listed(tfs), pa.array(lengths, pa.int32())], names=["key", "terms", "tfs", "dl"])

    return chunks.select(F.col(key).alias("key"), F.col("text")).mapInArrow(run, f"key {chunks.schema[key].dataType.simpleString()}, terms array<int>, tfs array<int>, dl int")


Asked = list[tuple[tuple[tuple[int, float], ...], tuple[tuple[int, float], ...]]]


def _score(best: Best, asked: Asked, keys: pa.Array, terms: pa.Array, tfs: pa.Array, dl: np.ndarray, often: int, p: Bm25, avgdl: float, matching: bool) -> None:
    """Adds a batch's chunks for every question, each a pair of its frequent terms, which have the places below ``often``, and its other terms, with their weights.

    Questions are in order of their frequent terms, so each sum over those is made once, for all chunks and all questions that have these terms; each question then
    looks only at the chunks whose sum reaches what its k-th has, and at those that have one of its other terms, whose sums are shared likewise.
    """
    n = len(keys)
    order = pc.sort_indices(keys)
    best.batch(keys.take(order))
    terms, tfs, length = terms.take(order), tfs.take(order), dl[order.to_numpy()]
    row = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
    norm = p.k1 * (1 - p.b + p.b * length / avgdl) if avgdl else np.full(n, p.k1)
    gain = tf * (p.k1 + 1) / (tf + norm[row])
    by_term = np.argsort(term.astype(np.int16) if not len(term) or term.max() < 1 << 15 else term, kind="stable")
    term, row, gain = term[by_term], row[by_term], gain[by_term]
    begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=int)
    posted = {int(term[i]): (row[i:j], gain[i:j]) for i, j in zip(begins, [*begins[1:], len(term)])}
    wide: dict[int, np.ndarray] = {}
    for w in range(often):
        if w in posted:
            wide[w] = np.zeros(n)
            wide[w][posted[w][0]] = posted[w][1]
    more, mark, floor = np.zeros(n), np.zeros(n, dtype=bool), best.floor - 2 * best.slack
    stack: list[np.ndarray] = [np.zeros(n)]  # sums over the first frequent terms of a question
    has: list[np.ndarray] = [np.zeros(n, dtype=bool)]
    before: tuple = ()
    gains: dict[tuple, tuple[np.ndarray, np.ndarray] | None] = {}  # of sets of other terms, which questions share: places and sums, the highest last
    held = 0

    def sums(other: tuple) -> tuple[np.ndarray, np.ndarray] | None:
        hits = [(posted[w], weight) for w, weight in other if w in posted]
        if not hits:
            return None
        for (at, g), weight in hits:
            more[at] += weight * g
            mark[at] = True
        touched = np.flatnonzero(mark)
        gained = more[touched]
        more[touched], mark[touched] = 0.0, False
        up = np.argsort(gained)
        return touched[up], gained[up]

    for frequent, group in groupby(enumerate(asked), key=lambda x: x[1][0]):
        same = 0
        while same < min(len(before), len(frequent)) and before[same] == frequent[same]:
            same += 1
        del stack[same + 1 :], has[same + 1 :]
        for w, weight in frequent[same:]:
            there = wide.get(w)
            stack.append(stack[-1] if there is None else stack[-1] + weight * there)
            if matching:
                has.append(has[-1] if there is None else has[-1] | (there > 0))
        before = frequent
        lone = np.where(has[-1], stack[-1], -np.inf) if matching else stack[-1]
        own = [(q, other) for q, (_, other) in group]
        least = min(floor[q] for q, _ in own)
        # what may come in by the frequent terms alone, for the question that asks least
        good = np.flatnonzero(lone >= least if least > -np.inf else lone > -np.inf)
        value, most = lone[good], stack[-1].max() if n else -np.inf
        for q, other in own:
            if other not in gains:
                if held > HELD:
                    gains.clear()
                    held = 0
                gains[other] = sums(other)
                held += len(gains[other][0]) if gains[other] else 0
            places, score = good, value
            if len(good) and floor[q] > least:
                places = np.flatnonzero(value >= floor[q])
                places, score = good[places], value[places]
            if (found := gains[other]) is not None:
                touched, gained = found
                if len(places):
                    mark[touched] = True
                    rest = ~mark[places]
                    mark[touched] = False
                    places, score = places[rest], score[rest]
                enough = gained.searchsorted(floor[q] - most - best.slack)  # lower ones can't come in with the highest sum
                touched = touched[enough:]
                summed = stack[-1][touched] + gained[enough:]
                near = summed >= floor[q]
                if near.any():
                    places, score = np.concatenate([places, touched[near]]), np.concatenate([score, summed[near]])
            if not len(places):
                continue
            if len(places) > best.k:
                order = np.argsort(places)
                first = order[best.first(score[order])]
                places, score = places[first], score[first]
            best.put(np.full(len(places), q), places, score)


def _scanned(chunks: DataFrame, questions: list[tuple[object, str]], k: int, p: Bm25, key: str, qid: str, kind: pa.DataType, qid_type: str, s: Statistics, matching: bool) -> DataFrame:
    spark, stop = chunks.sparkSession, frozenset(p.stopwords)
    counts = [Counter(t for t in re.findall(TOKEN, q.lower()) if t not in stop) for _, q in questions]
    wanted = pd.DataFrame({"term": sorted({t for c in counts for t in c})}, dtype=object)  # of a bounded number of questions
    known = idf(s, p).join(F.broadcast(spark.createDataFrame(wanted, "term string")), "term").collect()
    known.sort(key=lambda r: (-r["df"], r["term"]))
    places = {r["term"]: i for i, r in enumerate(known)}
    often = sum(r["df"] > OFTEN * s.n for r in known[:WIDE])  # the first places
    weights = [r["idf"] for r in known]
    alike: dict[tuple, list] = {}  # questions that ask for the same terms have one ranking
    for (q, _), c in zip(questions, counts):
        alike.setdefault(tuple(sorted((places[t], n) for t, n in c.items() if t in places)), []).append(q)
    listed = []
    for own, who in alike.items():
        weighed = [(w, n * weights[w]) for w, n in own]
        listed.append((who, tuple(x for x in weighed if x[0] < often), tuple(x for x in weighed if x[0] >= often)))
    listed.sort(key=lambda x: x[1])
    block, parts = grid(len(listed), SCORED, spark.sparkContext.defaultParallelism)
    counted = _counted(chunks, places, p, key)
    if len(listed) > block:
        counted = written(counted, "counted-terms")
    schema, avgdl, out = f"{qid} {qid_type}, {key} {chunks.schema[key].dataType.simpleString()}, score double", s.avgdl, None
    for at in range(0, max(1, len(listed)), block):
        part = listed[at : at + block]
        ends = np.cumsum([0, *(len(who) for who, _, _ in part)])
        shared = spark.sparkContext.broadcast((pa.array([q for who, _, _ in part for q in who], kind), ends, [(a, b) for _, a, b in part]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            who, ends, asked = shared.value
            best = Best(len(asked), k, p.digits)
            for b in growing(joined(batches, ROWS), FIRST):
                _score(best, asked, b.column(0), b.column(1), b.column(2), b.column(3).to_numpy(zero_copy_only=False), often, p, avgdl, matching)
            q, keys, scores = best.table()
            if keys is not None:
                own, entry = each(q, ends)
                yield from pa.table({qid: who.take(own), key: keys.take(entry), "score": scores[entry]}).combine_chunks().to_batches(max_chunksize=50_000)

        scored = counted.coalesce(parts).mapInArrow(run, schema)
        out = scored if out is None else out.unionByName(scored)
    return top_k(out, k, partition=(qid,), key=key, digits=p.digits)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int, p: Bm25 = Bm25(), key: str = "chunk_id", qid: str = "qid", question: str = "question", stats: Statistics | None = None, matching: bool = False) -> DataFrame:
    """``qid, key, score, rank``: the ``k`` best chunks of every question; chunks that match nothing have score 0 and rank by their keys, before those of negative score. With ``matching`` they are left out.

    Chunks must be unique in ``key``, and should be a written table, as they are read more than once; a null text has no terms. Questions
    are taken ``BLOCK`` at a time; chunks are read into the terms that these have once, and each task scores a part of the questions against all chunks, or a large
    part of them where questions are few. So few more than the ``k`` best of a question are shuffled. Joining postings instead (``scores_by_postings``) would make
    a row of every term that a question and a chunk share.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    s = stats or statistics(chunks, p)
    qid_type = questions.schema[qid].dataType.simpleString()
    kind = to_arrow_type(questions.schema[qid].dataType)
    out, block = None, []

    def scan() -> DataFrame:
        part = _scanned(chunks, block, k, p, key, qid, kind, qid_type, s, matching)
        return part if out is None else out.unionByName(part)

    for r in questions.select(qid, question).orderBy(qid).toLocalIterator():
        block.append((r[0], r[1] or ""))
        if len(block) == BLOCK:
            out, block = scan(), []
    return scan() if block or out is None else out


def okapi_idf(n: int, df: int) -> float:
    """The formula for one term, before the floor."""
    return math.log(n - df + 0.5) - math.log(df + 0.5)
