"""Models given from outside, as functions of batches: embedders and pair scorers, with what goes in and the guards around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.hashing import text_key
from folioscope.operators import caches
from folioscope.operators.bm25 import tokens
from folioscope.operators.guards import require_empty

#: Terms whose places a task remembers.
PLACES = 1_000_000
#: (texts) -> one vector each; made by the factory once in every task.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: (questions, texts) -> one score each.
PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def with_instruction(text: Column, instruction: str) -> Column:
    """A question as an embedder takes it: the instruction before it, trimmed; a null question is ''. Texts of the corpus have none."""
    return F.trim(F.concat_ws(" ", F.lit(instruction), F.coalesce(text, F.lit(""))))


def over_length(rows: DataFrame, text: str, most: int, *, specials: int = 2) -> DataFrame:
    """Rows whose text has more than ``most`` tokens, ``specials`` of the model's own included, with their number as ``n_tokens``."""
    return rows.withColumn("n_tokens", F.size(tokens(F.col(text))) + F.lit(specials)).where(F.col("n_tokens") > most)


def require_lengths(rows: DataFrame, text: str, most: int, *, specials: int = 2) -> None:
    """Raises if a model would cut a text without a word."""
    require_empty(over_length(rows, text, most, specials=specials), f"texts have more than {most} tokens")


def embed(texts: DataFrame, cache: DataFrame, revision: str, factory: Callable[[], Embedder], *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``texts`` with ``cache_key, vector``, additions to the cache). ``cache`` is ``cache_key, vector``.

    The key hashes the model's revision and the text, so each different text is embedded once, in batches, by what ``factory`` makes on the
    executors. The model gives a vector for each text or the task fails. Vectors come out with unit length; a zero vector stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if not len(pdf):
                continue
            model = model or factory()
            vectors = [list(map(float, v)) for v in model([*pdf["_text"]])]
            if len(vectors) != len(pdf):
                raise ValueError(f"{len(vectors)} vectors for {len(pdf)} texts")
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "vector": vectors})

    keyed = texts.withColumn("cache_key", text_key(revision, F.col(text)))
    wanted = keyed.select("cache_key", F.coalesce(text, F.lit("")).alias("_text"))
    known, added = caches.through_cache(wanted, cache.select("cache_key", "vector"), "cache_key", lambda miss: unit(miss.mapInPandas(run, "cache_key string, vector array<double>")))
    return keyed.join(known, "cache_key"), added


def unit(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors scaled to length 1; a zero vector stays as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("_l", length).withColumn(vector, F.when(F.col("_l") > 0, F.transform(vector, lambda x: x / F.col("_l"))).otherwise(F.col(vector))).drop("_l")


def hashed_vectors(rows: DataFrame, keys: Sequence[str], text: str, dims: int) -> DataFrame:
    """``keys, vector`` without a model: how many of a text's terms fall to each of ``dims`` places by their MD5, at unit length.

    ``keys`` should be unique; a text without terms has a zero vector. A text is counted where it is, and a term hashed once in a task.
    """
    find = re.compile("[a-z0-9]+").findall

    class Places(dict):
        def __missing__(self, t: str) -> int:
            if len(self) >= PLACES:
                self.clear()
            p = self[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims
            return p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Places().__getitem__
        for b in batches:
            at, ends = [], [0]
            for lowered in b.column(len(keys)).to_pylist():
                at.extend(map(place, find(lowered or "")))
                ends.append(len(at))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            counts = np.bincount(row * dims + np.array(at, dtype=np.int64), minlength=b.num_rows * dims).reshape(b.num_rows, dims).astype(float)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))  # whole numbers, so exact
            counts /= np.where(length == 0, 1, length)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], vectors], names=[*keys, "vector"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.lower(F.col(text)).alias("_text")).mapInArrow(run, f"{kinds}, vector array<double>")


def score_pairs(pairs: DataFrame, factory: Callable[[], PairScorer]) -> DataFrame:
    """``qid, chunk_id, score`` of ``qid, chunk_id, question, text``, in batches; no pairs need no model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if not len(pdf):
                continue
            model = model or factory()
            scores = [*map(float, model([*pdf["question"]], [*pdf["text"]]))]
            if len(scores) != len(pdf):
                raise ValueError(f"{len(scores)} scores for {len(pdf)} pairs")
            yield pd.DataFrame({"qid": pdf["qid"], "chunk_id": pdf["chunk_id"], "score": scores})

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("qid", "chunk_id"))
    return pairs.select("qid", "chunk_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"{kinds}, score double")


def overlap(question: Column, text: Column) -> Column:
    """A pair's score without a model: the share of the question's distinct terms that the text has, at six decimals."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked), 6)).otherwise(0.0)
