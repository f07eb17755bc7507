"""Retrieval as the settings say: backends by name, an index that is kept while it fits, reranking, metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.hashing import content_fingerprint
from folioscope.lineage import written
from folioscope.operators import bm25, dense, frozen, metrics, ranking
from folioscope.settings import Settings
from folioscope.sources import sinks


@dataclass(frozen=True)
class Corpus:
    """What backends search: ``chunks`` (``chunk_id, doc_id, page_num, text``, unique and written), and what some need besides.

    ``vectors`` is ``chunk_id, vector``, ``query_vectors`` ``qid, vector``; ``stopwords`` is the list that the settings may switch on;
    ``index`` a folder for a saved BM25 index; ``frozen`` a folder with a frozen ranking of revision ``revision``;
    ``pair_scores`` gives ``qid, chunk_id, score`` of candidates with their ``question`` and ``text``.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    stopwords: tuple[str, ...] = field(default=())
    index: str | None = None
    frozen: str | None = None
    revision: str = ""
    pair_scores: Callable[[DataFrame], DataFrame] | None = None


def _needed(value, name: str):
    if value is None:
        raise ValueError(f"this backend needs {name}")
    return value


def _dense(s: Settings, c: Corpus, questions: DataFrame) -> DataFrame:
    asked = _needed(c.query_vectors, "query_vectors").join(questions.select("qid"), "qid", "left_semi")
    return dense.nearest(_needed(c.vectors, "vectors"), asked, s.retrieval.top_k)


def _sparse(s: Settings, c: Corpus, questions: DataFrame) -> DataFrame:
    p = bm25.Bm25(s.sparse.k1, s.sparse.b, s.sparse.epsilon, c.stopwords if s.sparse.stopwords else ())
    if c.index is None:
        return bm25.retrieve(c.chunks, questions, s.retrieval.top_k, p)
    print_ = content_fingerprint(c.chunks, "chunk_id", "text").first()["content_fingerprint"]
    sinks.open_bm25(c.chunks, c.index, p, print_)
    return sinks.search_saved(c.chunks.sparkSession, c.index, questions, s.retrieval.top_k, p, print_)


def _hybrid(s: Settings, c: Corpus, questions: DataFrame) -> DataFrame:
    weights = {"k": s.fusion.k, "dense_weight": s.fusion.dense_weight, "sparse_weight": s.fusion.sparse_weight}
    return ranking.hybrid(_dense(s, c, questions), _sparse(s, c, questions), s.retrieval.top_k, **weights)


def _frozen(s: Settings, c: Corpus, questions: DataFrame) -> DataFrame:
    return frozen.search_ranking(questions.sparkSession, _needed(c.frozen, "frozen"), questions, s.retrieval.top_k, c.revision)


#: Backends by the name that settings have; more may be added.
BACKENDS: dict[str, Callable[[Settings, Corpus, DataFrame], DataFrame]] = {"dense": _dense, "sparse": _sparse, "hybrid": _hybrid, "frozen": _frozen}


def retrieve(s: Settings, c: Corpus, questions: DataFrame) -> DataFrame:
    """``qid, chunk_id, score, rank`` as the settings say; with reranking the first ``top_k`` are put in order of their pair scores and cut to ``top_n``."""
    ranked = BACKENDS[s.retrieval.backend](s, c, questions)
    if not s.rerank.enabled:
        return ranked
    ranked = written(ranked, "ranked")  # read three times: for the pairs, for the guard and for the result
    pairs = ranked.select("qid", "chunk_id").join(questions.select("qid", "question"), "qid").join(c.chunks.select("chunk_id", "text"), "chunk_id")
    return ranking.rerank(ranked, _needed(c.pair_scores, "pair_scores")(pairs), top=s.rerank.top_n)


def pages(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pages of a ranking, in order; a chunk that the corpus lacks is on page 0 of the document ''."""
    placed = ranked.join(chunks.select("chunk_id", "doc_id", "page_num"), "chunk_id", "left")
    return ranking.collapse_to_pages(placed.withColumn("doc_id", F.coalesce("doc_id", F.lit(""))).withColumn("page_num", F.coalesce("page_num", F.lit(0))))


def evaluate(s: Settings, c: Corpus, golden: DataFrame) -> DataFrame:
    """Metrics of every question, by the settings' names."""
    return metrics.per_question(pages(retrieve(s, c, golden), c.chunks), golden, s.evaluation.metrics, top_k=s.retrieval.top_k)
