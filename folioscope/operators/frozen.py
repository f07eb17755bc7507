"""Retrieval without models: vectors, rankings and rerank scores frozen under the revision that made them, and asked again.

Nothing is made up: a question without a frozen vector, a candidate without a score or another revision raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import dense, ranking
from folioscope.operators.guards import require_empty
from folioscope.sources import versions


def freeze_dense(vectors: DataFrame, query_vectors: DataFrame, path: str, revision: str) -> None:
    """Vectors of the corpus (``chunk_id, vector``) and of questions (``qid, question, vector``)."""
    versions.freeze({"vectors": vectors.select("chunk_id", "vector"), "query_vectors": query_vectors.select("qid", "question", "vector")}, path, {"embedding": revision})


def search_dense(spark: SparkSession, path: str, questions: DataFrame, k: int, revision: str) -> DataFrame:
    """``qid, chunk_id, score, rank`` for questions (``qid, question``), found by their text: one that was not frozen raises."""
    known = versions.thaw(spark, path, "query_vectors", {"embedding": revision}).select("question", "vector").dropDuplicates(["question"])
    require_empty(questions.select("qid", "question").join(known, "question", "left_anti"), "questions have no frozen vector")
    asked = questions.select("qid", "question").join(known, "question").select("qid", "vector")
    return dense.nearest(versions.thaw(spark, path, "vectors", {"embedding": revision}), asked, k)


def freeze_ranking(ranked: DataFrame, path: str, revision: str) -> None:
    """A ranking (``qid, chunk_id, score, rank``) of a retriever."""
    versions.freeze({"ranking": ranked.select("qid", "chunk_id", "score", "rank")}, path, {"ranking": revision})


def search_ranking(spark: SparkSession, path: str, questions: DataFrame, k: int, revision: str) -> DataFrame:
    """The frozen ranking cut to ``k``; see ``ranking.replay`` for what raises."""
    return ranking.replay(versions.thaw(spark, path, "ranking", {"ranking": revision}), questions, k)


def freeze_scores(scores: DataFrame, path: str, revision: str) -> None:
    """Scores of pairs (``qid, chunk_id, score``) that a reranker of this revision gave."""
    versions.freeze({"scores": scores.select("qid", "chunk_id", "score")}, path, {"reranker": revision})


def rerank(spark: SparkSession, path: str, candidates: DataFrame, revision: str, *, top: int | None = None) -> DataFrame:
    """Candidates by their frozen scores; one without a score raises."""
    return ranking.rerank(candidates, versions.thaw(spark, path, "scores", {"reranker": revision}), top=top)
