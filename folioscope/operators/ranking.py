"""Rankings: fusion, reranking, replays of frozen ones, and the step from chunks to pages.

A ranking is a table ``qid, chunk_id, score, rank`` with ranks from 1; order is always a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.bm25 import top_k
from folioscope.operators.guards import require_empty
from folioscope.operators.ranks import number_within


def fuse(dense: DataFrame, sparse: DataFrame, *, k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion: the whole union, each chunk with the sum of weight / (k + rank) over the arms.

    A chunk that an arm lists twice counts at its first position. Ties go by chunk id.
    """
    arm = lambda df, w: df.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank")).select("qid", "chunk_id", (F.lit(float(w)) / (F.col("rank") + k)).alias("score"))
    both = arm(dense, dense_weight).unionByName(arm(sparse, sparse_weight))
    fused = both.groupBy("qid", "chunk_id").agg(F.sum("score").alias("score"))
    return number_within(fused, ["qid"], [F.round("score", 12).desc(), F.col("chunk_id")], "rank")


def hybrid(dense: DataFrame, sparse: DataFrame, top: int, **weights) -> DataFrame:
    """The first ``top`` of each arm, fused and cut to ``top`` again."""
    first = lambda df: df.where(F.col("rank") <= top)
    return fuse(first(dense), first(sparse), **weights).where(F.col("rank") <= top)


def rerank(candidates: DataFrame, scores: DataFrame, *, top: int | None = None) -> DataFrame:
    """Candidates by their new ``score``, highest first, ties by chunk id; a candidate without a score raises, none is made up."""
    require_empty(candidates.join(scores, ["qid", "chunk_id"], "left_anti"), "candidates have no score")
    joined = candidates.select("qid", "chunk_id").distinct().join(scores.select("qid", "chunk_id", "score").dropDuplicates(["qid", "chunk_id"]), ["qid", "chunk_id"])
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id")
    ranked = joined.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def replay(frozen: DataFrame, questions: DataFrame, top: int) -> DataFrame:
    """A frozen ranking cut to ``top`` for the questions; a question that is not there, or a list stored shorter than ``top`` while another is as long, raises."""
    require_empty(questions.select("qid").join(frozen, "qid", "left_anti"), "questions have no frozen ranking")
    depth = frozen.agg(F.max("rank")).first()[0] or 0
    if top > depth:
        raise ValueError(f"the ranking is frozen to {depth}, not to {top}")
    return frozen.join(questions.select("qid"), "qid", "left_semi").where(F.col("rank") <= top)


def logged_rankings(retrieved: DataFrame) -> DataFrame:
    """``run_label, qid, chunk_id, doc_id, page_num, score, rank`` of logged runs.

    Of redelivered rows of one (run, question, chunk) the latest counts, at the same time the one with the higher
    score. Rows without a usable score come last. Ties go by chunk id.
    """
    usable = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    rows = retrieved.withColumn("score", usable)
    # the latest row of each chunk is the least by this, which tasks find before the shuffle
    key = F.struct(F.col("logged_at").isNull(), -F.unix_micros("logged_at"), F.col("score").isNull(), -F.col("score"), "doc_id", "page_num")
    one = rows.groupBy("run_label", "qid", "chunk_id").agg(F.min_by(F.struct("doc_id", "page_num", "score"), key).alias("_r"))
    one = one.select("run_label", "qid", "chunk_id", "_r.*")
    return number_within(one, ["run_label", "qid"], [F.col("score").desc_nulls_last(), F.col("chunk_id")], "rank")


def collapse_to_pages(ranked: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``by, doc_id, page_num, page_rank``: each page at the first position any of its chunks has, order kept."""
    first = ranked.groupBy(*by, "doc_id", "page_num").agg(F.min("rank").alias("_first"))
    return number_within(first, by, ["_first", "doc_id", "page_num"], "page_rank").drop("_first")


__all__ = ["collapse_to_pages", "fuse", "hybrid", "logged_rankings", "replay", "rerank", "top_k"]
