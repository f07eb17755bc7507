"""Retrieval metrics of ranked pages against relevant pages, and their means by group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.guards import require_empty

DEFAULT = ("recall@10", "recall@50", "recall@k", "ndcg@10", "mrr", "hit@1")
GROUPS = ("overall", "numeric", "prose")


@dataclass(frozen=True)
class Spec:
    """A metric's name and how many pages it looks at; None for those that look at all."""

    text: str
    name: str
    cutoff: int | None


def parse_spec(text: str, default_k: int) -> Spec:
    """``name`` or ``name@cutoff``; a cutoff of ``k``, or none, is ``default_k``. Unknown names raise, as do cutoffs under 1."""
    name, _, cut = text.partition("@")
    if name not in ("recall", "ndcg", "mrr", "hit"):
        raise ValueError(f"unknown metric {text!r}")
    k = default_k if cut in ("", "k") else int(cut)
    if k < 1:
        raise ValueError(f"the cutoff of {text!r} must be at least 1")
    return Spec(text, name, None if name in ("mrr", "hit") else k)


def column_name(spec: str) -> str:
    return spec.replace("@", "_at_")


def _value(spec: Spec) -> Column:
    hit, rank, n = F.col("_relevant"), F.col("page_rank"), F.col("_n_relevant")
    if spec.name == "recall":
        return F.sum(F.when(hit & (rank <= spec.cutoff), 1.0).otherwise(0.0)) / F.first(n)
    if spec.name == "hit":
        return F.max(F.when(hit & (rank == 1), 1.0).otherwise(0.0))
    if spec.name == "mrr":
        return F.coalesce(1.0 / F.min(F.when(hit, rank)), F.lit(0.0))
    gain = lambda r: F.log(2.0, r + 1)
    found = F.sum(F.when(hit & (rank <= spec.cutoff), 1.0 / gain(rank)).otherwise(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.first(n), F.lit(spec.cutoff)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / gain(r))
    return found / best


def relevant_pages(golden: DataFrame) -> DataFrame:
    """``qid, doc_id, page_num`` of the evidence, each page once."""
    return golden.select("qid", "doc_id", F.explode("evidence_pages").alias("page_num")).distinct()


def per_question(pages: DataFrame, golden: DataFrame, specs: Sequence[str] = DEFAULT, *, top_k: int = 50, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """``by, qid, answer_type`` and one column for each metric, rounded to ``digits``; a page is (doc_id, page_num).

    Every question of ``golden`` comes out, with zeros where nothing was retrieved for it; with
    ``by`` (such as a run's label) for each value of it. A question without evidence raises.
    """
    require_empty(golden.where(F.col("evidence_pages").isNull() | (F.size("evidence_pages") < 1)).select("qid"), "questions have no relevant page")
    relevant = relevant_pages(golden)
    counts = relevant.groupBy("qid").agg(F.count("*").alias("_n_relevant"))
    questions = golden.select("qid", "answer_type").join(counts, "qid")
    if by:  # the values of ``by`` are as few as the runs that are compared
        values = [r.asDict() for r in pages.select(*by).distinct().collect()]
        every = F.explode(F.array(*[F.struct(*[F.lit(v[c]).alias(c) for c in by]) for v in values])).alias("_by") if values else F.explode(F.array().cast("array<struct<x:int>>")).alias("_by")
        questions = questions.select("*", every).select("qid", "answer_type", "_n_relevant", *[F.col(f"_by.{c}").alias(c) for c in by])
    flagged = pages.select(*by, "qid", "doc_id", "page_num", "page_rank").join(relevant.withColumn("_hit", F.lit(True)), ["qid", "doc_id", "page_num"], "left")
    joined = questions.join(flagged, [*by, "qid"], "left").withColumn("_relevant", F.coalesce("_hit", F.lit(False)))
    parsed = [parse_spec(s, top_k) for s in specs]
    return joined.groupBy(*by, "qid", "answer_type").agg(*[F.round(_value(s), digits).alias(column_name(s.text)) for s in parsed])


def mean_of_rounded(c: Column) -> Column:
    """Mean of values that have six decimals, rounded half up to six: in whole millionths, so that no order of adding changes it."""
    millionths = F.sum(F.round(c * 1_000_000).cast("long"))
    n = F.count(c)
    return F.when(n > 0, F.call_function("div", 2 * millionths + n, 2 * n).cast("double") / 1_000_000)


def grouped(metrics: DataFrame, specs: Sequence[str] = DEFAULT, *, by: tuple[str, ...] = (), groups: Sequence[str] = GROUPS) -> DataFrame:
    """``by, group, n`` and the mean of each metric, for all questions and for each answer type; a group without questions has n 0 and nulls."""
    names = [column_name(s) for s in specs]
    own = F.explode(F.array(F.lit("overall"), F.col("answer_type"))).alias("group")
    means = metrics.select(*by, own, *names).where(F.col("group").isin(*groups)).groupBy(*by, "group").agg(F.count("*").alias("n"), *[mean_of_rounded(F.col(m)).alias(m) for m in names])
    every = (metrics.select(*by).distinct() if by else metrics.sparkSession.range(1).select()).select(*by, F.explode(F.array(*[F.lit(g) for g in groups])).alias("group"))
    return every.join(means, [*by, "group"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def long_form(report: DataFrame, specs: Sequence[str] = DEFAULT, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, group, metric, value``, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(column_name(s)).alias("value")) for s in specs])).alias("m")
    return report.select(*by, "group", pairs).select(*by, "group", "m.metric", "m.value").where("value IS NOT NULL")
