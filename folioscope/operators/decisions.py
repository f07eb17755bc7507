"""Decisions over reports: regression gate, adoption rule, complementarity of two runs, differences to a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.guards import require_empty
from folioscope.operators.metrics import mean_of_rounded, relevant_pages

GATED = ("recall@10", "ndcg@10", "recall@50")


def gate(baseline: DataFrame, current: DataFrame, *, metrics: tuple[str, ...] = GATED, tolerance: float = 0.02) -> DataFrame:
    """``metric, baseline, current, delta, regressed, ok``: one row for each gated metric; ``ok`` is of them all.

    Both sides are ``metric, value``. A metric regresses if it fell by more than ``tolerance``, at
    six decimals; one that is missing on a side raises.
    """
    named = baseline.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    sides = named.join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left").join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    require_empty(sides.where("baseline IS NULL OR current IS NULL"), "gated metrics are missing")
    checked = sides.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 6)).withColumn("regressed", F.round(F.col("baseline") - F.col("current"), 6) > tolerance)
    return checked.withColumn("ok", ~F.max("regressed").over(Window.partitionBy(F.lit(0))))  # over the gated metrics


def adoption(runs: DataFrame, baseline: DataFrame, *, tolerance: float = 0.02) -> DataFrame:
    """``run, dirty, d_recall_10, d_ndcg_10, d_recall_50, condition1, condition2, adopted, selected`` of each candidate run.

    ``runs`` has ``run, top_k, dirty`` and ``recall_at_10, ndcg_at_10, recall_at_50, recall_at_k`` (nullable);
    ``baseline`` is one row of the metrics. Recall at 50 is ``recall_at_k`` where that is missing and
    the run's ``top_k`` is 50; for the baseline always. Condition 1: none of the three fell by more than the
    tolerance, a missing one fails. Condition 2: recall or ndcg at 10 rose by more. Runs from a dirty
    tree are judged but never adopted. Of the adopted, ``selected`` has the highest gain in ndcg, then in recall, then the first label.
    """
    base = baseline.first()
    base50 = base["recall_at_50"] if base["recall_at_50"] is not None else base["recall_at_k"]
    current50 = F.coalesce("recall_at_50", F.when(F.col("top_k") == 50, F.col("recall_at_k")))
    d = lambda now, then: F.round(now - F.lit(then), 6)
    judged = runs.select(
        "run",
        "dirty",
        d(F.col("recall_at_10"), base["recall_at_10"]).alias("d_recall_10"),
        d(F.col("ndcg_at_10"), base["ndcg_at_10"]).alias("d_ndcg_10"),
        d(current50, base50).alias("d_recall_50"),
    )
    held = lambda c: F.coalesce(F.col(c) >= -tolerance, F.lit(False))
    rose = lambda c: F.coalesce(F.col(c) > tolerance, F.lit(False))
    ruled = judged.withColumn("condition1", held("d_recall_10") & held("d_ndcg_10") & held("d_recall_50")).withColumn("condition2", rose("d_recall_10") | rose("d_ndcg_10"))
    ruled = ruled.withColumn("adopted", F.col("condition1") & F.col("condition2") & ~F.col("dirty"))
    order = Window.partitionBy("adopted").orderBy(F.desc("d_ndcg_10"), F.desc("d_recall_10"), "run")  # one row for each run that is compared
    return ruled.withColumn("selected", F.col("adopted") & (F.row_number().over(order) == 1))


CELLS = ("both", "a_only", "b_only", "neither")


def pairs(golden: DataFrame, pages_a: DataFrame, pages_b: DataFrame, k: int) -> DataFrame:
    """``qid, doc_id, page_num, answer_type, rank_a, rank_b, cell``: each relevant page with its rank in two runs, null where it is not."""
    relevant = relevant_pages(golden).join(golden.select("qid", "answer_type"), "qid")
    on = ["qid", "doc_id", "page_num"]
    a = pages_a.select(*on, F.col("page_rank").alias("rank_a"))
    b = pages_b.select(*on, F.col("page_rank").alias("rank_b"))
    inside = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    cell = F.when(inside("rank_a") & inside("rank_b"), "both").when(inside("rank_a"), "a_only").when(inside("rank_b"), "b_only").otherwise("neither")
    return relevant.join(a, on, "left").join(b, on, "left").withColumn("cell", cell)


def cell_counts(paired: DataFrame) -> DataFrame:
    """``group`` and the number of pairs in each cell, zeros included, overall and by answer type."""
    own = F.explode(F.array(F.lit("overall"), F.col("answer_type"))).alias("group")
    return paired.select(own, "cell").groupBy("group").agg(*[F.count_if(F.col("cell") == c).alias(c) for c in CELLS])


def union_recall(paired: DataFrame) -> DataFrame:
    """``group, n, recall_a, recall_b, recall_union``: means over questions of recalls rounded to six decimals."""
    a, b = F.col("cell").isin("both", "a_only"), F.col("cell").isin("both", "b_only")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    each = paired.groupBy("qid", "answer_type").agg(share(a).alias("a"), share(b).alias("b"), share(a | b).alias("u"))
    own = F.explode(F.array(F.lit("overall"), F.col("answer_type"))).alias("group")
    return each.select(own, "a", "b", "u").groupBy("group").agg(F.count("*").alias("n"), mean_of_rounded(F.col("a")).alias("recall_a"), mean_of_rounded(F.col("b")).alias("recall_b"), mean_of_rounded(F.col("u")).alias("recall_union"))


def check_consistency(recomputed: DataFrame, reported: DataFrame, *, tolerance: float = 1e-6) -> None:
    """Raises if a recomputed ``group, value`` is farther from the reported one than ``tolerance``, or missing."""
    both = reported.select("group", F.col("value").alias("reported")).join(recomputed.select("group", F.col("value").alias("again")), "group", "left")
    require_empty(both.where(F.col("again").isNull() | (F.abs(F.col("again") - F.col("reported")) > tolerance)), "recomputed metrics differ from the report")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """``group, metric, old, new, delta`` of the metrics that both reports (``group, metric, value``) have."""
    joined = old.select("group", "metric", F.col("value").alias("old")).join(new.select("group", "metric", F.col("value").alias("new")), ["group", "metric"])
    return joined.withColumn("delta", F.round(F.col("new") - F.col("old"), 6))


def ablation(reports: DataFrame, *, baseline: str | None = None) -> DataFrame:
    """``run, group, metric, value, delta`` of every run against the baseline.

    ``reports`` has ``run, backend, position, group, metric, value``. The baseline is the run named, else the first
    dense one by position, else the first. A metric that a run lacks has a null value and a delta as if it were 0.
    """
    if baseline is None:
        order = F.struct(F.when(F.col("backend") == "dense", 0).otherwise(1), "position", "run")
        first = reports.agg(F.min_by("run", order)).first()
        baseline = first[0]
    runs, cells = reports.select("run").distinct(), reports.where(F.col("run") == baseline).select("group", "metric", F.col("value").alias("_base"))
    # both sides are as small as a report: the runs compared, and one run's metrics
    every = runs.select("run", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in cells.collect()])).alias("c")).select("run", "c.*")
    joined = every.join(reports.select("run", "group", "metric", "value"), ["run", "group", "metric"], "left")
    return joined.select("run", "group", "metric", "value", F.round(F.coalesce("value", F.lit(0.0)) - F.col("_base"), 6).alias("delta"))
