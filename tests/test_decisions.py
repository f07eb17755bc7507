import pytest
from pyspark.sql import functions as F

from folioscope.operators import answers, decisions


def side(spark, values):
    return spark.createDataFrame(list(values.items()), "metric string, value double")


BASE = {"recall@10": 0.5, "ndcg@10": 0.3, "recall@50": 0.816667}


@pytest.mark.parametrize("drop, ok", [(0.02, True), (0.020001, False), (-0.1, True)])
def test_gate_at_its_edge(spark, drop, ok):
    got = decisions.gate(side(spark, BASE), side(spark, BASE | {"ndcg@10": 0.3 - drop})).collect()
    assert {r["ok"] for r in got} == {ok} and len(got) == 3
    with pytest.raises(ValueError, match="missing"):
        decisions.gate(side(spark, BASE), side(spark, {"recall@10": 1.0}))


RUN = "run string, top_k int, dirty boolean, recall_at_10 double, ndcg_at_10 double, recall_at_50 double, recall_at_k double"


def test_adoption(spark):
    base = spark.createDataFrame([("base", 50, False, 0.5, 0.3, None, 0.816667)], RUN)
    runs = [("gain", 50, False, 0.5, 0.33, 0.82, None), ("gain2", 50, False, 0.53, 0.33, None, 0.82), ("dirty", 50, True, 0.9, 0.9, 0.9, None), ("k100", 100, False, 0.6, 0.4, None, 0.9), ("drop", 50, False, 0.6, 0.4, 0.79, None), ("flat", 50, False, 0.52, 0.32, 0.816667, None)]
    got = {r["run"]: r for r in decisions.adoption(spark.createDataFrame(runs, RUN), base).collect()}
    assert {k: (r["condition1"], r["condition2"], r["adopted"]) for k, r in got.items()} == {"gain": (True, True, True), "gain2": (True, True, True), "dirty": (True, True, False), "k100": (False, True, False), "drop": (False, True, False), "flat": (True, False, False)}
    assert [k for k, r in got.items() if r["selected"]] == ["gain2"]


def page_ranks(spark, spec):
    return spark.createDataFrame([(q, "D", p, r) for q, p, r in spec], "qid string, doc_id string, page_num int, page_rank int")


def test_complementarity(spark):
    golden = spark.createDataFrame([(f"q{i}", "numeric" if i < 3 else "prose", "D", [i]) for i in (1, 2, 3, 4)], "qid string, answer_type string, doc_id string, evidence_pages array<int>")
    paired = decisions.pairs(golden, page_ranks(spark, [("q1", 1, 1), ("q3", 3, 2), ("q4", 4, 99)]), page_ranks(spark, [("q1", 1, 5), ("q2", 2, 1)]), 50)
    counts = {r["group"]: r.asDict() for r in decisions.cell_counts(paired).collect()}
    assert [counts["overall"][c] for c in decisions.CELLS] == [1, 1, 1, 1] and counts["prose"]["b_only"] == 0
    recall = {r["group"]: r for r in decisions.union_recall(paired).collect()}["overall"]
    assert (recall["recall_a"], recall["recall_b"], recall["recall_union"]) == (0.5, 0.5, 0.75)
    value = lambda v: spark.createDataFrame([("overall", v)], "`group` string, value double")
    decisions.check_consistency(value(0.5), value(0.5))
    with pytest.raises(ValueError):
        decisions.check_consistency(value(0.5), value(0.6))


def test_ablation_takes_the_first_dense_run(spark):
    rows = [("s", "sparse", 0, "overall", "mrr", 0.2), ("d", "dense", 1, "overall", "mrr", 0.25), ("d", "dense", 1, "overall", "hit@1", 0.1), ("e", "dense", 2, "overall", "mrr", 0.3)]
    reports = spark.createDataFrame(rows, "run string, backend string, position int, `group` string, metric string, value double")
    got = {(r["run"], r["metric"]): (r["value"], r["delta"]) for r in decisions.ablation(reports).collect()}
    assert got["s", "mrr"] == (0.2, -0.05) and got["s", "hit@1"] == (None, -0.1) and got["e", "mrr"] == (0.3, 0.05)
    old, new = reports.where("run = 's'"), reports.where("run = 'd'")
    assert [tuple(r) for r in decisions.compare(old, new).collect()] == [("overall", "mrr", 0.2, 0.25, 0.05)]


def test_citations(spark):
    rows = [(["b", "a", "b", "x"], ["a", "b", "c"]), ([], ["a"]), (None, None), (["x"], ["a"]), (["a"], None)]
    c = answers.citations(F.col("cited"), F.col("context"))
    got = [(r["kept"], r["dropped"], r["validity"]) for r in spark.createDataFrame(rows, "cited array<string>, context array<string>").select(c["kept"].alias("kept"), c["dropped"].alias("dropped"), c["validity"].alias("validity")).collect()]
    assert got == [(["b", "a"], ["x"], 2 / 3), ([], [], 1.0), ([], [], 1.0), ([], ["x"], 0.0), ([], ["a"], 0.0)]


def graded(spark, rows):
    return spark.createDataFrame(rows, "grade_id string, answer_hash string, human_verdict string")


def judged(spark, rows):
    return spark.createDataFrame(rows, "grade_id string, answer_hash string, verdict string")


def test_agreement(spark):
    sheet = graded(spark, [("1", "a", "correct"), ("2", "b", " Correct "), ("3", "c", "correct"), ("4", "d", "refused"), ("5", "e", ""), ("6", "f", None)])
    judge = judged(spark, [("1", "a", "correct"), ("2", "b", "correct"), ("3", "c", "incorrect")])
    r = answers.agreement(sheet, judge).first()
    assert (r["n"], r["agreement"], r["kappa"], r["disagreements"], r["refused"], r["ungraded"]) == (3, 0.666667, 0.0, 1, 1, 2)
    same = answers.agreement(sheet.where("grade_id < '3'"), judge).first()
    assert (same["agreement"], same["kappa"]) == (1.0, 1.0)
    none = answers.agreement(sheet.where("false"), judge).first()
    assert (none["n"], none["agreement"], none["kappa"]) == (0, 0.0, 0.0)
    for bad, message in ((graded(spark, [("1", "a", "perhaps")]), "not valid"), (graded(spark, [("1", "z", "correct")]), "changed"), (graded(spark, [("9", "z", "correct")]), "no judgement")):
        with pytest.raises(ValueError, match=message):
            answers.agreement(bad, judge)


def test_latency_interpolates(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 31)] + [("a", None), ("b", 2.0)], "stage string, ms double")
    assert sorted(tuple(r) for r in answers.latency(df, "stage", "ms").collect()) == [("a", 30, 15.5, 28.55), ("b", 1, 2.0, 2.0)]


def test_verdicts_are_read_strictly(spark):
    replies = ['{"verdict": "Correct", "reason": "same"}', '{"verdict": "maybe", "reason": "x"}', '{"verdict": "correct"}', "no json", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in replies], "r string").select(answers.parse_verdict(F.col("r"))).collect()]
    assert [x and x["verdict"] for x in got] == ["correct", None, None, None, None]


def test_context(spark):
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "qid string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("a", "D", 4, "one"), ("b", "D", 5, None), ("c", "D", 6, "three")], "chunk_id string, doc_id string, page_num int, text string")
    r = answers.prompt_context(ranked, chunks, 2).first()
    assert r["context"] == "[b] (D, page 5)\n\n\n[a] (D, page 4)\none" and r["context_ids"] == ["b", "a"]
