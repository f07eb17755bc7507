import json
import random
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope import reports
from folioscope.functions.hashing import content_fingerprint
from folioscope.operators import answers, backends, caches, elements, frozen, fuzzy, generation, scorers
from folioscope.settings import Rerank, Retrieval, Settings

CHUNKS = [("c1", "D", 1, "net sales rose"), ("c2", "D", 2, "cost of sales fell"), ("c3", "E", 1, "valves and films"), ("c4", "E", 2, "")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, page_num int, text string")


def questions(spark, *rows):
    return spark.createDataFrame(rows or [("q1", "net sales"), ("q2", "films")], "qid string, question string")


def vectors(spark):
    return scorers.hashed_vectors(chunks(spark), ["chunk_id"], "text", 512), scorers.hashed_vectors(questions(spark), ["qid", "question"], "question", 512)


def test_what_goes_into_an_embedder(spark):
    df = questions(spark, ("a", " why? "), ("b", None))
    assert [r[0] for r in df.select(scorers.with_instruction(F.col("question"), "Search:")).collect()] == ["Search:  why?", "Search:"]
    assert [r["n_tokens"] for r in scorers.over_length(chunks(spark), "text", 5).collect()] == [6]
    scorers.require_lengths(chunks(spark), "text", 6)
    with pytest.raises(ValueError, match="more than 5 tokens"):
        scorers.require_lengths(chunks(spark), "text", 5)


def test_embedding_goes_through_the_cache(spark):
    empty = spark.createDataFrame([], "cache_key string, vector array<double>")
    made, added = scorers.embed(chunks(spark), empty, "r1", lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    got = {r["chunk_id"]: r["vector"] for r in made.collect()}
    assert got["c1"] == pytest.approx([0.6, 0.8]) and got["c4"] == [0.0, 0.0] and added.count() == 4

    def broken():
        raise AssertionError("the cache has all")

    again, more = scorers.embed(chunks(spark), added, "r1", broken)
    assert again.count() == 4 and more.count() == 0
    with pytest.raises(Exception, match="1 vectors for"):
        scorers.embed(chunks(spark).coalesce(1), empty, "r1", lambda: lambda texts: [[1.0]])[0].collect()


def test_pair_scores(spark):
    pairs = spark.createDataFrame([("q", "c1", "net sales", "net sales rose"), ("q", "c2", "net sales", None)], "qid string, chunk_id string, question string, text string")
    assert {r["chunk_id"]: r["score"] for r in scorers.score_pairs(pairs, lambda: lambda q, t: [len(x) for x in t]).collect()} == {"c1": 14.0, "c2": 0.0}
    assert scorers.score_pairs(pairs.where("false"), lambda: 1 / 0).count() == 0
    assert [r[0] for r in pairs.select(scorers.overlap(F.col("question"), F.col("text"))).collect()] == [1.0, 0.0]


def test_frozen_vectors(spark, tmp_path):
    path, (v, q) = str(tmp_path / "v"), vectors(spark)
    frozen.freeze_dense(v, q, path, "r1")
    got = frozen.search_dense(spark, path, questions(spark, ("other", "films")), 1, "r1").collect()
    assert [(r["qid"], r["chunk_id"]) for r in got] == [("other", "c3")]  # found by its text
    with pytest.raises(ValueError, match="no frozen vector"):
        frozen.search_dense(spark, path, questions(spark, ("q1", "unheard of")), 1, "r1")
    with pytest.raises(ValueError, match="another manifest"):
        frozen.search_dense(spark, path, questions(spark), 1, "r2")


def test_frozen_rankings_and_scores(spark, tmp_path):
    ranked = spark.createDataFrame([("q1", "c1", 2.0, 1), ("q1", "c2", 1.0, 2)], "qid string, chunk_id string, score double, rank int")
    frozen.freeze_ranking(ranked, str(tmp_path / "r"), "r1")
    assert frozen.search_ranking(spark, str(tmp_path / "r"), questions(spark, ("q1", "")), 1, "r1").count() == 1
    for asked, k in ((questions(spark), 1), (questions(spark, ("q1", "")), 3)):
        with pytest.raises(ValueError):
            frozen.search_ranking(spark, str(tmp_path / "r"), asked, k, "r1")
    frozen.freeze_scores(ranked.where("rank = 1"), str(tmp_path / "s"), "m1")
    assert frozen.rerank(spark, str(tmp_path / "s"), ranked.where("rank = 1"), "m1").count() == 1
    with pytest.raises(ValueError, match="no score"):
        frozen.rerank(spark, str(tmp_path / "s"), ranked, "m1")
    with pytest.raises(ValueError, match="another manifest"):
        frozen.rerank(spark, str(tmp_path / "s"), ranked, "m2")


def test_backends_follow_the_settings(spark, tmp_path):
    v, q = vectors(spark)
    corpus = backends.Corpus(chunks(spark), v, q, index=str(tmp_path / "i"), frozen=str(tmp_path / "f"), revision="r1", pair_scores=lambda pairs: pairs.select("qid", "chunk_id", F.when(F.col("chunk_id") == "c4", 9.0).otherwise(1.0).alias("score")))
    at = lambda name, k=4: Settings(retrieval=Retrieval(name, k))
    first = lambda s, c=corpus: {r["qid"]: r["chunk_id"] for r in backends.retrieve(s, c, questions(spark)).where("rank = 1").collect()}
    assert first(at("sparse")) == first(at("dense")) == first(at("hybrid")) == first(at("sparse"), replace(corpus, index=None)) == {"q1": "c1", "q2": "c3"}
    assert first(replace(at("sparse"), rerank=Rerank(True, 2))) == {"q1": "c4", "q2": "c4"}
    frozen.freeze_ranking(backends.retrieve(at("sparse"), corpus, questions(spark)), str(tmp_path / "f"), "r1")
    assert first(at("frozen")) == {"q1": "c1", "q2": "c3"}
    for name in ("dense", "frozen"):
        with pytest.raises(ValueError, match="needs"):
            first(at(name), backends.Corpus(chunks(spark)))
    golden = questions(spark).withColumn("answer_type", F.lit("prose")).withColumn("doc_id", F.when(F.col("qid") == "q1", "D").otherwise("E")).withColumn("evidence_pages", F.array(F.lit(1)))
    assert {r["mrr"] for r in backends.evaluate(at("sparse"), corpus, golden).collect()} == {1.0}
    odd = spark.createDataFrame([("q1", "gone", 1.0, 1)], "qid string, chunk_id string, score double, rank int")
    assert [tuple(r) for r in backends.pages(odd, chunks(spark)).collect()] == [("q1", "", 0, 1)]


def test_fuzzy_ratios(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))

    def lcs(a, b):
        @lru_cache(None)
        def go(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

        return go(0, 0)

    for _ in range(60):
        a, b = word(rng.randrange(12)), word(rng.randrange(25))
        assert fuzzy.common(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        want = max((fuzzy.ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0
        assert fuzzy.partial_ratio(a, b) == pytest.approx(want)
    assert fuzzy.partial_ratio("net sales", "then net sales rose") == 100.0 and fuzzy.ratio("", "") == 100.0
    assert fuzzy.token_set_ratio("sales net", "Net sales of valves") == 100.0 and fuzzy.token_set_ratio("", "x") == 0.0 and 0 < fuzzy.token_set_ratio("net sales", "net profit") < 100
    g = spark.createDataFrame([("q", "D", [2], "net sales rose in Oriva"), ("n", "D", [1], None)], "qid string, doc_id string, evidence_pages array<int>, evidence_text string")
    pages = spark.createDataFrame([("D", 1, "other words " * 40), ("D", 2, "in oriva net sales rose by far " * 20), ("D", 3, "net sales rose in oriva")], "doc_id string, page_num int, text string")
    assert [tuple(r) for r in fuzzy.best_page(g, pages).collect()] == [("q", 2, 100.0, True)]  # the third page is too short


def test_elements(spark):
    raw = spark.createDataFrame([("D", 0, "title", "Head", [2, 1, 2, None]), ("D", 1, "table", None, None)], "doc_id string, element_index int, label string, text string, provenance array<int>")
    got = elements.records(raw).orderBy("element_index").collect()
    assert [(r["page_num"], r["pages"], r["multi_page"], r["element_type"], r["text"]) for r in got] == [(1, [1, 2], True, "heading", "Head"), (None, [], False, "table", "")]
    assert {tuple(r) for r in elements.span_counts(elements.records(raw)).collect()} == {("heading", 2, 1), ("table", 0, 1)}
    spans = spark.createDataFrame([(None, 1, 3), (4, 0, 1), (None, None, None), (0, 0, 0)], "s int, a int, b int")
    assert [r[0] for r in spans.select(elements.grid_span(F.col("s"), F.col("a"), F.col("b"))).collect()] == [2, 4, 1, 1]


def test_latency_is_exact(spark):
    rng = random.Random(7)
    values = {"a": [rng.lognormvariate(3, 2) for _ in range(501)], "b": [5.0] * 400 + [1.0], "c": [2.5], "d": [rng.random() for _ in range(4)], "e": [-1e300, 0.0, 1e-300, 1e300]}
    rows = [(s, v) for s, own in values.items() for v in own] + [("a", None), ("a", float("nan"))]
    for bins in (4096, 3):
        got = {r["stage"]: (r["n"], r["p50"], r["p95"]) for r in answers.latency(spark.createDataFrame(rows, "stage string, ms double"), "stage", "ms", bins=bins).collect()}
        for s in "abcd":
            assert got[s] == (len(values[s]), pytest.approx(np.percentile(values[s], 50), abs=0.006), pytest.approx(np.percentile(values[s], 95), abs=0.006)), s
        assert got["e"][0] == 4
    assert answers.latency(spark.createDataFrame([], "stage string, ms double"), "stage", "ms").count() == 0


def test_timer():
    clock = iter(range(0, 100)).__next__
    timer = reports.Timer(clock=lambda: float(clock()))
    for _ in range(3):
        with timer.step("retrieve"):
            pass
    with timer.step("replay", replayed=True):
        pass
    assert timer.samples == [("retrieve", 1000.0)] * 2  # the first one warmed up


def test_texts_of_results(spark):
    gate = spark.createDataFrame([("mrr", 0.5, 0.4, -0.1, True, False), ("recall@10", 0.5, 0.6, 0.1, False, False)], "metric string, baseline double, current double, delta double, regressed boolean, ok boolean")
    assert reports.gate_text(gate) == "gate: FAILED\nmrr: 0.5000 -> 0.4000 (-0.1000) REGRESSED\nrecall@10: 0.5000 -> 0.6000 (+0.1000) ok"
    runs = spark.createDataFrame([(True, True, True), (False, False, True), (False, True, False), (False, True, True)], "dirty boolean, condition1 boolean, condition2 boolean")
    assert [bool(r[0]) for r in runs.select(reports.why_not()).collect()] == [True, True, True, False]
    assert reports.table_text(spark.createDataFrame([("a", 1.5), (None, 2.0)], "name string, x double"), order=["x"]) == "name  x\n----  ---\na     1.5\n      2"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "tier1_bm25" in capsys.readouterr().out
    assert cli.main(["config"]) == 0 and capsys.readouterr().out.split()[1] == "dense"
    for name, value in (("base", 0.5), ("same", 0.5), ("worse", 0.4)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"metrics": {"overall": {m: value for m in ("recall@10", "ndcg@10", "recall@50")}}}))
    call = lambda name: cli.main(["gate", str(tmp_path / "base.json"), str(tmp_path / f"{name}.json")])
    assert call("same") == 0 and call("worse") == 1 and "REGRESSED" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/nowhere"]) == 2


def test_retries_and_quota():
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert generation.retrying(flaky, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        generation.retrying(lambda p: (_ for _ in ()).throw(OSError("down")), attempts=2, sleep=waits.append)("p")
    before = len(waits)
    with pytest.raises(generation.QuotaExhausted):
        generation.retrying(lambda p: (_ for _ in ()).throw(generation.QuotaExhausted()), sleep=waits.append)("p")
    assert len(waits) == before


def test_faithfulness(spark):
    rows = [("a", "net sales rose sharply", ["c1"], ["c1"]), ("b", "net sales", ["zz"], ["c1"]), ("c", None, ["c1"], ["c1"]), ("d", "x", None, None)]
    df = spark.createDataFrame(rows, "grade_id string, generated_answer string, cited_ids array<string>, context_ids array<string>")
    assert {r[0]: r[1] for r in answers.faithfulness(df, chunks(spark)).collect()} == {"a": 0.75, "b": 0.0, "c": 0.0, "d": 0.0}
    records = spark.createDataFrame([("g1", "q", "gold", "right", ["c"], ["c"], False), ("g2", "q", "gold", "uncited", [], ["c"], False), ("g3", "q", "gold", "declines", ["c"], ["c"], True)], "grade_id string, question string, gold_answer string, generated_answer string, cited_ids array<string>, context_ids array<string>, refused boolean")
    judged, _ = generation.judge(records, spark.createDataFrame([], "judgment_key string, reply string"), lambda p: json.dumps({"verdict": "correct", "reason": "r", "faithfulness": 0.5}), "j")
    assert {r["grade_id"]: r["faithfulness"] for r in judged.collect()} == {"g1": 0.5, "g2": 0.0}


def test_fingerprints_and_tickers(spark):
    one = lambda df: content_fingerprint(df, "chunk_id", "text").first()["content_fingerprint"]
    base = chunks(spark)
    assert one(base) == one(base.orderBy(F.desc("chunk_id")).repartition(3))
    others = [base.where("chunk_id <> 'c1'"), base.withColumn("text", F.concat("text", F.lit("."))), base.unionByName(base.limit(1)), base.withColumn("text", F.nullif("text", F.lit(""))), base.where("false")]
    assert len({one(x) for x in [base, *others]}) == 6
    known = spark.createDataFrame([("velmora", "VEL")], "name string, ticker string")
    rows = lambda c: spark.createDataFrame([("D", c)], "doc_id string, company string")
    assert caches.with_tickers(rows(" VELMORA"), known).first()["ticker"] == "VEL"
    with pytest.raises(ValueError, match="no ticker"):
        caches.with_tickers(rows("Oriva"), known)


def test_a_ranking_is_made_once_for_reranking(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def backend(s, c, asked):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return asked.selectExpr("qid", "'c1' AS chunk_id", "1.0D AS score", "1 AS rank").mapInArrow(run, "qid string, chunk_id string, score double, rank int")

    monkeypatch.setitem(backends.BACKENDS, "sparse", backend)
    s = replace(Settings(), retrieval=Retrieval("sparse", 3), rerank=Rerank(True, 2))
    overlaps = lambda pairs: pairs.select("qid", "chunk_id", scorers.overlap(F.col("question"), F.col("text")).alias("score"))
    got = backends.retrieve(s, backends.Corpus(chunks(spark), pair_scores=overlaps), questions(spark)).collect()
    assert sorted((r["qid"], r["rank"]) for r in got) == [("q1", 1), ("q2", 1)] and made.value == 2
