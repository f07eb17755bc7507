import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import bm25, dense, metrics, ranking
from folioscope.operators import golden as golden_questions
from folioscope.operators.best import Best
from folioscope.operators.ranks import number_within

CORPUS = ["the acquisition of xilinx closed", "revenue growth was strong", "dividend per share", "tax rate fell", "", "net sales and revenue", "xilinx products", "growth of the dividend"]


def chunks(spark, texts=CORPUS):
    return spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)] or [], "chunk_id string, text string")


def brute(texts, question, k, p=bm25.Bm25()):
    docs = [[t for t in __import__("re").findall(bm25.TOKEN, (x or "").lower()) if t not in p.stopwords] for x in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: bm25.okapi_idf(n, c) for t, c in df.items()}
    floor = p.epsilon * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    terms = [t for t in __import__("re").findall(bm25.TOKEN, question.lower()) if t in idf and t not in p.stopwords]
    scores = [sum(idf[t] * d.count(t) * (p.k1 + 1) / (d.count(t) + p.k1 * (1 - p.b + p.b * len(d) / avg)) for t in terms if t in d) for d in docs]
    order = sorted(range(n), key=lambda i: (-round(scores[i], 9), f"{i:03}"))[:k]
    return [f"{i:03}" for i in order]


def ranked(df, qid):
    return [r["chunk_id"] for r in sorted(df.where(f"qid = '{qid}'").collect(), key=lambda r: r["rank"])]


QUESTIONS = [("q1", "XILINX acquisition"), ("q2", "revenue growth growth"), ("q3", "nothing here matches zzz"), ("q4", None), ("q5", "the the of")]


@pytest.mark.parametrize("most", [bm25.BLOCK, 2])
@pytest.mark.parametrize("p", [bm25.Bm25(), bm25.Bm25(k1=1.2, b=0.3, stopwords=("the", "of"))])
def test_bm25_in_one_block_and_more_against_brute_force(spark, monkeypatch, most, p):
    monkeypatch.setattr(bm25, "BLOCK", most)
    questions = spark.createDataFrame(QUESTIONS, "qid string, question string")
    out = bm25.retrieve(chunks(spark), questions, 5, p)
    for qid, q in QUESTIONS:
        assert ranked(out, qid) == brute(CORPUS, q or "", 5, p), qid


@pytest.mark.parametrize("most", [bm25.BLOCK, 2])
def test_chunks_that_match_nothing_come_before_negative_scores(spark, monkeypatch, most):
    monkeypatch.setattr(bm25, "BLOCK", most)
    texts = ["net sales tax", "net tax tax sales", "sales net tax", "net sales sales tax", "zzz", "net tax sales net", "tax net sales net"]  # nearly all chunks have most terms: the mean idf is negative
    questions = spark.createDataFrame([("q", "net sales"), ("r", "zzz net")], "qid string, question string")
    out = bm25.retrieve(chunks(spark, texts), questions, 4)
    assert out.where("qid = 'q' AND score < 0").count() and ranked(out, "q") == brute(texts, "net sales", 4) and ranked(out, "q")[0] == "004"
    assert ranked(out, "r") == brute(texts, "zzz net", 4)


def test_bm25_of_chunks_that_match_only(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SCORED", 7)
    monkeypatch.setattr(bm25, "ROWS", 16)
    monkeypatch.setattr(bm25, "OFTEN", 0.2)
    monkeypatch.setattr(bm25, "scores_by_postings", lambda *a, **k: pytest.fail("a row for each term that a question and a chunk share"))
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(words[int(i)] for i in rng.geometric(0.15, n) % 25)
    texts, asked = [text(int(rng.integers(0, 9))) for _ in range(120)], [text(int(rng.integers(0, 6))) for _ in range(40)]
    questions = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "qid string, question string")
    got = {}
    for r in bm25.retrieve(chunks(spark, texts).repartition(6), questions, 5, matching=True).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["chunk_id"]
    for i, q in enumerate(asked):
        want = [c for c in brute(texts, q, len(texts)) if set(q.split()) & set(texts[int(c)].split())][:5]
        assert [c for _, c in sorted(got.get(f"q{i}", {}).items())] == want, q
    every = bm25.retrieve(chunks(spark, texts).repartition(6), questions, 5).collect()
    assert all([r["chunk_id"] for r in sorted((r for r in every if r["qid"] == f"q{i}"), key=lambda r: r["rank"])] == brute(texts, q, 5) for i, q in enumerate(asked))


def test_the_best_of_many_batches_with_ties():
    rng = np.random.default_rng(3)
    scores, best, seen = rng.integers(-3, 4, 500) / 2.0, Best(2, 7, 9), []
    for at in range(0, 500, 60):
        keys = np.array([f"{i:03}" for i in range(at, min(500, at + 60))], dtype=object)
        best.add(1, keys, scores[at : at + 60])
        seen += [*zip(-scores[at : at + 60], keys)]
    q, keys, got = best.entries()
    assert set(q) == {1} and sorted(zip(-got, keys)) == sorted(seen)[:7]
    assert [len(x) for x in Best(3, 2, 9).entries()] == [0, 0, 0]


def test_bm25_over_small_tables(spark):
    questions = spark.createDataFrame([("q", "tax")], "qid string, question string")
    assert bm25.retrieve(chunks(spark).where("false"), questions, 3).count() == 0
    assert bm25.retrieve(chunks(spark), questions.where("false"), 3).count() == 0
    assert ranked(bm25.retrieve(chunks(spark, ["tax", "tax", None]), questions, 9), "q") == brute(["tax", "tax", None], "tax", 9)
    with pytest.raises(ValueError):
        bm25.retrieve(chunks(spark), questions, 0)


@pytest.mark.parametrize("most", [dense.BROADCAST_QUERIES, 0])
def test_dense(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 2)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 3.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("a", [5.0, 0.1]), ("z", None)], "qid string, vector array<float>")
    assert ranked(dense.nearest(v, q, 3), "a") == ["a", "c", "b"]
    assert ranked(dense.nearest(v, q, 4, exclude_self=True), "a") == ["c", "b", "e"]
    assert dense.nearest(v, q.where("false"), 2).count() == 0 == dense.nearest(v.where("false"), q, 2).count()


def test_dense_over_many_parts_shuffles_few_entries_and_misses_none(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 70)
    monkeypatch.setattr(dense, "TILE", (16, 30))
    rng = np.random.default_rng(8)
    v, q = rng.integers(0, 3, (400, 5)).astype(float), rng.integers(0, 3, (200, 5)).astype(float)  # many ties, some zero vectors
    table = lambda m, name: spark.createDataFrame([(f"{i:04}", x.tolist()) for i, x in enumerate(m)], f"{name} string, vector array<double>")
    vectors, asked = table(v, "chunk_id").repartition(40), table(q, "qid")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(q) @ unit(v).T, 9) + 0.0
    want = {(f"{i:04}", n, f"{j:04}") for i, row in enumerate(scores) for n, j in enumerate(np.argsort(-row, kind="stable")[:7], 1)}
    assert {(r["qid"], r["rank"], r["chunk_id"]) for r in dense.nearest(vectors, asked, 7).collect()} == want
    rows = lambda df, key: df.select(F.col(key).alias("q" if key == "qid" else "key"), F.col("vector").alias("v"))
    assert dense._broadcast(rows(vectors, "chunk_id"), rows(asked, "qid"), 7, "q string, key string, score double", 9, False).count() < 10 * 7 * len(q)  # of 40 parts each gave its own 7 before


def lists(spark, pages, name="q"):
    return spark.createDataFrame([(name, f"{p:03}", i + 1, 1 - 0.1 * i) for i, p in enumerate(pages)], "qid string, chunk_id string, rank int, score double")


def test_questions_that_ask_for_the_same_are_scored_once(spark, monkeypatch):
    scored = []
    plain = bm25.grid
    for module in (bm25, dense):
        monkeypatch.setattr(module, "grid", lambda n, most, cores: scored.append(n) or plain(n, most, cores))
    words = ["net", "sales", "rose", "fell", "cost"]
    chunks = spark.createDataFrame([(f"c{i:03}", " ".join(words[(i * j) % 5] for j in range(1 + i % 7))) for i in range(300)], "chunk_id string, text string")
    questions = spark.createDataFrame([(f"q{i}", " ".join(words[: 1 + i % 3][:: 1 if i < 6 else -1])) for i in range(12)], "qid string, question string")
    ranked = {}
    for r in bm25.retrieve(chunks, questions, 4).orderBy("qid", "rank").collect():
        ranked.setdefault(r["qid"], []).append((r["chunk_id"], r["score"]))
    alone = bm25.retrieve(chunks, questions.where("qid = 'q2'"), 4).orderBy("rank").collect()
    assert scored[0] == 3 and len(ranked) == 12 and all(ranked[f"q{i}"] == ranked[f"q{i % 3}"] for i in range(12))
    assert ranked["q2"] == [(r["chunk_id"], r["score"]) for r in alone] and len(alone) == 4
    scored.clear()
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i % 2), 0.5]) for i in range(8)], "qid int, vector array<double>")
    near = {}
    for r in dense.nearest(vectors, asked, 3, exclude_self=True).orderBy("qid", "rank").collect():
        near.setdefault(r["qid"], []).append(r["chunk_id"])
    v = {r["chunk_id"]: np.array(r["vector"]) for r in vectors.collect()}
    cosine = lambda q, c: round(float(q @ v[c] / np.linalg.norm(q) / np.linalg.norm(v[c])), 9)
    want = {i: sorted((c for c in v if c != i), key=lambda c: (-cosine(np.array([1.0, i % 2, 0.5]), c), c))[:3] for i in range(8)}
    assert scored == [2] and near == want


def test_fusion(spark):
    fused = ranking.fuse(lists(spark, [1, 2]), lists(spark, [2, 3]))
    assert ranked(fused, "q") == ["002", "001", "003"]
    assert math.isclose(fused.where("rank = 1").first()["score"], 1 / 62 + 1 / 61)
    twice = ranking.fuse(lists(spark, [1, 2, 1]), lists(spark, [2]))
    assert math.isclose(twice.where("chunk_id = '001'").first()["score"], 1 / 61)
    a, b = lists(spark, range(50)), lists(spark, range(50, 100))
    assert sorted(ranked(ranking.hybrid(a, b, 50, sparse_weight=0.5), "q")) == [f"{i:03}" for i in range(50)]
    assert ranking.fuse(a, b).count() == 100
    assert ranking.fuse(a.where("false"), b.where("false")).count() == 0


def test_rerank(spark):
    pool = lists(spark, [0, 1, 2])
    score = lambda s: spark.createDataFrame([("q", f"{i:03}", x) for i, x in enumerate(s)], "qid string, chunk_id string, score double")
    assert ranked(ranking.rerank(pool, score([0.1, 0.2, 9.9]), top=2), "q") == ["002", "001"]
    assert ranked(ranking.rerank(pool, score([1.0, 1.0, 1.0])), "q") == ["000", "001", "002"]
    with pytest.raises(ValueError, match="no score"):
        ranking.rerank(pool, score([1.0]))


def test_replay(spark):
    frozen, q = lists(spark, [3, 1, 2]), spark.createDataFrame([("q",)], "qid string")
    assert ranked(ranking.replay(frozen, q, 2), "q") == ["003", "001"]
    with pytest.raises(ValueError, match="frozen to 3"):
        ranking.replay(frozen, q, 4)
    with pytest.raises(ValueError, match="no frozen"):
        ranking.replay(frozen, spark.createDataFrame([("other",)], "qid string"), 1)


def pages(spark, spec):
    return spark.createDataFrame([(q, d, p, i + 1) for q, ps in spec.items() for i, (d, p) in enumerate(ps)], "qid string, doc_id string, page_num int, rank int")


def golden(spark, rows):
    return spark.createDataFrame(rows, "qid string, answer_type string, doc_id string, evidence_pages array<int>")


def test_collapse(spark):
    out = ranking.collapse_to_pages(pages(spark, {"q": [("D", p) for p in (52, 10, 52, 20, 30, 40, 52)]})).orderBy("page_rank").collect()
    assert [r["page_num"] for r in out] == [52, 10, 20, 30, 40]


def scores(spark, spec, rows, specs=metrics.DEFAULT, k=50):
    out = metrics.per_question(ranking.collapse_to_pages(pages(spark, spec)), golden(spark, rows), specs, top_k=k)
    return {r["qid"]: r.asDict() for r in out.collect()}


def test_metrics_by_hand(spark):
    got = scores(spark, {"a": [("D", p) for p in (5, 6, 7)], "b": [("D", i) for i in range(1, 12)], "w": [("E", 56), ("D", 99)], "m": [("D", 1), ("D", 9), ("D", 2)]}, [("a", "numeric", "D", [7]), ("b", "prose", "D", [11]), ("w", "prose", "D", [56]), ("n", "prose", "D", [1]), ("m", "numeric", "D", [1, 2, 3, 4])])
    assert got["a"]["mrr"] == 0.333333 and got["a"]["hit_at_1"] == 0.0 and got["a"]["ndcg_at_10"] == 0.5
    assert got["b"]["recall_at_10"] == 0.0 and got["b"]["recall_at_k"] == 1.0
    assert all(got[q][c] == 0.0 for q in "wn" for c in ("mrr", "hit_at_1", "recall_at_50", "ndcg_at_10"))
    ideal = sum(1 / math.log2(i + 1) for i in range(1, 5))
    assert got["m"]["recall_at_10"] == 0.5 and got["m"]["hit_at_1"] == 1.0
    assert got["m"]["ndcg_at_10"] == round((1 + 1 / math.log2(4)) / ideal, 6)
    assert scores(spark, {"a": [("D", 7)]}, [("a", "x", "D", [1, 7, 8])], ("recall@100",))["a"]["recall_at_100"] == 0.333333


def test_metrics_need_evidence_and_known_names(spark):
    with pytest.raises(ValueError, match="no relevant"):
        scores(spark, {"a": [("D", 1)]}, [("a", "x", "D", [])])
    for bad in ("precision@3", "recall@0"):
        with pytest.raises(ValueError):
            metrics.parse_spec(bad, 10)
    assert metrics.parse_spec("recall@k", 7).cutoff == 7 and metrics.parse_spec("hit@1", 7).cutoff is None


def test_groups(spark):
    per = spark.createDataFrame([("a", "numeric", 0.333333), ("b", "numeric", 0.0), ("c", "numeric", 1.0)], "qid string, answer_type string, mrr double")
    got = {r["group"]: (r["n"], r["mrr"]) for r in metrics.grouped(per, ["mrr"]).collect()}
    assert got == {"overall": (3, 0.444444), "numeric": (3, 0.444444), "prose": (0, None)}
    assert metrics.grouped(per.where("qid < 'c'"), ["mrr"], groups=["overall"]).first()["mrr"] == 0.166667


def test_positions_in_hot_groups_are_those_of_a_plain_window(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"g{i % 7}", int(rng.integers(0, 9)) if i % 11 else None, f"k{i:04}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, score int, key string")
    order = [F.col("score").desc_nulls_last(), F.col("key")]
    plain = number_within(df, ["g"], order, "rank", plain_bytes=1 << 60)
    cut = number_within(df, ["g"], order, "rank", hot_rows=50, plain_bytes=0)
    assert cut.schema["rank"].dataType == plain.schema["rank"].dataType
    assert sorted(map(repr, cut.select("g", "score", "key", "rank").collect())) == sorted(map(repr, plain.select("g", "score", "key", "rank").collect()))
    assert number_within(df.where("false"), ["g"], order, "rank", plain_bytes=0).count() == 0


@pytest.mark.parametrize("plain", [0, 1 << 60])
def test_the_best_page_with_and_without_meeting_every_page_against_brute_force(spark, plain):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    pages = [(f"D{i % 3}", i // 3, text(int(rng.integers(0, 14)))) for i in range(60)]
    asked = [(f"q{i}", f"D{i % 4}", [int(rng.integers(0, 25)), 2], text(int(rng.integers(0, 9))) if i % 9 else "zzz") for i in range(40)]
    g = spark.createDataFrame(asked, "qid string, doc_id string, evidence_pages array<int>, evidence_text string")
    got = {r["qid"]: (r["best_page"], r["score"], r["agrees"]) for r in golden_questions.best_page(g, spark.createDataFrame(pages, "doc_id string, page_num int, text string"), plain_bytes=plain).collect()}
    want = {}
    for qid, doc, labels, evidence in asked:
        w = set(evidence.split())
        scored = [(-round(len(w & set(t.split())) / len(w), 6), p) for d, p, t in pages if d == doc] if w else []
        if scored:
            want[qid] = (min(scored)[1], -min(scored)[0], min(scored)[1] in labels)
    assert got == want
