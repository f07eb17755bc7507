import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope import settings as S
from folioscope.operators import bm25, caches, generation, golden
from folioscope.sources import files, sinks, versions
from folioscope.streaming import index


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("retrieval: {backend: hybrid, top_k: 100}\nfusion: {sparse_weight: 0.5}\n")
    s = S.load(str(tmp_path / "a.yaml"), {"FOLIOSCOPE_RETRIEVAL__TOP_K": "20", "FOLIOSCOPE_RERANK__ENABLED": "true", "HOME": "/"})
    assert (s.retrieval.backend, s.retrieval.top_k, s.rerank.enabled) == ("hybrid", 20, True)
    assert S.run_label(s) == "hybrid sw0.5 rerank k20" and S.run_label(S.Settings()) == "dense"
    assert S.config_hash(s) != S.config_hash(S.Settings()) == S.config_hash(S.load(environ={}))
    assert S.canonical_json({"b": (1, 2), "a": tmp_path / "x"}).startswith('{"a":"/')
    for bad in ({"FOLIOSCOPE_RETRIEVAL__NOPE": "1"}, {"FOLIOSCOPE_CHUNKING__OVERLAP": "9999"}, {"FOLIOSCOPE_RETRIEVAL__BACKEND": "x"}):
        with pytest.raises(ValueError):
            S.load(environ=bad)


def test_files(spark, tmp_path):
    (tmp_path / "golden.jsonl").write_text('{"qid": "q1", "evidence_pages": [1, 2], "question": "x"}\n\n{"qid": "q2"}\n')
    assert [tuple(r) for r in files.read_golden(spark, str(tmp_path / "golden.jsonl")).select("qid", "evidence_pages").orderBy("qid").collect()] == [("q1", [1, 2]), ("q2", None)]
    (tmp_path / "D.layout.jsonl").write_text('{"doc_id": "D", "element_type": "text", "text": "b", "element_index": 1, "page_num": 1, "pages": [1, 2]}\n\n{"doc_id": "D", "text": "a", "page_num": 1}\n')
    elements = files.read_elements(spark, str(tmp_path / "*.layout.jsonl"))
    assert sorted(tuple(r) for r in files.page_credit(elements).collect()) == [("D", 1, "a\nb"), ("D", 2, "b")]
    assert [r[0] for r in files.documents_in(spark, str(tmp_path), ".layout.jsonl").collect()] == ["D"]
    (tmp_path / "words.txt").write_text("# list\nThe\n\nof\nthe\n")
    assert files.read_words(str(tmp_path / "words.txt")) == ("of", "the")


def test_sheet_round_trip(spark, tmp_path):
    rows = [("q1", 'say "hi", then\nnext line', ""), ("q2", "plain", "refused")]
    sheet = spark.createDataFrame(rows, "qid string, generated_answer string, human_verdict string")
    assert sinks.write_sheet(sheet, str(tmp_path / "sheet")) == 1
    back = files.read_sheet(spark, str(tmp_path / "sheet")).fillna("").orderBy("qid").collect()
    assert [tuple(r) for r in back] == rows


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "id string, at int, v string")


def test_upsert_is_idempotent_and_writes_what_it_touches(spark, tmp_path):
    path, order = str(tmp_path / "t"), [F.col("at").desc()]
    for _ in range(2):
        versions.upsert(rows_of(spark, ("a", 1, "old"), ("b", 1, "b"), *[(f"k{i}", 1, "x") for i in range(30)]), path, ["id"], order, buckets=8)
    before = versions.current(spark, path)["folders"]
    versions.upsert(rows_of(spark, ("a", 2, "new"), ("a", 1, "older")), path, ["id"], order)
    after = versions.current(spark, path)["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    got = {r["id"]: r["v"] for r in versions.read_table(spark, path).collect()}
    assert len(got) == 32 and got["a"] == "new" and got["b"] == "b"
    versions.upsert(spark.createDataFrame([("a", 3, 1.5)], "id string, at int, more double"), path, ["id"], order)
    assert versions.read_table(spark, path).where("id = 'a'").select("more", "v").first() == (1.5, None)
    versions.upsert(rows_of(spark), path, ["id"], order)
    assert versions.read_table(spark, path).count() == 32
    with pytest.raises(ValueError, match="kept by"):
        versions.upsert(rows_of(spark), path, ["v"], order)


def test_a_crash_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch):
    path, order = str(tmp_path / "t"), [F.col("at").desc()]
    versions.upsert(rows_of(spark, ("a", 1, "old"), ("b", 1, "b")), path, ["id"], order, buckets=2)
    for step in ("publish", "vacuum"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                versions.upsert(rows_of(spark, ("a", 2, "new")), path, ["id"], order)
        want = {"publish": "old", "vacuum": "new"}[step]  # the manifest's move is what counts
        assert sorted((r["id"], r["v"]) for r in versions.read_table(spark, path).collect()) == [("a", want), ("b", "b")]
    versions.upsert(rows_of(spark, ("a", 2, "new")), path, ["id"], order)  # the same rows again
    assert sorted((r["id"], r["v"]) for r in versions.read_table(spark, path).collect()) == [("a", "new"), ("b", "b")]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) <= 3
    stale = versions.current(spark, path)
    with pytest.raises(OSError, match="another writer"):
        versions.publish(spark, path, stale)


def test_freezing_keeps_what_was_frozen_until_all_is_there(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "f"), rows_of(spark, ("a", 1, "x"))
    versions.freeze({"t": df}, path, {"revision": "r1"})
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.freeze({"t": df}, path, {"revision": "r2"})
    assert versions.thaw(spark, path, "t", {"revision": "r1"}).count() == 1 and not versions.matches(spark, path, {"revision": "r2"})
    versions.freeze({"t": df.where("false")}, path, {"revision": "r2"})
    with pytest.raises(ValueError, match="another manifest"):
        versions.thaw(spark, path, "t", {"revision": "r1"})
    with pytest.raises(FileNotFoundError):
        versions.thaw(spark, str(tmp_path / "none"), "t", {})


def test_ensuring_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.ensure_table(spark, path, "id string, vector array<float>", ["id"]) and not versions.ensure_table(spark, path, "id string, vector array<float>", ["id"])
    assert versions.read_table(spark, path).count() == 0
    with pytest.raises(ValueError, match="differs"):
        versions.ensure_table(spark, path, "id string, vector array<double>", ["id"])


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "net sales rose"), ("2", "sales of valves"), ("3", "")], "chunk_id string, text string")
    questions = spark.createDataFrame([("q", "net sales")], "qid string, question string")
    p, path = bm25.Bm25(), str(tmp_path / "bm25")
    sinks.save_bm25(chunks, path, p, "f1")
    order = lambda df: [(r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert order(sinks.search_saved(spark, path, questions, 2, p, "f1")) == order(bm25.retrieve(chunks, questions, 2, p))
    for other in ((p, "f2"), (bm25.Bm25(b=0.5), "f1")):
        with pytest.raises(ValueError, match="another manifest"):
            sinks.search_saved(spark, path, questions, 2, *other)
    assert order(sinks.search_saved(spark, path, questions, 9, p, "f1")) == order(bm25.retrieve(chunks, questions, 9, p))  # with chunks that match nothing
    assert not sinks.open_bm25(chunks, path, p, "f1") and sinks.open_bm25(chunks, path, p, "f2") and not sinks.open_bm25(chunks, path, p, "f2")


def test_reports_are_the_same_byte_for_byte(spark, tmp_path):
    metrics = spark.createDataFrame([("overall", "mrr", 0.25), ("prose", "mrr", 0.5)], "`group` string, metric string, value double")
    report = sinks.build_report(metrics, {"b": 1, "a": "é"}, "abc", latency=None, **sinks.provenance(str(tmp_path)))
    assert "latency" not in report and report["metrics"]["prose"]["mrr"] == 0.5
    one = open(sinks.write_report(report, str(tmp_path)), "rb").read()
    two = open(sinks.write_report(dict(reversed(report.items())), str(tmp_path)), "rb").read()
    assert one == two and one.endswith(b"\n") and b"\r" not in one
    assert sorted(tuple(r) for r in files.report_metrics(spark, files.read_report(str(tmp_path / "abc.json"))).collect()) == [("overall", "mrr", 0.25), ("prose", "mrr", 0.5)]


def test_metadata_and_totals(spark):
    rows = spark.createDataFrame([("c1", "D", 1, "x", "10k"), ("c1", "D", 1, "x", "10k"), ("c2", "E", 2, "y", None)], "chunk_id string, doc_id string, page_num int, company string, form_type string")
    filings = spark.createDataFrame([("D", "Velmora", "VEL", None, "8ka")], "doc_id string, company string, ticker string, fiscal_year int, form_type string")
    with pytest.raises(ValueError, match="no metadata"):
        caches.with_metadata(rows, filings)
    assert [r["form_type"] for r in caches.with_metadata(rows, filings, strict=False).collect()] == ["8KA", "8KA"]
    t = caches.load_totals(rows).first()
    assert (t["documents"], t["pages"], t["chunks"], t["repeated"], t["repeated_rate"]) == (2, 2, 2, 1, 0.5)
    assert caches.load_totals(rows.where("false")).first()["chunks_per_page"] == 0.0


def test_golden(spark):
    records = spark.createDataFrame([("1", "What drove the EBITDA margin?", "a", "D", [(3, "x"), (0, "y"), (3, "z")]), ("2", "How much?", "b", "E", [])], golden.SOURCE)
    docs = spark.createDataFrame([("D",)], "doc_id string")
    [r] = golden.build(records, docs).collect()
    assert (r["answer_type"], r["evidence_pages"], r["evidence_text"]) == ("prose", [1, 4], "x\n\ny\n\nz")
    types = spark.createDataFrame([("What is the tax rate?",), ("Describe it",), (None,)], "q string").select(golden.answer_type(F.col("q"))).collect()
    assert [t[0] for t in types] == ["numeric", "prose", "prose"]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "p int").select(golden.one_based(F.col("p"))).collect()


def test_best_page_and_guard(spark):
    g = spark.createDataFrame([("q", "D", [2], "net sales rose in Oriva"), ("n", "D", [1], None)], "qid string, doc_id string, evidence_pages array<int>, evidence_text string")
    pages = spark.createDataFrame([("D", 1, "net sales " * 40), ("D", 2, "in Oriva net sales rose by far " * 20), ("D", 3, "10")], "doc_id string, page_num int, text string")
    assert [tuple(r) for r in golden.best_page(g, pages).collect()] == [("q", 2, 1.0, True)]
    golden.require_agreement(g, pages)
    with pytest.raises(ValueError, match="another page"):
        golden.require_agreement(g.withColumn("evidence_pages", F.array(F.lit(1))), pages)


def test_model_calls_go_through_the_cache(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompt):
        (calls / hashlib.sha256(prompt.encode()).hexdigest()).write_text(prompt)
        return json.dumps({"answer": "yes", "citations": ["c1", "zz"], "insufficient_evidence": False})

    questions = spark.createDataFrame([("q1", "Why?"), ("q2", "Why?")], "qid string, question string")
    contexts = spark.createDataFrame([("q1", "[c1] text", ["c1"]), ("q2", "[c1] text", ["c1"])], "qid string, context string, context_ids array<string>")
    empty = spark.createDataFrame([], "generation_key string, reply string")
    answers, added = generation.generate(questions, contexts, empty, model, "m1")
    sinks.append_to_cache(added, str(tmp_path / "cache"))
    assert len(list(calls.iterdir())) == 1  # both questions have one key
    for f in calls.iterdir():
        f.unlink()
    answers, added = generation.generate(questions, contexts, spark.read.parquet(str(tmp_path / "cache")), model, "m1")
    assert sorted((r["qid"], r["text"], r["cited_ids"], r["dropped"], r["citation_validity"]) for r in answers.collect()) == [("q1", "yes", ["c1"], ["zz"], 0.5), ("q2", "yes", ["c1"], ["zz"], 0.5)]
    assert added.count() == 0 and not list(calls.iterdir())


def test_judging(spark):
    records = spark.createDataFrame([("g1", "q", "gold", "right", ["c"], ["c"], False), ("g2", "q", "gold", "declines", [], [], True)], "grade_id string, question string, gold_answer string, generated_answer string, cited_ids array<string>, context_ids array<string>, refused boolean")
    cache = spark.createDataFrame([], "judgment_key string, reply string")
    judged, added = generation.judge(records, cache, lambda p: json.dumps({"verdict": "correct" if "right" in p else "incorrect", "reason": "r"}), "j1")
    assert [tuple(r) for r in judged.collect()] == [("g1", "correct", "r", None)] and added.count() == 1


def test_stream_merges(spark, tmp_path):
    schema = "chunk_id string, doc_id string, text string, ingested_at timestamp"
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, doc_id string, text string, t long").select("chunk_id", "doc_id", "text", F.timestamp_seconds("t").alias("ingested_at"))
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows(("a", "D", "old", 1), ("b", "D", "b", 1)).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    index.merge_stream(stream(), out, ck).awaitTermination(120)
    rows(("a", "D", "new", 9), ("a", "D", "older", 0)).write.mode("append").parquet(src)
    index.merge_stream(stream(), out, ck).awaitTermination(120)
    assert sorted((r["chunk_id"], r["text"]) for r in versions.read_table(spark, out).collect()) == [("a", "new"), ("b", "b")]
    q = index.ingest_counts(stream()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("rows")).first()[0] == 4
