"""Queries that decide over runs, and over answers: gate, adoption, complementarity, citations, agreement, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.lineage import written
from folioscope.operators import answers, decisions, metrics, ranking
from folioscope.operators.bm25 import tokens
from folioscope.operators.caches import latest_chunks
from folioscope.plans.retrieval import COLUMNS, LATEST, LOGGED, PAGES, SPECS, collapse_pages, grouped_sql, metrics_sql, tier1_grouped
from folioscope.sources.tables import table

BASE, OTHER, SPARSE = "dense", "hybrid_rrf_sw0.5", "sparse_bm25"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_form(tier1_grouped(spark, sf_dir), SPECS, by=("run_label",))


def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = written(_report(spark, sf_dir).where(F.col("group") == "overall"), "report")
    side = lambda run: report.where(F.col("run_label") == run).select("metric", "value")
    return decisions.gate(side(BASE), side(OTHER))


def adoption_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = written(tier1_grouped(spark, sf_dir).where(F.col("group") == "overall"), "overall")
    runs = overall.withColumnRenamed("run_label", "run").withColumn("top_k", F.lit(50)).withColumn("dirty", F.lit(False)).withColumn("recall_at_k", F.lit(None).cast("double"))
    return decisions.adoption(runs.where(F.col("run") != BASE), runs.where(F.col("run") == BASE))


def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir).withColumnRenamed("run_label", "run").withColumn("backend", F.when(F.col("run") == BASE, "dense").otherwise("other")).withColumn("position", F.lit(0))
    return decisions.ablation(written(report, "report"))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = written(_report(spark, sf_dir), "report")
    side = lambda run: report.where(F.col("run_label") == run).drop("run_label")
    return decisions.compare(side(BASE), side(OTHER))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = collapse_pages(spark, sf_dir)
    side = lambda run: pages.where(F.col("run_label") == run)
    return decisions.pairs(table(spark, sf_dir, "golden"), side(BASE), side(SPARSE), 50)


def complementarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def complementarity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.cell_counts(_pairs(spark, sf_dir))


def union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.union_recall(_pairs(spark, sf_dir))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = answers.citations(F.col("cited_ids"), F.col("context_ids"))
    return table(spark, sf_dir, "answers").select("grade_id", c["kept"].alias("kept"), c["dropped"].alias("dropped"), F.round(c["validity"], 6).alias("validity"))


def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cited_pages(table(spark, sf_dir, "answers"), latest_chunks(table(spark, sf_dir, "chunks")))


def cited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cited_texts(table(spark, sf_dir, "answers"), latest_chunks(table(spark, sf_dir, "chunks")))


def judge(records: DataFrame) -> DataFrame:
    """A stand-in for a judging model: correct if the answer has every token of the gold answer."""
    missing = F.array_except(tokens(F.col("gold_answer")), tokens(F.col("generated_answer")))
    return records.withColumn("verdict", F.when(F.size(missing) == 0, "correct").otherwise("incorrect"))


def _records(spark: SparkSession, sf_dir: str, *, faithful: bool = False) -> DataFrame:
    """One record for each graded answer, of rows that share an id the first by run and answer; with ``faithful`` how much of it its citations have."""
    graded = table(spark, sf_dir, "grading_baseline_dense").groupBy("grade_id").agg(F.min(F.struct("run_label", "qid", "answer_type", "question", "gold_answer", "generated_answer", "answer_hash", "human_verdict", "cited_pages")).alias("r")).select("grade_id", "r.*")
    own = table(spark, sf_dir, "answers").select("grade_id", "cited_ids", "context_ids", "insufficient_evidence", "prompt_tokens", "completion_tokens")
    c = answers.citations(F.col("cited_ids"), F.col("context_ids"))
    joined = graded.join(own, "grade_id").withColumn("citation_validity", F.round(c["validity"], 6)).withColumn("uncited", F.size(c["kept"]) == 0)
    judged = judge(joined.withColumn("refused", F.coalesce("insufficient_evidence", F.lit(False))))
    if not faithful:
        return judged
    known = answers.faithfulness(graded.select("grade_id", "generated_answer").join(own.select("grade_id", "cited_ids", "context_ids"), "grade_id"), latest_chunks(table(spark, sf_dir, "chunks")))
    return judged.join(known, "grade_id")


def tier2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.tier2_report(_records(spark, sf_dir, faithful=True), ("run_label",))


def tier2_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every answer stands in the chunks that it cites; null for refusals, which are not judged."""
    return _records(spark, sf_dir, faithful=True).select("grade_id", F.when(~F.col("refused"), F.col("faithfulness")).alias("faithfulness"))


def judge_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return answers.agreement(records, records.select("grade_id", "answer_hash", "verdict"))


def grading_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.grading_sheet(_records(spark, sf_dir))


def judgment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.judge_keys(_records(spark, sf_dir), "judge-1")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.latency(table(spark, sf_dir, "events"), "event_type", "value")


def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.logged_rankings(table(spark, sf_dir, "retrieved_chunks").where(F.col("run_label") == BASE))
    return answers.prompt_context(ranked, latest_chunks(table(spark, sf_dir, "chunks")), 5)


QUERIES = {
    f.__name__: f
    for f in (gate_check, adoption_verdicts, ablation_deltas, compare_runs, complementarity_pairs, complementarity_cells, union_recall, citation_validity, cited_pages, cited_texts, tier2_report, tier2_faithfulness, judge_kappa, grading_sheet, judgment_keys, latency_percentiles, context_prompt)
}

_REPORT = f"WITH {PAGES}, " + metrics_sql("pages", "run_label,") + ", report AS (" + grouped_sql("run_label,") + ")"
_LONG = ", long AS (SELECT run_label, \"group\", metric, value FROM (" + " UNION ALL ".join(f"SELECT run_label, \"group\", '{s}' AS metric, {c} AS value FROM report" for s, c in zip(SPECS, COLUMNS)) + ") WHERE value IS NOT NULL)"
_PAIRS = f"""WITH {PAGES}, pairs AS (
SELECT r.qid, r.doc_id, r.page_num, g.answer_type, a.page_rank AS rank_a, b.page_rank AS rank_b,
  CASE WHEN a.page_rank <= 50 AND b.page_rank <= 50 THEN 'both' WHEN a.page_rank <= 50 THEN 'a_only' WHEN b.page_rank <= 50 THEN 'b_only' ELSE 'neither' END AS cell
FROM relevant r JOIN golden g USING (qid)
LEFT JOIN (SELECT * FROM pages WHERE run_label = 'dense') a ON a.qid = r.qid AND a.doc_id = r.doc_id AND a.page_num = r.page_num
LEFT JOIN (SELECT * FROM pages WHERE run_label = 'sparse_bm25') b ON b.qid = r.qid AND b.doc_id = r.doc_id AND b.page_num = r.page_num)"""
_TWICE = "(SELECT qid, answer_type AS \"group\", {0} FROM pairs UNION ALL SELECT qid, 'overall', {0} FROM pairs)"
_CIT = """cit AS (SELECT *, list_filter(once, lambda x: list_contains(ctx, x)) AS kept, list_filter(once, lambda x: NOT list_contains(ctx, x)) AS dropped FROM (
  SELECT *, coalesce(context_ids, []) AS ctx, list_filter(coalesce(cited_ids, []), lambda x, i: list_position(coalesce(cited_ids, []), x) = i) AS once FROM answers)),
valid AS (SELECT *, CASE WHEN len(once) = 0 THEN 1.0::DOUBLE ELSE round(len(kept) / len(once), 6) END AS validity FROM cit)"""
_RECORDS = f"""{LATEST}, {_CIT},
shown AS (SELECT DISTINCT grade_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM (SELECT grade_id, unnest(kept) AS chunk_id FROM cit) JOIN latest USING (chunk_id)),
said AS (SELECT grade_id, f, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS term, len(w) AS n FROM (SELECT grade_id, r.f AS f, list_distinct(regexp_extract_all(lower(coalesce(r.f, '')), '[a-z0-9]+')) AS w FROM (SELECT grade_id, min({{'a': run_label, 'b': qid, 'c': answer_type, 'd': question, 'e': gold_answer, 'f': generated_answer, 'g': answer_hash, 'h': human_verdict, 'i': cited_pages}}) AS r FROM grading_baseline_dense GROUP BY grade_id))),
faith AS (SELECT grade_id, CASE WHEN any_value(n) = 0 THEN 0 ELSE round(count(s.term) / any_value(n), 6) END::DOUBLE AS faithfulness FROM said LEFT JOIN shown s USING (grade_id, term) GROUP BY grade_id),
graded AS (SELECT grade_id, r.* FROM (SELECT grade_id, min({{'a': run_label, 'b': qid, 'c': answer_type, 'd': question, 'e': gold_answer, 'f': generated_answer, 'g': answer_hash, 'h': human_verdict, 'i': cited_pages}}) AS r FROM grading_baseline_dense GROUP BY grade_id)),
records AS (SELECT g.grade_id, a AS run_label, b AS qid, c AS answer_type, d AS question, e AS gold_answer, f AS generated_answer, g AS answer_hash, h AS human_verdict, i AS cited_pages, coalesce(insufficient_evidence, false) AS refused,
  validity AS citation_validity, faithfulness, len(kept) = 0 AS uncited, kept, prompt_tokens, completion_tokens,
  CASE WHEN len(list_filter(regexp_extract_all(lower(coalesce(e, '')), '[a-z0-9]+'), lambda x: NOT list_contains(regexp_extract_all(lower(coalesce(f, '')), '[a-z0-9]+'), x))) = 0 THEN 'correct' ELSE 'incorrect' END AS verdict
  FROM graded g JOIN valid USING (grade_id) JOIN faith USING (grade_id))"""
_TIER2 = """count(*) AS n, round(100.0 * count(*) FILTER (WHERE verdict = 'correct') / count(*), 1) AS correct_pct, round(100.0 * count(*) FILTER (WHERE verdict = 'incorrect') / count(*), 1) AS incorrect_pct,
  round(100.0 * count(*) FILTER (WHERE refused) / count(*), 1) AS refused_pct, round(avg(citation_validity) FILTER (WHERE NOT refused), 4) AS mean_citation_validity, round(avg(CASE WHEN uncited THEN 0 ELSE faithfulness END) FILTER (WHERE NOT refused), 4) AS mean_faithfulness, count(*) FILTER (WHERE NOT refused) AS scored,
  count(*) FILTER (WHERE uncited AND NOT refused) AS uncited, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens"""

ORACLE = {
    "gate_check": _REPORT + _LONG + """, s AS (SELECT m.metric, b.value AS baseline, c.value AS current FROM (VALUES ('recall@10'), ('ndcg@10'), ('recall@50')) m(metric)
JOIN long b ON b.metric = m.metric AND b.run_label = 'dense' AND b."group" = 'overall' JOIN long c ON c.metric = m.metric AND c.run_label = 'hybrid_rrf_sw0.5' AND c."group" = 'overall')
SELECT *, round(current - baseline, 6) AS delta, round(baseline - current, 6) > 0.02 AS regressed, NOT bool_or(round(baseline - current, 6) > 0.02) OVER () AS ok FROM s""",
    "adoption_verdicts": _REPORT + """, b AS (SELECT * FROM report WHERE run_label = 'dense' AND "group" = 'overall'),
d AS (SELECT r.run_label AS run, false AS dirty, round(r.recall_at_10 - b.recall_at_10, 6) AS d_recall_10, round(r.ndcg_at_10 - b.ndcg_at_10, 6) AS d_ndcg_10, round(r.recall_at_50 - b.recall_at_50, 6) AS d_recall_50
  FROM report r, b WHERE r."group" = 'overall' AND r.run_label <> 'dense'),
c AS (SELECT *, d_recall_10 >= -0.02 AND d_ndcg_10 >= -0.02 AND d_recall_50 >= -0.02 AS condition1, d_recall_10 > 0.02 OR d_ndcg_10 > 0.02 AS condition2 FROM d)
SELECT *, condition1 AND condition2 AS adopted, condition1 AND condition2 AND row_number() OVER (PARTITION BY condition1 AND condition2 ORDER BY d_ndcg_10 DESC, d_recall_10 DESC, run) = 1 AS selected FROM c""",
    "ablation_deltas": _REPORT + _LONG + """ SELECT r.run_label AS run, b."group", b.metric, l.value, round(coalesce(l.value, 0) - b.value, 6) AS delta
FROM (SELECT DISTINCT run_label FROM long) r CROSS JOIN (SELECT * FROM long WHERE run_label = 'dense') b LEFT JOIN long l ON l.run_label = r.run_label AND l."group" = b."group" AND l.metric = b.metric""",
    "compare_runs": _REPORT + _LONG + """ SELECT o."group", o.metric, o.value AS old, n.value AS new, round(n.value - o.value, 6) AS delta FROM long o JOIN long n USING ("group", metric) WHERE o.run_label = 'dense' AND n.run_label = 'hybrid_rrf_sw0.5'""",
    "complementarity_pairs": _PAIRS + " SELECT * FROM pairs",
    "complementarity_cells": _PAIRS + " SELECT \"group\", " + ", ".join(f"count(*) FILTER (WHERE cell = '{c}') AS {c}" for c in decisions.CELLS) + f" FROM {_TWICE.format('cell')} GROUP BY 1",
    "union_recall": _PAIRS
    + f""", each AS (SELECT qid, "group", round(avg((cell IN ('both', 'a_only'))::INT), 6) AS a, round(avg((cell IN ('both', 'b_only'))::INT), 6) AS b, round(avg((cell <> 'neither')::INT), 6) AS u FROM {_TWICE.format('cell')} GROUP BY ALL)
SELECT "group", count(*) AS n, """
    + ", ".join(("((2 * sum(CAST(round({0} * 1000000) AS BIGINT)) + count(*)) // (2 * count(*))) / 1000000.0::DOUBLE AS {1}").format(a, b) for a, b in (("a", "recall_a"), ("b", "recall_b"), ("u", "recall_union")))
    + ' FROM each GROUP BY "group"',
    "citation_validity": f"WITH {_CIT} SELECT grade_id, kept, dropped, validity FROM valid",
    "cited_pages": f"""WITH {LATEST}, {_CIT},
k AS (SELECT grade_id, unnest(kept) AS chunk_id, unnest(generate_series(1, len(kept))) AS pos FROM cit),
p AS (SELECT k.grade_id, doc_id, page_num, min(pos) AS pos FROM k JOIN latest USING (chunk_id) GROUP BY ALL)
SELECT a.grade_id, coalesce(string_agg(p.doc_id || ' p.' || p.page_num, '; ' ORDER BY p.pos), '') AS cited_pages FROM answers a LEFT JOIN p USING (grade_id) GROUP BY a.grade_id""",
    "cited_texts": f"""WITH {LATEST}, {_CIT},
c AS (SELECT grade_id, chunk_id, CAST(min(pos) AS INTEGER) AS pos FROM (SELECT grade_id, unnest(context_ids) AS chunk_id, unnest(generate_series(0, len(context_ids) - 1)) AS pos FROM answers) GROUP BY ALL),
p AS (SELECT DISTINCT grade_id, doc_id, page_num FROM (SELECT grade_id, unnest(kept) AS chunk_id FROM cit) JOIN latest USING (chunk_id))
SELECT c.grade_id, c.chunk_id, c.pos AS "at" FROM c JOIN latest l USING (chunk_id) SEMI JOIN p ON p.grade_id = c.grade_id AND p.doc_id = l.doc_id AND p.page_num = l.page_num""",
    "tier2_report": f"WITH {_RECORDS} SELECT run_label, 'overall' AS \"group\", {_TIER2} FROM records GROUP BY run_label UNION ALL SELECT run_label, answer_type, {_TIER2} FROM records GROUP BY run_label, answer_type",
    "tier2_faithfulness": f"WITH {_RECORDS} SELECT grade_id, CASE WHEN NOT refused THEN faithfulness END AS faithfulness FROM records",
    "judge_kappa": f"""WITH {_RECORDS}, h AS (SELECT lower(trim(coalesce(human_verdict, ''))) AS human, verdict FROM records),
c AS (SELECT count(*) FILTER (WHERE human = 'correct' AND verdict = 'correct') AS cc, count(*) FILTER (WHERE human = 'correct' AND verdict = 'incorrect') AS ci, count(*) FILTER (WHERE human = 'incorrect' AND verdict = 'correct') AS ic,
  count(*) FILTER (WHERE human = 'incorrect' AND verdict = 'incorrect') AS ii, count(*) FILTER (WHERE human = 'refused') AS refused, count(*) FILTER (WHERE human = '') AS ungraded FROM h),
s AS (SELECT *, cc + ci + ic + ii AS n, (cc + ii) / (cc + ci + ic + ii) AS po, ((cc + ci) * (cc + ic) + (ic + ii) * (ci + ii)) / ((cc + ci + ic + ii) * (cc + ci + ic + ii)) AS pe FROM c)
SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, cc AS correct_correct, ci AS correct_incorrect, ic AS incorrect_correct, ii AS incorrect_incorrect, ci + ic AS disagreements, refused, ungraded FROM s""",
    "grading_sheet": f"WITH {_RECORDS} SELECT grade_id, qid, answer_type, question, gold_answer, generated_answer, cited_pages, sha256(generated_answer) AS answer_hash, CASE WHEN refused THEN 'refused' ELSE '' END AS human_verdict FROM records",
    "judgment_keys": f"WITH {_RECORDS} SELECT grade_id, sha256(coalesce(question, '') || chr(0) || coalesce(gold_answer, '') || chr(0) || coalesce(generated_answer, '') || chr(0) || 'judge-1' || chr(0) || len(kept) || chr(0) || array_to_string(kept, chr(0))) AS judgment_key FROM records",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "context_prompt": f"""WITH {LATEST}, {LOGGED} SELECT qid, string_agg('[' || l.chunk_id || '] (' || c.doc_id || ', page ' || c.page_num || ')' || chr(10) || coalesce(c.text, ''), chr(10) || chr(10) ORDER BY l.rank) AS context, list(l.chunk_id ORDER BY l.rank) AS context_ids
FROM logged l JOIN latest c USING (chunk_id) WHERE l.run_label = 'dense' AND l.rank <= 5 GROUP BY qid""",
}
