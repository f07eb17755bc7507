"""Queries of what surrounds the rankings: model inputs and hooks, frozen artifacts, backends by settings, elements, verdict texts."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import reports
from folioscope.lineage import written
from folioscope.operators import backends, bm25, caches, decisions, dense, elements, frozen, fuzzy, golden, metrics, ranking, scorers
from folioscope.operators.guards import require_empty
from folioscope.plans.corpus import region_tables
from folioscope.plans.evaluation import BASE, OTHER, gate_check
from folioscope.plans.retrieval import LATEST, LOGGED, PAGES, TOP, bm25_sql, collapse_pages, corpus, grouped_sql, indexed, metrics_sql, tier1_grouped
from folioscope.session import shared_folder
from folioscope.settings import Fusion, Rerank, Retrieval, Settings
from folioscope.sources.tables import table

INSTRUCTION = "Represent this question for searching relevant passages:"
#: Longest text in tokens for the guard's query, places of hashed vectors, and candidates that are scored in pairs.
LONGEST, DIMS, POOL = 60, 64, 20


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for an artifact beside this application's written tables."""
    return f"{shared_folder(spark)}/folioscope-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def query_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as an embedder takes them."""
    return table(spark, sf_dir, "golden").select("qid", scorers.with_instruction(F.col("question"), INSTRUCTION).alias("text"))


def over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a model of ``LONGEST`` tokens would cut, which the guard stops on."""
    return scorers.over_length(corpus(spark, sf_dir), "text", LONGEST).select("chunk_id", "n_tokens")


def _vectors(chunks: DataFrame) -> DataFrame:
    return scorers.hashed_vectors(chunks, ["chunk_id"], "text", DIMS)


def _query_vectors(questions: DataFrame) -> DataFrame:
    return scorers.hashed_vectors(questions, ["qid", "question"], "question", DIMS)


def embedded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of every question, by vectors of hashed terms, which stand in for a model's."""
    vectors, asked = written(_vectors(corpus(spark, sf_dir)), "vectors"), written(_query_vectors(table(spark, sf_dir, "golden")), "query-vectors")
    return dense.nearest(vectors, asked, 10).select("qid", "rank", "chunk_id")


def frozen_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from frozen vectors of the corpus and of the questions, found by their text."""
    path, questions = _folder(spark, "frozen-vectors"), table(spark, sf_dir, "golden")
    frozen.freeze_dense(_vectors(corpus(spark, sf_dir)), _query_vectors(questions), path, "hashed-1")
    return frozen.search_dense(spark, path, questions, 10, "hashed-1").select("qid", "rank", "chunk_id")


def frozen_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BM25 ranking of fifty, frozen, and asked again for all questions, cut to ten."""
    path, questions = _folder(spark, "frozen-ranking"), table(spark, sf_dir, "golden")
    frozen.freeze_ranking(bm25.retrieve(indexed(spark, sf_dir), questions, TOP), path, "bm25-1")
    return frozen.search_ranking(spark, path, questions, 10, "bm25-1").select("qid", "chunk_id", "rank")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ranking.logged_rankings(table(spark, sf_dir, "retrieved_chunks").where(F.col("run_label") == BASE))
    return run.where(F.col("rank") <= POOL)


def _overlaps(pairs: DataFrame) -> DataFrame:
    return pairs.select("qid", "chunk_id", scorers.overlap(F.col("question"), F.col("text")).alias("score"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _pool(spark, sf_dir).select("qid", "chunk_id").join(table(spark, sf_dir, "golden").select("qid", "question"), "qid")
    return asked.join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id", "left")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every candidate of the dense run's first ``POOL``: the share of the question's terms that its text has."""
    return _overlaps(_pairs(spark, sf_dir))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense run's first ``POOL``, in order of their pair scores, cut to five as for serving."""
    asked = _pool(spark, sf_dir).join(table(spark, sf_dir, "golden").select("qid"), "qid", "left_semi")
    return ranking.rerank(asked, written(pair_scores(spark, sf_dir), "pair-scores"), top=5).select("qid", "chunk_id", "rank")


def frozen_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by scores that were frozen under the reranker's revision."""
    path = _folder(spark, "frozen-scores")
    frozen.freeze_scores(pair_scores(spark, sf_dir), path, "overlap-1")
    asked = _pool(spark, sf_dir).join(table(spark, sf_dir, "golden").select("qid"), "qid", "left_semi")
    return frozen.rerank(spark, path, asked, "overlap-1", top=5).select("qid", "chunk_id", "rank")


def _searched(spark: SparkSession, sf_dir: str, s: Settings) -> DataFrame:
    chunks, questions = indexed(spark, sf_dir), table(spark, sf_dir, "golden")
    c = backends.Corpus(chunks, written(_vectors(chunks), "vectors"), written(_query_vectors(questions), "query-vectors"), index=_folder(spark, "bm25"), pair_scores=lambda pairs: written(_overlaps(pairs), "pair-scores"))
    return backends.retrieve(s, c, questions)


#: Settings of the live runs below.
SPARSE = Settings(retrieval=Retrieval("sparse", 20))
HYBRID = replace(SPARSE, retrieval=Retrieval("hybrid", 20), fusion=Fusion(60, 1.0, 0.5))
RERANKED = replace(HYBRID, rerank=Rerank(True, 5))


def dispatch_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as the settings say: BM25 over a saved index."""
    return _searched(spark, sf_dir, SPARSE).select("qid", "rank", "chunk_id")


def dispatch_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as the settings say: both arms live, fused."""
    return _searched(spark, sf_dir, HYBRID).select("qid", "rank", "chunk_id")


def dispatch_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as the settings say: both arms, fused, and reranked."""
    return _searched(spark, sf_dir, RERANKED).select("qid", "rank", "chunk_id")


def company_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings by company with the ticker that a map of companies gives, letter case aside; a company that the map lacks stops the run."""
    filings = table(spark, sf_dir, "filings")
    known = filings.groupBy(F.lower(F.trim("company")).alias("name")).agg(F.min("ticker").alias("ticker"))
    return caches.with_tickers(filings.select("doc_id", "company"), known)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as a parser gives it: the pages it was seen on, out of order and repeated."""
    seen = F.concat(F.reverse("evidence_pages"), F.array(F.lit(None).cast("int")), "evidence_pages")
    label = F.when(F.col("answer_type") == "numeric", "table").otherwise("paragraph")
    raw = table(spark, sf_dir, "golden").select("doc_id", F.col("qid").alias("element_index"), label.alias("label"), F.col("evidence_text").alias("text"), seen.alias("provenance"))
    return elements.records(raw)


def element_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("doc_id", F.col("element_index").alias("qid"), "page_num", F.array_join("pages", ",").alias("pages"), "multi_page", "element_type", "text")


def multipage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each type by the number of pages they span."""
    return elements.span_counts(_elements(spark, sf_dir))


def page_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a heading and a table that goes on on the next page, as flat text: the table counts on both."""
    made = region_tables(spark, sf_dir)
    none = F.lit(None).cast(made.schema["table"].dataType)
    heading = made.select(F.col("r_name").alias("doc_id"), F.lit(0).alias("element_index"), F.lit(1).alias("page_num"), F.array(F.lit(1)).alias("pages"), F.lit("heading").alias("element_type"), F.concat(F.lit("Customers of "), "r_name").alias("text"), none.alias("table"))
    body = made.select(F.col("r_name").alias("doc_id"), F.lit(1).alias("element_index"), F.lit(1).alias("page_num"), F.array(F.lit(1), F.lit(2)).alias("pages"), F.lit("table").alias("element_type"), F.lit("").alias("text"), "table")
    return elements.page_flat_texts(heading.unionByName(body))


def gate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict in lines to read."""
    return gate_check(spark, sf_dir).select("metric", reports.gate_line().alias("line"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at the run's own depth, written ``recall@k``, of every question of every run at 20."""
    per = metrics.per_question(collapse_pages(spark, sf_dir), table(spark, sf_dir, "golden"), ("recall@k", "recall"), top_k=20, by=("run_label",))
    return per.select("run_label", "qid", "recall_at_k", "recall")


def adoption_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts where one run comes from a tree with changes and lacks recall at 50, which its recall at k stands in for: why each is not adopted."""
    overall = written(tier1_grouped(spark, sf_dir).where(F.col("group") == "overall"), "overall")
    odd = F.col("run_label") == OTHER
    runs = overall.select(F.col("run_label").alias("run"), F.lit(50).alias("top_k"), odd.alias("dirty"), "recall_at_10", "ndcg_at_10", F.when(~odd, F.col("recall_at_50")).alias("recall_at_50"), F.col("recall_at_50").alias("recall_at_k"))
    judged = decisions.adoption(runs.where(F.col("run") != BASE), runs.where(F.col("run") == BASE))
    return judged.select("run", "d_recall_50", "adopted", "selected", reports.why_not().alias("reason"))


def fuzzy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence against each page that it is labelled with, read fuzzily: whether all of it is found there."""
    pages = golden.page_texts(corpus(spark, sf_dir))
    labelled = table(spark, sf_dir, "golden").where(F.length("evidence_text") > 0).select("qid", "doc_id", "evidence_text", F.explode("evidence_pages").alias("page_num"))
    scored = labelled.join(pages, ["doc_id", "page_num"]).withColumn("score", fuzzy.score(F.col("evidence_text"), F.col("text"), "token_set_ratio"))
    return scored.select("qid", "page_num", (F.col("score") == 100.0).alias("whole"))


def consistent_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 50 made again from the pairs of pages, next to the report's; the run stops where they differ."""
    pages = collapse_pages(spark, sf_dir)
    paired = decisions.pairs(table(spark, sf_dir, "golden"), pages.where(F.col("run_label") == BASE), pages.where(F.col("run_label") == OTHER), 50)
    again = written(decisions.union_recall(paired).select("group", F.col("recall_a").alias("value")), "recall-again")
    reported = written(tier1_grouped(spark, sf_dir).where((F.col("run_label") == BASE) & (F.col("n") > 0)).select("group", F.col("recall_at_50").alias("value")), "recall-reported")
    decisions.check_consistency(again, reported)
    require_empty(again.join(reported, "group", "left_anti"), "the report lacks groups")
    return again


QUERIES = {
    f.__name__: f
    for f in (query_inputs, over_length, embedded_topk, frozen_dense, frozen_replay, pair_scores, rerank_topk, frozen_rerank, dispatch_sparse, dispatch_hybrid, dispatch_reranked, company_tickers, element_records, multipage_counts, page_flat, gate_messages, recall_at_k, adoption_reasons, fuzzy_evidence, consistent_recall)
}

_T = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_VECTOR = "list_transform(generate_series(0, {dims} - 1), lambda d: len(list_filter(list_transform({terms}, lambda t: CAST('0x' || md5(t)[1:8] AS UBIGINT) % {dims}), lambda x: x = d))::DOUBLE)"
_NEAR = f"""vc AS MATERIALIZED (SELECT chunk_id, {_VECTOR.format(dims=DIMS, terms=_T.format('text'))} AS v FROM latest), vq AS MATERIALIZED (SELECT qid, {_VECTOR.format(dims=DIMS, terms=_T.format('question'))} AS v FROM golden),
near AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT vq.qid, vc.chunk_id, CASE WHEN list_sum(vq.v) = 0 OR list_sum(vc.v) = 0 THEN 0 ELSE list_cosine_similarity(vq.v, vc.v) END AS s FROM vq CROSS JOIN vc))"""
_OVERLAP = f"""pool AS (SELECT l.qid, l.chunk_id, g.question FROM logged l JOIN golden g USING (qid) WHERE run_label = '{BASE}' AND rank <= {POOL}),
scored AS (SELECT qid, chunk_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_intersect(w, t)) / len(w), 6) END::DOUBLE AS score FROM (SELECT p.qid, p.chunk_id, list_distinct({_T.format('p.question')}) AS w, list_distinct({_T.format('l.text')}) AS t FROM pool p LEFT JOIN latest l USING (chunk_id)))"""
_FIVE = f"WITH {LATEST}, {LOGGED}, {_OVERLAP} SELECT * FROM (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5"
_LIVE = bm25_sql(False, True) + f""", {_NEAR},
fused AS (SELECT qid, chunk_id, sum(s) AS score FROM (SELECT qid, chunk_id, 1.0 / (60 + rank) AS s FROM near WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, 0.5 / (60 + rank) FROM ranked WHERE rank <= 20) GROUP BY ALL),
both_arms AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank FROM fused)"""
_REPORT = f"WITH {PAGES}, " + metrics_sql("pages", "run_label,") + ", report AS (" + grouped_sql("run_label,") + ")"
_FLAT = """WITH c AS (SELECT c_nationkey, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer GROUP BY ALL),
r AS (SELECT r_name, n_name, coalesce(n, 0) AS n, coalesce(cents, 0)::BIGINT AS cents FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey),
f AS (SELECT r_name, r_name || chr(10) || 'nation customers balance' || chr(10) || string_agg(n_name || ' ' || n || ' ' || cents, chr(10) ORDER BY n_name) AS t FROM r GROUP BY r_name)"""
_EVIDENCE = "SELECT doc_id, qid, list_sort(list_distinct(evidence_pages)) AS pages, CASE WHEN answer_type = 'numeric' THEN 'table' ELSE 'text' END AS element_type, coalesce(evidence_text, '') AS text FROM golden"
ORACLE = {
    "query_inputs": f"SELECT qid, trim('{INSTRUCTION} ' || coalesce(question, '')) AS text FROM golden",
    "over_length": f"WITH {LATEST} SELECT chunk_id, CAST(len({_T.format('text')}) + 2 AS INTEGER) AS n_tokens FROM latest WHERE len({_T.format('text')}) + 2 > {LONGEST}",
    "embedded_topk": f"WITH {LATEST}, {_NEAR} SELECT qid, rank, chunk_id FROM near WHERE rank <= 10",
    "frozen_dense": f"WITH {LATEST}, {_NEAR} SELECT qid, rank, chunk_id FROM near WHERE rank <= 10",
    "frozen_replay": bm25_sql(False, True) + " SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 10",
    "pair_scores": f"WITH {LATEST}, {LOGGED}, {_OVERLAP} SELECT qid, chunk_id, score FROM scored",
    "rerank_topk": _FIVE,
    "frozen_rerank": _FIVE,
    "dispatch_sparse": bm25_sql(False, True) + " SELECT qid, rank, chunk_id FROM ranked WHERE rank <= 20",
    "dispatch_hybrid": _LIVE + " SELECT qid, rank, chunk_id FROM both_arms WHERE rank <= 20",
    "dispatch_reranked": _LIVE + f""", again AS (SELECT b.qid, b.chunk_id, list_distinct({_T.format('g.question')}) AS w, list_distinct({_T.format('l.text')}) AS t FROM both_arms b JOIN golden g USING (qid) JOIN latest l USING (chunk_id) WHERE rank <= 20)
SELECT * FROM (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_intersect(w, t)) / len(w), 6) END DESC, chunk_id) AS INTEGER) AS rank FROM again) WHERE rank <= 5""",
    "company_tickers": "SELECT f.doc_id, f.company, k.ticker FROM filings f JOIN (SELECT lower(trim(company)) AS name, min(ticker) AS ticker FROM filings GROUP BY 1) k ON lower(trim(f.company)) = k.name",
    "element_records": f"SELECT doc_id, qid, pages[1] AS page_num, array_to_string(pages, ',') AS pages, len(pages) > 1 AS multi_page, element_type, text FROM ({_EVIDENCE})",
    "multipage_counts": f"SELECT element_type, CAST(len(pages) AS INTEGER) AS spans, count(*) AS elements FROM ({_EVIDENCE}) GROUP BY ALL",
    "page_flat": _FLAT + " SELECT r_name AS doc_id, 1 AS page_num, 'Customers of ' || r_name || chr(10) || t AS text FROM f UNION ALL SELECT r_name, 2, t FROM f",
    "gate_messages": _REPORT + f""", w AS (SELECT m.metric, CASE m.metric WHEN 'recall@10' THEN b.recall_at_10 WHEN 'recall@50' THEN b.recall_at_50 ELSE b.ndcg_at_10 END AS b, CASE m.metric WHEN 'recall@10' THEN c.recall_at_10 WHEN 'recall@50' THEN c.recall_at_50 ELSE c.ndcg_at_10 END AS c
FROM (VALUES ('recall@10'), ('ndcg@10'), ('recall@50')) m(metric), (SELECT * FROM report WHERE run_label = '{BASE}' AND "group" = 'overall') b, (SELECT * FROM report WHERE run_label = '{OTHER}' AND "group" = 'overall') c)
SELECT metric, printf('%s: %.4f -> %.4f (%s%.4f) %s', metric, b, c, CASE WHEN round(c - b, 6) < 0 THEN '-' ELSE '+' END, abs(round(c - b, 6)), CASE WHEN round(b - c, 6) > 0.02 THEN 'REGRESSED' ELSE 'ok' END) AS line FROM w""",
    "recall_at_k": f"""WITH {PAGES}, n AS (SELECT qid, count(*) AS n FROM relevant GROUP BY qid), hit AS (SELECT p.run_label, p.qid, count(*) AS h FROM pages p JOIN relevant USING (qid, doc_id, page_num) WHERE page_rank <= 20 GROUP BY ALL)
SELECT r.run_label, n.qid, round(coalesce(h, 0) / n.n, 6) AS recall_at_k, round(coalesce(h, 0) / n.n, 6) AS recall FROM (SELECT DISTINCT run_label FROM pages) r CROSS JOIN n LEFT JOIN hit ON hit.run_label = r.run_label AND hit.qid = n.qid""",
    "adoption_reasons": _REPORT + f""", d AS (SELECT r.run_label AS run, r.run_label = '{OTHER}' AS dirty, round(r.recall_at_10 - b.recall_at_10, 6) AS r10, round(r.ndcg_at_10 - b.ndcg_at_10, 6) AS n10, round(r.recall_at_50 - b.recall_at_50, 6) AS d_recall_50
  FROM report r, (SELECT * FROM report WHERE run_label = '{BASE}' AND "group" = 'overall') b WHERE r."group" = 'overall' AND r.run_label <> '{BASE}'),
c AS (SELECT *, r10 >= -0.02 AND n10 >= -0.02 AND d_recall_50 >= -0.02 AS c1, r10 > 0.02 OR n10 > 0.02 AS c2 FROM d), a AS (SELECT *, c1 AND c2 AND NOT dirty AS adopted FROM c)
SELECT run, d_recall_50, adopted, adopted AND row_number() OVER (PARTITION BY adopted ORDER BY n10 DESC, r10 DESC, run) = 1 AS selected,
  CASE WHEN dirty THEN 'uncommitted changes' WHEN NOT c1 THEN 'loses more than the tolerance' WHEN NOT c2 THEN 'gains no more than the tolerance' ELSE '' END AS reason FROM a""",
    "fuzzy_evidence": f"""WITH {LATEST}, page AS (SELECT doc_id, page_num, string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_id) AS text FROM latest GROUP BY ALL),
e AS (SELECT qid, doc_id, evidence_text, unnest(evidence_pages) AS page_num FROM golden WHERE length(evidence_text) > 0),
w AS (SELECT qid, page_num, list_filter(regexp_split_to_array(lower(evidence_text), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS b FROM e JOIN page USING (doc_id, page_num))
SELECT qid, page_num, len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b)) AS whole FROM w""",
    "consistent_recall": _REPORT + f""" SELECT "group", recall_at_50 AS value FROM report WHERE run_label = '{BASE}' AND n > 0""",
}
