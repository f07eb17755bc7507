"""Queries over the corpus: pages, chunks, identities, keyed tables, golden questions, rendered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.functions.readingform import reading_form_col, reading_form_sql
from folioscope.operators import caches, chunking, golden, tables
from folioscope.plans.retrieval import LATEST, corpus
from folioscope.session import spread
from folioscope.sources.tables import table


def pages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pages_of(table(spark, sf_dir, "documents"))


def short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with fewer than 40 characters besides white space at the ends."""
    pages = chunking.pages_of(table(spark, sf_dir, "documents"))
    return pages.where(F.length(tables.strip(F.col("text"))) < 40).groupBy("doc_id").agg(F.count("*").alias("short_pages"), F.count_if(~F.col("text").rlike(r"\S")).alias("blank_pages"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all chunks by their offset in the page, its chunks joined by line feeds in order of their present ids, and the numbers they stand for."""
    order = Window.partitionBy("doc_id", "page_num").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)  # a page's chunks
    chunks = corpus(spark, sf_dir).withColumn("offset", F.coalesce(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(order), F.lit(0)))
    made = chunks.select("doc_id", "page_num", "offset", hashing.chunk_id(F.col("doc_id"), F.col("page_num"), F.col("offset")).alias("chunk_id"))
    return made.withColumn("point", hashing.point_id(F.col("chunk_id")).cast("string"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the whole corpus's chunk ids."""
    return hashing.content_fingerprint(corpus(spark, sf_dir), "chunk_id", name="fingerprint")


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.content_fingerprint(corpus(spark, sf_dir), "chunk_id", "text")


def embed_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_id", hashing.text_key("rev-1", F.col("text")).alias("cache_key"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a page, cut to 200 characters with an overlap of 40."""
    return chunking.chunk_pages(chunking.pages_of(spread(table(spark, sf_dir, "documents"))), 200, 40, "chars")


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pages, cut by tokens at the default size."""
    whole = spread(table(spark, sf_dir, "documents")).select("doc_id", F.lit(1).alias("page_num"), "text")
    return chunking.chunk_pages(whole)


def chunk_recursive_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page that isn't blank: its chunks begin at 0, end at its end, and none passes size and overlap together."""
    chunks = chunk_recursive(spark, sf_dir)
    return chunks.groupBy("doc_id", "page_num").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), (F.max(F.col("end") - F.col("start")) <= 240).alias("bounded"))


def chunk_tokens_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document that isn't blank: its chunks by tokens begin at 0, end at its end, leave no gap, and none has more tokens than size and overlap together."""
    chunks = chunk_tokens(spark, sf_dir)
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))  # a document's chunks
    gaps = chunks.withColumn("gap", F.col("start") > F.coalesce(before, F.lit(0)))
    most = chunking.SIZE + chunking.OVERLAP
    return gaps.groupBy("doc_id").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), (~F.max("gap")).alias("whole"), (F.max(F.regexp_count("text", F.lit(r"(?U)\w+|[^\w\s]"))) <= most).alias("bounded"))


def layout_chunks_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every region's page: the rows of its table over all chunks, none lost or repeated, and whether every chunk of it begins with the header."""
    rows = layout_chunks(spark, sf_dir).where(F.col("text").contains("| nation |"))
    lines = rows.select("doc_id", "text", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\| [A-Z]"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("line").alias("different"))


def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden").select("qid", golden.answer_type(F.col("question")).alias("answer_type"))


def golden_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records, with pages counted from 0, made into golden rows again."""
    rows = table(spark, sf_dir, "golden")
    evidence = F.transform("evidence_pages", lambda p: F.struct((p - 1).alias("evidence_page_num"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text")))
    records = rows.select(F.col("qid").alias("financebench_id"), "question", "answer", F.col("doc_id").alias("doc_name"), evidence.alias("evidence"))
    return golden.build(records, table(spark, sf_dir, "filings"))


def golden_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_build(spark, sf_dir).groupBy("doc_id", "answer_type").agg(F.count("*").alias("questions"))


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_id", "doc_id", "page_num", F.unix_micros("ingested_at").alias("ingested_micros"), F.sha2("text", 256).alias("text_hash"))


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = caches.with_metadata(corpus(spark, sf_dir), table(spark, sf_dir, "filings"))
    return joined.select("chunk_id", "doc_id", "company", "ticker", "fiscal_year", "form_type")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of answers that no gold answer has, by the key under which their vectors are kept."""
    keyed = lambda c: table(spark, sf_dir, "grading_baseline_dense").where(F.col(c).isNotNull()).select(hashing.text_key("rev-1", F.col(c)).alias("cache_key"))
    return caches.misses(keyed("generated_answer"), keyed("gold_answer"), "cache_key")


def load_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.load_totals(table(spark, sf_dir, "chunks"))


def form_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy(caches.form_type(F.col("form_type")).alias("form_type")).agg(F.count("*").alias("chunk_rows"))


def best_match_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.best_page(table(spark, sf_dir, "golden"), golden.page_texts(corpus(spark, sf_dir)))


def best_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.agreement_summary(best_match_page(spark, sf_dir))


def page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its chunks have it against its reading form, whose terms are those that a reader sees."""
    pages = golden.page_texts(corpus(spark, sf_dir))
    return golden.alignment(pages, pages.withColumn("text", reading_form_col("text")))


def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of cells for each region: nations with their customers and balances, under a flagged header row."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    named = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").fillna(0, ["n", "cents"])
    listed = named.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n", "cents"))).alias("rows"))
    cell = lambda text, row, col, head: F.struct(text.cast("string").alias("text"), row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(head).alias("column_header"), F.lit(False).alias("row_header"), F.lit(False).alias("row_section"))
    head = F.array(*[cell(F.lit(t), F.lit(0), i, True) for i, t in enumerate(("nation", "customers", "balance"))])
    body = F.flatten(F.transform("rows", lambda r, i: F.array(cell(r["n_name"], i + 1, 0, False), cell(r["n"], i + 1, 1, False), cell(r["cents"], i + 1, 2, False))))
    made = F.struct((F.size("rows") + 1).alias("num_rows"), F.lit(3).alias("num_cols"), F.col("r_name").alias("caption"), F.concat(head, body).alias("cells"))
    return listed.join(table(spark, sf_dir, "region"), listed["n_regionkey"] == F.col("r_regionkey")).select("r_name", made.cast(tables.TABLE).alias("table"))


def table_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_tables(spark, sf_dir).select("r_name", tables.flat(F.col("table")).alias("text"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, body = tables.markdown(F.col("table"))
    return region_tables(spark, sf_dir).select("r_name", F.array_join(F.concat(header, body), "\n").alias("text"))


def table_linearized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_tables(spark, sf_dir).select("r_name", F.array_join(tables.linearized(F.col("table")), "\n").alias("text"))


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of a heading and a table, cut with the table in markdown, its rows packed under the repeated header."""
    made = region_tables(spark, sf_dir)
    heading = made.select(F.col("r_name").alias("doc_id"), F.lit(0).alias("element_index"), F.lit(1).alias("page_num"), F.lit("heading").alias("element_type"), F.concat(F.lit("Customers of "), "r_name").alias("text"), F.lit(None).cast(tables.TABLE).alias("table"))
    body = made.select(F.col("r_name").alias("doc_id"), F.lit(1).alias("element_index"), F.lit(1).alias("page_num"), F.lit("table").alias("element_type"), F.lit("").alias("text"), "table")
    return chunking.chunk_elements(heading.unionByName(body), "markdown", 120, 20, "chars")


QUERIES = {
    f.__name__: f
    for f in (pages_from_documents, short_pages, chunk_ids, corpus_fingerprint, content_fingerprint, embed_cache_keys, chunk_recursive, chunk_tokens, chunk_recursive_invariants, chunk_tokens_invariants, layout_chunks_invariants, answer_types, golden_build, golden_split, upsert_last_wins, metadata_join, cache_misses, load_totals, form_types, best_match_page, best_match_summary, page_alignment, table_flat, table_markdown, table_linearized, layout_chunks)
}

_PAGES = "SELECT doc_id, CAST(i AS INTEGER) AS page_num, lines[i] AS text FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"


def _cues(cues: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(coalesce(question, '')), '{c}')" for c in cues)


_TYPE = f"CASE WHEN {_cues(golden.PROSE_CUES)} THEN 'prose' WHEN {_cues(golden.NUMERIC_CUES)} THEN 'numeric' ELSE 'prose' END"
_FORM = "CASE WHEN lower({0}) IN ('10k', '10-k') THEN '10-K' WHEN lower({0}) IN ('10q', '10-q') THEN '10-Q' ELSE upper({0}) END"
_BUILT = f"""SELECT qid, question, answer, {_TYPE} AS answer_type, doc_id, list_sort(list_distinct(evidence_pages)) AS evidence_pages,
  array_to_string(list_transform(evidence_pages, lambda x: coalesce(evidence_text, '')), chr(10) || chr(10)) AS evidence_text
FROM golden SEMI JOIN filings USING (doc_id)"""
_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_PAGE_TEXT = f"{LATEST}, page AS (SELECT doc_id, page_num, string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_id) AS text FROM latest GROUP BY ALL)"
_BEST = f"""WITH {_PAGE_TEXT},
asked AS (SELECT qid, doc_id, evidence_pages, {_TOKENS.format("evidence_text")} AS want FROM golden WHERE evidence_text IS NOT NULL),
scored AS (SELECT a.qid, p.page_num, a.evidence_pages, round(len(list_intersect(a.want, {_TOKENS.format("p.text")})) / len(a.want), 6) AS score FROM asked a JOIN page p USING (doc_id) WHERE len(a.want) > 0),
best AS (SELECT qid, page_num AS best_page, score, list_contains(evidence_pages, page_num) AS agrees FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_num) AS n FROM scored) WHERE n = 1)"""
_REGION = """WITH c AS (SELECT c_nationkey, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer GROUP BY ALL),
r AS (SELECT r_name, n_name, coalesce(n, 0) AS n, coalesce(cents, 0)::BIGINT AS cents FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey)"""



def _fingerprint(value: str, name: str) -> str:
    part = lambda at: f"sum(CAST(CAST('0x' || sha256(v)[{at}:{at + 14}] AS UBIGINT) AS HUGEINT))"
    return f"""WITH {LATEST}, v AS (SELECT {value} AS v FROM latest), s AS (SELECT count(*) AS rows, {part(1)} AS a, {part(31)} AS b FROM v)
SELECT rows, sha256(rows || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR)) AS {name} FROM s"""


ORACLE = {
    "pages_from_documents": _PAGES,
    "short_pages": rf"WITH p AS ({_PAGES}) SELECT doc_id, count(*) AS short_pages, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS blank_pages FROM p WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 40 GROUP BY doc_id",
    "chunk_ids": f"""WITH {LATEST}, o AS (SELECT doc_id, page_num, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM latest),
h AS (SELECT *, sha256(doc_id || ':' || page_num || ':' || "offset")[1:16] AS chunk_id FROM o) SELECT *, CAST(CAST('0x' || chunk_id AS UBIGINT) AS VARCHAR) AS point FROM h""",
    "corpus_fingerprint": _fingerprint("'1' || chunk_id", "fingerprint"),
    "content_fingerprint": _fingerprint("'1' || chunk_id || chr(0) || CASE WHEN text IS NULL THEN '0' ELSE '1' || text END", "content_fingerprint"),
    "embed_cache_keys": f"WITH {LATEST} SELECT chunk_id, sha256('rev-1' || chr(0) || coalesce(text, '')) AS cache_key FROM latest",
    "chunk_recursive_invariants": rf"WITH p AS ({_PAGES}) SELECT doc_id, page_num, 0 AS first_start, CAST(length(text) AS INTEGER) AS last_end, true AS bounded FROM p WHERE regexp_matches(text, '\S')",
    "chunk_tokens_invariants": r"SELECT doc_id, 0 AS first_start, CAST(length(text) AS INTEGER) AS last_end, true AS whole, true AS bounded FROM documents WHERE regexp_matches(text, '\S')",
    "layout_chunks_invariants": "SELECT r_name AS doc_id, count(*) AS rows, count(*) AS different FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "answer_types": f"SELECT qid, {_TYPE} AS answer_type FROM golden",
    "golden_build": _BUILT,
    "golden_split": f"SELECT doc_id, answer_type, count(*) AS questions FROM ({_BUILT}) GROUP BY ALL",
    "upsert_last_wins": f"WITH {LATEST} SELECT chunk_id, doc_id, page_num, epoch_us(ingested_at) AS ingested_micros, sha256(text) AS text_hash FROM latest",
    "metadata_join": f"WITH {LATEST} SELECT l.chunk_id, l.doc_id, f.company, f.ticker, f.fiscal_year, {_FORM.format('f.form_type')} AS form_type FROM latest l JOIN filings f USING (doc_id)",
    "cache_misses": "WITH k AS (SELECT DISTINCT generated_answer AS t FROM grading_baseline_dense WHERE generated_answer IS NOT NULL) SELECT sha256('rev-1' || chr(0) || t) AS cache_key FROM k WHERE t NOT IN (SELECT gold_answer FROM grading_baseline_dense WHERE gold_answer IS NOT NULL)",
    "load_totals": """WITH s AS (SELECT chunk_id, count(*) AS times, min(doc_id) AS doc_id, min(page_num) AS page_num FROM chunks GROUP BY chunk_id),
t AS (SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, page_num)) AS pages, count(*) AS chunks, CAST(sum(times - 1) AS BIGINT) AS repeated FROM s)
SELECT *, round(chunks / pages, 3) AS chunks_per_page, round(repeated / chunks, 3) AS repeated_rate FROM t""",
    "form_types": f"SELECT {_FORM.format('form_type')} AS form_type, count(*) AS chunk_rows FROM chunks GROUP BY 1",
    "best_match_page": f"{_BEST} SELECT * FROM best",
    "best_match_summary": f"{_BEST} SELECT count(*) AS n, count(*) FILTER (WHERE agrees) AS agree, count(*) FILTER (WHERE NOT agrees) AS disagree, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean FROM best",
    "page_alignment": f"""WITH {_PAGE_TEXT}, other AS (SELECT doc_id, page_num, {reading_form_sql("text")} AS text FROM page),
a AS (SELECT doc_id, page_num, {_TOKENS.format("text")} AS want, length(text) AS n FROM page), b AS (SELECT doc_id, page_num, {_TOKENS.format("text")} AS have, length(coalesce(text, '')) AS n FROM other),
j AS (SELECT a.doc_id, a.page_num, b.page_num - a.page_num AS d, CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, coalesce(have, []))) / len(want), 6) ELSE 0 END AS s, a.n AS own_n, b.n AS other_n
  FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND b.page_num BETWEEN a.page_num - 1 AND a.page_num + 1),
g AS (SELECT doc_id, page_num, coalesce(max(s) FILTER (WHERE d = 0), 0)::DOUBLE AS same, coalesce(max(s) FILTER (WHERE d = -1), 0)::DOUBLE AS before, coalesce(max(s) FILTER (WHERE d = 1), 0)::DOUBLE AS "after",
  coalesce(max(other_n) FILTER (WHERE d = 0), 0) AS r, max(own_n) AS l FROM j GROUP BY ALL)
SELECT doc_id, page_num, same, before, "after", greatest(before, "after") - same > 0.05 AS drifts, r < 0.5 * l AS short FROM g""",
    "table_flat": _REGION + " SELECT r_name, r_name || chr(10) || 'nation customers balance' || chr(10) || string_agg(n_name || ' ' || n || ' ' || cents, chr(10) ORDER BY n_name) AS text FROM r GROUP BY r_name",
    "table_markdown": _REGION + " SELECT r_name, '| nation | customers | balance |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n || ' | ' || cents || ' |', chr(10) ORDER BY n_name) AS text FROM r GROUP BY r_name",
    "table_linearized": _REGION + " SELECT r_name, string_agg(n_name || ' — customers: ' || n || '; balance: ' || cents, chr(10) ORDER BY n_name) AS text FROM r GROUP BY r_name",
}
