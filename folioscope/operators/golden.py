"""Golden questions: built from source records, typed by what they ask, their evidence checked against the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import written
from folioscope.operators.bm25 import tokens
from folioscope.operators.guards import require_empty
from folioscope.operators.ranks import PLAIN_BYTES, estimated_bytes

# Phrases that ask for a narrative, looked for first, and phrases that ask for figures.
PROSE_CUES = ("what drove", "what industry", "geograph", "products and services", "major products", "acquisitions", "debt securities", "legal battles", "primary customers", "who are", "cyclicality", "retain")
NUMERIC_CUES = ("how much", "how many", "quick ratio", "current ratio", "tax rate", "ebitda", "capex", "margin profile", "restructuring costs", "customer concentration", "production rate", "more than", "proportionally", "the most", "the least", "largest", "greatest", "highest", "lowest")
SOURCE = "financebench_id string, question string, answer string, doc_name string, evidence array<struct<evidence_page_num:int,evidence_text:string>>"
SHORTEST_PAGE = 300


def answer_type(question: Column) -> Column:
    """prose or numeric, by the cues in the question; prose where there are none or no question."""
    q = F.lower(F.coalesce(question, F.lit("")))
    has = lambda cues: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: q.contains(c))
    return F.when(has(PROSE_CUES), "prose").when(has(NUMERIC_CUES), "numeric").otherwise("prose")


def one_based(page: Column) -> Column:
    """A page counted from 0 as one counted from 1; a negative one raises when it is read."""
    return F.when(page < 0, F.raise_error(F.concat(F.lit("page counted from 0 is negative: "), page.cast("string"))).cast("int")).otherwise(page + 1)


def build(records: DataFrame, documents: DataFrame) -> DataFrame:
    """``qid, question, answer, answer_type, doc_id, evidence_pages, evidence_text`` of the records whose document is there (``documents.doc_id``)."""
    kept = records.join(documents.select(F.col("doc_id").alias("doc_name")).distinct(), "doc_name", "left_semi")
    pages = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: one_based(e["evidence_page_num"]))))
    text = F.array_join(F.transform("evidence", lambda e: e["evidence_text"]), "\n\n")
    return kept.select(F.col("financebench_id").alias("qid"), "question", "answer", answer_type(F.col("question")).alias("answer_type"), F.col("doc_name").alias("doc_id"), pages.alias("evidence_pages"), text.alias("evidence_text"))


def page_texts(chunks: DataFrame) -> DataFrame:
    """``doc_id, page_num, text``: each page's chunk texts, joined in the order of their ids; one page is what is collected."""
    entry = F.struct("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunks.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n").alias("text"))


def best_page(golden: DataFrame, pages: DataFrame, *, shortest: int = 0, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """``qid, best_page, score, agrees``: the page of the question's own document that holds most of the evidence's words.

    The score is the share of the evidence's distinct tokens that the page has, at six decimals; ties go to the first
    page. Pages shorter than ``shortest`` characters are left out. Questions without evidence text or without a page don't come out.

    Where the plan's estimate is beyond ``plain_bytes``, not every question meets every page of its document: with n words, of which the labelled pages have m at best, a page that has as many
    has one of the n - m + 1 words that stand on the fewest pages. Only such pages are scored, besides the labelled ones and the first.
    """
    asked = golden.where(F.col("evidence_text").isNotNull()).select("qid", "doc_id", "evidence_pages", F.array_distinct(tokens(F.col("evidence_text"))).alias("want")).where(F.size("want") > 0)
    shared = F.size(F.array_intersect("want", "have"))
    score = F.round(shared / F.size("want"), 6)
    there = pages.where(F.length("text") >= shortest).select("doc_id", "page_num", F.array_distinct(tokens(F.col("text"))).alias("have"))
    met = asked.join(there, "doc_id") if estimated_bytes(there) <= plain_bytes else _near_pages(asked, written(there, "page-words"), shared)
    best = met.groupBy("qid").agg(F.min_by(F.struct("page_num", score.alias("score"), F.array_contains("evidence_pages", F.col("page_num")).alias("agrees")), F.struct(-score, F.col("page_num"))).alias("b"))
    return best.select("qid", F.col("b.page_num").alias("best_page"), "b.score", "b.agrees")


def _near_pages(asked: DataFrame, there: DataFrame, shared: Column) -> DataFrame:
    """``asked`` with the pages that may be best; see ``best_page``."""
    labelled = asked.select("qid", "doc_id", "want", F.explode("evidence_pages").alias("page_num")).join(there, ["doc_id", "page_num"]).groupBy("qid").agg(F.max(shared).alias("_m"))
    stands = there.select("doc_id", "page_num", F.explode("have").alias("term"))
    often = stands.groupBy("doc_id", "term").agg(F.count("*").alias("_n"))
    words = asked.join(labelled, "qid", "left").select("qid", "doc_id", F.size("want").alias("_size"), F.greatest(F.coalesce("_m", F.lit(1)), F.lit(1)).alias("_m"), F.explode("want").alias("term"))
    ordered = words.join(often, ["doc_id", "term"], "left").groupBy("qid", "doc_id", "_size", "_m").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "term"))).alias("_t"))  # a question's words
    rare = ordered.select("qid", "doc_id", F.explode(F.slice("_t", F.lit(1), F.col("_size") - F.col("_m") + 1)).alias("x")).select("qid", "doc_id", F.col("x.term").alias("term"))
    near = rare.join(stands, ["doc_id", "term"]).select("qid", "page_num")
    given = asked.select("qid", F.explode("evidence_pages").alias("page_num"))
    first = asked.select("qid", "doc_id").join(there.groupBy("doc_id").agg(F.min("page_num").alias("page_num")), "doc_id").select("qid", "page_num")
    return near.unionByName(given).unionByName(first).distinct().join(asked, "qid").join(there, ["doc_id", "page_num"])


def require_agreement(golden: DataFrame, pages: DataFrame) -> None:
    """Raises if the best page of a question's evidence isn't among its labelled pages."""
    require_empty(best_page(golden, pages, shortest=SHORTEST_PAGE).where(~F.col("agrees")), "the evidence is on another page than labelled")


def agreement_summary(best: DataFrame) -> DataFrame:
    """One row: ``n, agree, disagree, least, most, mean`` of the scores."""
    return best.agg(F.count("*").alias("n"), F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"))


def alignment(left: DataFrame, right: DataFrame, *, margin: float = 0.05) -> DataFrame:
    """``doc_id, page_num, same, before, after, drifts, short``: two readings of the same pages (``doc_id, page_num, text``) compared.

    ``same``, ``before`` and ``after`` are the shares of the left page's distinct tokens that the right page of the same number,
    the one before and the one after have. A page drifts if a neighbour has more than ``margin`` more; it is short if the
    right text is under half as long as the left. A right page that is missing counts as empty.
    """
    words = lambda df, name: df.select("doc_id", "page_num", F.array_distinct(tokens(F.col("text"))).alias(name), F.length(F.coalesce("text", F.lit(""))).alias(f"{name}_len"))
    a, b = words(left, "want"), words(right, "have")
    # a band of three pages is an equality join once every right page stands under its neighbours' numbers too
    near = b.select("doc_id", F.explode(F.array(*[F.col("page_num") + d for d in (-1, 0, 1)])).alias("page_num"), F.col("page_num").alias("own"), "have", "have_len")
    joined = a.join(near, ["doc_id", "page_num"], "left")
    share = F.when(F.size("want") > 0, F.round(F.size(F.array_intersect("want", F.coalesce("have", F.array().cast("array<string>")))) / F.size("want"), 6)).otherwise(0.0)
    at = lambda d: F.coalesce(F.max(F.when(F.col("own") - F.col("page_num") == d, share)), F.lit(0.0))
    length = F.coalesce(F.max(F.when(F.col("own") == F.col("page_num"), F.col("have_len"))), F.lit(0))
    grouped = joined.groupBy("doc_id", "page_num").agg(at(0).alias("same"), at(-1).alias("before"), at(1).alias("after"), length.alias("_right"), F.max("want_len").alias("_left"))
    return grouped.select("doc_id", "page_num", "same", "before", "after", (F.greatest("before", "after") - F.col("same") > margin).alias("drifts"), (F.col("_right") < 0.5 * F.col("_left")).alias("short"))
