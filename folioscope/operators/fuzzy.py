"""Fuzzy similarity of texts, 0 to 100: the longest common subsequence over both lengths, of whole texts, best places and sets of words."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shortest page that evidence is looked for on, and the characters of the evidence that are compared.
SHORTEST_PAGE, SNIPPET = 300, 500


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as one number's bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The shorter text against its best place in the longer one; 0 if it is empty.

    Places whose characters alone cannot do better than the best so far are passed over.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n, best = len(short), 0.0
    need, seen = Counter(short), Counter()
    shared = 0
    for end, c in enumerate(long, 1):
        seen[c] += 1
        shared += seen[c] <= need[c]
        if end > n:
            gone = long[end - n - 1]
            shared -= seen[gone] <= need[gone]
            seen[gone] -= 1
        if end >= n and 100.0 * shared / n > best:
            best = max(best, ratio(short, long[end - n : end]))
            if best == 100.0:
                break
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The words that both have against those with the rest of each; 100 if one's words are all in the other, 0 if one has none."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)


def score(a: Column, b: Column, kind: str) -> Column:
    """``ratio``, ``partial_ratio`` or ``token_set_ratio`` of two columns, over Arrow batches; nulls count as ''."""
    one = {"ratio": ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio}[kind]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y)], index=x.index)

    return run(a, b)


def best_page(golden: DataFrame, pages: DataFrame, *, kind: str = "token_set_ratio", shortest: int = SHORTEST_PAGE, snippet: int = SNIPPET) -> DataFrame:
    """``qid, best_page, score, agrees``: the page of the question's document that reads most like the evidence, the first of equal ones.

    The first ``snippet`` characters of the evidence are compared, as the score asks for texts of like length, with pages of ``shortest`` characters at least. Meant as a guard over golden questions:
    every page of their documents is scored; for a corpus see ``golden.best_page``. Questions without evidence text or without a page don't come out.
    """
    asked = golden.where(F.length("evidence_text") > 0).select("qid", "doc_id", "evidence_pages", F.substring("evidence_text", 1, snippet).alias("want"))
    there = pages.where(F.length("text") >= shortest).select("doc_id", "page_num", "text")
    scored = asked.join(there, "doc_id").select("qid", "page_num", "evidence_pages", F.round(score(F.col("want"), F.col("text"), kind), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "page_num")
    first = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("qid", F.col("page_num").alias("best_page"), "score", F.array_contains("evidence_pages", F.col("page_num")).alias("agrees"))
