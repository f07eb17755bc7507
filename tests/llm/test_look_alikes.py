from itertools import combinations

import pytest

from folioscope.functions.readingform import reading_form
from folioscope.llm import look_alikes as la
from folioscope.llm.shared import written

ROWS = [
    ("k1", "Net sales rose"), ("k2", "Net sаles rose"), ("k3", "Net sales rose"), ("k3", "Net sales rose"), ("k4", "Net sales​ rose"),
    ("k5", "net sales rose"), ("k6", "café"), ("k7", "café"), ("k8", "cafe"), ("k9", "​﻿"), ("k10", ""), ("k11", None), ("k12", "　"),
    (None, "Net sales rose"), ("k13", "ﬁne １２"), ("k14", "fine 12"), ("k15", "fine 13"), ("k16", "Net sales rose"),
]


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, body string, text_a int")
    texts = written(la.keyed_texts(df, "id", "body", "f"), "t")
    return df, texts, la.classes(texts, [(df, "body", "f")])


def pairs(spark, rows, **options):
    _, texts, classes = found(spark, rows)
    return sorted(tuple(r) for r in la.same_reading_pairs(texts, classes, **options).collect())


def canonical(spark, rows):
    df, _, classes = found(spark, rows)
    return la.canonical_texts(df, "id", "body", "f", classes)


def brute(rows):
    unique = sorted({r for r in rows if r[0] and r[1] and reading_form(r[1]).strip()})
    return sorted((a[0], b[0]) for a, b in combinations(unique, 2) if a[0] != b[0] and a[1] != b[1] and reading_form(a[1]) == reading_form(b[1]))


@pytest.mark.parametrize("block", [1024, 2])
def test_pairs_against_brute_force(spark, block):
    assert pairs(spark, ROWS, block=block) == [("f", *p) for p in brute(ROWS)]


def test_a_class_that_is_cut_into_blocks(spark):
    rows = [(f"k{i:03}", "Velmora" if i % 3 else "Velmοra") for i in range(60)] + [("x", "Velmora​")]
    assert [p[1:] for p in pairs(spark, rows, block=7)] == brute(rows)


def test_one_member_stands_for_each_class(spark):
    got = {r["key"]: r["canonical"] for r in canonical(spark, ROWS).where("key IS NOT NULL").collect()}
    least = min(t for _, t in ROWS if t and reading_form(t) == "Net sales rose")
    assert got["k1"] == got["k2"] == got["k3"] == got["k4"] == least
    assert got["k5"] == "net sales rose" and got["k6"] == got["k7"] == min(dict(ROWS)["k6"], dict(ROWS)["k7"]) and got["k8"] == "cafe"
    assert not {"k9", "k10", "k11", "k12"} & set(got) and got["k13"] == got["k14"] == "fine 12"
    assert canonical(spark, []).count() == 0


def test_links_count_members_with_another_text(spark):
    _, texts, classes = found(spark, ROWS)
    got = {r["key"]: r["links"] for r in la.members(texts, classes).where("key IS NOT NULL").collect()}
    unique = {r for r in ROWS if r[1] and reading_form(r[1]).strip()}
    assert got == {k: sum(t != u and reading_form(t) == reading_form(u) for _, u in unique) for k, t in unique if k}


def test_the_collation_decides(spark, monkeypatch):
    rows = [("a", "cafe\u0301"), ("b", "caf\u00e9"), ("c", "cafe"), ("d", "cafe\u200b")]
    assert pairs(spark, rows) == [("f", "a", "b"), ("f", "c", "d")]
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, **k: sql(self, q.replace("COLLATE UNICODE", "COLLATE UTF8_BINARY"), **k))
    assert pairs(spark, rows) == [("f", "c", "d")]  # bytes do not see one accent stored in two ways
    monkeypatch.setattr(type(spark), "sql", lambda self, q, **k: sql(self, q.replace("COLLATE UNICODE", "COLLATE UNICODE_AI"), **k))
    assert len(pairs(spark, rows)) == 6  # without accents all are one


def test_digits_of_other_scripts_read_differently(spark):
    rows = [("a", "page 1"), ("b", "page ١"), ("c", "pаge 1"), ("d", "pаge ١")]
    assert [p[1:] for p in pairs(spark, rows)] == [("a", "c"), ("b", "d")] == brute(rows)


def test_a_long_text(spark):
    assert pairs(spark, [("a", "х" * 300_000), ("b", "x" * 300_000)]) == [("f", "a", "b")]
