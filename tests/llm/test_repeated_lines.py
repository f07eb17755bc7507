import random

import pytest

from folioscope.llm import repeated_lines as rl
from folioscope.llm.shared import written

SCHEMA = "id string, doc string, page int, body string, keys string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def found(spark, rows, at_least=3, counters=rl.COUNTERS):
    keyed = rl.keyed_rows(table(spark, rows), "id", "doc", "page", "body")
    confirmed = written(rl.repeated_lines(keyed, at_least, counters=counters), "c")
    return sorted(tuple(r) for r in rl.found_lines(keyed, confirmed).collect()), confirmed


def brute(rows, at_least=3):
    pages = {}
    for _, doc, page, body in rows:
        for line in (body or "").split("\n"):
            if (k := rl.line_key(line)) is not None and doc is not None and page is not None:
                pages.setdefault((doc, k), set()).add(page)
    return sorted({(i, n) for i, doc, page, body in rows for n, line in enumerate((body or "").split("\n"), 1) if (k := rl.line_key(line)) is not None and len(pages.get((doc, k), ())) >= at_least})


def random_rows(seed=3):
    rng = random.Random(seed)
    lines = ["Page 12 of 30", "PAGE  7 OF 99 ", "Pаge 1 of 2", "", "  ", "Unique", "* * *", "​", "Notice"]
    rows = []
    for i in range(300):
        body = "\n".join(rng.choice(lines) if rng.random() < 0.4 else f"line {rng.choice('abcdefghijklmnop') * rng.randrange(1, 9)}" for _ in range(rng.randrange(0, 7)))
        rows.append((f"c{i}", "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), body if i % 17 else None))
    return rows + rows[:40]


@pytest.mark.parametrize("counters", [rl.COUNTERS, 4, 1])
def test_against_brute_force_also_where_counters_are_shared(spark, counters):
    rows = random_rows()
    assert found(spark, rows, counters=counters)[0] == brute(rows)


def test_what_is_one_line():
    assert rl.line_key("Page 3 of 12") == rl.line_key("  pаge 10   of 4​ ") != rl.line_key("Page three of 12")
    assert rl.line_key("") is rl.line_key(" \t​") is None
    assert rl.line_key("é") == rl.line_key("É") != rl.line_key("e")


def test_empty_table_and_pages_of_one_number(spark):
    assert found(spark, [])[0] == []
    same = [(f"c{i}", "d", 1, "x\ny") for i in range(9)]  # many chunks of one page
    assert found(spark, same)[0] == []


def test_summaries_prune_and_lose_nothing(spark):
    rows = [(f"c{i}", "d", i, "\n".join(["HEAD", f"body {i:b}".replace("1", "x").replace("0", "y")])) for i in range(400)]
    keyed = rl.keyed_rows(table(spark, rows), "id", "doc", "page", "body").repartition(5)
    left = rl.candidates(keyed, 6)
    assert left.where(f"key = {rl.line_key('HEAD')}").count() == 400 and left.count() < 420  # of 800 lines
    assert rl.candidates(keyed, 6, counters=1).count() == 800


def test_many_sources_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(rl, "HELD", 2)
    rows = [(f"c{i}", f"s{i % 9}", i, "HEAD\nbody") for i in range(60)]
    assert found(spark, rows)[0] == brute(rows)


@pytest.mark.parametrize("small", [True, False])
def test_texts_come_out_without_the_lines(spark, monkeypatch, small):
    monkeypatch.setattr(rl, "is_small", lambda keys: small)
    rows = [*[(f"c{i}", "d", i, f"HEAD {i}\nbody {'x' * i}\n\nend of {'y' * i}") for i in range(1, 5)], ("n", "d", 9, None), ("o", None, 1, "HEAD 1"), ("p", "d", 10, "head 77"), ("q", "d", 11, "")]
    _, confirmed = found(spark, rows)
    clean = {r["id"]: (r["clean_text"], r["lines_removed"]) for r in rl.without_lines(table(spark, rows), confirmed, "doc", "body").collect()}
    assert clean["c1"] == ("body x\n\nend of y", 1) and clean["p"] == ("", 1)
    assert clean["q"] == ("", 0)
    assert clean["n"] == (None, 0) and clean["o"] == ("HEAD 1", 0)
    assert rl.without_lines(table(spark, rows), confirmed, "doc", "body").columns == ["id", "doc", "page", "body", "keys", "clean_text", "lines_removed"]
