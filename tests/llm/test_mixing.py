import random

import pytest

from folioscope.llm.mixing import mixture, pivot, plan, settle, shares

SCHEMA = "key bigint, source string, tokens bigint, p double"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]


def sized(spark, rows):
    return spark.createDataFrame([(*r, 9.0) for r in rows], SCHEMA)


def sizes(rows):
    out = {}
    for _, s, t in rows:
        if t:
            n, k = out.get(s, (0, 0))
            out[s] = (n + 1, k + t)
    return out


def corpus(seed=4, n=3000):
    rng = random.Random(seed)
    return [(i, rng.choices(["a", "b", "c", "z", None], [60, 20, 6, 3, 1])[0], int(rng.lognormvariate(4, 0.8)) if i % 40 else 0) for i in range(n)]


def test_pivot_keeps_tokens_and_expectation():
    rng = random.Random(1)
    records = [(i, rng.randrange(1, 50), 0.3) for i in range(200)]
    hits = [0] * 200
    for seed in range(300):
        done, left = pivot(records, seed)
        every = done + ([left] if left else [])
        assert len(every) == 200 and all(r[2] in (0.0, 1.0) for r in done)
        assert abs(sum(t * p for _, t, p in every) - sum(t * 0.3 for _, t, _ in records)) < 1e-6
        for k, _, p in every:
            hits[k] += p
    assert abs(sum(hits) / 300 - 60) < 3 and all(0.15 < h / 300 < 0.45 for h in hits)


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_shares_are_met_within_a_record(spark, bucket):
    rows = corpus()
    p = plan(sizes(rows), TARGETS)
    mixed = mixture(sized(spark, rows), p, bucket=bucket).persist()
    out = mixed.collect()
    caps = {s: cap for s, _, cap in TARGETS}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in out)
    assert len({r["key"] for r in out}) == len(out)
    for r in shares(mixed, p).collect():
        assert abs(r["used_tokens"] - p.total * r["target_share"]) <= max(t for _, s, t in rows if s == r["source"])
        assert abs(r["actual_share"] - r["target_share"]) < 0.02
    again = mixture(sized(spark, rows[::-1]).repartition(3), p, bucket=bucket).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_plan_respects_caps_and_absent_sources():
    p = plan({"a": (10, 1000), "b": (10, 100)}, [*TARGETS])
    by = {r[0]: r for r in p.rows}
    assert by["c"][5] == 0.0 and by["b"][5] == 2.0
    assert abs(by["a"][5] * 1000 / p.total - 0.5 / 0.8) < 1e-9
    assert plan({}, TARGETS).total == 0.0
    assert {r[0]: r[5] for r in plan({"a": (1, 10), "b": (1, 10), "c": (1, 10)}, TARGETS, total=1e9).rows} == {"a": 1.0, "b": 2.0, "c": 4.0}


def test_empty_and_repeated_rows(spark):
    p = plan({}, TARGETS)
    empty = mixture(sized(spark, []), p)
    assert empty.count() == 0
    assert [r["used_tokens"] for r in shares(empty, p).collect()] == [0, 0, 0]
    rows = [(1, "a", 10), (1, "a", 10), (2, "b", 10), (None, "b", 10), (3, "c", 10)]
    q = plan(sizes(rows), TARGETS)
    assert sum(r["copies"] * r["tokens"] for r in mixture(sized(spark, rows), q).collect()) <= q.total + 30


def heavy(n, seed, giants=()):
    """Lengths with a heavy tail: a few records hold most of the tokens."""
    rng = random.Random(seed)
    return [(i, max(1, int(rng.paretovariate(0.9) * 20))) for i in range(n)] + [(n + i, t) for i, t in enumerate(giants)]


def test_settling_keeps_expectations_and_tokens():
    records = [(i, t, 0.3) for i, t in heavy(120, 2) if t < 600]
    quota, hits = sum(t * 0.3 for _, t, _ in records), [0] * len(records)
    for seed in range(300):
        done = settle(records, seed)
        assert len(done) == len(records) and all(p in (0.0, 1.0) for _, _, p in done)
        assert abs(sum(t * p for _, t, p in done) - quota) <= 40
        for at, (_, _, p) in enumerate(sorted(done)):
            hits[at] += p
    assert all(0.17 < h / 300 < 0.43 for h in hits) and abs(sum(hits) / 300 - 0.3 * len(records)) < 2


@pytest.mark.parametrize("giant", [4_000, 9_000, 30_000])
def test_a_record_larger_than_what_its_source_may_give_does_not_spoil_the_share(giant):
    records = [(i, t, 0.2) for i, t in heavy(200, 3, [giant]) if t < 500 or t == giant]
    quota = sum(t * 0.2 for _, t, _ in records)
    for seed in range(40):
        assert abs(sum(t * p for _, t, p in settle(records, seed)) - quota) <= 40, seed


def test_open_records_alone_and_equal_ones():
    assert settle([], 0) == [] and settle([("a", 5, 0.5)], 1)[0][2] in (0.0, 1.0)
    assert sum(p for _, _, p in settle([(i, 7, 0.25) for i in range(40)], 3)) == 10


@pytest.mark.parametrize("bucket", [50_000, 30])
def test_shares_are_met_closely_with_heavy_tails(spark, bucket):
    rng = random.Random(8)
    rows = [(i, rng.choices(["a", "b", "c"], [60, 25, 15])[0], t) for i, t in heavy(9000, 9)]
    p = plan(sizes(rows), TARGETS)
    mixed = mixture(sized(spark, rows), p, bucket=bucket).persist()
    for r in shares(mixed, p).collect():
        assert abs(r["actual_share"] - r["target_share"]) <= 0.001
    mixed.unpersist()
