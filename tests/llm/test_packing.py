import random
from collections import defaultdict

import pytest

from folioscope.llm.packing import best_fit, fill_report, pack
from folioscope.llm.tokens import count_tokens, token_count

SCHEMA = "key bigint, tokens bigint, source string, cluster binary, bin string"


def brute(items, capacity, apart):
    bins, out = [], []
    for size, source, cluster in items:
        ok = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and not any(apart.get(source, 0) >> s & 1 for s in b["s"]) and (cluster < 0 or cluster not in b["c"])]
        if ok:
            i = min(ok)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[i]["room"] -= size
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
        out.append(i)
    return out


def test_tightest_compatible_bin_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        items = sorted(((rng.randrange(1, 40), rng.randrange(4), rng.choice([-1, -1, 0, 1])) for _ in range(80)), reverse=True)
        apart = {0: 0b10, 1: 0b01}
        assert best_fit(items, 40, apart) == brute(items, 40, apart)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def check(out, rows, sizes):
    sizes = dict(sizes)
    for name, capacity in sizes.items():
        own = [r for r in out if r["container"] == name]
        bins, items = defaultdict(int), defaultdict(list)
        for r in own:
            bins[r["bin"]] += r["tokens"]
            items[r["key"]].append(r["tokens"])
        assert all(b <= capacity for b in bins.values()) and all(r["fill"] == bins[r["bin"]] for r in own)
        for key, tokens, *_ in rows:
            if tokens:
                assert sum(items[str(key)]) == tokens
                assert len(items[str(key)]) == -(-tokens // capacity)
            else:
                assert str(key) not in items
        yield name, len(bins), -(-sum(bins.values()) // capacity)


@pytest.mark.parametrize("shard", [20_000, 60])
def test_every_token_once_and_little_room_left(spark, shard):
    rng = random.Random(2)
    rows = [(i, int(rng.lognormvariate(4, 1)) if i % 50 else 0, rng.choice(["a", "b", None]), bytes([i % 7]) if i % 3 == 0 else None) for i in range(600)]
    out = pack(rows_of(spark, rows), [("s", 100), ("l", 1000)], shard=shard).collect()
    for _, bins, least in check(out, rows, [("s", 100), ("l", 1000)]):
        # each of the last round's shards may leave bins open: 60 items are hardly six bins
        assert bins <= least * 1.1 + 6 + (0 if shard > len(rows) else len(rows) / shard)
    report = {r["container"]: r for r in fill_report(pack(rows_of(spark, rows), [("s", 100), ("l", 1000)], shard=shard)).collect()}
    assert report["s"]["tokens"] == report["l"]["tokens"] == sum(r[1] for r in rows)


def test_copies_and_conflicting_sources_are_kept_apart(spark):
    rows = [(i, 10, "a" if i < 6 else "b", b"same" if i < 4 else None) for i in range(12)]
    out = pack(rows_of(spark, rows), [("c", 100)], apart=[("a", "b")]).collect()
    bins = defaultdict(set)
    for r in out:
        bins[r["bin"]].add(int(r["key"]))
    for b in bins.values():
        assert len(b & {0, 1, 2, 3}) <= 1
        assert not (b & set(range(6)) and b & set(range(6, 12)))


def test_empty_repeated_and_huge(spark):
    assert pack(rows_of(spark, []), [("c", 10)]).count() == 0
    out = pack(rows_of(spark, [(1, 25, "a", None), (1, 25, "a", None), (2, 10, None, None)]), [("c", 10)]).collect()
    assert sum(r["tokens"] for r in out) == 60 and len({r["bin"] for r in out}) == 6


def test_tokens(spark):
    assert count_tokens(None) == count_tokens("") == 0
    assert count_tokens("<|endoftext|>") > 1
    text = "Net sales rose by 4.6%. " * 20_000
    df = spark.createDataFrame([(text,), (None,), ("",), ("net sales",)], "t string")
    assert [r[0] for r in df.select(token_count(df.t)).collect()] == [count_tokens(text), 0, 0, count_tokens("net sales")]
