"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source has the same number of expected copies. Its whole part is certain; the
fractions are rounded dependently: token mass goes at random from one record to another until one
of the two has an integral number of copies, so every record keeps its expectation and the tokens
of its source stay as they were.

What cannot be rounded without changing the tokens is the last open record, so that one has to be
small. Records are therefore paired with records of like size, in many groups, which leaves one
open record of each group. A reduction tree merges groups until ``OPEN`` or fewer are left of each
size class; at its root, the open records of a source meet from the largest to the smallest, each
against all smaller ones together, so large ones are settled while there is much to make up for
them, and one of the smallest is left to be drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import written

#: Records that one group pairs about, groups that meet in one node of the tree, and groups of one size class that are left for the root.
BUCKET, FAN_IN, OPEN = 50_000, 64, 64
#: Fractions this close to 0 or 1 are 0 or 1.
NEAR = 1e-12


@dataclass(frozen=True)
class Plan:
    """For each source its target share, cap, records, tokens and the copies expected of each record; ``total`` is the mixture's size in tokens."""

    rows: list[tuple[str, float, int, int, int, float]]
    total: float


def plan(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> Plan:
    """Copies per record for each target, given (records, tokens) of each source.

    Without ``total`` the mixture is as large as the caps allow with every share met. A larger
    ``total`` takes each source as often as its cap allows, and shares are missed. Sources without
    tokens, a positive share or a cap give nothing; the shares of the others are scaled to sum to 1.
    """
    usable = {s: (share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and sizes.get(s, (0, 0))[1] > 0}
    weight = sum(share for share, _ in usable.values())
    reach = min((cap * sizes[s][1] * weight / share for s, (share, cap) in usable.items()), default=0.0)
    size = reach if total is None else total
    rows = []
    for s, share, cap in targets:
        records, tokens = sizes.get(s, (0, 0))
        copies = min(cap, size * share / weight / tokens) if s in usable else 0.0
        if abs(copies - round(copies)) < 1e-9:
            copies = float(round(copies))
        rows.append((s, float(share or 0.0), int(cap or 0), records, tokens, copies))
    return Plan(rows, size)


def _draw(seed: int, *parts: object) -> float:
    return xxhash.xxh3_64_intdigest(repr((seed, *parts))) / 2.0**64


def _snap(p: float) -> float:
    return 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p


def pivot(records: list[tuple[object, int, float]], seed: int) -> tuple[list[tuple[object, int, float]], tuple[object, int, float] | None]:
    """Rounds (key, tokens, fraction) pair by pair in order; returns the rounded ones, with 0.0 or 1.0, and the one left between, if any."""
    done, open_ = [], None
    for b in records:
        if b[2] in (0.0, 1.0):
            done.append(b)
            continue
        if open_ is None:
            open_ = b
            continue
        a = open_
        to_a = min(a[1] * (1 - a[2]), b[1] * b[2])  # mass that a can take and b can give
        to_b = min(a[1] * a[2], b[1] * (1 - b[2]))
        move = to_a if _draw(seed, a[0], b[0]) * (to_a + to_b) < to_b else -to_b
        open_ = None
        for key, tokens, p in ((a[0], a[1], _snap(a[2] + move / a[1])), (b[0], b[1], _snap(b[2] - move / b[1]))):
            if p in (0.0, 1.0) or open_ is not None:
                done.append((key, tokens, p))
            else:
                open_ = (key, tokens, p)
    return done, open_


def settle(records: list[tuple[object, int, float]], seed: int) -> list[tuple[object, int, float]]:
    """Rounds the open records of one source, largest first, each against all smaller ones together; all come back with 0.0 or 1.0.

    A move takes mass from the record and gives it to the others, or the other way, in the
    proportion of what each of them has to its nearer bound, and goes on until one of them is
    integral; both ways have one direction, so expectations stay. A record that the smaller ones
    cannot make up for loses its expectation, or the share would be missed by more than twice the smallest
    record: it stays out if a copy would put in more than all others can give back, and comes in if they
    cannot fill its place; if neither fits, whichever misses less is done. The last one is drawn.
    """
    order = sorted(records, key=lambda r: (-r[1], repr(r[0])))
    tokens = np.array([float(r[1]) for r in order])
    p = np.array([r[2] for r in order])
    least = 2 * tokens[-1] if len(order) else 0.0  # a miss that the last draw may make anyway
    for i in range(len(order)):
        step = 0
        while 0.0 < p[i] < 1.0:
            rest = np.arange(i + 1, len(p))
            rest = rest[(p[rest] > 0.0) & (p[rest] < 1.0)]
            t, q = tokens[rest], p[rest]
            give, take, own = float(t @ q), float(t @ (1 - q)), tokens[i]
            if not len(rest):
                p[i] = float(_draw(seed, "last", order[i][0]) < p[i] if own <= least else p[i] > 0.5)
                break
            over, under = own * (1 - p[i]) - give, own * p[i] - take
            if over > least or under > least:
                if over > under:  # out: the others take its mass, as far as they can
                    p[rest], p[i] = (1 - (1 - q) * max(0.0, -under / take)) if take else q, 0.0
                else:
                    p[rest], p[i] = q * max(0.0, -over / give), 1.0
            else:
                v = np.minimum(q, 1 - q)
                mass = float(t @ v)
                to_own = min(own * (1 - p[i]), float((q / v).min()) * mass)
                to_rest = min(own * p[i], float(((1 - q) / v).min()) * mass)
                move = to_own if _draw(seed, step, order[i][0]) * (to_own + to_rest) < to_rest else -to_rest
                p[i] = _snap(p[i] + move / own)
                p[rest] = q - v * move / mass
            p[rest] = [_snap(x) for x in p[rest]]
            step += 1
    return [(r[0], r[1], float(x)) for r, x in zip(order, p)]


_COLUMNS = ["source", "class", "node", "h", "key", "tokens", "p"]
_SCHEMA = "source string, class int, node long, h long, key string, tokens long, p double, settled boolean"


def _paired(rows: DataFrame, seed: int) -> DataFrame:
    """``pivot`` of each (source, class, node), as a stream over sorted partitions: a task holds one open record at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, at = None, None
        flat = lambda at, r, settled: (*at, *r[0], r[1], r[2], settled)
        for pdf in batches:
            out = []
            for source, kind, node, h, key, tokens, p in zip(*[pdf[c] for c in _COLUMNS]):
                if (source, kind, node) != at:
                    if open_:
                        out.append(flat(at, open_, False))
                    open_, at = None, (source, kind, node)
                done, open_ = pivot([*([open_] if open_ else []), ((h, key), tokens, p)], seed)
                out += [flat(at, r, True) for r in done]
            yield pd.DataFrame(out, columns=[*_COLUMNS, "settled"])
        if open_:
            yield pd.DataFrame([flat(at, open_, False)], columns=[*_COLUMNS, "settled"])

    return rows.repartition("source", "class", "node").sortWithinPartitions("source", "class", "node", "h", "key").mapInPandas(run, _SCHEMA)


def _rooted(rows: DataFrame, seed: int) -> DataFrame:
    """``settle`` of each source: at most ``OPEN`` records of each of its size classes, of which there are as many as a long has bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = settle([((h, key), tokens, p) for h, key, tokens, p in zip(pdf["h"], pdf["key"], pdf["tokens"], pdf["p"])], seed)
        return pd.DataFrame([(pdf["source"].iloc[0], *r[0], r[1], r[2]) for r in done], columns=["source", "h", "key", "tokens", "p"])

    return rows.groupBy("source").applyInPandas(run, "source string, h long, key string, tokens long, p double")


def size_class(tokens: Column) -> Column:
    """Number of a record's size class: those of one class differ by less than a factor of two."""
    return F.floor(F.log2(tokens)).cast("int")


def mixture(sized: DataFrame, p: Plan, *, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``key, source, tokens, copies`` of every record that the mixture has, with 1 to ``max_repeats`` copies.

    ``sized`` has ``key, source, tokens`` and should be a written table. Records of a source that
    has no target, of a null source, and those without tokens have no copies and do not come out. A
    repeated row is a record of its own. The same input and seed give the same mixture in every execution.
    """
    targets = [r for r in p.rows if r[5] > 0]
    records = sized.where("tokens > 0").select(F.col("key").cast("string").alias("key"), "source", F.col("tokens").cast("long").alias("tokens"))
    if not targets:
        return records.where("false").select("key", "source", "tokens", F.lit(0).cast("int").alias("copies"))
    table = sized.sparkSession.createDataFrame([(r[0], int(math.floor(r[5])), r[5] - math.floor(r[5])) for r in targets], "source string, whole int, fraction double")
    rows = records.join(F.broadcast(table), "source").withColumn("h", F.xxhash64("key", F.lit(seed)))
    certain = rows.where("fraction = 0").select("key", "source", "tokens", F.col("whole").alias("copies"))
    open_ = rows.where("fraction > 0").withColumn("class", size_class(F.col("tokens")))
    # a row for each size class of each target
    groups = open_.groupBy("source", "class").agg(F.greatest(F.lit(OPEN), F.ceil(F.count("*") / bucket)).cast("long").alias("nodes"))
    counted = written(groups, "mixture-groups")
    most = counted.agg(F.max("nodes")).first()[0]
    if most is None:
        return certain.where("copies > 0")
    level = open_.join(F.broadcast(counted), ["source", "class"]).select("source", "class", F.pmod("h", "nodes").alias("node"), "h", "key", "tokens", F.col("fraction").alias("p"))
    settled = []
    while True:
        done = written(_paired(level, seed), "pivotal")
        settled.append(done.where("settled").select("source", "h", "key", "tokens", "p"))
        left = done.where("NOT settled")
        if most <= OPEN:
            break
        most = max(OPEN, math.ceil(most / FAN_IN))
        level = left.withColumn("node", F.pmod("node", F.lit(most))).drop("settled")
    rounded = written(_rooted(left, seed), "pivotal-root")
    for s in settled:
        rounded = rounded.unionByName(s)
    extra = rounded.join(F.broadcast(table), "source").select("key", "source", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
    return certain.unionByName(extra).where("copies > 0")


def shares(mixed: DataFrame, p: Plan) -> DataFrame:
    """For each target: ``source, target_share, max_repeats, records, tokens, expected_copies, used_records, used_tokens, actual_share, most_repeats``; zeros for a source that gives nothing."""
    spark = mixed.sparkSession
    table = spark.createDataFrame(p.rows, "source string, target_share double, max_repeats int, records long, tokens long, expected_copies double")
    used = mixed.groupBy("source").agg(F.count("*").alias("used_records"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_repeats"))
    joined = table.join(F.broadcast(used), "source", "left").fillna(0, ["used_records", "used_tokens", "most_repeats"])
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # over the targets, not the records
    share = F.when(every > 0, F.col("used_tokens") / every).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "records", "tokens", "expected_copies", "used_records", "used_tokens", share.alias("actual_share"), "most_repeats")
