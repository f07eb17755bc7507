"""Filling fixed-capacity containers with items by conflict-constrained best fit.

Items go by decreasing size into bins ordered by the room left in them. Each bin carries a bitmap
of the sources in it and one of the duplicate clusters in it; from the tightest bin that has room,
the search goes on to the next until one is compatible, and a new bin is opened if none is.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import written

#: Items that one shard packs by itself, and the fill from which a bin is left as it is in further rounds.
SHARD, FULL = 20_000, 0.99


def best_fit(items: Sequence[tuple[int, int, int]], capacity: int, apart: dict[int, int] | None = None) -> list[int]:
    """Bin number of each item (size, source bit number, cluster bit number or -1), in the order given.

    ``apart`` has for a source's number the bitmap of sources that must not share a bin with it.
    Items of one duplicate cluster never share a bin. Equal room goes to the older bin. Sizes are 1 to ``capacity``.
    """
    by_room: list[tuple[int, int]] = []  # (room, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        forbidden, own = (apart or {}).get(source, 0), 1 << cluster if cluster >= 0 else 0
        at = bisect_left(by_room, (size, -1))
        while at < len(by_room):
            b = by_room[at][1]
            if not (sources[b] & forbidden or clusters[b] & own):
                break
            at += 1
        if at < len(by_room):
            room, b = by_room.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= 1 << source
        clusters[b] |= own
        if room > size:
            insort(by_room, (room - size, b))
        out.append(b)
    return out


_SCHEMA = "container string, capacity int, bin string, fill int, key string, piece int, tokens int, source string, cluster binary"


def _packed(items: DataFrame, round_no: int, apart: Sequence[tuple[str, str]]) -> DataFrame:
    """``best_fit`` of every (container, shard), streamed over sorted partitions."""
    pairs = [tuple(p) for p in apart]
    columns = ["container", "capacity", "bin", "fill", "key", "piece", "tokens", "source", "cluster"]

    def pack(at: tuple, rows: list[tuple]) -> list[tuple]:
        container, capacity, shard = at
        names = {s: i for i, s in enumerate(sorted({r[3] or "" for r in rows}))}
        masks: dict[int, int] = {}
        for a, b in pairs:
            if a in names and b in names:
                masks[names[a]] = masks.get(names[a], 0) | 1 << names[b]
                masks[names[b]] = masks.get(names[b], 0) | 1 << names[a]
        seen: dict[bytes, int] = {}
        for r in rows:
            if r[4] is not None:
                seen[bytes(r[4])] = seen.get(bytes(r[4]), 0) + 1
        bits = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
        bins = best_fit([(r[2], names[r[3] or ""], bits.get(bytes(r[4]), -1) if r[4] is not None else -1) for r in rows], capacity, masks)
        fills: dict[int, int] = {}
        for b, r in zip(bins, rows):
            fills[b] = fills.get(b, 0) + r[2]
        return [(container, capacity, f"{container}-{round_no}-{shard}-{b}", fills[b], r[0], r[1], r[2], r[3], r[4]) for b, r in zip(bins, rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for pdf in batches:
            out = []
            for container, capacity, shard, *item in zip(*[pdf[c] for c in ("container", "capacity", "shard", "key", "piece", "tokens", "source", "cluster")]):
                if (container, capacity, shard) != at:
                    out += pack(at, held) if held else []
                    held, at = [], (container, capacity, shard)
                held.append(tuple(item))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(pack(at, held) if held else [], columns=columns)

    ordered = items.repartition("container", "capacity", "shard").sortWithinPartitions("container", "capacity", "shard", F.desc("tokens"), "key", "piece")
    return ordered.mapInPandas(run, _SCHEMA)


def pack(sized: DataFrame, containers: Sequence[tuple[str, int]], *, apart: Sequence[tuple[str, str]] = (), shard: int = SHARD, full: float = FULL) -> DataFrame:
    """``container, capacity, bin, fill, key, piece, tokens`` of every piece of every item, for each kind of container.

    ``sized`` has ``key, tokens, source, cluster`` and should be a written table; ``cluster`` is what
    copies of one text share (null: none). An item larger than the capacity is cut into full pieces,
    each a container of its own, and the rest, which is packed like any item; no other is split.
    Items without tokens go nowhere. A null source is the source ''. A repeated row is an item of its own.
    ``apart`` are pairs of sources that must not share a container.

    Full pieces are containers of their own, made without packing. Shards of about ``shard`` items, by the
    key's hash, are packed each in one task. Then the items of all bins filled to less than ``full`` are packed
    again in fewer shards, and so on until one is left, so a shard's last bins don't stay half empty; no task
    holds more than about two shards of items, however long texts are.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(int(c)).alias("capacity")) for n, c in containers])).alias("k")
    each = sized.where("tokens > 0").select(F.col("key").cast("string").alias("key"), F.col("tokens").cast("int").alias("tokens"), "source", "cluster", kinds).select("*", "k.*").drop("k")
    whole, rest = F.floor(F.col("tokens") / F.col("capacity")).cast("int"), F.col("tokens") % F.col("capacity")
    # repeated rows of an item are told apart by a number
    long = each.where("tokens >= capacity").groupBy("container", "capacity", "key", "tokens").count()
    copies = long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).withColumn("piece", F.explode(F.sequence(F.lit(1), whole)))
    name = F.concat_ws("-", "container", F.lit("full"), F.xxhash64("key", "tokens"), F.col("key"), F.col("copy"), F.col("piece"))
    done = copies.select("container", "capacity", name.alias("bin"), F.col("capacity").alias("fill"), "key", "piece", F.col("capacity").alias("tokens"))
    open_ = each.where(rest > 0).select("container", "capacity", "key", (whole + 1).alias("piece"), rest.alias("tokens"), "source", "cluster")
    spread = lambda df, n, salt: df.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(salt)), F.lit(n)).cast("int"))
    largest = lambda df: df.groupBy("container", "capacity").count().agg(F.max("count")).first()[0] or 0
    columns = ["container", "capacity", "bin", "fill", "key", "piece", "tokens"]
    settled = F.col("fill") >= full * F.col("capacity")
    shards, round_no = max(1, math.ceil(largest(open_) / shard)), 1
    while True:
        packed = _packed(spread(open_, shards, round_no), round_no, apart)
        if shards == 1:
            break
        packed = written(packed, "packed")
        open_ = packed.where(~settled).select("container", "capacity", "key", "piece", "tokens", "source", "cluster")
        fewer = max(1, math.ceil(largest(open_) / (2 * shard)))
        if fewer >= shards:  # hardly a bin is full: a further round would find the same
            break
        done = done.unionByName(packed.where(settled).select(*columns))
        round_no, shards = round_no + 1, fewer
    return done.unionByName(packed.select(*columns))


def fill_report(packed: DataFrame, *, full: float = FULL) -> DataFrame:
    """For each kind of container: ``container, capacity, bins, pieces, tokens, least_bins, fill_rate, settled_from``.

    ``least_bins`` is tokens over capacity, rounded up; ``settled_from`` is the fill from which packing left a bin as it was, the ``full`` it was packed with.
    """
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    return total.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill_rate", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6)).withColumn("settled_from", F.lit(float(full)))


def invariants(packed: DataFrame, items: DataFrame) -> DataFrame:
    """For each kind of container: ``container, capacity, items, overfull, split, met, lost``.

    ``items`` is what was packed (``key, tokens, source, cluster``, keys unique). Of the packed pieces: bins above their capacity, items
    that were split though they fit, bins with two items of one cluster, and tokens that are in no bin; all four are to be 0.
    """
    own = items.where("tokens > 0").select(F.col("key").cast("string").alias("key"), F.col("tokens").alias("size"), "cluster")
    joined = packed.join(own, "key")
    kind = ["container", "capacity"]
    bins = joined.groupBy(*kind, "bin").agg(F.sum("tokens").alias("t"), (F.count("cluster") - F.count_distinct("cluster")).alias("m"))
    per_bin = bins.groupBy(*kind).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), F.count_if(F.col("m") > 0).alias("met"))
    pieces = joined.groupBy(*kind, "key", "size").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    per_item = pieces.groupBy(*kind).agg(F.count("*").alias("items"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("split"), F.sum(F.col("size") - F.col("t")).alias("lost"))
    return per_item.join(per_bin, kind).select(*kind, "items", "overfull", "split", "met", "lost")
