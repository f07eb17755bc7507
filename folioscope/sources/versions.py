"""Tables and sets of tables that are replaced as a whole or in parts, without a moment in which one is missing.

A folder holds data folders, each written once and never changed, and numbered manifests that name the data of a version. A version
is there from the moment its manifest is moved to its place under the next number; whatever fails before leaves the version
before as it was. One writer at a time: of two that publish the same number the second fails and has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.caches import last_wins

MANIFESTS = "_manifests"
#: Parts that a keyed table is kept in, by the hash of the key, where its first writer names no other number.
BUCKETS = 64


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    folder = at(f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0].isdigit())


def _read(spark: SparkSession, path: str, version: int) -> dict[str, Any]:
    lines = spark.read.text(f"{path}/{MANIFESTS}/{version:020}.json", wholetext=True)
    return json.loads(lines.first()[0])


def current(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The manifest of the newest version, None where there is none."""
    known = _versions(spark, path)
    return _read(spark, path, known[-1]) if known else None


def publish(spark: SparkSession, path: str, manifest: dict[str, Any]) -> int:
    """Makes a manifest the newest version; the move is the one step that counts."""
    fs, at = _fs(spark, path)
    version = manifest["version"]
    made, place = at(f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}"), at(f"{path}/{MANIFESTS}/{version:020}.json")
    out = fs.create(made)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(made, place):
        fs.delete(made, False)
        raise OSError(f"version {version} of {path} was published by another writer")
    return version


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> None:
    """Removes the data folders and manifests that none of the ``keep`` newest versions names, so that readers of the version before can finish."""
    fs, at = _fs(spark, path)
    known = _versions(spark, path)
    kept = known[-keep:]
    used = {f for v in kept for f in _read(spark, path, v)["folders"].values()}
    for status in fs.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in used:
            fs.delete(status.getPath(), True)
    for v in known[:-keep]:
        fs.delete(at(f"{path}/{MANIFESTS}/{v:020}.json"), False)


# --- keyed tables ----------------------------------------------------------------------------------


def ensure_table(spark: SparkSession, path: str, schema: str, key: Sequence[str], *, buckets: int = BUCKETS) -> bool:
    """Makes an empty keyed table if none is there, and says whether it did; one that is there under another key or with other types of the same columns raises."""
    fields = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    there = current(spark, path)
    if there is None:
        publish(spark, path, {"version": 1, "key": list(key), "buckets": buckets, "schema": fields, "folders": {}})
        return True
    other = {n: (there["schema"][n], t) for n, t in fields.items() if n in there["schema"] and there["schema"][n] != t}
    if other or there["key"] != list(key):
        raise ValueError(f"the table at {path} is kept by {there['key']} and differs in {other}")
    return False


def read_table(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The newest version of a keyed table, or some of its buckets."""
    m = current(spark, path)
    if m is None:
        raise FileNotFoundError(f"no table at {path}")
    parts = [f"{path}/{folder}/_bucket={b}" for b, folder in m["folders"].items() if buckets is None or int(b) in buckets]
    empty = spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in m["schema"].items()))
    return spark.read.schema(empty.schema).parquet(*parts) if parts else empty


def upsert(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[Column], *, buckets: int = BUCKETS) -> None:
    """Merges rows into the keyed table at ``path``: of each key the first by ``order`` stays. Running it twice changes nothing, and no step that fails loses a row.

    The table is kept in ``buckets`` by the hash of the key (the first call decides); only those that the rows touch are read and
    written again. ``order`` should be total. Columns that one side lacks are null.
    """
    spark = rows.sparkSession
    m = current(spark, path) or {"version": 0, "key": list(key), "buckets": buckets, "schema": {}, "folders": {}}
    if m["key"] != list(key):
        raise ValueError(f"the table at {path} is kept by {m['key']}")
    own = F.pmod(F.xxhash64(*key), F.lit(m["buckets"])).cast("int").alias("_bucket")
    new = rows.select("*", own)
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # no more than buckets
    if not touched:
        return
    every = read_table(spark, path, touched).select("*", own).unionByName(new, allowMissingColumns=True) if m["version"] else new
    merged = last_wins(every, [*key, "_bucket"], order)
    folder = f"data-{uuid.uuid4().hex}"
    # a bucket in files of an even size, however large
    merged.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fields = m["schema"] | {f.name: f.dataType.simpleString() for f in merged.schema if f.name != "_bucket"}
    publish(spark, path, m | {"version": m["version"] + 1, "schema": fields, "folders": m["folders"] | {str(b): folder for b in touched}})
    vacuum(spark, path)


# --- sets of tables --------------------------------------------------------------------------------


def freeze(tables: dict[str, DataFrame], path: str, manifest: dict[str, Any]) -> None:
    """Writes all tables to a new folder and publishes them with the manifest at once."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    before = _versions(spark, path)
    publish(spark, path, {"version": (before or [0])[-1] + 1, "folders": {name: folder for name in tables}, "manifest": manifest})
    vacuum(spark, path)


def matches(spark: SparkSession, path: str, expected: dict[str, Any]) -> bool:
    """Whether something is frozen at ``path`` whose manifest has all of ``expected``."""
    m = current(spark, path)
    return m is not None and all(m["manifest"].get(k) == v for k, v in expected.items())


def thaw(spark: SparkSession, path: str, name: str, expected: dict[str, Any]) -> DataFrame:
    """A frozen table; raises if its manifest differs from what is expected in any entry, or nothing is frozen."""
    m = current(spark, path)
    if m is None:
        raise FileNotFoundError(f"nothing is frozen at {path}")
    if wrong := {k: (m["manifest"].get(k), v) for k, v in expected.items() if m["manifest"].get(k) != v}:
        raise ValueError(f"frozen under another manifest: {wrong}")
    return spark.read.parquet(f"{path}/{m['folders'][name]}/{name}")
