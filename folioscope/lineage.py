"""Tables written once to the folder all executors share, to cut lineage, and joins with counted sets of keys."""

from __future__ import annotations

import atexit
import shutil
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import shared_folder

#: Bytes of a set of keys up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
_registered: set[str] = set()


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/folioscope-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_end(spark_ref, path: str) -> None:
    try:
        _delete(spark_ref(), path)
    except Exception:  # the session has ended, and with it the way to any but a plain folder
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once here.

    A lost executor costs nothing of it. Plans made from the result hold no more than its path, so
    it is kept until ``clear`` or the interpreter's end. All tables of an application lie in one
    folder with its id, so what a killed driver left can be told from what is in use.
    """
    spark = df.sparkSession
    own = _own(spark)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own not in _registered:
        _registered.add(own)
        atexit.register(_at_end, weakref.ref(spark), own)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written; results not yet computed from them are lost. For long sessions, between queries."""
    _delete(spark, _own(spark))


def is_small(keys: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is proven to have no more than ``most`` bytes: by its rows, counted to a bound, times the largest row's bytes as text and 16 for each field."""
    rows = most // (16 * max(1, len(keys.columns)))
    if keys.limit(rows + 1).count() > rows:
        return False
    wide = F.lit(0)
    for name, kind in keys.dtypes:
        wide = wide + (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16))
    return (keys.agg(F.sum(wide.cast("long"))).first()[0] or 0) <= most


def having(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns ``on`` are in ``keys``, a written table: by broadcast if it ``is_small``, else by a shuffle."""
    return rows.join(F.broadcast(keys) if is_small(keys) else keys, on, "left_semi")
