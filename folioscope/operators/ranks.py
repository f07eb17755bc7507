"""Positions within groups, also where one group has a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import written
from folioscope.session import parallelism

#: Rows of a group from which several tasks put it in order, and bytes, as the plan estimates them, up to which no group can be too large for one.
HOT_ROWS, PLAIN_BYTES = 2_000_000, 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of a result as the plan estimates them, from the sizes of its files; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, *, hot_rows: int = HOT_ROWS, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """``df`` with ``name``, the position of each row in its group ``by``, from 1; ``order`` should be total. The same result at every size.

    Where the plan's estimate leaves room for a group too large for one task, groups are counted. Those beyond ``hot_rows`` are cut
    into ranges of the order, each range is numbered by itself, and the rows of the ranges before it are added.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    plainly = lambda rows, *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy(*order))
    if not by or estimated_bytes(df) <= plain_bytes:
        return df.withColumn(name, plainly(df))
    df = written(df, "to-be-numbered")
    hot = written(df.groupBy(*by).count().where(F.col("count") > hot_rows).select(*by), "hot-groups")  # no more than rows over hot_rows
    if hot.isEmpty():
        return df.withColumn(name, plainly(df))
    own = [F.col(c).alias(f"_h{k}") for k, c in enumerate(by)]
    keys, same = F.broadcast(hot.select(*own)), [F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(by)]
    rest = df.join(keys, same, "left_anti")
    ranges = written(df.join(keys, same, "left_semi").repartitionByRange(4 * parallelism(df.sparkSession), *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_rows")  # a group's ranges
    counts = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_rows")).withColumn("_before", before)
    counts = counts.select(*own, F.col("_range").alias("_r"), "_before")
    placed = ranges.join(counts, [*same, F.col("_range") == F.col("_r")])
    numbered = placed.withColumn(name, (plainly(placed, "_range") + F.col("_before")).cast("int"))
    return rest.withColumn(name, plainly(rest)).unionByName(numbered.select(*df.columns, name))
