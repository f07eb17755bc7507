"""Texts that people read of small results, and wall-clock times of steps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gate_line() -> Column:
    """A gated metric as one line: name, baseline, current, difference and whether it regressed."""
    return F.format_string("%s: %.4f -> %.4f (%s%.4f) %s", "metric", "baseline", "current", F.when(F.col("delta") < 0, "-").otherwise("+"), F.abs("delta"), F.when(F.col("regressed"), "REGRESSED").otherwise("ok"))


def gate_text(gate: DataFrame) -> str:
    """The gate's lines, the verdict first."""
    rows = gate.select("ok", "metric", gate_line().alias("line")).orderBy("metric").collect()  # a row for each gated metric
    return "\n".join([f"gate: {'passed' if all(r['ok'] for r in rows) else 'FAILED'}", *[r["line"] for r in rows]])


def why_not(dirty: str = "dirty", condition1: str = "condition1", condition2: str = "condition2") -> Column:
    """Why a run isn't adopted: its tree has changes, it loses somewhere, or it gains nowhere; '' if it is."""
    return F.when(F.col(dirty), "uncommitted changes").when(~F.col(condition1), "loses more than the tolerance").when(~F.col(condition2), "gains no more than the tolerance").otherwise("")


def table_text(df: DataFrame, *, order: Iterable[str] = ()) -> str:
    """A small result as aligned columns."""
    rows = [[_plain(x) for x in r] for r in (df.orderBy(*order) if order else df).collect()]
    widths = [max(map(len, col)) for col in zip(df.columns, *rows)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join(map(line, [df.columns, ["-" * w for w in widths], *rows]))


def _plain(x: Any) -> str:
    return "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


class Timer:
    """Milliseconds of steps by stage. The first call of each stage warms up and doesn't count; a stage of replayed results is not timed."""

    def __init__(self, *, warm_up: int = 1, clock: Callable[[], float] = time.perf_counter):
        self.warm_up, self.clock = warm_up, clock
        self.samples: list[tuple[str, float]] = []
        self._calls: dict[str, int] = {}

    @contextmanager
    def step(self, stage: str, *, replayed: bool = False):
        began = self.clock()
        yield
        self._calls[stage] = self._calls.get(stage, 0) + 1
        if not replayed and self._calls[stage] > self.warm_up:
            self.samples.append((stage, 1000.0 * (self.clock() - began)))

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        """Computes a result and throws it away, timed; a plan for many questions has one time, not one for each."""
        with self.step(stage):
            df.write.format("noop").mode("overwrite").save()
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """``stage, millis`` of the steps that count, for ``answers.latency``."""
        return spark.createDataFrame(self.samples, "stage string, millis double")
