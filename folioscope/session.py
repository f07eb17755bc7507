"""Session settings for a laptop, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session with UTC and AQE, as the tests and the bench use it; ``shared`` is its folder for written tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names; a temporary one only on one machine where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "folioscope-shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def parallelism(spark: SparkSession) -> int:
    """Partitions for a step whose work for each byte is large: the session's shuffle partitions, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many partitions as there are cores; one that has them already is left as it is.

    A few megabytes of text are one split to Spark and seconds of work to a tokenizer. For scans
    only: counting the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that functions run there whether or not they have it installed."""
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    package = Path(__file__).parent
    made = Path(tempfile.mkdtemp()) / "folioscope.zip"  # the driver serves it from here
    with zipfile.ZipFile(made, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(made))
    atexit.register(shutil.rmtree, made.parent, True)
    context._folioscope_shipped = True
