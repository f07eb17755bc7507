"""A stream of chunks merged into a keyed table, and running counts of late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.versions import BUCKETS, upsert


def merge_stream(chunks: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges each micro-batch into the keyed table at ``path``: of each chunk id the row ingested last stays. A batch that runs again after a failure changes nothing, and only the buckets it touches are written."""
    order = [F.col("ingested_at").desc_nulls_last(), F.col("text").asc_nulls_last()]
    writer = chunks.writeStream.foreachBatch(lambda batch, _: upsert(batch, path, ["chunk_id"], order, buckets=buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_counts(chunks: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """``from, doc_id, rows``: rows of each document in windows of their ingestion; those later than the watermark are dropped."""
    counted = chunks.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "doc_id").agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("from"), "doc_id", "rows")
