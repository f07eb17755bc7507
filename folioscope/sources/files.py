"""Files read with explicit schemas: layout elements, golden questions, grading sheets, reports, word lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.tables import TABLE

GOLDEN = "qid string, question string, answer string, answer_type string, doc_id string, evidence_pages array<int>, evidence_text string"
ELEMENTS = f"doc_id string, element_index int, page_num int, pages array<int>, multi_page boolean, element_type string, docling_label string, text string, table {TABLE}"
SHEET = ("qid", "answer_type", "question", "gold_answer", "generated_answer", "cited_pages", "answer_hash", "human_verdict")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of golden questions; blank lines are skipped, fields that are missing are null."""
    return spark.read.schema(GOLDEN).json(path).where("qid IS NOT NULL")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of layout elements of one document or, by a path with wildcards, of many; a missing index is 0. The order is the column ``element_index``."""
    rows = spark.read.schema(ELEMENTS).json(path).where("element_type IS NOT NULL OR text IS NOT NULL")
    return rows.withColumn("element_index", F.coalesce("element_index", F.lit(0)))


def documents_in(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``doc_id`` of every file ``<doc_id><suffix>`` in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"{suffix.replace('.', '[.]')}$", "").alias("doc_id"))


def page_credit(elements: DataFrame) -> DataFrame:
    """``doc_id, page_num, text`` where an element counts on every page it spans, unlike in chunking, where it counts on its first."""
    each = elements.select("doc_id", "element_index", "text", F.explode(F.coalesce("pages", F.array("page_num"))).alias("page_num")).where("page_num IS NOT NULL")
    entry = F.struct("element_index", F.coalesce("text", F.lit("")).alias("text"))
    return each.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n").alias("text"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A grading sheet: CSV with a header, every column a string, cells with quotes and line feeds."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def read_report(path: str) -> dict:
    """A report: one JSON document, small."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def report_metrics(spark: SparkSession, report: dict) -> DataFrame:
    """``group, metric, value`` of a report's metrics."""
    return spark.createDataFrame([(g, m, float(v)) for g, ms in report["metrics"].items() for m, v in ms.items() if isinstance(v, (int, float))], "`group` string, metric string, value double")


def read_words(path: str) -> tuple[str, ...]:
    """A word list: lower case, blank lines and those with a ``#`` first left out, each word once, sorted."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted({w for line in f if (w := line.strip().lower()) and not w.startswith("#")}))
