"""Tables and documents written: caches, indexes with their policy, sheets, canonical reports. Keyed and frozen tables are in ``versions``."""

from __future__ import annotations

import hashlib
import os
import subprocess
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import bm25
from folioscope.settings import canonical_json
from folioscope.sources.versions import freeze, matches, thaw


def append_to_cache(added: DataFrame, path: str) -> None:
    """Appends what a cache lacked."""
    added.write.mode("append").parquet(path)


def save_bm25(chunks: DataFrame, path: str, p: bm25.Bm25, fingerprint: str) -> None:
    """Idf of all terms, the corpus and its size as tables, under the policy and fingerprint they were made from."""
    s = bm25.statistics(chunks, p)
    size = chunks.sparkSession.createDataFrame([(s.n, s.avgdl)], "n long, avgdl double")
    freeze({"idf": bm25.idf(s, p), "size": size, "chunks": chunks.select("chunk_id", "text")}, path, policy(p, fingerprint))


def policy(p: bm25.Bm25, fingerprint: str) -> dict[str, Any]:
    words = hashlib.sha256("".join(f"{w}\x00" for w in sorted(p.stopwords)).encode()).hexdigest()[:16]
    return {"version": 1, "token": bm25.TOKEN, "k1": p.k1, "b": p.b, "epsilon": p.epsilon, "stopwords": words, "fingerprint": fingerprint}


def search_saved(spark: SparkSession, path: str, questions: DataFrame, k: int, p: bm25.Bm25, fingerprint: str) -> DataFrame:
    """``qid, chunk_id, score, rank`` from a saved index, the same that ``bm25.retrieve`` gives; raises if it was made under another policy or from another corpus."""
    table = lambda name: thaw(spark, path, name, policy(p, fingerprint))
    n, avgdl = table("size").first()
    return bm25.retrieve(table("chunks"), questions, k, p, stats=bm25.Statistics(n, avgdl, table("idf").select("term", "df")))


def open_bm25(chunks: DataFrame, path: str, p: bm25.Bm25, fingerprint: str) -> bool:
    """Makes the saved index at ``path`` fit a corpus: it is kept if policy and fingerprint match, else built again. Says whether it was built."""
    if matches(chunks.sparkSession, path, policy(p, fingerprint)):
        return False
    save_bm25(chunks, path, p, fingerprint)
    return True


def write_sheet(sheet: DataFrame, path: str) -> int:
    """A grading sheet as CSV that spreadsheets read; returns how many answers are to be graded."""
    sheet.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return sheet.where("human_verdict = ''").count()


def write_golden(golden: DataFrame, path: str) -> None:
    """JSON lines in order of document and question, in one file."""
    golden.orderBy("doc_id", "qid").coalesce(1).write.mode("overwrite").json(path)


def provenance(root: str = ".") -> dict[str, Any]:
    """Commit and whether the tree has changes; None where there is no repository."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    head = run("rev-parse", "HEAD")
    return {"git_sha": head.stdout.strip() if head.returncode == 0 else None, "git_dirty": bool(run("status", "--porcelain").stdout.strip()) if head.returncode == 0 else None}


def build_report(metrics: DataFrame, settings: dict[str, Any], config_hash: str, **more: Any) -> dict[str, Any]:
    """A report as one document; ``metrics`` is ``group, metric, value`` of one run. What is None in ``more`` is left out."""
    groups: dict[str, dict[str, float]] = {}
    for r in metrics.collect():
        groups.setdefault(r["group"], {})[r["metric"]] = r["value"]
    return {"config": settings, "config_hash": config_hash, "metrics": groups, **{k: v for k, v in more.items() if v is not None}}


def write_report(report: dict[str, Any], folder: str) -> str:
    """``<config hash>.json`` with sorted keys and line feeds, byte for byte the same for the same report; written beside and moved."""
    path = Path(folder) / f"{report['config_hash']}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    import json

    new = path.with_suffix(".new")
    new.write_text(json.dumps(json.loads(canonical_json(report)), sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8", newline="\n")
    os.replace(new, path)
    return str(path)
