"""Checks that stop a run with a message instead of giving a quiet wrong result."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_empty(wrong: DataFrame, message: str) -> None:
    """Raises ``ValueError`` with up to five of the rows, if there are any."""
    rows = wrong.take(5)
    if rows:
        raise ValueError(f"{message}, such as {[r.asDict() for r in rows]}")
