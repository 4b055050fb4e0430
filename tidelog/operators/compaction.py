"""Merging runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.resolve import newest


def merge(log: DataFrame, purge: bool, keys: list[str] | None = None, seq: str = "seq", value: str = "value") -> DataFrame:
    """The newest version of each key.  purge: without deletions, right only if no older data remains elsewhere."""
    out = newest(log, keys or ["key"], seq)
    return out.filter(F.col(value).isNotNull()) if purge else out
