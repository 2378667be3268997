"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def bounded(rows: DataFrame, limit: int, key: str) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of ``key``; all of them where there are no more."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(SCALE)) < int(SCALE * limit / n))
