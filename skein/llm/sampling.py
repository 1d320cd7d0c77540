"""Bounded samples of rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(rows: int, wanted: int) -> float:
    """The share of ``rows`` that gives at least ``wanted`` with room for chance: half again and some more."""
    return 1.0 if rows <= 2 * wanted else min(1.0, (1.5 * wanted + 100) / rows)


def below(key: Column, share: float) -> Column:
    """Whether a row's hash lies in the lowest ``share`` of all hashes: the same rows at every run."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(key) < F.lit(int(-(2**63) + share * 2**64))


def lowest(df: DataFrame, key: str, limit: int, rows: int) -> DataFrame:
    """At most ``limit`` rows of ``df``, those with the lowest hash of ``key``, where about ``rows`` are there.

    The cut by hash comes first, so that all tasks together, not each of them, send about ``limit`` rows on.
    """
    return df.where(below(F.col(key), share_of(rows, limit))).orderBy(F.xxhash64(key), key).limit(limit)
