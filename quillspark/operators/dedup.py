"""Keyed deduplication with explicit tie-breaks.

All of these aggregate on the map side first, so a key that holds a large share
of the rows costs one row per map task after the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key (insert-or-ignore: the first one wins)."""
    picked = df.groupBy(*keys).agg(F.min_by(_whole_row(df), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` per key (insert-or-replace: the last one wins)."""
    picked = df.groupBy(*keys).agg(F.max_by(_whole_row(df), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def merge_best(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], score: str = "score") -> DataFrame:
    """Best-scored row per key; among equal scores the first arrival stays.

    Adds ``seen_at``: the smallest arrival of the key, i.e. the position at which
    the key entered the merged list, even when a later row replaced its content.
    ``arrival`` columns must be numeric and unique within a key.
    """
    best = F.struct(F.col(score), *[(-F.col(a)).alias(f"_n{i}") for i, a in enumerate(arrival)])
    picked = df.groupBy(*keys).agg(
        F.max_by(_whole_row(df), best).alias("_row"),
        F.min(F.struct(*arrival)).alias("seen_at"),
    )
    return picked.select("_row.*", "seen_at")
