"""Top-k and rank operators.

``row_number() <= k`` lets Spark place a group limit below the shuffle: each map
task sends at most k rows per key, so hot keys do not concentrate their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_bounded(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str = "rank"
) -> DataFrame:
    """Position within groups that are bounded by construction (the results of one question)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Global top-k; planned as per-task top-k and one small merge."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def best_and_worst(df: DataFrame, score: str, tie: str, k: int = 5) -> DataFrame:
    """The k best and the k worst rows with a positive score."""
    scored = df.where(F.col(score) > 0)
    best = top_k(scored, [F.col(score).desc(), F.col(tie)], k).withColumn("side", F.lit("best"))
    worst = top_k(scored, [F.col(score).asc(), F.col(tie)], k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
