"""Joins of the retrieval and ingestion flows.

No side carries a broadcast hint: Spark broadcasts a side only when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, and AQE splits skewed
partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_with_defaults(left: DataFrame, right: DataFrame, on: str, fill: Sequence[str]) -> DataFrame:
    """Left join whose missing right values become empty strings."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in fill})


def not_yet_done(todo: DataFrame, done: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is absent from the finished set (resume)."""
    keys = [on] if isinstance(on, str) else list(on)
    return todo.join(done.select(*keys), keys, "left_anti")


def filtered_else_all(filtered: DataFrame, fallback: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Per key: the filtered rows, or the fallback rows where the filter left none."""
    keys = [key] if isinstance(key, str) else list(key)
    missing = fallback.join(filtered.select(*keys).distinct(), keys, "left_anti")
    return filtered.unionByName(missing, allowMissingColumns=True)


def attach_parent_text(docs: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace the text of a retrieved child by its parent's text where there is one."""
    known = parents.select("parent_id", F.col("parent_text").alias("_pt"))
    joined = docs.join(known, "parent_id", "left")
    return joined.select(
        *[c for c in docs.columns if c not in ("text", "child_text")],
        F.when(F.col("_pt").isNotNull(), F.col("text")).alias("child_text"),
        F.coalesce("_pt", "text").alias("text"),
    )
