"""Keyed table writes, checks and file exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import assert_dim
from quillspark.operators.dedup import first_per_key
from quillspark.operators.search import quantisation_bound
from quillspark.plans.golden import REVIEW_COLUMNS, review_rows
from quillspark.plans.index import upsert, with_codes
from quillspark.session import scratch_path
from quillspark.settings import QUANTILE, SHARD_ROWS
from quillspark.sources.files import table_exists


def append_new(rows: DataFrame, path: str, key: str, order: Sequence[str], shard_rows: int = SHARD_ROWS) -> None:
    """Append the first row of every key the table does not hold yet."""
    spark = rows.sparkSession
    fresh = first_per_key(rows, [key], order)
    if table_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").option("maxRecordsPerFile", shard_rows).parquet(path)


def replace_keys(rows: DataFrame, path: str, key: str, order: Sequence[str], shard_rows: int = SHARD_ROWS) -> str:
    """New version of a table with the given keys replaced; returns its path.

    Readers of the old version are not disturbed and an interrupted write leaves it whole.
    """
    spark = rows.sparkSession
    existing = spark.read.parquet(path) if table_exists(spark, path) else rows.limit(0)
    target = scratch_path(spark, path.rstrip("/").rsplit("/", 1)[-1])
    upsert(existing, rows, key, order).write.option("maxRecordsPerFile", shard_rows).parquet(target)
    return target


def create_table(rows: DataFrame, path: str, reset: bool = False) -> None:
    """Write a table unless it exists; ``reset`` replaces it."""
    rows.write.mode("overwrite" if reset else "ignore").parquet(path)


def create_collection(points: DataFrame, path: str, dim: int, quantile: float = QUANTILE, reset: bool = False) -> bool:
    """Write a searchable collection: checked vectors, int8 codes and a row describing them.

    Rows are laid out by id, so that fetching the texts of a few hits reads few row
    groups.  An existing collection is kept unless ``reset``.
    """
    spark = points.sparkSession
    if table_exists(spark, f"{path}/points") and not reset:
        return False
    checked = points.withColumn("embedding", assert_dim(F.col("embedding"), dim))
    bound = quantisation_bound(checked, "embedding", quantile)
    coded = with_codes(checked, "embedding", bound)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded.repartitionByRange(width, "cid").sortWithinPartitions("cid").write.mode("overwrite").parquet(f"{path}/points")
    about = spark.range(1).select(
        F.lit(dim).alias("dim"), F.lit("cosine").alias("metric"), F.lit(quantile).alias("quantile"), F.lit(bound).alias("bound")
    )
    about.write.mode("overwrite").json(f"{path}/about")
    return True


def verify_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, int]:
    """Row count per table; a missing table is an error."""
    missing = [name for name, path in paths.items() if not table_exists(spark, path)]
    if missing:
        raise RuntimeError(f"missing tables: {', '.join(sorted(missing))}")
    return {name: spark.read.parquet(path).count() for name, path in paths.items()}


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], bom: bool = True) -> None:
    """CSV with fixed columns; the byte-order mark precedes the first header name of each file."""
    first, *rest = columns
    head = ("﻿" if bom else "") + first
    named = rows.select(F.col(first).alias(head), *rest)
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_review(flagged: DataFrame, path: str) -> None:
    write_csv(review_rows(flagged), path, REVIEW_COLUMNS)


def log_metrics(metrics: DataFrame, params: dict, path: str, run: str | None) -> bool:
    """Run parameters and metrics as one JSON row; nothing is written without a run name."""
    if not run:
        return False
    tagged = metrics.withColumns({"run": F.lit(run), "params": F.lit(json.dumps(params, ensure_ascii=False))})
    tagged.write.mode("append").json(path)
    return True
