"""Incremental ingestion: each micro-batch of documents goes through the batch plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quillspark.functions import models
from quillspark.functions.chunking import ARTICLE_BOUNDARY
from quillspark.functions.text import VIETNAMESE, TextProfile
from quillspark.plans.ingest import ingest
from quillspark.settings import Settings
from quillspark.sinks.keyed import KeyedTable
from quillspark.streaming.runner import drain_batches


def ingest_stream(
    content: DataFrame,
    metadata: DataFrame,
    parents_path: str,
    children_path: str,
    cfg: Settings | None = None,
    embedder: models.Embedder | None = None,
    profile: TextProfile = VIETNAMESE,
    boundary: str = ARTICLE_BOUNDARY,
    stream: str | None = None,
    buckets: int = 64,
) -> None:
    """Append new parents and children of every micro-batch to two keyed tables.

    ``stream`` names the source in the tables' snapshots: a micro-batch that is replayed after a
    failure is known by its number and does nothing.  Each call that starts from a new streaming
    checkpoint needs a name of its own; rows whose keys are known are not added in any case.
    """
    cfg = cfg or Settings()
    stream = stream or uuid.uuid4().hex
    spark = content.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        parents = KeyedTable(spark, parents_path, "parent_id", buckets)
        children = KeyedTable(spark, children_path, "cid", buckets)
        done = ingest(batch, metadata, cfg, embedder, profile=profile, boundary=boundary, staged=True)
        parents.append(done.parents, ["doc_id"], (stream, number), cfg.shard_rows)
        children.append(done.children, ["doc_id", "parent_index", "child_index"], (stream, number), cfg.shard_rows)

    drain_batches(content, "ingest", apply)
