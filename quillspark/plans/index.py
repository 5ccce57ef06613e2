"""Index maintenance: keyed writes, copies, metadata enrichment, graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import models
from quillspark.functions.text import first_filled, or_empty, strip
from quillspark.functions.vectors import assert_dim, quantise, unpack
from quillspark.operators.blocks import OrderedBlocks
from quillspark.operators.dedup import first_per_key, last_per_key


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows to append: the first new row of every key the table does not hold."""
    return first_per_key(new, [key], order).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Table content after replacing the rows of the new keys; the last new row wins."""
    latest = last_per_key(new, [key], order)
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


# Payload of an indexed chunk.
PAYLOAD = ("cid", "parent_id", "text", "doc_id", "title", "legal_type", "url")


def points_of(children: DataFrame, dim: int) -> DataFrame:
    """Index points of stored children; packed vectors are unpacked, the size is checked."""
    vec = F.col("dense_vector")
    if dict(children.dtypes)["dense_vector"] == "binary":
        vec = unpack(vec, dim)
    return children.select(*PAYLOAD, assert_dim(vec, dim).alias("embedding"))


def copy_points(legacy: DataFrame) -> DataFrame:
    """Points of the older layout: text under ``content`` or ``text``, blanks fall through."""
    columns = [F.col(c) for c in ("content", "text") if c in legacy.columns]
    return legacy.select("id", "vector", "cid", first_filled(*columns).alias("text"))


def clean_value(c: Column, kind: T.DataType) -> Column:
    """Metadata value as text: missing and "nan" to empty, dates to ISO form, else trimmed."""
    if isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = strip(c.cast("string"))
    lowered = or_empty(text)
    missing = lowered.isin("nan", "NaN") if isinstance(kind, (T.FloatType, T.DoubleType)) else lowered == "nan"
    return F.when(missing, F.lit("")).otherwise(lowered)


def clean_metadata(metadata: DataFrame, key: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in metadata.schema.fields}
    return metadata.select(
        key, *[clean_value(F.col(c), kinds[c]).alias(c) for c in metadata.columns if c != key]
    )


def profile(df: DataFrame) -> DataFrame:
    """Non-null count of every column, as (column, non_null) rows, from one scan."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null")) for c in df.columns]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def enrich(points: DataFrame, metadata: DataFrame, on: str = "doc_id") -> DataFrame:
    """All points, with the metadata of their document overriding older payload values."""
    new = [c for c in metadata.columns if c != on]
    renamed = metadata.select(on, *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = points.join(renamed, on, "left")
    keep = [c for c in points.columns if c not in new]
    values = [
        (F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in points.columns else F.col(f"_new_{c}")).alias(c) for c in new
    ]
    return joined.select(*keep, *values)


def enrich_summary(points: DataFrame, metadata: DataFrame, on: str = "doc_id") -> DataFrame:
    """Dry-run report: metadata ids, matched ids, matched points, unmatched ids."""
    per_doc = points.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    return metadata.select(on).distinct().join(per_doc, on, "left").agg(
        F.count(F.lit(1)).alias("metadata_docs"),
        F.count("_n").alias("matched_docs"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("matched_points"),
        F.count_if(F.col("_n").isNull()).alias("skipped_docs"),
    )


def point_batches(points: DataFrame, on: str, point: str, size: int) -> DataFrame:
    """(doc, batch_no, point_ids): the points of a document in lists of at most ``size``."""
    placed = OrderedBlocks(points.select(on, point), [on], [point]).position("_pos").rows()
    batch = ((F.col("_pos") - 1) / size).cast("long")
    return placed.groupBy(on, batch.alias("batch_no")).agg(
        F.array_sort(F.collect_list(point)).alias("point_ids")
    )


def embed_rows(
    rows: DataFrame,
    done: DataFrame | None,
    key: str,
    primary: str,
    secondary: str,
    literal: str,
    embedder: models.Embedder,
) -> DataFrame:
    """Graph rows with vectors; rows already in the target are skipped (resume by key)."""
    todo = rows.join(done.select(key), key, "left_anti") if done is not None else rows
    text = first_filled(strip(F.col(primary)), strip(F.col(secondary)), F.lit(literal))
    return todo.withColumn("vector", assert_dim(models.embed(text, embedder), embedder.dim))


def entity_rows(entities: DataFrame) -> DataFrame:
    return entities.select(*[or_empty(F.col(c).cast("string")).alias(c) for c in ("id", "name", "description")])


def community_rows(reports: DataFrame) -> DataFrame:
    """Community key as LONG, unreadable keys as 0."""
    return reports.select(
        F.coalesce(F.col("community").cast("string").try_cast("double").cast("long"), F.lit(0)).alias("community"),
        or_empty(F.col("title")).alias("title"),
        or_empty(F.col("full_content")).alias("full_content"),
    )


def with_codes(points: DataFrame, vec: str, bound: float) -> DataFrame:
    """Points with an int8 code column next to the exact vectors."""
    return points.withColumn("code", quantise(F.col(vec), F.lit(bound)))


def index_summary(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count(F.lit(1)).alias("n_children"), F.count_distinct("parent_id").alias("n_parents")
    )
