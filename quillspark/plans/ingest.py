"""Corpus ingestion: scan, metadata join, filter, two-level chunks, vectors, keyed write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ids, models
from quillspark.functions.chunking import ARTICLE_BOUNDARY, ChunkSpec, parents_and_children
from quillspark.functions.markup import strip_html
from quillspark.functions.text import REJECT_REASONS, SKIPPED_TYPES, VIETNAMESE, TextProfile, first_filled, or_empty, reject_reason
from quillspark.operators.dedup import last_per_key
from quillspark.operators.joins import not_yet_done
from quillspark.session import stored
from quillspark.settings import Settings

# Source column to metadata column.
METADATA_COLUMNS = {
    "so_ky_hieu": "document_number",
    "title": "title",
    "loai_van_ban": "legal_type",
    "linh_vuc": "legal_sectors",
    "co_quan_ban_hanh": "issuing_authority",
    "ngay_ban_hanh": "issuance_date",
    "nguon_thu_thap": "url",
}
META = list(METADATA_COLUMNS.values())


def valid_id(c: Column) -> Column:
    return c.cast("string").try_cast("long")


def read_content(spark: SparkSession, path: str, cfg: Settings, html: bool = True) -> DataFrame:
    """(doc_id, text) of the content files; rows without an integer id are dropped."""
    raw = spark.read.parquet(path)
    fields = [F.col(c) for c in ("content_html", "content") if c in raw.columns]
    body = first_filled(*fields)
    docs = raw.select(valid_id(F.col("id")).alias("doc_id"), body.alias("text")).where("doc_id is not null")
    return docs.withColumn("text", strip_html(F.col("text"))) if html else docs


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Renamed metadata, one row per id: the last one in file order wins."""
    raw = spark.read.parquet(path)
    rows = raw.select(
        valid_id(F.col("id")).alias("doc_id"),
        *[(F.col(s) if s in raw.columns else F.lit(None)).cast("string").alias(t) for s, t in METADATA_COLUMNS.items()],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    ).where("doc_id is not null")
    return last_per_key(rows, ["doc_id"], ["_file", "_row"]).drop("_file", "_row")


@dataclass(frozen=True)
class Ingested:
    """Lazy results of one ingestion; ``documents`` carries the reject reason."""

    documents: DataFrame
    parents: DataFrame
    children: DataFrame
    counters: DataFrame


def classify(
    content: DataFrame,
    metadata: DataFrame,
    cfg: Settings,
    profile: TextProfile = VIETNAMESE,
    skipped_types: tuple[str, ...] = SKIPPED_TYPES,
) -> DataFrame:
    """Content with its metadata (empty where missing) and the first reject reason."""
    joined = content.join(metadata, "doc_id", "left")
    filled = joined.withColumns({c: or_empty(F.col(c)) for c in META if c in joined.columns})
    missing = {c: F.lit("") for c in META if c not in joined.columns}
    filled = filled.withColumns(missing) if missing else filled
    return filled.withColumn(
        "reject_reason",
        reject_reason(F.col("text"), F.col("legal_type"), F.col("issuance_date"), cfg, profile, skipped_types),
    )


def pack(documents: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Documents with ``_p``, their parents and children; rejected texts are not chunked."""
    passed = F.when(F.col("reject_reason").isNull(), F.col("text"))
    return documents.withColumn("_p", parents_and_children(passed, spec))


def chunk(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of the accepted documents; no shuffle.

    The outer explosion keeps Spark from filtering on the size of ``_p`` first, which would cut every text twice;
    the row it adds for a document without parents has no children and goes with them.
    """
    accepted = packed.where("reject_reason is null")
    one = accepted.select("doc_id", *META, F.posexplode_outer("_p").alias("parent_index", "_parent")).withColumn(
        "parent_id", ids.parent_id(F.col("doc_id"), F.col("parent_index"))
    )
    kept = F.size("_parent.children") > 0
    parents = one.where(kept).select(
        "parent_id", "doc_id", F.col("_parent.parent_text").alias("parent_text"), *META
    )
    children = one.select(
        "parent_id", "doc_id", "parent_index", *META, F.posexplode("_parent.children").alias("child_index", "text")
    )
    cid = ids.child_id(F.col("doc_id"), F.col("parent_index"), F.col("child_index"))
    return parents, children.select(cid.alias("cid"), *children.columns)


def count_documents(packed: DataFrame) -> DataFrame:
    """All ingestion counters in one aggregation."""
    passed = F.col("reject_reason").isNull()
    sized = packed.select(
        "reject_reason",
        F.coalesce(F.size("_p"), F.lit(0)).alias("_np"),
        F.coalesce(
            F.aggregate("_p", F.lit(0), lambda acc, p: acc + F.size(p["children"])), F.lit(0)
        ).alias("_nc"),
    )
    chunked = F.col("_nc") > 0
    return sized.agg(
        F.count(F.lit(1)).alias("total_seen"),
        F.count_if(passed).alias("passed_filter"),
        F.count_if(chunked).alias("docs_with_chunks"),
        F.sum(F.when(chunked, F.col("_np")).otherwise(0)).alias("parents_generated"),
        F.sum("_nc").alias("chunks_generated"),
        *[F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in REJECT_REASONS],
    ).withColumn(
        "avg_children_per_parent",
        F.col("chunks_generated") / F.greatest(F.col("parents_generated"), F.lit(1)),
    )


def ingest(
    content: DataFrame,
    metadata: DataFrame,
    cfg: Settings | None = None,
    embedder: models.Embedder | None = None,
    done: DataFrame | None = None,
    profile: TextProfile = VIETNAMESE,
    boundary: str = ARTICLE_BOUNDARY,
    skipped_types: tuple[str, ...] = SKIPPED_TYPES,
    staged: bool = False,
) -> Ingested:
    """The whole ingestion as one lazy plan.

    ``staged`` stores the chunked documents once; use it when several of the results
    are read, as every one of them would otherwise repeat the chunking.
    """
    cfg = cfg or Settings()
    todo = not_yet_done(content, done, "doc_id") if done is not None else content
    packed = pack(classify(todo, metadata, cfg, profile, skipped_types), ChunkSpec.of(cfg, boundary))
    if staged:
        packed = stored(packed, "chunked")
    parents, children = chunk(packed)
    if embedder is not None:
        children = children.withColumn("dense_vector", models.embed(F.col("text"), embedder))
    return Ingested(packed.drop("_p"), parents, children, count_documents(packed))
