"""Index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions.models import HashingEmbedder
from quillspark.functions.vectors import dot
from quillspark.operators.ranking import page
from quillspark.plans import index
from quillspark.session import scratch_path
from quillspark.sinks.keyed import KeyedTable


def _old_and_new(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), F.col("source").alias("value"))
    rows = table(spark, sf, "events").select(
        (F.col("user_id") * 97).alias("cid"), F.col("event_type").alias("value"), F.col("event_id").alias("arrived")
    )
    return docs, rows


@query(
    """SELECT cid, value FROM (SELECT user_id * 97 AS cid, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
    WHERE r = 1 AND cid NOT IN (SELECT doc_id FROM documents)"""
)
def keyed_append(spark, sf):
    docs, rows = _old_and_new(spark, sf)
    return index.insert_or_ignore(docs, rows, "cid", ["arrived"]).select("cid", "value")


@query(
    """WITH latest AS (SELECT cid, value FROM (SELECT user_id * 97 AS cid, event_type AS value,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT cid, value FROM latest UNION ALL SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT cid FROM latest)"""
)
def keyed_upsert(spark, sf):
    docs, rows = _old_and_new(spark, sf)
    return index.upsert(docs, rows, "cid", ["arrived"]).select("cid", "value")


@query(
    """SELECT cid, value, arrived FROM (SELECT user_id * 97 AS cid, event_type AS value, event_id AS arrived,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS r FROM events) WHERE r = 1"""
)
def keyed_table_append(spark, sf):
    """Events in three batches into a bucketed table; the second batch comes twice."""
    _, rows = _old_and_new(spark, sf)
    target = KeyedTable(spark, scratch_path(spark, "keyed"), "cid", 8)
    for number in (0, 1, 1, 2):
        target.append(rows.where(F.col("arrived") % 3 == number), ["arrived"], ("events", number))
    target.compact()
    return target.read()


@query(
    """WITH batches AS (SELECT user_id * 97 AS cid, event_type AS value, event_id AS arrived FROM events
      UNION ALL SELECT doc_id, source, -1 FROM documents),
    last AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY (arrived >= 0 AND arrived % 2 = 1) DESC, arrived DESC) AS r FROM batches)
    SELECT cid, value, 'new' AS version FROM last WHERE r = 1
    UNION ALL SELECT doc_id, source, 'first' FROM documents"""
)
def keyed_table_replace(spark, sf):
    """Keys replaced by two batches; the first version can still be read."""
    docs, rows = _old_and_new(spark, sf)
    target = KeyedTable(spark, scratch_path(spark, "keyed"), "cid", 8)
    first = target.replace(docs.withColumn("arrived", F.lit(-1).cast("long")), ["arrived"])
    for odd in (0, 1):
        target.replace(rows.where(F.col("arrived") % 2 == odd), ["arrived"], ("events", odd))
    now = target.read().select("cid", "value", F.lit("new").alias("version"))
    return now.unionByName(target.read(first).select("cid", "value", F.lit("first").alias("version")))


def _line_points(spark, sf):
    """Order lines as points of their order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("point_id"), F.lit("old").alias("legal_type")
    )


def _order_meta(spark, sf):
    keep = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return keep.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("legal_type"))


@query(
    """SELECT coalesce(o_orderpriority, 'old') AS legal_type, count(*) AS points, sum(l_partkey)::BIGINT AS ids FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY 1"""
)
def enrich_points(spark, sf):
    out = index.enrich(_line_points(spark, sf), _order_meta(spark, sf))
    return out.groupBy("legal_type").agg(F.count(F.lit(1)).alias("points"), F.sum("point_id").alias("ids"))


@query(
    """WITH m AS (SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE o_orderstatus <> 'P')
    SELECT count(*) AS metadata_docs, count(n) AS matched_docs, sum(n)::BIGINT AS matched_points, count(*) - count(n) AS skipped_docs FROM m"""
)
def enrich_dry_run(spark, sf):
    return index.enrich_summary(_line_points(spark, sf), _order_meta(spark, sf))


@query(
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
    SELECT user_id, (r - 1) // 20 AS batch_no, count(*) AS points, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM p GROUP BY 1, 2"""
)
def point_batches(spark, sf):
    rows = index.point_batches(table(spark, sf, "events"), "user_id", "event_id", 20)
    return rows.select(
        "user_id", "batch_no", F.size("point_ids").cast("long").alias("points"),
        F.array_join(F.transform("point_ids", lambda x: x.cast("string")), ",").alias("ids"),
    )


@query(
    """SELECT unnest(['event_id', 'kind', 'value']) AS "column", unnest([count(event_id), count(CASE WHEN event_type <> 'error' THEN 1 END),
      count(CASE WHEN user_id % 3 = 0 THEN value END)]) AS non_null FROM events"""
)
def non_null_profile(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("value"),
    )
    return index.profile(rows)


@query("SELECT count(*) AS n_children, count(DISTINCT l_orderkey) AS n_parents FROM lineitem")
def index_summary(spark, sf):
    return index.index_summary(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "parent_id"))


@query(
    """SELECT coalesce(try_cast(CASE WHEN event_type = 'error' THEN 'c' || user_id ELSE user_id::VARCHAR END AS BIGINT), 0) AS community,
      count(*) AS n FROM events GROUP BY 1"""
)
def community_keys(spark, sf):
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("c"), F.col("user_id").cast("string"))).otherwise(
        F.col("user_id").cast("string")
    )
    rows = table(spark, sf, "events").select(key.alias("community"), F.lit("").alias("title"), F.lit("").alias("full_content"))
    return index.community_rows(rows).groupBy("community").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH rows AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'unknown' ELSE {Q.strip("text")} END AS body FROM benchmark
      WHERE item_id NOT IN (SELECT doc_id FROM labels)), {Q.vectors("v", "rows", "item_id", "body")}
    SELECT item_id, round(sum(x), 6) AS total, round(sum(x * x), 5) AS norm FROM rows JOIN v ON id = item_id GROUP BY 1"""
)
def embed_resume(spark, sf):
    """Graph rows not embedded yet, with the fallback text where the primary one is blank."""
    blank = F.col("item_id") % 3 == 0
    rows = table(spark, sf, "benchmark").select(
        "item_id", F.when(~blank, F.col("text")).alias("description"), F.lit(" ").alias("name")
    )
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    out = index.embed_rows(rows, done, "item_id", "description", "name", "unknown", HashingEmbedder(Q.DIM))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(
        "item_id", F.round(total, 6).alias("total"), F.round(dot(F.col("vector"), F.col("vector")), 5).alias("norm")
    )


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500 OFFSET 250")
def offset_page(spark, sf):
    """LIMIT with OFFSET is the operator here: a page of a resumed scan."""
    return page(table(spark, sf, "events").select("event_id", "user_id"), ["event_id"], 250, 500)


@query(
    """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS in_both,
      (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_documents,
      (SELECT count(DISTINCT text) FROM documents) AS distinct_texts"""
)
def id_set_operations(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = docs.select("doc_id").intersect(labels.select("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    only = docs.select("doc_id").subtract(labels.select("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    texts = docs.agg(F.count_distinct("text").alias("n"))
    named = [d.withColumn("k", F.lit(k)) for d, k in ((both, "in_both"), (only, "only_documents"), (texts, "distinct_texts"))]
    parts = named[0].unionByName(named[1]).unionByName(named[2])
    return parts.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("in_both", "only_documents", "distinct_texts")])
