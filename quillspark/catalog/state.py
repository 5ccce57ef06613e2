"""Resilience state and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog.ingest import _ACCEPTED
from quillspark.catalog.registry import query, table
from quillspark.catalog.text import SKIPPED
from quillspark.plans.web import micros, shared_calls, spaced_starts
from quillspark.streaming.runner import drain, drain_batches, state_session, table_stream
from quillspark.streaming.state import circuit_breaker, counters

DAY_US = 86_400_000_000
_US = "epoch_us(ts)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, {_US} AS t0, event_type IN ('error', 'view') AS failed,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (
      SELECT key, seq, i, t0, CASE WHEN failed THEN 1 ELSE 0 END AS c, 0::BIGINT AS until, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome FROM e WHERE i = 1
      UNION ALL
      SELECT e.key, e.seq, e.i, e.t0,
        CASE WHEN e.t0 < s.until THEN s.c WHEN NOT e.failed THEN 0 WHEN s.c + 1 >= 3 THEN 0 ELSE s.c + 1 END,
        CASE WHEN e.t0 < s.until THEN s.until WHEN NOT e.failed THEN 0 WHEN s.c + 1 >= 3 THEN e.t0 + {DAY_US} ELSE s.until END,
        CASE WHEN e.t0 < s.until THEN 'blocked' WHEN NOT e.failed THEN 'ok' WHEN s.c + 1 >= 3 THEN 'opened' ELSE 'failed' END
      FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
    SELECT key, seq, outcome FROM s"""
)
def circuit_breaker_state(spark, sf):
    """Breaker per user over all events, as keyed streaming state; cooldown of one day."""
    calls = table_stream(state_session(spark), sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("at"),
        F.col("event_type").isin("error", "view").alias("failed"),
    )
    return spark.read.parquet(drain(circuit_breaker(calls, cooldown_us=DAY_US), "breaker"))


_KEPT = _ACCEPTED.replace(" OR ".join(f"contains(source, '{s}')" for s in SKIPPED), "FALSE").replace(
    "WHEN 1960 + doc_id % 80 < 1986 THEN 'too_old' ", ""
)
SPACING_US = 200_000_000


@query(
    f"""WITH e AS (SELECT event_id, {_US} AS t0, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
    m AS (SELECT event_id, t0, i, max(t0 - i * {SPACING_US}) OVER (ORDER BY i) AS m FROM e)
    SELECT event_id, m + i * {SPACING_US} AS start_at, m + i * {SPACING_US} - t0 AS waited FROM m"""
)
def rate_limit(spark, sf):
    """One spacing rule over all calls, computed over ordered blocks instead of one task."""
    calls = table(spark, sf, "events").select("event_id", micros(F.col("ts")).alias("at"))
    return spaced_starts(calls, ["at", "event_id"], "at", SPACING_US).select("event_id", "start_at", "waited")


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_US} AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    m AS (SELECT event_id, user_id, t0, i, max(t0 - i * {DAY_US}) OVER (PARTITION BY user_id ORDER BY i) AS m FROM e)
    SELECT user_id, event_id, m + i * {DAY_US} AS start_at FROM m"""
)
def rate_limit_per_user(spark, sf):
    calls = table(spark, sf, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    return spaced_starts(calls, ["at", "event_id"], "at", DAY_US, ["user_id"]).select("user_id", "event_id", "start_at")


_FAIL = "event_type IN ('error', 'view')"


@query(
    f"""WITH e AS (SELECT *, {_FAIL} AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT *, max(CASE WHEN NOT failed THEN i ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS last_ok FROM e)
    SELECT user_id, event_id, i - last_ok AS failures_in_row FROM g"""
)
def consecutive_failures(spark, sf):
    """Running count of failures since the last success of the user."""
    from quillspark.operators.blocks import OrderedBlocks

    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").isin("error", "view").alias("failed"))
    placed = OrderedBlocks(rows, ["user_id"], ["ts", "event_id"]).position("i")
    last_ok = F.when(F.col("failed"), F.lit(0).cast("long")).otherwise(F.col("i"))
    out = placed.running("last_ok", "max", last_ok).rows()
    return out.select("user_id", "event_id", (F.col("i") - F.col("last_ok")).alias("failures_in_row"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def metrics_by_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counters_stream(spark, sf):
    """The same counters kept by a stream; the last state of the table is returned."""
    from quillspark.session import scratch_path

    path = scratch_path(spark, "counters")
    running = counters(table_stream(state_session(spark), sf, "events"), ["event_type"])
    drain_batches(running, "counters", lambda df, _: df.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path)


@query(
    """SELECT cache_key, query, n FROM (SELECT md5(lower(event_type || '/' || user_id)) AS cache_key, event_type || '/' || user_id AS query,
      count(*) OVER (PARTITION BY event_type, user_id) AS n, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events) WHERE r = 1"""
)
def shared_web_calls(spark, sf):
    """Identical questions share one call."""
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("qid"), F.concat_ws("/", "event_type", "user_id").alias("query")
    )
    calls, mapping = shared_calls(requests)
    users = mapping.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))
    return calls.join(users, "cache_key").select("cache_key", "query", "n")


@query(f"WITH {_KEPT} SELECT count(*) AS children, count(DISTINCT (doc_id, parent)) AS parents FROM kids")
def ingest_stream_tables(spark, sf):
    """Documents ingested as a stream; replayed micro-batches add nothing."""
    from quillspark.functions.chunking import LINE_BOUNDARY
    from quillspark.functions.text import NEUTRAL
    from quillspark.catalog.ingest import SMALL
    from quillspark.session import scratch_path
    from quillspark.sinks.keyed import KeyedTable
    from quillspark.streaming.ingest import ingest_stream

    parents, children = scratch_path(spark, "parents"), scratch_path(spark, "children")
    own = state_session(spark)
    meta = own.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("legal_type"))
    for _ in range(2):
        content = table_stream(own, sf, "documents").select("doc_id", "text")
        ingest_stream(content, meta, parents, children, SMALL, profile=NEUTRAL, boundary=LINE_BOUNDARY, buckets=8)
    kids = KeyedTable(spark, children, "cid").read()
    return kids.agg(F.count(F.lit(1)).alias("children"), F.count_distinct("parent_id").alias("parents"))
