"""Web fallback: page search, content gate, call sharing and call spacing."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions.ids import cache_key, web_id
from quillspark.functions.text import content_tokens, first_filled, overlap_ratio, smart_truncate, strip
from quillspark.operators.blocks import OrderedBlocks
from quillspark.operators.dedup import first_per_key
from quillspark.operators.terms import search_terms, term_index
from quillspark.session import stored


class WebSource(Protocol):
    def find(self, queries: DataFrame, limit: int) -> DataFrame:
        """(cache_key, rank, url, title, content, raw_content, score) of (cache_key, query)."""


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


class PageSource:
    """Offline source: term search over a table of pages (url, title, text)."""

    def __init__(self, pages: DataFrame, domains: Sequence[str] = ()) -> None:
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
        allowed = F.lit(not domains)
        for d in domains:
            allowed = allowed | (host == d) | host.endswith("." + d)
        self.pages = pages.where(allowed)

    def find(self, queries: DataFrame, limit: int) -> DataFrame:
        asked = queries.select(
            F.col("cache_key").alias("qid"), content_tokens(F.col("query")).alias("payload")
        )
        corpus = self.pages.select(F.col("url").alias("id"), content_tokens(F.col("text")).alias("payload"))
        # stored, so that Spark knows how few pages are fetched
        hits = stored(search_terms(asked, term_index(corpus), limit), "web-hits")
        rows = hits.select(F.col("qid").alias("cache_key"), F.col("id").alias("url"), "rank").join(self.pages, "url")
        scored = rows.join(queries, "cache_key")
        share = overlap_ratio(content_tokens(F.col("query")), content_tokens(F.col("text")))
        return scored.select(
            "cache_key", "rank", "url", "title", F.lit("").alias("content"),
            F.col("text").alias("raw_content"), F.coalesce(share, F.lit(0.0)).alias("score"),
        )


def web_documents(results: DataFrame) -> DataFrame:
    """Usable results as documents: full page before snippet, short pages dropped, text cut."""
    content = strip(first_filled(F.col("raw_content"), F.col("content")))
    usable = results.withColumn("_c", content).where(F.length("_c") >= S.WEB_MIN_CHARS)
    return usable.select(
        *[c for c in ("cache_key", "rank") if c in results.columns],
        web_id(F.col("url")).alias("cid"),
        F.concat(F.lit("[Nguồn: "), F.col("url"), F.lit("]\n"), smart_truncate(F.col("_c"), S.WEB_MAX_CHARS)).alias("text"),
        F.bround(F.col("score"), 4).alias("score"),
        "url",
        "title",
        F.lit(True).alias("from_web"),
    )


def shared_calls(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct calls, request to call map): identical questions share one call."""
    keyed = requests.withColumn("cache_key", cache_key(F.col("query")))
    calls = first_per_key(keyed.select("cache_key", "query", "qid"), ["cache_key"], ["qid"])
    return calls.select("cache_key", "query"), keyed.select("qid", "cache_key")


def search_web(requests: DataFrame, source: WebSource, limit: int = S.WEB_RESULTS) -> DataFrame:
    """Web documents of every request (qid, query)."""
    calls, mapping = shared_calls(requests)
    docs = web_documents(source.find(calls, limit))
    return mapping.join(docs, "cache_key").drop("cache_key")


def spaced_starts(calls: DataFrame, order: Sequence[str], at: str, interval: int, keys: Sequence[str] = ()) -> DataFrame:
    """Start time of each call under a minimum spacing, in the unit of ``at`` (an integer).

    start(i) = max over j <= i of (t(j) - j * interval) + i * interval, which needs
    a position and a running maximum; both are computed over ordered blocks.
    """
    placed = OrderedBlocks(calls, keys, order).position("_i")
    shifted = F.col(at) - F.col("_i") * interval
    out = placed.running("_m", "max", shifted).rows()
    return out.withColumn("start_at", F.col("_m") + F.col("_i") * interval).withColumn(
        "waited", F.col("start_at") - F.col(at)
    ).drop("_i", "_m")
