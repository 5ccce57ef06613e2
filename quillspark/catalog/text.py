"""Text predicates, scalars, projections and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions import ids, parsing, text
from quillspark.functions.models import sigmoid
from quillspark.operators.ranking import top_k
from quillspark.plans import index, retrieve, web
from quillspark.session import spread
from quillspark.settings import Settings

SKIPPED = ("src3", "src11")
LETTERS = text.VIETNAMESE_LETTERS


def _reason_sql(letter_class: str) -> str:
    lines = f"list_transform(regexp_split_to_array(text, {Q.lit(text.LINE_BREAK)}), lambda x: {Q.strip('x')})"
    meaningful = rf"len(list_filter({lines}, lambda x: length(x) > 20 AND NOT regexp_full_match(x, '[#\-=_\s|]+')))"
    skipped = " OR ".join(f"contains(source, '{s}')" for s in SKIPPED)
    return rf"""CASE
        WHEN {Q.strip("text")} = '' THEN 'no_content'
        WHEN length(text) < 10 OR regexp_matches(text, '[^\p{{L}}\p{{N}}_\s]{{20,}}')
          OR (length(text) - length(replace(text, '|', '')))::DOUBLE / greatest(length(text), 1) > 0.10
          OR len(regexp_extract_all(text, '{letter_class}')) < 5 THEN 'corrupted'
        WHEN length(text) < 300 THEN 'too_short'
        WHEN length(text) > 500000 THEN 'too_long'
        WHEN {meaningful} < 3 THEN 'few_lines'
        WHEN {skipped} THEN 'legal_type'
        WHEN 1960 + doc_id % 80 < 1986 THEN 'too_old' END"""


def _reasons(spark: SparkSession, sf: str, profile: text.TextProfile) -> DataFrame:
    issued = F.concat(F.lit("01/02/"), (F.lit(1960) + F.col("doc_id") % 80).cast("string"))
    reason = text.reject_reason(F.col("text"), F.col("source"), issued, Settings(), profile, SKIPPED)
    return spread(table(spark, sf, "documents")).select("doc_id", "n_chars", reason.alias("reject_reason"))


@query(f"SELECT doc_id, {_reason_sql(r'\p{L}')} AS reject_reason FROM documents")
def filter_cascade(spark, sf):
    return _reasons(spark, sf, text.NEUTRAL).drop("n_chars")


@query(f"SELECT doc_id, {_reason_sql('[' + LETTERS + ']')} AS reject_reason FROM documents")
def filter_cascade_default_profile(spark, sf):
    return _reasons(spark, sf, text.VIETNAMESE).drop("n_chars")


@query(
    f"""SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n, sum(n_chars)::BIGINT AS chars
    FROM (SELECT n_chars, {_reason_sql(r'\p{L}')} AS reject_reason FROM documents) GROUP BY 1"""
)
def reject_stats(spark, sf):
    return _reasons(spark, sf, text.NEUTRAL).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query(f"SELECT doc_id, md5({Q.fold('text')}) AS folded FROM documents")
def normalize_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


def _last(sep: str) -> str:
    at = f"strpos(reverse(w), {Q.lit(sep[::-1])})"
    return f"CASE WHEN {at} = 0 THEN -1 ELSE length(w) - {at} - {len(sep) - 1} END"


@query(
    f"""SELECT doc_id, md5(cut) AS cut_md5, length(cut)::BIGINT AS cut_chars FROM (
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text
      WHEN s > 160 THEN rtrim(left(w, s + 1), {Q.WS})
      WHEN n > 160 THEN rtrim(left(w, n), {Q.WS})
      ELSE rtrim(w, {Q.WS}) || '…' END AS cut
    FROM (SELECT *, greatest({_last(". ")}, {_last(chr(46) + chr(10))}, {_last("? ")}, {_last(":" + chr(10))}) AS s,
      {_last(chr(10))} AS n FROM (SELECT doc_id, text, left(text, 400) AS w FROM documents)))"""
)
def truncate_at_sentence(spark, sf):
    cut = text.smart_truncate(F.col("text"), 400)
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.md5(cut).alias("cut_md5"), F.length(cut).cast("long").alias("cut_chars")
    )


@query(
    r"""SELECT o_orderkey, try_cast(nullif(regexp_extract(d, '/(\d{4})$', 1), '') AS INTEGER) AS issued_year
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE ' ' || strftime(o_orderdate, '%d/%m/%Y') || ' ' END AS t, trim(t) AS d FROM orders)"""
)
def year_of_issue(spark, sf):
    written = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" "))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.year_of(written).alias("issued_year"))


@query(
    f"""SELECT doc_id, len(k)::BIGINT AS n_tokens, md5(array_to_string(list_sort(k), ' ')) AS token_md5
    FROM (SELECT doc_id, {Q.content_tokens("text")} AS k FROM documents)"""
)
def overlap_tokens(spark, sf):
    kept = text.content_tokens(F.col("text"))
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.size(kept).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(kept), " ")).alias("token_md5")
    )


WORDS = ("with by", "ring", "que")
_HAS = " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS)


@query(
    f"""SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id,
      (n_chars % 1000) / 1000.0::DOUBLE + CASE WHEN {_HAS} THEN 0.05 ELSE 0 END AS score FROM documents)
    ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""
)
def keyword_boost_topk(spark, sf):
    base = (F.col("n_chars") % 1000) / F.lit(1000.0)
    scored = table(spark, sf, "documents").select(
        "doc_id", F.round(retrieve.boost(base, F.col("text"), WORDS), 6).alias("score")
    )
    return top_k(scored, [F.col("score").desc(), F.col("doc_id")], 50)


@query(
    f"""SELECT doc_id FROM documents WHERE lang = 'en' AND
    len(list_filter(list_distinct({Q.tokens("'The, of WITH'")}), lambda t: NOT list_contains({Q.tokens("text")}, t))) = 0"""
)
def full_text_match(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("lang") == "en")
    return docs.where(text.contains_all_words(F.col("text"), F.lit("The, of WITH"))).select("doc_id")


@query(
    r"""SELECT event_id, try_cast(json_extract_string(j, '$.k') AS BIGINT) AS k FROM (SELECT event_id,
      CASE event_type WHEN 'click' THEN props WHEN 'signup' THEN NULL ELSE regexp_extract('reply: ' || props || ' done', '(\{[\s\S]*?\})', 1) END AS j
      FROM events)"""
)
def json_in_reply(spark, sf):
    reply = (
        F.when(F.col("event_type") == "click", F.col("props"))
        .when(F.col("event_type") == "signup", F.lit("no {json here"))
        .otherwise(F.concat(F.lit("reply: "), F.col("props"), F.lit(" done")))
    )
    found = F.from_json(parsing.embedded_json(reply), "map<string,string>")
    return table(spark, sf, "events").select(
        "event_id", F.try_element_at(found, F.lit("k")).try_cast("long").alias("k")
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 2 WHEN 'error' THEN 0 ELSE 1 END::BIGINT AS n_ids,
      CASE event_type WHEN 'click' THEN event_id + user_id WHEN 'view' THEN event_id + user_id WHEN 'error' THEN 0 ELSE user_id END::BIGINT AS id_sum
    FROM events"""
)
def parse_id_lists(spark, sf):
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("["), e, F.lit(", "), u, F.lit("]")))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), e, F.lit(" "), u, F.lit("]")))
        .when(F.col("event_type") == "error", F.lit(""))
        .otherwise(u)
    )
    found = parsing.parse_ids(raw)
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "events").select(
        "event_id", F.size(found).cast("long").alias("n_ids"), total.alias("id_sum")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN user_id % 2 = 0
      THEN 'art ' || event_id || E'\n\n' || 'sec ' || user_id ELSE 'plain ' || event_id END AS context FROM events"""
)
def parse_context_lists(spark, sf):
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = (
        F.when(F.col("event_type") == "view", F.lit(" "))
        .when(F.col("user_id") % 2 == 0, F.concat(F.lit("[' art "), e, F.lit("', '', 'sec "), u, F.lit("']")))
        .otherwise(F.concat(F.lit(" plain "), e))
    )
    return table(spark, sf, "events").select("event_id", parsing.parse_context(raw).alias("context"))


_REPLY_INTENT = """CASE event_type WHEN 'click' THEN 'LEGAL_LOOKUP' WHEN 'view' THEN 'PROCEDURE' WHEN 'error' THEN 'LEGAL_LOOKUP'
      WHEN 'purchase' THEN 'LEGAL_LOOKUP' ELSE 'DEFINITION' END"""


@query(
    f"""SELECT event_id, {_REPLY_INTENT} AS intent,
      CASE event_type WHEN 'error' THEN 'q' || event_id ELSE 'r' || user_id END AS refined_query,
      CASE event_type WHEN 'error' THEN 0.4 WHEN 'purchase' THEN 0.7 ELSE value END::DOUBLE AS confidence,
      CASE event_type WHEN 'error' THEN 'fallback' ELSE 'llm' END AS source,
      CASE event_type WHEN 'signup' THEN 'a/b/c' ELSE '' END AS expanded,
      CASE event_type WHEN 'signup' THEN 4 ELSE 0 END::BIGINT AS n_sub FROM events"""
)
def parse_model_reply(spark, sf):
    e, u, v = (F.col(c).cast("string") for c in ("event_id", "user_id", "value"))

    def body(intent: str, more: str = "", confidence=v):
        head = F.lit(f'{{"intent": "{intent}", "refined_query": " r')
        tail = F.lit("}") if confidence is None else F.concat(F.lit(', "confidence": '), confidence, F.lit("}"))
        return F.concat(head, u, F.lit(f' "{more}'), tail)

    raw = (
        F.when(F.col("event_type") == "click", body("legal_query"))
        .when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), body("PROCEDURE", ', "expanded_queries": "x"'), F.lit("\n```")))
        .when(F.col("event_type") == "error", F.lit("{not json"))
        .when(F.col("event_type") == "purchase", body("WEATHER", confidence=None))
        .otherwise(body("DEFINITION", ', "expanded_queries": ["a","b","c","d","e"], "sub_entities": ["1","2","3","4","5"]'))
    )
    r = parsing.parse_reply(raw, F.concat(F.lit("q"), e))
    return table(spark, sf, "events").withColumn("r", r).select(
        "event_id", "r.intent", "r.refined_query", "r.confidence", "r.source",
        F.array_join("r.expanded_queries", "/").alias("expanded"), F.size("r.sub_entities").cast("long").alias("n_sub"),
    )


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 2 END::BIGINT AS n_terms,
      CASE WHEN event_type IN ('click', 'view') THEN 0.75 END::DOUBLE AS weight FROM events"""
)
def parse_sparse_vectors(spark, sf):
    kind = F.col("event_type")
    indices = F.when(kind == "error", F.lit("[]")).when(kind == "signup", F.lit("broken")).otherwise(
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit("]"))
    )
    values = F.when(kind == "purchase", F.lit("[0.5]")).otherwise(F.lit("[0.5, 0.25]"))
    v = parsing.parse_sparse(indices, values)
    weight = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf, "events").select(
        "event_id", F.when(v.isNotNull(), F.size(v["indices"])).cast("long").alias("n_terms"), weight.alias("weight")
    )


@query(
    """SELECT page_id, 'web_' || left(md5(url), 8) AS web_id, md5(lower(trim(url))) AS cache_key,
      coalesce(try_cast('web_' || page_id AS BIGINT), -1) AS numeric_id FROM pages"""
)
def web_identifiers(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", ids.web_id(url).alias("web_id"), ids.cache_key(F.concat(F.lit(" "), url, F.lit("\n"))).alias("cache_key"),
        ids.numeric_or_minus_one(F.concat(F.lit("web_"), F.col("page_id").cast("string"))).alias("numeric_id"),
    )


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN source ELSE '' END AS text,
      (lang NOT IN ('en', 'fr')) AS no_text FROM documents"""
)
def payload_rename(spark, sf):
    legacy = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(None).alias("vector"), F.col("doc_id").alias("cid"),
        F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit("")).alias("content"),
        F.when(F.col("lang") == "fr", F.col("source")).alias("text"),
    )
    return index.copy_points(legacy).select(F.col("cid").alias("doc_id"), "text", (F.col("text") == "").alias("no_text"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS seen,
      CASE WHEN event_type IN ('error', 'view') THEN '' ELSE event_type END AS kind, user_id::VARCHAR AS owner FROM events"""
)
def metadata_cleaning(spark, sf):
    kind = F.col("event_type")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(kind != "click", F.col("ts")).alias("seen"),
        F.when(kind == "error", F.lit("nan")).when(kind != "view", F.concat(F.lit("  "), kind, F.lit("\n"))).alias("kind"),
        F.col("user_id").alias("owner"),
    )
    return index.clean_metadata(raw, "event_id")


@query(
    """SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN source ELSE 'unknown' END) AS body_md5
    FROM documents"""
)
def embed_text_fallback(spark, sf):
    lang = F.col("lang")
    primary = F.when(lang == "en", F.col("text")).otherwise(F.lit("  "))
    secondary = F.when(lang == "fr", F.col("source"))
    body = text.first_filled(F.when(text.strip(primary) != "", primary), text.strip(secondary), F.lit("unknown"))
    return table(spark, sf, "documents").select("doc_id", F.md5(body).alias("body_md5"))


@query(
    f"""SELECT page_id, 'web_' || left(md5(url), 8) AS cid, starts_with(body, url) AS short_page, round_even(page_id / 7.0::DOUBLE, 4) AS score
    FROM (SELECT page_id, url, {Q.strip("CASE page_id % 5 WHEN 0 THEN url ELSE html END")} AS body FROM pages) WHERE length(body) >= 100"""
)
def web_content_gate(spark, sf):
    """Pages without body (their address only) are too short to be used."""
    body = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html"))
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("rank"), "url", F.lit("").alias("title"),
        F.when(F.col("page_id") % 2 == 0, body).otherwise(F.lit("")).alias("raw_content"),
        body.alias("content"), (F.col("page_id") / F.lit(7.0)).alias("score"),
    )
    return web.web_documents(rows).select(
        F.col("rank").alias("page_id"), "cid",
        F.col("text").startswith(F.concat(F.lit("[Nguồn: "), "url", F.lit("]\n"), "url")).alias("short_page"), "score",
    )


@query(
    """SELECT event_id, round(1.0 / (1.0 + exp(-(value / 10.0 - 6.0))), 6) AS relevance,
      round_even(value, 1) AS shown FROM events"""
)
def sigmoid_and_rounding(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(sigmoid(F.col("value") / 10.0 - 6.0), 6).alias("relevance"), F.bround("value", 1).alias("shown")
    )


@query(
    """SELECT doc_id, md5(left(text, 800)) AS memory_cut, md5(left(text, 500)) AS report_cut, left(text, 100) AS preview
    FROM documents"""
)
def fixed_cuts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(F.left("text", F.lit(800))).alias("memory_cut"),
        F.md5(F.left("text", F.lit(500))).alias("report_cut"), F.left("text", F.lit(100)).alias("preview"),
    )


@query(
    """SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'en' THEN source ELSE '' END AS title,
      CASE WHEN lang = 'fr' THEN 'http://' || source ELSE '' END AS url, round_even(n_chars / 7.0::DOUBLE, 4) AS score,
      '' AS entity FROM documents"""
)
def source_format(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), F.col("doc_id").alias("cid"),
        F.when(F.col("lang") == "en", F.col("source")).alias("title"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("http://"), "source")).alias("url"),
        (F.col("n_chars") / F.lit(7.0)).alias("score"), F.lit(None).cast("string").alias("entity_label"), "text",
    )
    return retrieve.format_sources(docs).select("id", "title", "url", "score", "entity")
