"""Corpus ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.catalog.text import SKIPPED, _reason_sql
from quillspark.functions.chunking import LINE_BOUNDARY, ChunkSpec, chunk_documents
from quillspark.functions.markup import strip_html as html_text
from quillspark.functions.text import NEUTRAL
from quillspark.operators.dedup import first_per_key, last_per_key
from quillspark.operators.joins import left_with_defaults, not_yet_done
from quillspark.plans import ingest as I
from quillspark.session import spread
from quillspark.settings import Settings

SMALL = Settings(parent_size_chars=900, child_size_chars=300, child_overlap_chars=60, min_child_chars=40)
SPEC = ChunkSpec.of(SMALL, LINE_BOUNDARY)


def _unescape(x: str) -> str:
    """The references that occur in the pages; the ampersand comes last, as in one pass."""
    named = f"replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    return f"regexp_replace({named}, '&amp;?', '&', 'g')"


_BARE = "regexp_replace(html, '(?is)<script[\\s>].*?</script>|<style[\\s>].*?</style>|<head[\\s>].*?</head>', '', 'g')"
_NODES = f"regexp_split_to_array({_BARE}, '(?s)<!--.*?-->|<[a-zA-Z/!][^>]*>')"
_TRIMMED = f"list_filter(list_transform({_NODES}, lambda n: {Q.strip(_unescape('n'))}), lambda n: n <> '')"
_PLAIN = Q.strip(_unescape(f"array_to_string({_TRIMMED}, chr(10))"))


@query(f"SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM (SELECT page_id, {_PLAIN} AS t FROM pages)")
def strip_html(spark, sf):
    """Plain text of every page."""
    body = html_text(F.col("html"))
    pages = spread(table(spark, sf, "pages")).select("page_id", body.alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars"))


@query(f"SELECT page_id, CASE WHEN contains(html, '<meta') THEN 0 ELSE length({_PLAIN}) END AS chars FROM pages")
def strip_html_strict(spark, sf):
    """The form that loses all text after an unclosed void element."""
    body = html_text(F.col("html"), strict=True)
    return spread(table(spark, sf, "pages")).select("page_id", F.length(body).cast("long").alias("chars"))


_PARENTS = f"""
art AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip("x")}), lambda x: x <> '') AS a FROM documents),
pack AS (
  WITH RECURSIVE p AS (
    SELECT doc_id, a, 1 AS i, 0 AS parent, length(a[1]) AS used, a[1] AS body FROM art WHERE len(a) > 0
    UNION ALL
    SELECT doc_id, a, i + 1,
      CASE WHEN used + length(a[i + 1]) > {{size}} THEN parent + 1 ELSE parent END,
      CASE WHEN used + length(a[i + 1]) > {{size}} THEN length(a[i + 1]) ELSE used + 2 + length(a[i + 1]) END,
      a[i + 1] FROM p WHERE i < len(a))
  SELECT doc_id, parent, string_agg(body, chr(10) || chr(10) ORDER BY i) AS parent_text FROM p GROUP BY 1, 2)"""


def _cut(sep: str) -> str:
    """End of the window after its last ``sep`` in the second half, null when absent (1-based, inclusive)."""
    n = len(sep)
    q = Q.lit(sep)
    half = "substr(parent_text, s + {half}, e - s - {half} + 1)"
    return (
        f"CASE WHEN contains({half}, {q}) THEN e - strpos(reverse({half}), {Q.lit(sep[::-1])}) + 1 - {n} + {n} END"
    )


_ENDS = ", ".join(_cut(s) for s in ("\n\n", "\n", ". ", " "))

_CHILDREN = f"""
kids AS (
  WITH RECURSIVE w AS (
    SELECT doc_id, parent, parent_text, 1 AS s, least({{child}}, length(parent_text)) AS e, 0 AS step FROM pack WHERE length(parent_text) > 0
    UNION ALL
    SELECT doc_id, parent, parent_text, ns, least(ns + {{child}} - 1, length(parent_text)), step + 1
    FROM (SELECT *, greatest(s + 1, stop - {{overlap}} + 1) AS ns FROM (
      SELECT *, CASE WHEN e < length(parent_text) THEN coalesce({_ENDS}, e) ELSE e END AS stop FROM w)
      WHERE stop < length(parent_text))),
  cut AS (SELECT *, CASE WHEN e < length(parent_text) THEN coalesce({_ENDS}, e) ELSE e END AS stop FROM w),
  kept AS (SELECT doc_id, parent, step, {Q.strip("substr(parent_text, s, stop - s + 1)")} AS text FROM cut)
  SELECT doc_id, parent, row_number() OVER (PARTITION BY doc_id, parent ORDER BY step) - 1 AS child, text
  FROM kept WHERE length(text) >= {{least}})"""


def _sized(body: str) -> str:
    return body.format(
        size=SMALL.parent_size_chars, child=SMALL.child_size_chars, half=SMALL.child_size_chars // 2,
        overlap=SMALL.child_overlap_chars, least=SMALL.min_child_chars,
    )


_CHUNKS = _sized(_PARENTS) + "," + _sized(_CHILDREN)


@query(f"WITH {_sized(_PARENTS)} SELECT doc_id, parent AS parent_index, md5(parent_text) AS parent_md5, length(parent_text) AS chars FROM pack")
def parent_packing(spark, sf):
    from quillspark.functions.chunking import parents_and_children

    docs = spread(table(spark, sf, "documents"))
    packed = docs.select("doc_id", F.posexplode(parents_and_children(F.col("text"), SPEC)).alias("parent_index", "_p"))
    return packed.where(F.col("_p.parent_text") != "").select(
        "doc_id", "parent_index", F.md5("_p.parent_text").alias("parent_md5"), F.length("_p.parent_text").cast("long").alias("chars")
    )


@query(f"WITH {_CHUNKS} SELECT doc_id, parent AS parent_index, child::INTEGER AS child_index, md5(text) AS text_md5, length(text) AS chars FROM kids")
def parent_child_chunks(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunk_documents(docs, SPEC).select(
        "doc_id", "parent_index", "child_index", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


@query(f"WITH {_CHUNKS} SELECT count(*) AS rows, count(DISTINCT (doc_id, parent, child)) AS distinct_ids, count(DISTINCT (doc_id, parent)) AS parents FROM kids")
def stable_chunk_ids(spark, sf):
    """Hashed ids are as distinct as the positions they are made of."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunk_documents(docs, SPEC).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cid").alias("distinct_ids"), F.count_distinct("parent_id").alias("parents")
    )


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.select(
        "doc_id", F.concat(F.lit("N"), F.col("quality").cast("string")).alias("document_number"),
        F.concat(F.lit("01/02/"), (F.lit(1960) + F.col("doc_id") % 80).cast("string")).alias("issuance_date"),
    )


@query(
    """SELECT d.doc_id, coalesce('N' || quality, '') AS document_number, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def metadata_left_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return left_with_defaults(docs, _metadata(spark, sf).select("doc_id", "document_number"), "doc_id", ["document_number"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return not_yet_done(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query(
    """SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
    FROM conversations) WHERE r = 1"""
)
def metadata_last_wins(spark, sf):
    """Duplicate metadata ids: the last row stays."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))
    return last_per_key(rows, ["conv_id"], ["turn"])


@query(
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1"""
)
def insert_or_ignore_keys(spark, sf):
    """Duplicate parent ids: the first row stays."""
    return first_per_key(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query(
    """SELECT event_id, try_cast(CASE event_type WHEN 'error' THEN 'x' || event_id WHEN 'view' THEN NULL ELSE event_id::VARCHAR END AS BIGINT) AS doc_id
    FROM events WHERE doc_id IS NOT NULL"""
)
def valid_ids(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(
        F.col("event_type") != "view", F.col("event_id").cast("string")
    )
    rows = table(spark, sf, "events").select("event_id", I.valid_id(raw).alias("doc_id"))
    return rows.where("doc_id is not null")


def _ingested(spark: SparkSession, sf: str) -> I.Ingested:
    docs = spread(table(spark, sf, "documents"))
    content = docs.select("doc_id", "text")
    meta = docs.select(
        "doc_id", F.col("source").alias("legal_type"),
        F.concat(F.lit("01/02/"), (F.lit(1960) + F.col("doc_id") % 80).cast("string")).alias("issuance_date"),
    )
    return I.ingest(content, meta, SMALL, profile=NEUTRAL, boundary=LINE_BOUNDARY, skipped_types=SKIPPED)


_ACCEPTED = _CHUNKS.replace("FROM documents)", f"FROM documents WHERE {_reason_sql(chr(92) + 'p{L}')} IS NULL)", 1)


@query(
    f"""WITH {_ACCEPTED} SELECT k.doc_id, source AS legal_type, parent AS parent_index, child::INTEGER AS child_index, md5(k.text) AS text_md5
    FROM kids k JOIN documents d ON k.doc_id = d.doc_id"""
)
def ingest_children(spark, sf):
    """Metadata join, filter cascade and both chunk levels in one plan."""
    return _ingested(spark, sf).children.select(
        "doc_id", "legal_type", "parent_index", "child_index", F.md5("text").alias("text_md5")
    )


@query(
    f"""WITH {_ACCEPTED} SELECT p.doc_id, md5(parent_text) AS parent_md5 FROM pack p
    WHERE (p.doc_id, p.parent) IN (SELECT (doc_id, parent) FROM kids)"""
)
def ingest_parents(spark, sf):
    return _ingested(spark, sf).parents.select("doc_id", F.md5("parent_text").alias("parent_md5"))


@query(
    f"""WITH {_ACCEPTED}, per AS (SELECT doc_id, count(*) AS n FROM kids GROUP BY 1),
    pp AS (SELECT doc_id, count(*) AS n FROM pack WHERE doc_id IN (SELECT doc_id FROM per) GROUP BY 1),
    seen AS (SELECT {_reason_sql(chr(92) + 'p{L}')} AS r FROM documents)
    SELECT (SELECT count(*) FROM seen) AS total_seen, (SELECT count(*) FROM seen WHERE r IS NULL) AS passed_filter,
      (SELECT count(*) FROM per) AS docs_with_chunks, (SELECT sum(n)::BIGINT FROM pp) AS parents_generated,
      (SELECT sum(n)::BIGINT FROM per) AS chunks_generated, (SELECT count(*) FROM seen WHERE r = 'corrupted') AS rejected_corrupted,
      (SELECT count(*) FROM seen WHERE r = 'too_short') AS rejected_too_short,
      round((SELECT sum(n) FROM per)::DOUBLE / (SELECT sum(n) FROM pp), 6) AS avg_children_per_parent"""
)
def ingest_counters(spark, sf):
    return _ingested(spark, sf).counters.select(
        "total_seen", "passed_filter", "docs_with_chunks", "parents_generated", "chunks_generated",
        "rejected_corrupted", "rejected_too_short", F.round("avg_children_per_parent", 6).alias("avg_children_per_parent"),
    )
