"""Batch retrieval strategies over the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions import routing
from quillspark.functions.models import ExtractiveGenerator, HashingEmbedder, OverlapScorer, embed
from quillspark.functions.text import tokens
from quillspark.operators.joins import attach_parent_text, filtered_else_all
from quillspark.operators.blocks import OrderedBlocks
from quillspark.operators.search import search
from quillspark.operators.terms import search_among, term_index
from quillspark.plans import retrieve as R
from quillspark.plans import web
from quillspark.session import spread, stored

K = 5
# Openings by intent; the question text behind them is a whole benchmark item.
OPENINGS = {
    "LEGAL_LOOKUP": "",
    "COMPARE": "so sánh xe máy và ",
    "SUMMARIZE": "tóm tắt nghị định 100/2019 ",
    "PROCEDURE": "thủ tục đăng ký ",
    "DEFINITION": "khái niệm ",
    "MULTI_HOP": "nếu vượt đèn đỏ thì phạt ",
}
_NAMES = list(OPENINGS)


def document_points(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as indexed chunks, vectors computed once and stored."""
    docs = spread(table(spark, sf, "documents"))
    points = docs.select(
        F.col("doc_id").alias("cid"),
        F.col("doc_id").alias("parent_id"),
        "text",
        F.col("source").alias("title"),
        F.concat_ws("/", F.lit("http:/"), "source", "doc_id").alias("url"),
        F.col("lang").alias("legal_type"),
        embed(F.col("text"), HashingEmbedder(Q.DIM)).alias("embedding"),
    )
    return stored(points, "points")


def document_index(spark: SparkSession, sf: str) -> R.Index:
    return R.Index(document_points(spark, sf), HashingEmbedder(Q.DIM), OverlapScorer())


def benchmark_questions(spark: SparkSession, sf: str, intent: str | None = None) -> DataFrame:
    """Every benchmark item as a question, opened for one intent or for all in turn."""
    items = spread(table(spark, sf, "benchmark"))
    if intent:
        opening = F.lit(OPENINGS[intent])
    else:
        at = (F.col("item_id") % len(OPENINGS) + 1).cast("int")
        opening = F.element_at(F.array(*[F.lit(OPENINGS[n]) for n in _NAMES]), at)
    asked = items.select(F.col("item_id").alias("qid"), F.concat(opening, F.col("text")).alias("question"))
    decided = routing.reflect(asked).withColumn("question", F.col("refined_query"))
    return decided.select("qid", "question", "intent", "expanded_queries", "sub_entities")


def _out(docs: DataFrame) -> DataFrame:
    return docs.select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- DuckDB counterparts -------------------------------------------------------


def _questions(intent: str) -> str:
    return f"questions AS (SELECT item_id AS qid, {Q.strip(Q.lit(OPENINGS[intent]) + ' || text')} AS question FROM benchmark)"


_FINAL = "SELECT qid, cid, round(score, 6) AS score, rank FROM {}"


def _asks(*templates: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT qid, {i} AS ask_no, replace({Q.lit(t)}, '{{}}', question) AS query FROM questions" for i, t in enumerate(templates)
    )
    return f"asks AS ({rows})"


def _simple(intent: str, templates: tuple[str, ...], width: int, keep: int) -> str:
    return f"""{_questions(intent)}, {Q.DOC_VECTORS}, {_asks("{}", *templates)},
    {Q.text_search("hits", "asks", "dv", width)}, {Q.rerank("ranked", "hits", "questions", keep)}"""


_LOOKUP = _simple("LEGAL_LOOKUP", (), K, K)
_SUMMARIZE = _simple("SUMMARIZE", routing.EXPANSIONS["SUMMARIZE"], 15, 15)
_PROCEDURE = _simple("PROCEDURE", routing.EXPANSIONS["PROCEDURE"], 10, K)
_DEFINITION = _simple("DEFINITION", routing.EXPANSIONS["DEFINITION"][:1], 9, 3)


def _merged(name: str, first: str, second: str) -> str:
    """Pool of two ranked lists (part 0 and 1) in order of first arrival."""
    return f"""
    {name}_u AS (SELECT qid, cid, score, 0 AS part, seq FROM {first} UNION ALL SELECT qid, cid, score, 1, seq FROM {second}),
    {name}_w AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY score DESC, part, seq) AS b,
      min(part * 100000 + seq) OVER (PARTITION BY qid, cid) AS seen FROM {name}_u),
    {name} AS (SELECT qid, cid, score, part, row_number() OVER (PARTITION BY qid ORDER BY seen) AS seq FROM {name}_w WHERE b = 1)"""


_COMPARE = f"""{_questions("COMPARE")}, {Q.DOC_VECTORS},
    e0 AS (SELECT qid, 0 AS ask_no, 'so sánh xe máy' AS query FROM questions),
    e1 AS (SELECT item_id AS qid, 0 AS ask_no, {Q.strip("text")} AS query FROM benchmark),
    {Q.text_search("h0", "e0", "dv", K)}, {Q.text_search("h1", "e1", "dv", K)},
    {_merged("pool", "h0", "h1")}, {Q.rerank("ranked", "pool", "questions", 2 * K)}"""

_MULTI_HOP = f"""{_questions("MULTI_HOP")}, {Q.DOC_VECTORS},
    s0 AS (SELECT qid, 0 AS ask_no, 'nếu vượt đèn đỏ' AS query FROM questions), {Q.text_search("hop1", "s0", "dv", K)},
    ctx AS (SELECT qid, {Q.strip("string_agg(left(text, 400), ' ' ORDER BY seq)")} AS c
      FROM hop1 JOIN documents ON cid = doc_id WHERE seq <= 3 GROUP BY 1),
    s1 AS (SELECT item_id AS qid, 0 AS ask_no, {Q.strip("'phạt ' || text")} || CASE WHEN c <> '' THEN ' [ngữ cảnh: ' || c || ']' ELSE '' END AS query
      FROM benchmark LEFT JOIN ctx ON item_id = qid),
    {Q.text_search("hop2", "s1", "dv", K)}, {_merged("pool", "hop1", "hop2")}, {Q.rerank("ranked", "pool", "questions", K)}"""


@query(f"WITH {_LOOKUP} {_FINAL.format('ranked')}")
def strategy_lookup(spark, sf):
    return _out(R.lookup(document_index(spark, sf), benchmark_questions(spark, sf, "LEGAL_LOOKUP"), K))


@query(
    f"WITH {_COMPARE} SELECT r.qid, r.cid, round(r.score, 6) AS score, r.rank, p.part::BIGINT AS entity FROM ranked r JOIN pool p USING (qid, cid)"
)
def strategy_compare(spark, sf):
    docs = R.compare(document_index(spark, sf), benchmark_questions(spark, sf, "COMPARE"), K)
    entity = (F.col("entity_label") != "so sánh xe máy").cast("long")
    return _out(docs).join(docs.select("qid", "cid", entity.alias("entity")), ["qid", "cid"])


@query(f"WITH {_SUMMARIZE} {_FINAL.format('ranked')}")
def strategy_summarize(spark, sf):
    return _out(R.summarize(document_index(spark, sf), benchmark_questions(spark, sf, "SUMMARIZE"), K))


@query(f"WITH {_PROCEDURE} {_FINAL.format('ranked')}")
def strategy_procedure(spark, sf):
    return _out(R.procedure(document_index(spark, sf), benchmark_questions(spark, sf, "PROCEDURE"), K))


@query(f"WITH {_DEFINITION} {_FINAL.format('ranked')}")
def strategy_definition(spark, sf):
    return _out(R.definition(document_index(spark, sf), benchmark_questions(spark, sf, "DEFINITION"), K))


@query(f"WITH {_MULTI_HOP} {_FINAL.format('ranked')}")
def strategy_multi_hop(spark, sf):
    return _out(R.multi_hop(document_index(spark, sf), benchmark_questions(spark, sf, "MULTI_HOP"), K))


_PARTS = {
    "LEGAL_LOOKUP": _LOOKUP, "COMPARE": _COMPARE, "SUMMARIZE": _SUMMARIZE,
    "PROCEDURE": _PROCEDURE, "DEFINITION": _DEFINITION, "MULTI_HOP": _MULTI_HOP,
}
_ALL = " UNION ALL ".join(
    f"SELECT * FROM (WITH {body} SELECT qid, '{intent}' AS intent, cid, round(score, 6) AS score, rank FROM ranked WHERE qid % {len(_PARTS)} = {i})"
    for i, (intent, body) in enumerate(_PARTS.items())
)


@query(_ALL)
def retrieve_all(spark, sf):
    """Every question through the strategy of its intent."""
    asked = benchmark_questions(spark, sf)
    docs = R.retrieve(document_index(spark, sf), asked, K)
    return _out(docs).join(asked.select("qid", "intent"), "qid")




@query(
    f"""WITH q AS (SELECT item_id AS qid, list_distinct({Q.tokens("text")}) AS w FROM benchmark),
    d AS (SELECT doc_id, n_chars, list_distinct({Q.tokens("text")}) AS t FROM documents),
    f AS (SELECT qid, doc_id, n_chars, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, doc_id) AS rank
      FROM q JOIN d ON len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(t, x))) = 0 QUALIFY rank <= 3),
    a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3)
    SELECT qid, doc_id, rank, TRUE AS filtered FROM f UNION ALL
    SELECT qid, doc_id, rank, FALSE FROM (SELECT item_id AS qid FROM benchmark), a WHERE qid NOT IN (SELECT qid FROM f)"""
)
def filtered_else_unfiltered(spark, sf):
    """Longest documents holding every word of the question, else the longest of all."""
    words = F.array_distinct(tokens(F.col("text")))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), words.alias("words"))
    size = F.array(F.col("n_chars").cast("float"))
    docs = table(spark, sf, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), size.alias("payload"))
    one = F.array(F.lit(1.0).cast("float"))
    postings = term_index(docs.select(F.col("doc_id").alias("id"), words.alias("payload")))
    inside = stored(search_among(asked.select("qid", one.alias("payload"), "words"), sizes, postings, 3), "inside").withColumn("filtered", F.lit(True))
    everywhere = search(asked.select("qid", one.alias("payload")), sizes, 3)
    out = filtered_else_all(inside, everywhere.withColumn("filtered", F.lit(False)), "qid")
    return out.select("qid", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "filtered")


@query(
    """SELECT d.doc_id, md5(CASE WHEN l.doc_id IS NULL THEN 'part of ' || d.source ELSE d.text END) AS text_md5,
      (l.doc_id IS NOT NULL) AS enriched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def parent_enrich(spark, sf):
    docs = table(spark, sf, "documents")
    part = F.concat(F.lit("part of "), F.col("source"))
    children = docs.select("doc_id", F.col("doc_id").alias("parent_id"), part.alias("text"))
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    parents = known.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    out = attach_parent_text(children, parents)
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.col("child_text").isNotNull().alias("enriched"))


THRESHOLD = 0.02


@query(
    f"""WITH {_LOOKUP} SELECT item_id AS qid, coalesce(m < {THRESHOLD}, TRUE) AS used_web
    FROM benchmark LEFT JOIN (SELECT qid, avg(score) AS m FROM ranked GROUP BY 1) ON item_id = qid"""
)
def fallback_decision(spark, sf):
    asked = benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    return R.needs_fallback(R.lookup(document_index(spark, sf), asked, K), asked, THRESHOLD)


def _terms(asked: str) -> str:
    """CTEs ending in wdocs: the web results of ``asked``(qid, question)."""
    return f"""wq AS (SELECT qid, question, {Q.content_tokens("question")} AS t FROM {asked}),
    wd AS (SELECT doc_id, source, text, 'http://' || source || '/' || doc_id AS url, {Q.content_tokens("text")} AS t FROM documents),
    wqt AS (SELECT qid, unnest(t) AS w FROM wq), wdt AS (SELECT doc_id, url, unnest(t) AS w FROM wd),
    wr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, url) AS rank
      FROM wqt JOIN wdt USING (w) GROUP BY qid, doc_id, url QUALIFY rank <= 3),
    wdocs AS (SELECT wr.qid, 'web_' || left(md5(url), 8) AS cid, rank, round_even({Q.overlap("wq.t", "wd.t")}, 4) AS score
      FROM wr JOIN wq USING (qid) JOIN wd USING (doc_id) WHERE length({Q.strip("wd.text")}) >= 100)"""


_TERMS = _terms("(SELECT item_id AS qid, text AS question FROM benchmark)")


def _web_docs(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """Documents as a web of pages."""
    pages = spread(table(spark, sf, "documents")).select(
        F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id").alias("url"), F.col("source").alias("title"), "text"
    )
    found = web.search_web(asked.select("qid", F.col("question").alias("query")), web.PageSource(pages))
    return found.select("qid", "cid", "text", "score", "rank", "url", "title")


@query(f"WITH {_TERMS} SELECT qid, cid, rank, score FROM wdocs")
def web_search(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return _web_docs(spark, sf, asked).select("qid", "cid", F.col("rank").cast("long").alias("rank"), "score")


@query(
    f"""WITH {_LOOKUP}, {_TERMS}, decision AS (SELECT item_id AS qid, coalesce(m < {THRESHOLD}, TRUE) AS used_web
      FROM benchmark LEFT JOIN (SELECT qid, avg(score) AS m FROM ranked GROUP BY 1) ON item_id = qid),
    chosen AS (SELECT w.* FROM wdocs w JOIN decision d ON w.qid = d.qid WHERE used_web)
    SELECT qid, cid, rank, score FROM chosen UNION ALL
    SELECT qid, cid::VARCHAR, rank, round_even(score, 4) FROM ranked WHERE qid NOT IN (SELECT qid FROM chosen)"""
)
def web_fallback(spark, sf):
    asked = benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    docs = stored(R.lookup(document_index(spark, sf), asked, K), "ranked").withColumn("cid", F.col("cid").cast("string"))
    decision = R.needs_fallback(docs, asked, THRESHOLD)
    weak = asked.join(decision.where("used_web"), "qid", "left_semi")
    final = R.substitute(docs, _web_docs(spark, sf, weak), decision)
    return final.select("qid", "cid", F.col("rank").cast("long").alias("rank"), F.bround("score", 4).alias("score"))


_BLOCKS = f"""ctx AS (SELECT qid, string_agg('[ID: ' || cid || E']\\n' || {Q.strip("text")}, E'\\n---\\n' ORDER BY rank) AS context
    FROM ranked JOIN documents ON cid = doc_id GROUP BY 1)"""


@query(
    f"""WITH {_LOOKUP}, {_BLOCKS} SELECT qid, md5(context) AS context_md5, length(context)::BIGINT AS context_chars,
      md5(question || E'\\n' || replace(context, E'\\n---\\n', E'\\n\\n')) AS answer_md5 FROM ctx JOIN questions USING (qid)"""
)
def context_and_answer(spark, sf):
    asked = benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    blocks = R.context_block(R.lookup(document_index(spark, sf), asked, K), asked).join(asked.select("qid", "question"), "qid")
    answer = ExtractiveGenerator().answer(F.col("question"), F.col("context"))
    return blocks.select(
        "qid", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("context_chars"),
        F.md5(answer).alias("answer_md5"),
    )


@query(
    f"""WITH {_LOOKUP}, placed AS (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) % count(*) OVER () AS place, count(*) OVER () AS m FROM benchmark),
    g AS (SELECT qid, doc_id AS cid, 0.3::DOUBLE AS score, 1 + quality AS rank FROM placed JOIN labels ON doc_id % m = place AND toxic = 1),
    u AS (SELECT qid, cid, score, 0 AS src, rank FROM ranked UNION ALL SELECT qid, cid, score, 1, 2 * cid + rank FROM g),
    b AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY score DESC, src, rank) AS best,
      min(src * 1000000000 + rank) OVER (PARTITION BY qid, cid) AS seen FROM u),
    o AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM b WHERE best = 1)
    SELECT qid, cid, round(score, 6) AS score, rank FROM o WHERE rank <= 10"""
)
def both_route_merge(spark, sf):
    """Text results merged with a second list; every labelled document is dealt to one question, by its id."""
    asked = benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    local = R.lookup(document_index(spark, sf), asked, K).select("qid", "cid", "score", "rank")
    count = F.lit(max(1, asked.count()))
    placed = OrderedBlocks(asked.select("qid"), [], ["qid"]).position("place").rows().select("qid", (F.col("place") % count).alias("place"))
    marked = table(spark, sf, "labels").where("toxic = 1").withColumn("place", F.col("doc_id") % count)
    graph = placed.join(marked, "place").select(
        "qid", F.col("doc_id").alias("cid"), F.lit(0.3).alias("score"),
        (F.col("doc_id") * 2 + 1 + F.col("quality")).cast("int").alias("rank"),
    )
    return _out(R.route_merge(local, graph, K))


@query(
    """WITH c AS (SELECT conv_id AS qid, turn AS seq, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
    SELECT qid, seq, rank FROM (SELECT qid, seq, row_number() OVER (PARTITION BY qid ORDER BY
      round(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) / 100.0::DOUBLE, 9) DESC, seq) AS rank FROM c WHERE a <= 4) WHERE rank <= 3"""
)
def rerank_arrival_cap(spark, sf):
    """Only the first arrivals are reranked, however good the later ones are."""

    class WordCount:
        def logits(self, question, text):
            share = F.round(F.size(tokens(text)) / F.lit(100.0), 9)
            return F.log(share / (share + 1.0)) - F.log(F.lit(1.0) - share / (share + 1.0))

    pool = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("qid"), F.lit("").alias("question"), F.col("turn").alias("cid"), "text",
        F.lit(0.0).alias("score"), F.col("turn").alias("seq"),
    )
    return R.rerank(pool, WordCount(), 3, cap=4).select("qid", "seq", F.col("rank").cast("long").alias("rank"))
