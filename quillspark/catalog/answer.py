"""The whole answer flow over a batch of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog import graph as G
from quillspark.catalog import retrieval as V
from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions.models import ExtractiveGenerator
from quillspark.functions.routing import CHITCHAT_REPLY
from quillspark.plans.answer import Engine, Graph, answer_batch, answers, route_documents
from quillspark.plans.retrieve import Index
from quillspark.plans.web import PageSource
from quillspark.session import spread

THRESHOLD = 0.02
_ASKED = " UNION ALL ".join(
    f"SELECT * FROM (WITH {V._questions(intent)} SELECT qid, '{intent}' AS intent, question FROM questions WHERE qid % {len(V._PARTS)} = {i})"
    for i, intent in enumerate(V._PARTS)
)


@query(
    f"""WITH asked AS ({_ASKED}), found AS ({V._ALL}),
    placed AS (SELECT qid, intent, cid, score, CASE WHEN intent = 'SUMMARIZE' THEN row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) ELSE rank END AS rank FROM found),
    docs AS (SELECT * FROM placed WHERE intent <> 'SUMMARIZE' OR rank <= {2 * V.K}),
    weak AS (SELECT a.qid, coalesce(avg(d.score) < {THRESHOLD}, TRUE) AS used_web FROM asked a LEFT JOIN docs d ON a.qid = d.qid GROUP BY 1),
    {V._terms("(SELECT a.qid, a.question FROM asked a JOIN weak USING (qid) WHERE used_web)")}
    SELECT qid, cid, rank, score, TRUE AS from_web FROM wdocs
    UNION ALL SELECT qid, cid::VARCHAR, rank, round_even(score, 4), FALSE FROM docs WHERE qid NOT IN (SELECT qid FROM wdocs)"""
)
def answer_sources(spark, sf):
    """Routing, retrieval, route merge, mean-score fallback and web documents."""
    pages = table(spark, sf, "documents").select(
        F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id").alias("url"), F.col("source").alias("title"), "text"
    )
    engine = Engine(V.document_index(spark, sf), web=PageSource(pages), threshold=THRESHOLD)
    items = spread(table(spark, sf, "benchmark"))
    opening = F.element_at(F.array(*[F.lit(o) for o in V.OPENINGS.values()]), (F.col("item_id") % len(V.OPENINGS) + 1).cast("int"))
    asked = items.select(F.col("item_id").alias("qid"), F.concat(opening, F.col("text")).alias("question"))
    _, docs = answer_batch(engine, asked, V.K)
    return docs.select(
        "qid", "cid", F.col("rank").cast("long").alias("rank"), F.bround("score", 4).alias("score"),
        F.col("cid").startswith("web_").alias("from_web"),
    )


class _ShortSighted(ExtractiveGenerator):
    """A model that fails on contexts of more than ``limit`` characters."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def answer(self, question, context):
        return F.when(F.length(context) <= self.limit, super().answer(question, context))


@query(
    """SELECT doc_id AS qid, md5(CASE WHEN lang = 'de' THEN 'small talk'
      WHEN length(c) > 600 THEN '[Lỗi: không thể tạo phản hồi. Vui lòng thử lại.]' ELSE coalesce(source, '') || chr(10) || c END) AS answer_md5
    FROM (SELECT *, '[ID: ' || doc_id || ']' || chr(10) || trim(text, """ + Q.WS + """) AS c FROM documents)"""
)
def answers_or_error(spark, sf):
    """An answer from every document; the model fails on long ones, small talk needs none."""
    docs = table(spark, sf, "documents")
    decisions = docs.select(
        F.col("doc_id").alias("qid"), F.col("source").alias("question"), F.lit(1.0).alias("confidence"), F.lit(False).alias("used_web"),
        F.when(F.col("lang") == "de", F.lit("CHITCHAT")).otherwise(F.lit("LEGAL_LOOKUP")).alias("intent"),
    )
    found = docs.select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), F.col("doc_id").alias("cid"), "text")
    made = answers(Engine(index=None, generator=_ShortSighted(600)), decisions, found)
    talk = F.when(F.col("answer") == CHITCHAT_REPLY, F.lit("small talk")).otherwise(F.col("answer"))
    return made.select("qid", F.md5(talk).alias("answer_md5"))


_DENSE = f"""{Q.vectors("ql", "questions", "qid", "question")},
    qv AS (SELECT q.qid, list(coalesce(x, 0.0) ORDER BY i) AS v FROM questions q CROSS JOIN range({Q.DIM}) r(i) LEFT JOIN ql ON ql.id = q.qid AND ql.b = i GROUP BY 1)"""


@query(
    f"""WITH {V._questions("LEGAL_LOOKUP")}, {Q.DOC_VECTORS}, {V._asks("{}")}, {Q.text_search("hits", "asks", "dv", V.K)}, {_DENSE}, {G.graph_sql("qv")},
    local AS (SELECT qid, cid::VARCHAR AS cid, score, seq AS rank FROM hits WHERE seq <= {V.K}),
    g AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM pool QUALIFY rank <= {2 * V.K}),
    u AS (SELECT *, 0 AS src FROM local UNION ALL SELECT *, 1 FROM g),
    merged AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, src, rank) AS place FROM u WHERE qid % 3 = 2 QUALIFY place <= {2 * V.K})
    SELECT qid, cid, round(score, 6) AS score, place AS rank FROM merged
    UNION ALL SELECT qid, cid, round(score, 6), rank FROM local WHERE qid % 3 = 0
    UNION ALL SELECT qid, cid, round(score, 6), rank FROM g WHERE qid % 3 = 1"""
)
def graph_routes(spark, sf):
    """Text search, graph search and both, a third of the questions each; ranked by vector score."""
    base = V.document_index(spark, sf)
    entities, reports = G.graph_tables(spark, sf)
    engine = Engine(Index(base.points, base.embedder), Graph(entities, reports, G.edges(spark, sf)))
    name = F.element_at(F.array(*[F.lit(r) for r in ("rag", "graphrag", "both")]), (F.col("qid") % 3 + 1).cast("int"))
    docs = route_documents(engine, V.benchmark_questions(spark, sf, "LEGAL_LOOKUP").withColumn("route", name), V.K)
    return docs.select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
