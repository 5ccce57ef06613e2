"""Answering a batch of questions: routing, retrieval, web fallback, context, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions import models, routing
from quillspark.plans import retrieve as R
from quillspark.plans import web
from quillspark.plans.graph import graph_search
from quillspark.plans.prompt import ERROR_REPLY
from quillspark.session import stored

DOC = ["qid", "cid", "text", "score", "rank", "title", "url", "entity_label"]


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    communities: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Engine:
    """What an installation is made of; only the index is required."""

    index: R.Index
    graph: Graph | None = None
    web: web.WebSource | None = None
    generator: models.Generator = models.ExtractiveGenerator()
    threshold: float = S.FALLBACK_MEAN_SCORE


def _shaped(docs: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in DOC if c not in docs.columns}
    out = docs.withColumns(missing) if missing else docs
    return out.withColumn("cid", F.col("cid").cast("string")).select(*DOC)


def route_documents(engine: Engine, decided: DataFrame, k: int) -> DataFrame:
    """Documents of every question along its route (none, rag, graphrag or both).

    A failing graph search must not lose the text results, so a graph route without
    documents falls back to them.
    """
    routes = {r[0] for r in decided.select("route").distinct().collect()} - {"none"}
    asked = decided.where(F.col("route") != "none")
    local = _shaped(R.retrieve(engine.index, asked, k))
    if not routes & {"both", "graphrag"}:
        return local
    wide = asked.where(F.col("route") == "both").select("qid")
    if engine.graph is None:
        graph_docs = local.limit(0)
    else:
        vector = models.embed(F.col("question"), engine.index.embedder)
        seekers = asked.where(F.col("route").isin("both", "graphrag")).select("qid", "question", vector.alias("payload"))
        g = engine.graph
        graph_docs = _shaped(
            graph_search(stored(seekers, "seekers"), g.entities, g.communities, g.edges, k, engine.index.scorer)
        )
    merged = R.route_merge(
        local.join(wide, "qid", "left_semi"), graph_docs.join(wide, "qid", "left_semi"), k
    ).select(*DOC)
    only_graph = asked.where(F.col("route") == "graphrag").select("qid")
    found = graph_docs.join(only_graph, "qid", "left_semi")
    plain = local.join(wide, "qid", "left_anti").join(found.select("qid").distinct(), "qid", "left_anti")
    return plain.unionByName(merged).unionByName(found)


def answer_batch(
    engine: Engine,
    questions: DataFrame,
    k: int = S.DEFAULT_TOP_K,
    routes: dict[str, str] = routing.ROUTES,
    reply: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, documents) of a batch of (qid, question).

    Decisions: qid, question, intent, confidence, route, used_web.  Documents: the
    final ones of each question, local or from the web.
    """
    decided = routing.reflect(questions, reply).withColumn("question", F.col("refined_query"))
    decided = stored(decided.withColumn("route", routing.route(F.col("intent"), routes)), "decided")
    docs = stored(route_documents(engine, decided, k), "docs")
    asked = decided.where(F.col("route") != "none")
    weak = R.needs_fallback(docs, asked, engine.threshold)
    if engine.web is not None:
        failing = asked.join(weak.where("used_web").select("qid"), "qid", "left_semi")
        found = web.search_web(failing.select("qid", F.col("question").alias("query")), engine.web)
        docs = R.substitute(docs, _shaped(found), weak)
    flagged = decided.join(weak, "qid", "left").withColumn("used_web", F.coalesce("used_web", F.lit(False)))
    return flagged, docs


def answers(engine: Engine, decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, intent, used_web, answer): small talk gets the fixed reply, a null answer the error text."""
    blocks = R.context_block(docs, decisions).join(decisions, "qid")
    generated = F.coalesce(engine.generator.answer(F.col("question"), F.col("context")), F.lit(ERROR_REPLY))
    reply = F.when(F.col("intent") == "CHITCHAT", F.lit(routing.CHITCHAT_REPLY)).otherwise(generated)
    return blocks.select("qid", "intent", "confidence", "used_web", reply.alias("answer"))
