"""Batch retrieval: all questions of a batch share one scan of the corpus per step.

``points`` holds one row per indexed chunk: cid, parent_id, text, title, url,
legal_type, embedding.  ``questions`` holds qid, question, intent,
expanded_queries, sub_entities.  Every step keeps ``seq``, the position at which a
document reached the result list, because ties and the reranking cap follow it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions import models, routing
from quillspark.functions.text import contains_any, or_empty, strip, tokens
from quillspark.operators.dedup import merge_best
from quillspark.operators.joins import attach_parent_text, filtered_else_all
from quillspark.operators.ranking import rank_bounded, top_k_per_key
from quillspark.operators.search import DenseKernel, search
from quillspark.operators.terms import search_among, term_index
from quillspark.session import stored

HIT_COLUMNS = ["qid", "cid", "score", "seq"]
DOC_COLUMNS = ["text", "parent_id", "title", "url", "legal_type"]


@dataclass(frozen=True)
class Index:
    """An indexed corpus with the models that read it."""

    points: DataFrame
    embedder: models.Embedder
    scorer: models.Scorer | None = None
    parents: DataFrame | None = None
    postings: DataFrame | None = None

    def term_table(self) -> DataFrame:
        """Postings of the texts: those given, or built from the points."""
        if self.postings is not None:
            return self.postings
        return term_index(self.points.select(F.col("cid").alias("id"), tokens(F.col("text")).alias("payload")))

    def corpus(self) -> DataFrame:
        return self.points.select(F.col("cid").alias("id"), F.col("embedding").alias("payload"))

    def with_text(self, hits: DataFrame) -> DataFrame:
        """Texts are fetched after the search, for the hits only; these are stored, so that Spark knows how few they are."""
        return stored(hits, "hits").join(self.points.select("cid", *DOC_COLUMNS), "cid")


def merge_asks(found: DataFrame, named: DataFrame) -> DataFrame:
    """Union of the ranked lists of a qid, one row per document, in score order."""
    rows = found.withColumnRenamed("qid", "_ask").join(named.select("_ask", "qid", "ask_no"), "_ask")
    rows = rows.select("qid", F.col("id").alias("cid"), "score", "ask_no", "rank")
    merged = merge_best(rows, ["qid", "cid"], ["ask_no", "rank"])
    ranked = rank_bounded(merged, ["qid"], [F.col("score").desc(), F.col("seen_at")], "seq")
    return ranked.select(*HIT_COLUMNS)


def rerank(
    candidates: DataFrame,
    scorer: models.Scorer | None,
    k: int,
    cap: int = S.RERANK_CAP,
) -> DataFrame:
    """Final order of the candidates of each question.

    With a scorer: the first ``cap`` candidates in arrival order, blank texts
    dropped, ranked by sigmoid score.  Without one: all candidates by vector score.
    ``candidates`` has qid, question, cid, text, score, seq, and optionally ``keep``,
    a smaller width for single questions.
    """
    body = F.col("text")
    if "child_text" in candidates.columns:
        body = F.coalesce(F.nullif(F.col("child_text"), F.lit("")), body)
    if scorer is not None:
        first = top_k_per_key(candidates, ["qid"], [F.col("seq")], cap, "_arrived").drop("_arrived")
        candidates = first.where(strip(or_empty(body)) != "").withColumn(
            "score", models.sigmoid(scorer.logits(F.col("question"), body))
        )
    ranked = top_k_per_key(candidates, ["qid"], [F.col("score").desc(), F.col("seq")], k)
    return ranked.where(F.col("rank") <= F.col("keep")).drop("keep") if "keep" in ranked.columns else ranked


def boost(score: Column, text: Column, words=routing.PROCEDURE_WORDS, bonus: float = S.KEYWORD_BONUS) -> Column:
    """Bonus for texts that contain one of the words."""
    lowered = F.lower(or_empty(text))
    return F.when(contains_any(lowered, [w.lower() for w in words]), score + bonus).otherwise(score)


def hop_question(second: Column, texts: Column) -> Column:
    """Second sub-question extended by the start of the best texts of the first hop."""
    context = strip(F.array_join(F.transform(texts, lambda t: F.left(t, F.lit(S.HOP_CONTEXT_CHARS))), " "))
    return F.when(context != "", F.concat(second, F.lit(" [ngữ cảnh: "), context, F.lit("]"))).otherwise(second)


def strategy_of(intent: Column, sub_entities: Column) -> Column:
    """Strategy of a question; comparisons and chains without parts are plain lookups."""
    parts = F.size(sub_entities)
    return (
        F.when((intent == "COMPARE") & (parts > 0), F.lit("compare"))
        .when(intent == "SUMMARIZE", F.lit("summarize"))
        .when(intent == "PROCEDURE", F.lit("procedure"))
        .when(intent == "DEFINITION", F.lit("definition"))
        .when((intent == "MULTI_HOP") & (parts >= 2), F.lit("multi_hop"))
        .otherwise(F.lit("lookup"))
    )


def _widths(k: int) -> dict[str, tuple[int, int]]:
    """Strategy to (candidates per query, results per question)."""
    broad, tight = min(k * S.SUMMARIZE_FACTOR, S.SUMMARIZE_CAP), min(k, 3)
    return {
        "lookup": (k, k),
        "compare": (k, k * S.COMPARE_MAX_ENTITIES),
        "summarize": (broad, broad),
        "procedure": (2 * k, k),
        "definition": (3 * tight, tight),
        "multi_hop": (k, k),
    }


def _by_strategy(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("strategy"))


def first_asks(planned: DataFrame, k: int) -> DataFrame:
    """All queries of the first search: qid, part, entity_label, ask_no, query, width.

    A comparison has one part per compared thing, every other question a single one.
    """
    extras = F.col("expanded_queries")
    short = F.slice(extras, F.lit(1), F.lit(S.COMPARE_EXTRAS_PER_ENTITY))
    things = F.slice("sub_entities", F.lit(1), F.lit(S.COMPARE_MAX_ENTITIES))
    queries = (
        F.when(F.col("strategy") == "definition", F.concat(F.array("question"), F.slice(extras, F.lit(1), F.lit(1))))
        .when(F.col("strategy") == "multi_hop", F.slice("sub_entities", F.lit(1), F.lit(1)))
        .otherwise(F.concat(F.array("question"), extras))
    )

    def part(label, texts):
        return F.struct(label.cast("string").alias("entity_label"), texts.alias("queries"))

    per_thing = F.transform(
        things, lambda e: part(e, F.concat(F.array(e), F.transform(short, lambda x: F.concat_ws(" ", e, x))))
    )
    parts = F.when(F.col("strategy") == "compare", per_thing).otherwise(F.array(part(F.lit(None), queries)))
    width = _by_strategy({name: w for name, (w, _) in _widths(k).items()})
    exploded = planned.select("qid", "question", "strategy", width.alias("width"), F.posexplode(parts).alias("part", "_p"))
    return exploded.select(
        "qid", "question", "strategy", "width", "part", "_p.entity_label", F.posexplode("_p.queries").alias("ask_no", "query")
    )


def _parts(found: DataFrame, asks: DataFrame) -> DataFrame:
    """Hits per (qid, part), best score per document, in score order."""
    rows = found.withColumnRenamed("qid", "_ask").join(
        asks.select("_ask", "qid", "part", "ask_no", "width"), "_ask"
    )
    rows = rows.where(F.col("rank") <= F.col("width")).select(
        "qid", "part", F.col("id").alias("cid"), "score", "ask_no", "rank"
    )
    merged = merge_best(rows, ["qid", "part", "cid"], ["ask_no", "rank"])
    ranked = rank_bounded(merged, ["qid", "part"], [F.col("score").desc(), F.col("seen_at")], "seq")
    return ranked.select("qid", "part", "cid", "score", "seq")


def _search(index: Index, asks: DataFrame, k: int, kernel=DenseKernel()) -> DataFrame:
    """One scan of the corpus for all asks (``_ask``, ``payload``)."""
    return search(asks.select(F.col("_ask").alias("qid"), "payload"), index.corpus(), k, kernel)


def _inside_named(index: Index, asks: DataFrame, width: int) -> DataFrame:
    """Hits of the summaries that name a document, among the texts that mention it."""
    words = F.array_distinct(tokens(routing.law_name(F.col("question"))))
    named = asks.where(F.col("strategy") == "summarize").withColumn("words", words).where(F.size("words") > 0)
    if named.isEmpty():  # no term table is needed then
        return _parts(search(named.select(F.col("_ask").alias("qid"), "payload"), index.corpus(), width), named)
    asked = named.select(F.col("_ask").alias("qid"), "payload", "words")
    return stored(_parts(search_among(asked, index.corpus(), index.term_table(), width), named), "inside")


def _second_hop(index: Index, planned: DataFrame, hop1: DataFrame, k: int) -> DataFrame:
    """Hits of the chained questions, asked with the best texts of the first hop."""
    best = index.with_text(hop1.where(F.col("seq") <= S.HOP_CONTEXT_DOCS))
    context = best.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]).alias("texts")
    )
    none = F.array().cast("array<string>")
    second = planned.join(context, "qid", "left").select(
        "qid", hop_question(F.get("sub_entities", F.lit(1)), F.coalesce("texts", none)).alias("query")
    )
    asks = second.select(
        "qid", F.lit(1).alias("part"), F.lit(0).alias("ask_no"), F.lit(k).alias("width"),
        F.col("qid").cast("string").alias("_ask"), models.embed(F.col("query"), index.embedder).alias("payload"),
    )
    return _parts(_search(index, asks, k), asks)


def run_strategies(index: Index, planned: DataFrame, k: int) -> DataFrame:
    """Ranked documents of questions with a ``strategy``, for the whole batch at once.

    The first searches of all strategies share one scan of the vectors.  A second
    scan runs only for chained questions, a third only for summaries that name a
    document.  Questions and hits (a few rows per query) are stored, as several steps
    read them.
    """
    widths = _widths(k)
    planned = stored(planned.select("qid", "question", "strategy", "expanded_queries", "sub_entities"), "planned")
    asks = first_asks(planned, k).withColumn("_ask", F.concat_ws("|", "qid", "part", "ask_no"))
    asks = stored(asks.withColumn("payload", models.embed(F.col("query"), index.embedder)), "asks")
    hits = stored(_parts(_search(index, asks, max(w for w, _ in widths.values())), asks), "hits")
    kinds = {r[0] for r in planned.select("strategy").distinct().collect()}
    if "summarize" in kinds:
        inside = _inside_named(index, asks, widths["summarize"][0])
        hits = stored(filtered_else_all(inside, hits, "qid"), "hits")
    if "multi_hop" in kinds:
        chained = planned.where(F.col("strategy") == "multi_hop")
        hop1 = hits.join(chained.select("qid"), "qid", "left_semi")
        hits = hits.unionByName(_second_hop(index, chained, hop1, widths["multi_hop"][0]))
    labels = asks.select("qid", "part", "entity_label").distinct()
    rows = hits.join(labels, ["qid", "part"], "left")
    merged = merge_best(rows, ["qid", "cid"], ["part", "seq"])
    pool = rank_bounded(merged.drop("seq", "part"), ["qid"], ["seen_at"], "seq").drop("seen_at")
    keep = F.when(
        F.col("strategy") == "compare", k * F.least(F.size("sub_entities"), F.lit(S.COMPARE_MAX_ENTITIES))
    ).otherwise(_by_strategy({name: n for name, (_, n) in widths.items()}))
    docs = index.with_text(pool).join(planned.select("qid", "question", "strategy", keep.alias("keep")), "qid")
    boosted = F.when(F.col("strategy") == "procedure", boost(F.col("score"), F.col("text"))).otherwise(F.col("score"))
    ranked = rerank(docs.withColumn("score", boosted).drop("strategy"), index.scorer, max(n for _, n in widths.values()))
    return attach_parent_text(ranked, index.parents) if index.parents is not None else ranked


def _forced(name: str):
    def run(index: Index, questions: DataFrame, k: int) -> DataFrame:
        return run_strategies(index, questions.withColumn("strategy", F.lit(name)), k)

    run.__name__ = name
    run.__doc__ = f"All questions by the {name} strategy."
    return run


lookup = _forced("lookup")
compare = _forced("compare")
summarize = _forced("summarize")
procedure = _forced("procedure")
definition = _forced("definition")
multi_hop = _forced("multi_hop")


def retrieve(index: Index, questions: DataFrame, k: int = S.DEFAULT_TOP_K) -> DataFrame:
    """Every question through the strategy of its intent, with parent texts attached."""
    chosen = strategy_of(F.col("intent"), F.col("sub_entities"))
    return run_strategies(index, questions.withColumn("strategy", chosen), k)


def route_merge(local: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Both result lists of a question in one: best score per cid, cut to 3k, then to 2k."""
    rows = local.withColumn("_src", F.lit(0)).unionByName(
        graph.withColumn("_src", F.lit(1)), allowMissingColumns=True
    )
    merged = merge_best(rows.withColumnRenamed("rank", "_at"), ["qid", "cid"], ["_src", "_at"])
    ranked = top_k_per_key(merged, ["qid"], [F.col("score").desc(), F.col("seen_at")], 3 * k)
    return ranked.where(F.col("rank") <= 2 * k).drop("_src", "_at", "seen_at")


def needs_fallback(docs: DataFrame, questions: DataFrame, threshold: float = S.FALLBACK_MEAN_SCORE) -> DataFrame:
    """(qid, used_web): no documents, or a mean score below the threshold."""
    means = docs.groupBy("qid").agg(F.avg("score").alias("_mean"))
    return questions.select("qid").join(means, "qid", "left").select(
        "qid", F.coalesce(F.col("_mean") < threshold, F.lit(True)).alias("used_web")
    )


def substitute(docs: DataFrame, web_docs: DataFrame, decision: DataFrame) -> DataFrame:
    """Web documents replace the local ones where the fallback fired and found any."""
    chosen = stored(web_docs.join(decision.where("used_web").select("qid"), "qid", "left_semi"), "web-docs")
    return filtered_else_all(chosen, docs, "qid")


def format_sources(docs: DataFrame, include_content: bool = False) -> DataFrame:
    """Source references of an answer."""
    columns = [
        "qid", "rank",
        F.col("cid").cast("string").alias("id"),
        or_empty(F.col("title")).alias("title"),
        or_empty(F.col("url")).alias("url"),
        F.bround(F.col("score"), 4).alias("score"),
        or_empty(F.col("entity_label")).alias("entity"),
    ]
    return docs.select(*columns, *([F.col("text").alias("content")] if include_content else []))


# How a document is shown to the model, and the text for no documents.
CONTEXT_ITEM = "[ID: {}]\n{}"
CONTEXT_SEPARATOR = "\n---\n"
NO_CONTEXT = "(Không có tài liệu liên quan được tìm thấy.)"


def context_block(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, context): the documents of a question in rank order, bounded by k."""
    item = F.concat(F.lit("[ID: "), F.col("cid").cast("string"), F.lit("]\n"), strip(or_empty(F.col("text"))))
    blocks = docs.groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda s: s["t"]),
            CONTEXT_SEPARATOR,
        ).alias("context")
    )
    return questions.select("qid").join(blocks, "qid", "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_CONTEXT))
    )

