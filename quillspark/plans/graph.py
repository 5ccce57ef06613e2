"""Graph retrieval: entity and community search with neighbour expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions import models
from quillspark.functions.text import or_empty, strip
from quillspark.functions.vectors import l2_to_score
from quillspark.operators.dedup import merge_best
from quillspark.operators.ranking import rank_bounded, top_k_per_key
from quillspark.operators.search import DenseKernel, search
from quillspark.plans.retrieve import rerank
from quillspark.session import stored

# Identifier and text formats of graph documents.
ENTITY_ID, COMMUNITY_ID, RELATION_ID = "graphrag-entity-", "graphrag-community-", "graphrag-rel-"
SOURCE_NAME = "graphrag"


def clean_edges(edges: DataFrame) -> DataFrame:
    """Trimmed end points, null descriptions and weights filled, blank ends dropped."""
    return edges.withColumns(
        {
            "source": strip(or_empty(F.col("source"))),
            "target": strip(or_empty(F.col("target"))),
            "description": strip(or_empty(F.col("description"))),
            "weight": F.coalesce(F.col("weight").cast("double"), F.lit(1.0)),
        }
    ).where((F.col("source") != "") & (F.col("target") != ""))


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge once per direction, from a single scan."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    pair = F.explode(
        F.array(
            F.struct(F.col("source").alias("s"), F.col("target").alias("t"), F.lit(0).alias("d")),
            F.struct(F.col("target").alias("s"), F.col("source").alias("t"), F.lit(1).alias("d")),
        )
    ).alias("_e")
    return edges.select(*rest, pair).select(
        F.col("_e.s").alias("name"), F.col("_e.t").alias("target"), F.col("_e.d").alias("reversed"), *rest
    )


def expand_neighbors(entities: DataFrame, edges: DataFrame, n: int = S.GRAPH_NEIGHBORS) -> DataFrame:
    """Strongest edges of the found entities as documents.

    ``entities``: qid, name, score, entity_rank.  ``edges``: source, target,
    description, weight, edge_seq (input order, the tie-break).  The cap of ``n``
    edges comes first, then one row per target in entity order, then blank
    descriptions are dropped.  Edges are cut to n per name before the join, so a
    name with very many edges sends n rows per task.
    """
    wanted = entities.select("name").distinct()
    touching = both_directions(clean_edges(edges)).join(wanted, "name", "left_semi")
    strongest = top_k_per_key(
        touching, ["name"], [F.col("weight").desc(), F.col("edge_seq"), F.col("reversed")], n, "edge_rank"
    )
    pairs = entities.join(strongest, "name")
    first = top_k_per_key(pairs, ["qid", "target"], [F.col("entity_rank"), F.col("edge_rank")], 1, "_first")
    return first.where(F.col("description") != "").select(
        "qid",
        F.concat(F.lit(RELATION_ID), F.col("name"), F.lit("-"), F.col("target")).alias("cid"),
        F.concat(
            F.lit("[Relationship: "), F.col("name"), F.lit(" → "), F.col("target"), F.lit("]\n"), F.col("description")
        ).alias("text"),
        (F.coalesce(F.col("score"), F.lit(S.GRAPH_DEFAULT_SCORE)) * S.GRAPH_NEIGHBOR_FACTOR).alias("score"),
        F.lit("relationship").alias("type"),
        "entity_rank",
        "edge_rank",
    )


def nearest(questions: DataFrame, table: DataFrame, key: str, k: int) -> DataFrame:
    """k nearest rows by squared distance: (qid, <key>, score, rank) with score max(0, 1 - d)."""
    found = search(
        questions.select("qid", "payload"),
        table.select(F.col(key).alias("id"), F.col("vector").alias("payload")),
        k,
        DenseKernel("l2"),
    )
    return found.select("qid", F.col("id").alias(key), l2_to_score(-F.col("score")).alias("score"), "rank")


def graph_search(
    questions: DataFrame,
    entities: DataFrame,
    communities: DataFrame,
    edges: DataFrame,
    k: int,
    scorer: models.Scorer | None = None,
    min_score: float = S.GRAPH_MIN_SCORE,
) -> DataFrame:
    """Entities, their neighbours and community reports of each question.

    ``questions``: qid, question, payload (vector).
    """
    # Stored, as three steps read them, and so that Spark knows how few names the edges are filtered by.
    near = stored(stored(nearest(questions, entities, "id", k), "nearest").join(entities.drop("vector"), "id"), "near")
    entity_docs = near.select(
        "qid",
        F.concat(F.lit(ENTITY_ID), F.col("id").cast("string")).alias("cid"),
        strip(
            F.concat(F.lit("[Entity: "), or_empty(F.col("name")), F.lit("]\n"), or_empty(F.col("description")))
        ).alias("text"),
        "score", F.lit("entity").alias("type"), F.lit(0).alias("_group"), F.col("rank").alias("_a"), F.lit(0).alias("_b"),
    )
    around = expand_neighbors(
        near.select("qid", "name", "score", F.col("rank").alias("entity_rank")), edges
    ).select(
        "qid", "cid", "text", "score", "type", F.lit(1).alias("_group"),
        F.col("entity_rank").alias("_a"), F.col("edge_rank").alias("_b"),
    )
    reports = nearest(questions, communities, "community", k).join(communities.drop("vector"), "community")
    report_docs = reports.select(
        "qid",
        F.concat(F.lit(COMMUNITY_ID), F.col("community").cast("string")).alias("cid"),
        strip(
            F.concat(
                F.lit("[Community Report: "), or_empty(F.col("title")), F.lit("]\n"), or_empty(F.col("full_content"))
            )
        ).alias("text"),
        "score", F.lit("community").alias("type"), F.lit(2).alias("_group"), F.col("rank").alias("_a"), F.lit(0).alias("_b"),
    )
    rows = entity_docs.unionByName(around).unionByName(report_docs)
    merged = merge_best(rows, ["qid", "cid"], ["_group", "_a", "_b"])
    pool = rank_bounded(merged, ["qid"], ["seen_at"], "seq").drop("seen_at", "_group", "_a", "_b")
    asked = pool.join(questions.select("qid", "question"), "qid")
    # All merged documents are reranked here; the cap of the text search does not apply.
    widest = k * (2 + S.GRAPH_NEIGHBORS)
    ranked = rerank(asked, scorer, 2 * k, cap=widest)
    if scorer is not None:
        ranked = ranked.where(F.col("score") >= min_score)
    return ranked.withColumns({"url": F.lit(SOURCE_NAME), "title": F.lit("")})
