"""Graph retrieval: customers as entities, order lines as weighted edges to parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog.registry import query, table
from quillspark.catalog.search import CENTROIDS, K, label_questions
from quillspark.functions.models import OverlapScorer
from quillspark.functions.vectors import centroids
from quillspark.plans import graph


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines; orders get their names first, so that the lines, the largest table, are shuffled once."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    owned = orders.join(table(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    named = table(spark, sf, "lineitem").join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    return named.select(
        F.col("c_name").alias("source"),
        F.concat(F.lit(" Part#"), F.col("l_partkey").cast("string")).alias("target"),
        F.when(F.col("l_returnflag") != "R", F.concat("o_orderpriority", F.lit(" "), "l_linestatus")).alias("description"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("weight"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("edge_seq"),
    )


_EDGES = """edges AS (SELECT c_name AS source, 'Part#' || l_partkey AS target,
      CASE WHEN l_returnflag <> 'R' THEN o_orderpriority || ' ' || l_linestatus ELSE '' END AS description,
      coalesce(CASE WHEN l_linestatus = 'O' THEN l_quantity END, 1.0) AS weight, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    undirected AS (SELECT *, source AS name, target AS other, 0 AS rev FROM edges UNION ALL SELECT *, target, source, 1 FROM edges),
    strongest AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rev) AS er
      FROM undirected QUALIFY er <= 3)"""


def _expanded(entities: str) -> str:
    return f"""hit AS (SELECT e.*, s.other, s.description, s.er FROM {entities} e JOIN strongest s ON e.name = s.name),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, other ORDER BY entity_rank, er) AS f FROM hit),
    around AS (SELECT qid, 'graphrag-rel-' || name || '-' || other AS cid, score * 0.8 AS score, entity_rank, er, name, other, description
      FROM firsts WHERE f = 1 AND description <> '')"""


@query(
    f"""WITH {_EDGES}, ents AS (SELECT c_nationkey::BIGINT AS qid, c_name AS name, c_acctbal / 10000.0 AS score,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS entity_rank FROM customer),
    {_expanded("ents")} SELECT qid, cid, round(score, 6) AS score, er AS edge_rank FROM around"""
)
def graph_neighbors_top3(spark, sf):
    """Strongest edges of all customers, one target per nation."""
    from quillspark.operators.blocks import OrderedBlocks

    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("qid"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000.0).alias("score"),
        (-F.col("c_acctbal")).alias("_bal"), "c_custkey",
    )
    entities = OrderedBlocks(customers, ["qid"], ["_bal", "c_custkey"]).position("entity_rank").rows()
    docs = graph.expand_neighbors(entities.drop("_bal", "c_custkey"), edges(spark, sf))
    return docs.select("qid", "cid", F.round("score", 6).alias("score"), F.col("edge_rank").cast("long").alias("edge_rank"))


@query(
    f"""WITH {_EDGES} SELECT name, count(*) AS degree, round(max(weight), 6) AS top_weight FROM undirected GROUP BY 1"""
)
def edge_degrees(spark, sf):
    both = graph.both_directions(graph.clean_edges(edges(spark, sf)))
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("degree"), F.round(F.max("weight"), 6).alias("top_weight"))


def graph_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vecs = table(spark, sf, "embeddings")
    customers = table(spark, sf, "customer")
    entities = vecs.join(customers, F.col("vec_id") == F.col("c_custkey")).select(
        F.col("vec_id").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
        F.col("embedding").alias("vector"),
    )
    reports = centroids(vecs, "label", "embedding").select(
        F.col("label").cast("long").alias("community"),
        F.concat(F.lit("Label "), F.col("label").cast("string")).alias("title"),
        F.concat(F.lit("Report on label "), F.col("label").cast("string")).alias("full_content"), "vector",
    )
    return entities, reports


def _distance(a: str, b: str) -> str:
    return f"round(-list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))), 9)"


def graph_sql(asked: str) -> str:
    """CTEs ending in ``pool``: graph documents of the questions in ``asked``(qid, v)."""
    return f"""{CENTROIDS}, {_EDGES},
    ent AS (SELECT e.vec_id AS id, c_name AS name, c_mktsegment AS description, embedding::DOUBLE[] AS v FROM embeddings e JOIN customer ON vec_id = c_custkey),
    near AS (SELECT c.qid, e.id, e.name, e.description, {_distance("c.v", "e.v")} AS d,
      row_number() OVER (PARTITION BY c.qid ORDER BY d DESC, e.id) AS entity_rank FROM {asked} c, ent e QUALIFY entity_rank <= {K}),
    ents AS (SELECT qid, name, description, id, entity_rank, greatest(0.0, 1 + d) AS score FROM near),
    {_expanded("(SELECT qid, name, score, entity_rank FROM ents)")},
    com AS (SELECT c.qid, r.label::BIGINT AS community, {_distance("c.v", "r.v")} AS d,
      row_number() OVER (PARTITION BY c.qid ORDER BY d DESC, r.label) AS cr FROM {asked} c, cent r QUALIFY cr <= {K}),
    docs AS (
      SELECT qid, 'graphrag-entity-' || id AS cid, '[Entity: ' || name || E']\\n' || description AS text, score, 0 AS g, entity_rank AS a, 0 AS b FROM ents
      UNION ALL SELECT qid, cid, '[Relationship: ' || name || ' → ' || other || E']\\n' || description, score, 1, entity_rank, er FROM around
      UNION ALL SELECT qid, 'graphrag-community-' || community, '[Community Report: Label ' || community || E']\\nReport on label ' || community,
        greatest(0.0, 1 + d), 2, cr, 0 FROM com),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY score DESC, g, a, b) AS w,
      min(g * 1000000 + a * 1000 + b) OVER (PARTITION BY qid, cid) AS seen FROM docs),
    pool AS (SELECT qid, cid, text, score, row_number() OVER (PARTITION BY qid ORDER BY seen) AS seq FROM best WHERE w = 1)"""


_GRAPH = graph_sql("(SELECT label::BIGINT AS qid, v FROM cent)")


@query(
    f"""WITH {_GRAPH} SELECT qid, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank
    FROM pool QUALIFY rank <= {2 * K}"""
)
def graph_search_by_vector(spark, sf):
    entities, reports = graph_tables(spark, sf)
    asked = label_questions(spark, sf).withColumn("question", F.lit(""))
    docs = graph.graph_search(asked, entities, reports, edges(spark, sf), K)
    return docs.select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1))"


@query(
    f"""WITH {_GRAPH}, s AS (SELECT qid, cid, seq, {_WORDS.format("'report on entity urgent label ' || qid")} AS q, {_WORDS.format("text")} AS t FROM pool),
    r AS (SELECT qid, cid, seq, 1.0 / (1.0 + exp(-(len(list_intersect(q, t))::DOUBLE / len(q) * 8.0 - 6.0))) AS score FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM r QUALIFY rank <= {2 * K})
    SELECT qid, cid, round(score, 6) AS score, rank FROM k WHERE score >= 0.01"""
)
def graph_search_reranked(spark, sf):
    entities, reports = graph_tables(spark, sf)
    asked = label_questions(spark, sf).withColumn(
        "question", F.concat(F.lit("report on entity urgent label "), F.col("qid").cast("string"))
    )
    docs = graph.graph_search(asked, entities, reports, edges(spark, sf), K, OverlapScorer(), min_score=0.01)
    return docs.select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
