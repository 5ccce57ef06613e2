"""Vector search over whole tables; the questions are unit centroids of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions import vectors
from quillspark.functions.models import HashingEmbedder, embed
from quillspark.functions.text import tokens
from quillspark.operators import search as S
from quillspark.operators.cells import build_cells, probes_for, search_cells
from quillspark.operators.codes import search_coded, store_codes
from quillspark.operators.dedup import merge_best
from quillspark.operators.terms import search_terms, term_index
from quillspark.plans import graph
from quillspark.plans.retrieve import merge_asks
from quillspark.session import spread

K = 5


def label_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, payload): one unit centroid per label."""
    means = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return means.select(F.col("label").cast("long").alias("qid"), F.col("vector").alias("payload"))


def vector_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("payload"))


# Centroids in long form, unit length, float32 like the stored vectors.
CENTROIDS = """
comp AS (SELECT label, unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label, pos, avg(x) AS m FROM comp GROUP BY 1, 2),
cnorm AS (SELECT label, sqrt(sum(m * m)) AS n FROM mean GROUP BY 1),
cent AS (SELECT label, list((m / n)::FLOAT ORDER BY pos)::DOUBLE[] AS v FROM mean JOIN cnorm USING (label) GROUP BY 1)"""
PAIRS = f"""{CENTROIDS},
pairs AS (SELECT c.label::BIGINT AS qid, e.vec_id AS id, e.label, round(list_inner_product(c.v, e.embedding::DOUBLE[]), 9) AS score
    FROM cent c, embeddings e)"""


def _top(k: int, source: str = "pairs") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAIRS} SELECT qid, id, round(score, 6) AS score, rank FROM {_top(K)}")
def knn_topk(spark, sf):
    return _out(S.search(label_questions(spark, sf), vector_corpus(spark, sf), K))


CELLS, PROBES, BUCKETS = 16, 4, 16


@query(f"WITH {PAIRS} SELECT qid, id, round(score, 6) AS score, rank FROM {_top(K)}")
def cell_search_exact(spark, sf):
    """Nearest vectors through the cell index; cells that cannot hold a better one are not read."""
    index = build_cells(vector_corpus(spark, sf), CELLS)
    return _out(search_cells(index, label_questions(spark, sf), K, PROBES, exact=True))


#: Neighbours counted for the recall of the cell index: every 20th vector, asked against all.
RECALL_OF = 10


@query()
def cell_search_recall(spark, sf):
    """Share of the nearest vectors that probing finds, per question; every id divisible by 20 asks."""
    corpus = vector_corpus(spark, sf)
    asked = corpus.where(F.col("id") % 20 == 0).withColumnRenamed("id", "qid")
    index = build_cells(corpus, CELLS)
    found = search_cells(index, asked, RECALL_OF, probes_for(index, RECALL_OF))
    true = S.search(asked, corpus, RECALL_OF)
    both = true.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall"))


@query(
    f"""WITH {PAIRS}, topped AS (SELECT qid // 3 AS q, qid % 3 AS ask_no, id, score, rank FROM {_top(K)}),
    best AS (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY score DESC, ask_no, rank) AS b,
      min(ask_no * 1000 + rank) OVER (PARTITION BY q, id) AS seen FROM topped)
    SELECT q AS qid, id AS cid, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen) AS seq
    FROM best WHERE b = 1"""
)
def multi_query_merge(spark, sf):
    asks = label_questions(spark, sf).select(
        (F.col("qid") / 3).cast("long").alias("qid"), (F.col("qid") % 3).alias("ask_no"), "payload"
    )
    named = asks.withColumn("_ask", F.concat_ws("|", "qid", "ask_no"))
    found = S.search(named.select(F.col("_ask").alias("qid"), "payload"), vector_corpus(spark, sf), K)
    return merge_asks(found, named).select(
        "qid", "cid", F.round("score", 6).alias("score"), F.col("seq").cast("long").alias("seq")
    )


@query(
    f"""WITH {CENTROIDS}, pairs AS (SELECT c.label::BIGINT AS qid, e.vec_id AS id,
      round(-list_sum(list_transform(range(1, 65), lambda i: (c.v[i] - e.embedding[i]::DOUBLE) * (c.v[i] - e.embedding[i]::DOUBLE))), 9) AS score
      FROM cent c, embeddings e)
    SELECT qid, id, round(greatest(0.0, 1 + score), 6) AS score, rank FROM {_top(K)}"""
)
def knn_l2_score(spark, sf):
    entities = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _out(graph.nearest(label_questions(spark, sf), entities, "id", K))


_BOUND = """
hist AS (SELECT ceil(abs(x) / 0.001) AS b, count(*) AS c FROM comp GROUP BY 1),
cum AS (SELECT b, sum(c) OVER (ORDER BY b) AS upto, sum(c) OVER () AS n FROM hist),
bound AS (SELECT min(b) * 0.001 AS w FROM cum WHERE upto >= n * 0.99)"""


def _code(v: str) -> str:
    return f"list_transform({v}, lambda x: least(greatest(round(x::DOUBLE / w * 127.0), -127), 127))"


@query(
    f"""WITH {CENTROIDS}, {_BOUND}, ccode AS (SELECT label, v, {_code("v")} AS code FROM cent, bound),
    ecode AS (SELECT vec_id, embedding, {_code("embedding")} AS code FROM embeddings, bound),
    coarse AS (SELECT c.label::BIGINT AS qid, e.vec_id AS id, list_inner_product(c.code, e.code) AS s,
      round(list_inner_product(c.v, e.embedding::DOUBLE[]), 9) AS score,
      row_number() OVER (PARTITION BY c.label ORDER BY s DESC, e.vec_id) AS cr FROM ccode c, ecode e),
    pairs AS (SELECT * FROM coarse WHERE cr <= 8)
    SELECT qid, id, round(score, 6) AS score, rank FROM {_top(K)}"""
)
def quantized_rescore(spark, sf):
    """Codes are scanned; exact vectors are read from the buckets of the coarse winners."""
    return _out(search_coded(store_codes(vector_corpus(spark, sf), BUCKETS), label_questions(spark, sf), K))


@query(
    f"""WITH {CENTROIDS}, {_BOUND} SELECT vec_id, list_sum(list_transform({_code("embedding")}, lambda x: x::BIGINT))::BIGINT AS code_sum,
      list_max({_code("embedding")})::BIGINT AS code_max FROM embeddings, bound"""
)
def int8_codes(spark, sf):
    points = table(spark, sf, "embeddings")
    coded = points.select("vec_id", vectors.quantise(F.col("embedding"), F.lit(S.quantisation_bound(points, "embedding"))).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return coded.select("vec_id", total.alias("code_sum"), F.array_max("c").cast("long").alias("code_max"))


@query("SELECT vec_id, 256::BIGINT AS packed_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total, TRUE AS same FROM embeddings")
def pack_round_trip(spark, sf):
    packed = table(spark, sf, "embeddings").withColumn("blob", vectors.pack(F.col("embedding")))
    back = packed.withColumn("v", vectors.unpack(F.col("blob"), Q.DIM))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(
        "vec_id", F.length("blob").cast("long").alias("packed_bytes"), F.round(total, 6).alias("total"),
        (F.col("v") == F.col("embedding")).alias("same"),
    )


@query(
    f"""WITH {PAIRS}, topped AS (SELECT qid // 4 AS q, qid AS entity, id, score, rank FROM {_top(K)}),
    best AS (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY score DESC, entity, rank) AS b FROM topped)
    SELECT q AS qid, id, entity, round(score, 6) AS score FROM best WHERE b = 1"""
)
def compare_entity_merge(spark, sf):
    found = S.search(label_questions(spark, sf), vector_corpus(spark, sf), K)
    tagged = found.select((F.col("qid") / 4).cast("long").alias("q"), F.col("qid").alias("entity"), "id", "score", "rank")
    merged = merge_best(tagged, ["q", "id"], ["entity", "rank"])
    return merged.select(F.col("q").alias("qid"), "id", "entity", F.round("score", 6).alias("score"))


@query(
    f"""WITH {PAIRS}, hop1 AS {_top(K)},
    seed AS (SELECT h.qid, pos, avg(x) AS m FROM (SELECT qid, id FROM hop1 WHERE rank <= 3) h
      JOIN (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) c ON c.vec_id = h.id
      GROUP BY 1, 2),
    snorm AS (SELECT qid, sqrt(sum(m * m)) AS n FROM seed GROUP BY 1),
    sv AS (SELECT qid, list((m / n)::FLOAT ORDER BY pos)::DOUBLE[] AS v FROM seed JOIN snorm USING (qid) GROUP BY 1),
    p2 AS (SELECT s.qid, e.vec_id AS id, round(list_inner_product(s.v, e.embedding::DOUBLE[]), 9) AS score FROM sv s, embeddings e),
    both_hops AS (SELECT qid, id, score, 1 AS hop, rank FROM hop1 UNION ALL SELECT qid, id, score, 2, rank FROM {_top(K, "p2")}),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, hop, rank) AS b FROM both_hops)
    SELECT qid, id, hop::BIGINT AS hop, round(score, 6) AS score FROM best WHERE b = 1"""
)
def two_hop_vectors(spark, sf):
    corpus = vector_corpus(spark, sf)
    hop1 = S.search(label_questions(spark, sf), corpus, K)
    seeds = hop1.where("rank <= 3").select("qid", "id").join(corpus, "id")
    second = vectors.centroids(seeds, "qid", "payload").select("qid", F.col("vector").alias("payload"))
    hop2 = S.search(second, corpus, K)
    rows = hop1.withColumn("hop", F.lit(1)).unionByName(hop2.withColumn("hop", F.lit(2)))
    merged = merge_best(rows, ["qid", "id"], ["hop", "rank"])
    return merged.select("qid", "id", F.col("hop").cast("long").alias("hop"), F.round("score", 6).alias("score"))


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


_RRF = f"""{Q.vectors("bv", "benchmark", "item_id", "text")}, {Q.DOC_VECTORS},
dense AS (SELECT q.id AS qid, d.id AS id, round(sum(q.x * d.x), 9) AS score,
    row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.x * d.x), 9) DESC, d.id) AS rank
    FROM bv q JOIN dv d USING (b) GROUP BY 1, 2 QUALIFY rank <= 10),
sparse AS (SELECT q.id AS qid, d.id AS id, sum(q.c * d.c)::DOUBLE AS score,
    row_number() OVER (PARTITION BY q.id ORDER BY sum(q.c * d.c) DESC, d.id) AS rank
    FROM bv_m q JOIN dv_m d USING (h) GROUP BY 1, 2 QUALIFY rank <= 10)"""


def _term_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = text_questions(spark, sf).select("qid", tokens(F.col("question")).alias("payload"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("payload"))
    return search_terms(asked, term_index(docs), 10)


@query(f"WITH {_RRF} SELECT qid, id, score, rank FROM sparse")
def term_search(spark, sf):
    return _term_search(spark, sf).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_RRF}, pairs AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60.0 + rank)), 9) AS score
      FROM (SELECT qid, id, rank FROM dense UNION ALL SELECT qid, id, rank FROM sparse) GROUP BY 1, 2)
    SELECT qid, id, round(score, 6) AS score, rank FROM {_top(K)}"""
)
def rrf_fusion(spark, sf):
    embedder = HashingEmbedder(Q.DIM)
    docs = spread(table(spark, sf, "documents"))
    corpus = docs.select(F.col("doc_id").alias("id"), embed(F.col("text"), embedder).alias("payload"))
    asked = text_questions(spark, sf).select("qid", embed(F.col("question"), embedder).alias("payload"))
    return _out(S.fuse_ranks(S.search(asked, corpus, 2 * K), _term_search(spark, sf), K))


@query(
    f"""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b
    FROM events) WHERE b = 1"""
)
def arg_max_dedup(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    return merge_best(rows, ["user_id"], ["event_id"], "value").select("user_id", "event_id", "value")
