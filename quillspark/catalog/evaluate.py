"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import retrieval as V
from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.catalog.search import PAIRS, label_questions, vector_corpus
from quillspark.functions.models import ExtractiveGenerator, OverlapJudge
from quillspark.functions.text import bar
from quillspark.operators.ranking import best_and_worst, top_k
from quillspark.operators.search import search
from quillspark.plans import evaluate as E
from quillspark.plans import retrieve as R
from quillspark.session import stored


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evaluation records: modes, judge replies, timings."""
    kind, v = F.col("event_type"), F.col("value")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("qid"),
        F.when(kind == "click", F.lit("backend")).when(kind == "view", F.lit("oracle_gt")).when(kind == "error", F.lit("backend_error")).alias("source"),
        F.when(kind == "error", F.lit("timeout")).alias("error"),
        (F.col("user_id") % 3 == 0).alias("context_hit"),
        (F.col("user_id") % 5 / F.lit(4.0)).alias("cid_recall"),
        (F.pmod(F.floor(v * 100), F.lit(700)) / 100.0 - 1.0).cast("string").alias("faithfulness"),
        F.when(kind == "signup", F.lit("n/a")).otherwise((F.col("user_id") % 6).cast("string")).alias("answer_relevancy"),
        F.when(kind == "view", F.lit("NaN")).otherwise((F.col("event_id") % 8).cast("string")).alias("completeness"),
        F.when(kind != "purchase", (F.col("user_id") % 4 + 0.5).cast("string")).alias("citation_accuracy"),
        (v - 5.0).alias("retrieval_ms"), (v * 2).alias("generation_ms"), (F.col("user_id") * 3).alias("completion_tokens"),
    )
    return E.composite(rows)


def _clean(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} <= 0 THEN 0.0 ELSE least(greatest({x}, 1.0), 5.0) END"


_RECORDS = f"""raw AS (SELECT event_id AS qid,
      CASE event_type WHEN 'click' THEN 'backend' WHEN 'view' THEN 'oracle_gt' WHEN 'error' THEN 'backend_error' END AS source,
      CASE WHEN event_type = 'error' THEN 'timeout' END AS error, (user_id % 3 = 0) AS context_hit, user_id % 5 / 4.0::DOUBLE AS cid_recall,
      ((floor(value * 100)::BIGINT % 700 + 700) % 700) / 100.0::DOUBLE - 1.0 AS f,
      CASE WHEN event_type = 'signup' THEN NULL ELSE user_id % 6 END::DOUBLE AS r,
      CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 8 END::DOUBLE AS c,
      CASE WHEN event_type <> 'purchase' THEN user_id % 4 + 0.5 END::DOUBLE AS t,
      value - 5.0 AS retrieval_ms, value * 2 AS generation_ms, user_id * 3 AS completion_tokens FROM events),
    clean AS (SELECT * EXCLUDE (f, r, c, t), {_clean("f")} AS faithfulness, {_clean("r")} AS answer_relevancy,
      {_clean("c")} AS completeness, {_clean("t")} AS citation_accuracy FROM raw),
    listed AS (SELECT *, list_filter([faithfulness, answer_relevancy, completeness, citation_accuracy], lambda x: x > 0) AS l FROM clean),
    records AS (SELECT *, CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE 0.0 END AS overall_score FROM listed)"""


@query(
    f"WITH {_RECORDS} SELECT qid, faithfulness, answer_relevancy, completeness, citation_accuracy, round(overall_score, 6) AS overall_score FROM records"
)
def composite_scores(spark, sf):
    return records(spark, sf).select("qid", *E.JUDGED, F.round("overall_score", 6).alias("overall_score"))


_POS = ", ".join(
    f"round(coalesce(avg(CASE WHEN {c} > 0 THEN {c} END), 0), 6) AS avg_{c}" for c in (*E.JUDGED, "overall_score")
)


@query(
    f"""WITH {_RECORDS} SELECT count(*) AS n_total, count(error) AS n_errors, count(CASE WHEN source = 'backend' THEN 1 END) AS n_retrieval,
      count(CASE WHEN source = 'backend' AND context_hit THEN 1 END) AS context_hits,
      round(count(CASE WHEN source = 'backend' AND context_hit THEN 1 END)::DOUBLE / count(CASE WHEN source = 'backend' THEN 1 END), 6) AS hit_rate,
      round(avg(CASE WHEN source = 'backend' THEN cid_recall END), 6) AS avg_cid_recall, {_POS},
      round(avg(CASE WHEN source = 'backend' AND retrieval_ms > 0 THEN retrieval_ms END), 6) AS avg_retrieval_ms,
      round(avg(generation_ms), 6) AS avg_generation_ms, round(sum(completion_tokens)::DOUBLE / count(*), 6) AS avg_tokens FROM records"""
)
def eval_summary(spark, sf):
    s = E.summary(records(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(
    f"""WITH {_RECORDS} SELECT mode, coalesce(n, 0) AS n FROM (SELECT unnest(['backend', 'oracle_gt', 'backend_error', 'missing']) AS mode)
    LEFT JOIN (SELECT coalesce(source, 'missing') AS mode, count(*) AS n FROM records GROUP BY 1) USING (mode)"""
)
def mode_counts(spark, sf):
    return E.mode_counts(records(spark, sf))


@query(
    f"""WITH {_RECORDS}, b AS (SELECT CASE WHEN faithfulness <= 1.5 THEN '1 (Poor)' WHEN faithfulness <= 2.5 THEN '2 (Fair)'
      WHEN faithfulness <= 3.5 THEN '3 (Good)' WHEN faithfulness <= 4.5 THEN '4 (Very Good)' ELSE '5 (Excellent)' END AS rating, count(*) AS n
      FROM records WHERE faithfulness > 0 GROUP BY 1)
    SELECT rating, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(n) OVER (), 6)::DOUBLE AS pct,
      repeat('█', floor(coalesce(n, 0)::DOUBLE / (SELECT max(n) FROM b) * 20)::INTEGER) || repeat('░', 20 - floor(coalesce(n, 0)::DOUBLE / (SELECT max(n) FROM b) * 20)::INTEGER) AS bar
    FROM (SELECT unnest(['1 (Poor)', '2 (Fair)', '3 (Good)', '4 (Very Good)', '5 (Excellent)']) AS rating) LEFT JOIN b USING (rating)"""
)
def score_histogram(spark, sf):
    from pyspark.sql import Window

    hist = E.histogram(records(spark, sf), "faithfulness")
    top = F.max("n").over(Window.partitionBy(F.lit(0)))  # five rows
    share = hist.withColumn("_s", F.col("n").cast("double") / top)
    return share.select("rating", "n", F.round("pct", 6).alias("pct"), bar(F.col("_s"), 1.0).alias("bar"))


@query(
    f"""WITH {_RECORDS}, s AS (SELECT qid, overall_score FROM records WHERE overall_score > 0)
    SELECT 'best' AS side, qid, round(overall_score, 6) AS overall_score FROM (SELECT * FROM s ORDER BY round(overall_score, 9) DESC, qid LIMIT 5)
    UNION ALL SELECT 'worst', qid, round(overall_score, 6) FROM (SELECT * FROM s ORDER BY round(overall_score, 9), qid LIMIT 5)"""
)
def best_worst5(spark, sf):
    rows = records(spark, sf).select("qid", F.round("overall_score", 9).alias("overall_score"))
    return best_and_worst(rows, "overall_score", "qid").select("side", "qid", F.round("overall_score", 6).alias("overall_score"))


@query(f"WITH {_RECORDS} SELECT qid, faithfulness FROM records ORDER BY faithfulness, qid LIMIT 5")
def lowest_faithfulness(spark, sf):
    return top_k(records(spark, sf).select("qid", "faithfulness"), ["faithfulness", "qid"], 5)


@query(
    "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem"
)
def float_means(spark, sf):
    m = E.float_means(table(spark, sf, "lineitem"))
    return m.select(*[F.round(c, 4 if c == "l_extendedprice" else 6).alias(c) for c in m.columns])


@query(
    f"""WITH {V._LOOKUP} SELECT count(*) AS n, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean,
      round(count(CASE WHEN score >= 0.3 THEN 1 END)::DOUBLE / count(*), 6) AS pass_0_3, round(count(CASE WHEN score >= 0.1 THEN 1 END)::DOUBLE / count(*), 6) AS pass_0_1,
      round(count(CASE WHEN score >= 0.05 THEN 1 END)::DOUBLE / count(*), 6) AS pass_0_05 FROM ranked"""
)
def reranker_diagnosis(spark, sf):
    asked = V.benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    d = E.reranker_diagnosis(R.lookup(V.document_index(spark, sf), asked, V.K))
    return d.select("n", *[F.round(c, 6).alias(c) for c in d.columns if c != "n"])


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("ground_truth_context"),
        F.array("item_id", F.col("item_id") + 1).alias("ground_truth_cids"),
    )


_SCORED = f"""got AS (SELECT qid, list_distinct(flatten(list({Q.content_tokens("text")}))) AS t, list(cid) AS c FROM ranked JOIN documents ON cid = doc_id GROUP BY 1),
    gt AS (SELECT item_id AS qid, {Q.content_tokens("text")} AS g FROM benchmark),
    scored AS (SELECT qid, {Q.overlap("g", "t")} >= CASE WHEN len(g) > 30 THEN 0.45 ELSE 0.3 END AS context_hit,
      len(list_intersect([qid, qid + 1], c)) / 2.0::DOUBLE AS cid_recall FROM gt JOIN got USING (qid))"""


@query(f"WITH {V._LOOKUP}, {_SCORED} SELECT qid, context_hit, cid_recall FROM scored")
def token_overlap_hit(spark, sf):
    asked = V.benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    docs = R.lookup(V.document_index(spark, sf), asked, V.K)
    return E.score_retrieval(_samples(spark, sf), docs)


_SWEEP = " UNION ALL ".join(
    f"""SELECT * FROM (WITH {V._simple("LEGAL_LOOKUP", (), k, k)}, {_SCORED}
      SELECT {k} AS top_k, count(*) AS n, round(avg(context_hit::INTEGER), 6) AS hit_rate, round(avg(cid_recall), 6) AS recall FROM scored)"""
    for k in (3, 5, 10)
)


@query(_SWEEP)
def sweep_top_k(spark, sf):
    index = V.document_index(spark, sf)
    asked = stored(V.benchmark_questions(spark, sf, "LEGAL_LOOKUP"), "asked")

    def run(k: int) -> DataFrame:
        scored = E.score_retrieval(_samples(spark, sf), R.lookup(index, asked, k))
        return scored.agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("context_hit").cast("int")), 6).alias("hit_rate"),
            F.round(F.avg("cid_recall"), 6).alias("recall"),
        )

    return E.sweep(run)


@query(
    f"""WITH {PAIRS}, got AS (SELECT qid, id, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= 20)
    SELECT g.qid, round(count(CASE WHEN g.label = g.qid THEN 1 END)::DOUBLE / any_value(n), 6) AS recall
    FROM got g JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) s ON s.label = g.qid GROUP BY 1"""
)
def cid_recall(spark, sf):
    """Share of a label's vectors among the 20 nearest to its centroid."""
    vecs = table(spark, sf, "embeddings")
    found = search(label_questions(spark, sf), vector_corpus(spark, sf), 20)
    got = found.join(vecs.select(F.col("vec_id").alias("id"), "label"), "id")
    hits = got.groupBy("qid").agg(F.count_if(F.col("label") == F.col("qid")).alias("h"))
    truth = vecs.groupBy(F.col("label").cast("long").alias("qid")).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(truth, "qid").select("qid", F.round(F.col("h") / F.col("n"), 6).alias("recall"))


@query(
    f"""SELECT conv_id * 100000 + turn AS qid, {Q.strip("text")} AS question, 'context no ' || conv_id || E'\\n\\n' || 'turn is ' || turn AS ground_truth_context,
    conv_id + turn AS id_sum FROM conversations WHERE length({Q.strip("text")}) > 10 AND role <> 'system'"""
)
def golden_rows(spark, sf):
    """Question file rows: blanks, missing contexts and list literals handled."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).cast("string").alias("qid"), F.col("text").alias("question"),
        F.when(F.col("role") != "system", F.concat(F.lit("['context no "), c, F.lit("', 'turn is "), t, F.lit("']"))).alias("context"),
        F.concat(F.lit("["), c, F.lit(" "), t, F.lit("]")).alias("cid"),
    )
    total = F.aggregate("ground_truth_cids", F.lit(0).cast("long"), lambda a, x: a + x)
    return E.golden_rows(rows).select("qid", "question", "ground_truth_context", total.alias("id_sum"))


@query("SELECT doc_id AS qid, doc_id AS cid, md5(text) AS text_md5, 'oracle_gt' AS source FROM documents")
def oracle_retrieval(spark, sf):
    samples = table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"), F.col("text").alias("ground_truth_context"), F.array("doc_id").alias("ground_truth_cids")
    )
    return E.oracle_docs(samples).select("qid", "cid", F.md5("text").alias("text_md5"), "source")


def _share(of: str, within: str) -> str:
    return f"coalesce(1.0 + {Q.overlap(Q.content_tokens(of), Q.content_tokens(within))} * 4.0, 0.0)"


@query(
    f"""WITH {V._LOOKUP}, {V._BLOCKS}, {_SCORED},
    a AS (SELECT qid, b.text AS truth, context, b.text || E'\\n' || replace(context, E'\\n---\\n', E'\\n\\n') AS answer FROM benchmark b JOIN ctx ON qid = item_id),
    j AS (SELECT qid, {_share("answer", "context")} AS f, {_share("truth", "answer")} AS r, {_share("context", "truth")} AS c FROM a)
    SELECT j.qid, context_hit, cid_recall, round(f, 6) AS faithfulness, round(r, 6) AS completeness, round(c, 6) AS citation_accuracy,
      round((f + r + r + c) / 4, 6) AS overall_score FROM j JOIN scored USING (qid)"""
)
def evaluation_run(spark, sf):
    """Questions answered from retrieved documents and judged, one record each."""
    asked = V.benchmark_questions(spark, sf, "LEGAL_LOOKUP")
    docs = stored(R.lookup(V.document_index(spark, sf), asked, V.K), "docs")
    samples = _samples(spark, sf).withColumn("question", F.col("ground_truth_context"))
    scored = E.evaluation_records(samples, docs, ExtractiveGenerator(), OverlapJudge())
    rounded = [F.round(c, 6).alias(c) for c in ("faithfulness", "completeness", "citation_accuracy", "overall_score")]
    return scored.select("qid", "context_hit", "cid_recall", *rounded)
