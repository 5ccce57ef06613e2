"""Search against brute force, including mass ties and the split question set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import routing
from quillspark.functions.models import HashingEmbedder, OverlapScorer, embed
from quillspark.operators import search as S
from quillspark.operators.cells import build_cells, probes_for, search_cells
from quillspark.operators.codes import coarse_hits, search_coded, store_codes
from quillspark.operators.dedup import first_per_key, last_per_key, merge_best
from quillspark.operators.terms import rows_with_all, search_among, search_terms, term_index
from quillspark.plans import graph
from quillspark.plans import retrieve as R

RNG = np.random.default_rng(3)
CORPUS = RNG.normal(size=(120, 8)).astype("f4")
CORPUS[40:80] = CORPUS[40]  # a third of the rows are copies
QUESTIONS = np.vstack([RNG.normal(size=(6, 8)), CORPUS[40:41]]).astype("f4")


def frame(spark, name, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"{name} long, payload array<float>").repartition(3)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def brute(k, score):
    s = np.round(score, 9)
    return {(q, int(i), r + 1) for q in range(len(QUESTIONS)) for r, i in enumerate(np.lexsort((np.arange(120), -s[:, q]))[:k])}


DOTS = CORPUS.astype("f8") @ QUESTIONS.astype("f8").T


@pytest.mark.parametrize("max_rows", [100, 2])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_dense_search(spark, metric, max_rows):
    exact = DOTS
    if metric == "l2":
        exact = -((CORPUS.astype("f8")[:, None, :] - QUESTIONS.astype("f8")[None]) ** 2).sum(-1)
    found = S.search(frame(spark, "qid", QUESTIONS), frame(spark, "id", CORPUS), 7, S.DenseKernel(metric), max_rows=max_rows)
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == brute(7, exact)


def test_byte_bound_splits_too(spark):
    found = S.search(frame(spark, "qid", QUESTIONS), frame(spark, "id", CORPUS), 7, max_rows=3, max_bytes=1)
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == brute(7, DOTS)


def test_quantised_search_keeps_most_neighbours(spark):
    questions, corpus = frame(spark, "qid", QUESTIONS[:6]), frame(spark, "id", CORPUS)
    bound = S.quantisation_bound(corpus, "payload")
    exact = {(r.qid, round(r.score, 6)) for r in S.search(questions, corpus, 10).collect()}
    for max_rows in (100, 2):
        rows = S.search_quantised(questions, corpus, 10, bound, 1.5, max_rows=max_rows).collect()
        assert len(rows) == 60
        assert len({(r.qid, round(r.score, 6)) for r in rows} & exact) >= 0.8 * len(exact)


def test_term_and_filtered_search(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, [])], "id long, payload array<string>"
    )
    asked = spark.createDataFrame([(1, ["a", "c"]), (2, ["z"]), (3, ["d", "d"])], "qid long, payload array<string>")
    postings = term_index(docs)
    got = {(r.qid, r.id): r.score for r in search_terms(asked, postings, 3).collect()}
    assert got == {(1, 2): 3.0, (1, 1): 1.0, (3, 3): 2.0}
    vec = F.array(F.lit(1.0).cast("float"))
    filtered = search_among(asked.select("qid", vec.alias("payload"), F.col("payload").alias("words")), docs.select("id", vec.alias("payload")), postings, 3)
    assert {(r.qid, r.id) for r in filtered.collect()} == {(1, 2), (3, 3)}


def test_term_table_as_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    # half of all rows hold w0, some hold nothing
    rows = {k: [words[int(x)] for x in rng.zipf(1.4, rng.integers(0, 30)) % 40] + ["w0"] * (k % 2) for k in range(300)}
    asks = {q: [words[int(x)] for x in rng.integers(0, 40, 1 + q % 4)] for q in range(25)}
    docs = spark.createDataFrame(list(rows.items()), "id long, payload array<string>")
    asked = spark.createDataFrame(list(asks.items()), "qid long, payload array<string>")
    postings = term_index(docs.unionByName(spark.createDataFrame([(None, ["w0"]), (500, None), (501, [None])], docs.schema)))
    scores = {(q, d): float(sum(have.count(w) for w in ask)) for q, ask in asks.items() for d, have in rows.items()}
    best = set()
    for q in asks:
        order = sorted((-s, d) for (q2, d), s in scores.items() if q2 == q and s)[:7]
        best |= {(q, d, -s, r) for r, (s, d) in enumerate(order, 1)}
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert {tuple(r) for r in search_terms(asked, postings, 7).collect()} == best
        holding = {tuple(r) for r in rows_with_all(asked.withColumnRenamed("payload", "words"), postings).collect()}
        assert holding == {(q, d) for q, ask in asks.items() for d, have in rows.items() if set(ask) <= set(have)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_term_search_sums_where_postings_lie(spark):
    docs = spark.createDataFrame([(k, ["a", f"t{k}"]) for k in range(50)], "id long, payload array<string>")
    plan = plan_of(search_terms(spark.createDataFrame([(1, ["a"])], "qid long, payload array<string>"), term_index(docs), 3))
    assert plan.count("Exchange hashpartitioning(id") == 0 and "Bucketed: true" in plan and "BroadcastHashJoin" in plan


def test_cells_find_what_a_full_scan_finds(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[0 if k % 3 == 0 else k % 12] + rng.normal(scale=0.4, size=16)).tolist()) for k in range(1500)]
    corpus = spark.createDataFrame(rows, "id long, payload array<float>").repartition(5)
    asked = corpus.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index = build_cells(corpus.unionByName(spark.createDataFrame([(9999, None)], corpus.schema)), 12)
    assert index.rows().count() == 1500
    true = {tuple(r) for r in S.search(asked, corpus, 10).collect()}
    for bounds in ({}, {"max_rows": 9}, {"max_bytes": 4000}):
        assert {tuple(r) for r in search_cells(index, asked, 10, 1, exact=True, **bounds).collect()} == true
    probes = probes_for(index, 10)
    assert 1 <= probes < 12
    found = {(r.qid, r.id) for r in search_cells(index, asked, 10, probes).collect()}
    assert len(found & {t[:2] for t in true}) >= 0.9 * len(true)


def test_coded_search_as_the_two_stages_in_memory(spark):
    questions, corpus = frame(spark, "qid", QUESTIONS), frame(spark, "id", CORPUS)
    vectors = store_codes(corpus, 4)
    want = {tuple(r) for r in S.search_quantised(questions, corpus, 10, vectors.bound).collect()}
    for bounds in ({}, {"max_rows": 3}):
        assert {tuple(r) for r in search_coded(vectors, questions, 10, **bounds).collect()} == want


def test_coarse_pass_reads_codes_only(spark):
    corpus = spark.createDataFrame([(f"n{k}", [k / 50, 1 - k / 50]) for k in range(50)] + [("none", None)], "id string, payload array<float>")
    vectors = store_codes(corpus, 8)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, payload array<float>")
    plan = plan_of(coarse_hits(vectors, asked, 3))
    assert "ReadSchema: struct<id:string,code:binary>" in plan and "exact-vectors" not in plan
    last = plan_of(search_coded(vectors, asked, 2))
    assert "PartitionFilters: [bucket" in last or "PartitionFilters: [isnotnull(bucket" in last
    assert [r["id"] for r in search_coded(vectors, asked, 2).orderBy("rank").collect()] == ["n49", "n48"]


def test_cells_read_only_what_is_probed(spark):
    rows = [(k, [float(k % 4 == j) for j in range(4)]) for k in range(400)]
    index = build_cells(spark.createDataFrame(rows, "id long, payload array<float>"), 4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, payload array<float>")
    plan = plan_of(search_cells(index, asked, 5, 1))
    cell = index.rows().where("id = 0").first()["cell"]
    filters = plan.split("PartitionFilters: ")[1].split("], ")[0]
    assert "cell#" in filters and f" = {cell})" in filters


def test_summary_of_a_named_decree_stays_inside_it(spark):
    """The text filter of summaries hits: only texts with all words of the name are left; without a hit all texts are searched."""
    texts = {1: "theo nghị định 100/2019 về giao thông", 2: "tóm tắt nghị định 100 khác", 3: "2019 có nghị quyết và định mức 100", 4: "nghị định số 7"}
    points = spark.createDataFrame(list(texts.items()), "cid long, text string").select(
        "cid", F.col("cid").alias("parent_id"), "text", F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("x").alias("legal_type"),
        embed(F.col("text"), HashingEmbedder(64)).alias("embedding"),
    )
    asked = spark.createDataFrame([(1, "tóm tắt nghị định 100/2019"), (2, "tóm tắt nghị định 55/2001")], "qid long, question string")
    found = R.summarize(R.Index(points, HashingEmbedder(64)), routing.reflect(asked), 4).collect()
    assert {r["cid"] for r in found if r["qid"] == 1} == {1, 3}
    assert {r["cid"] for r in found if r["qid"] == 2} == {1, 2, 3, 4}


def test_no_questions_means_no_scan(spark):
    empty = frame(spark, "qid", QUESTIONS).where("qid < 0")
    assert S.search(empty, frame(spark, "id", CORPUS), 3).count() == 0


def test_merge_keeps_first_of_equals_and_first_position(spark):
    rows = spark.createDataFrame(
        [(1, "x", 0.5, 0, "a"), (1, "y", 0.4, 1, "b"), (1, "x", 0.5, 2, "c"), (1, "y", 0.9, 3, "d")],
        "qid int, cid string, score double, at int, tag string",
    )
    got = {r.cid: (r.tag, r.seen_at[0]) for r in merge_best(rows, ["qid", "cid"], ["at"]).collect()}
    assert got == {"x": ("a", 0), "y": ("d", 1)}
    assert {r.tag for r in first_per_key(rows, ["cid"], ["at"]).collect()} == {"a", "b"}
    assert {r.tag for r in last_per_key(rows, ["cid"], ["at"]).collect()} == {"c", "d"}


def candidates(spark, texts):
    rows = [(1, "alpha beta", i, t, 1.0 - i / 100, i + 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "qid int, question string, cid int, text string, score double, seq int")


def test_rerank_cap_follows_arrival(spark):
    texts = ["other"] * 31
    texts[3] = "  "
    texts[7] = "alpha"
    texts[30] = "alpha beta"
    pool = candidates(spark, texts)
    ranked = [r.cid for r in R.rerank(pool, OverlapScorer(), 40).orderBy("rank").collect()]
    assert ranked[0] == 7 and 30 not in ranked and 3 not in ranked and len(ranked) == 29
    assert R.rerank(pool, None, 40).count() == 31


def index(spark):
    e = HashingEmbedder(32)
    texts = ["tax law one", "fee law two", "nghị định 100/2019 về phạt", "bước hồ sơ thủ tục", "tax and fee together", ""]
    rows = [(i, i % 2, t, "t", "u", "k", v.tolist()) for i, (t, v) in enumerate(zip(texts, e.encode(texts)))]
    points = spark.createDataFrame(
        rows, "cid long, parent_id long, text string, title string, url string, legal_type string, embedding array<float>"
    )
    parents = spark.createDataFrame([(0, "whole parent")], "parent_id long, parent_text string")
    return R.Index(points, e, None, parents)


def ask(spark, intent, question, extras=(), subs=()):
    return spark.createDataFrame(
        [(1, question, intent, list(extras), list(subs))],
        "qid long, question string, intent string, expanded_queries array<string>, sub_entities array<string>",
    )


def test_strategies(spark):
    ix = index(spark)
    compared = R.retrieve(ix, ask(spark, "COMPARE", "tax và fee", (), ("tax law one", "fee law two", "a", "b", "c")), 2).collect()
    labels = {r.cid: r.entity_label for r in compared}
    assert labels[0] == "tax law one" and labels[1] == "fee law two" and len(compared) <= 8
    inside = R.retrieve(ix, ask(spark, "SUMMARIZE", "tóm tắt nghị định 100/2019"), 2).collect()
    assert [r.cid for r in inside] == [2]
    anywhere = R.retrieve(ix, ask(spark, "SUMMARIZE", "tóm tắt nghị định 7/2001"), 2).collect()
    assert len(anywhere) == 6
    assert len(R.retrieve(ix, ask(spark, "DEFINITION", "tax law one"), 5).collect()) == 3
    boosted = {r.cid: r.score for r in R.retrieve(ix, ask(spark, "PROCEDURE", "bước hồ sơ thủ tục"), 3).collect()}
    assert abs(boosted[3] - 1.05) < 1e-6
    assert len(R.retrieve(ix, ask(spark, "MULTI_HOP", "nếu tax law thì fee", (), ("tax law", "fee law")), 3).collect()) == 3
    plain = R.retrieve(ix, ask(spark, "COMPARE", "tax law one"), 2).orderBy("rank").collect()
    assert (plain[0].cid, plain[0].text, plain[0].child_text) == (0, "whole parent", "tax law one")


def test_neighbours(spark):
    entities = spark.createDataFrame(
        [(1, "A", 0.9, 1), (1, "B", 0.8, 2), (1, "C]x", None, 3)], "qid int, name string, score double, entity_rank int"
    )
    edges = spark.createDataFrame(
        [
            ("A", "T1", "", 9.0, 0), ("A", "T2", "two", 8.0, 1), ("A", "T3", "three", 7.0, 2), ("A", "T4", "four", 6.0, 3),
            ("B", "T1", "hidden by the blank one", 5.0, 4), ("B", "B", "self", 4.0, 5), (" T5 ", "B", "reverse", None, 6),
            ("C]x", "T6", "six", 1.0, 7), ("", "A", "no source", 99.0, 8),
        ],
        "source string, target string, description string, weight double, edge_seq int",
    )
    got = {r.cid: r.score for r in graph.expand_neighbors(entities, edges).collect()}
    assert got == pytest.approx({
        "graphrag-rel-A-T2": 0.72, "graphrag-rel-A-T3": 0.72, "graphrag-rel-B-B": 0.64, "graphrag-rel-C]x-T6": 0.4,
    })


def test_fallback_threshold(spark):
    docs = spark.createDataFrame([(1, 0.05), (1, 0.05), (2, 0.04)], "qid int, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    assert {r.qid: r.used_web for r in R.needs_fallback(docs, asked).collect()} == {1: False, 2: True, 3: True}


def test_terms_of_an_id_in_several_batches(spark):
    rows = [(k % 3 and f"http://s/{k % 7}", ["x", None, "y"] * (k % 4) or None) for k in range(60)]
    rows = [(i or None, words) for i, words in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = {(r.id, r.term): r.n for r in term_index(spark.createDataFrame(rows, "id string, payload array<string>")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, words in rows:
        for w in words or []:
            if i and w:
                want[i, w] = want.get((i, w), 0) + 1
    assert got == want


def test_term_pairs_are_not_grouped_by_shuffle(spark):
    docs = spark.createDataFrame([(f"d{k:04}", ["a", "b"]) for k in range(400)], "id string, payload array<string>")
    asked = spark.createDataFrame([(q, ["a", "b", "b"]) for q in range(30)], "qid long, payload array<string>")
    found = search_terms(asked, term_index(docs), 3)
    assert "MapInArrow" in plan_of(found)
    # all rows tie: the smallest ids win
    assert {tuple(r) for r in found.collect()} == {(q, f"d{r:04}", 3.0, r + 1) for q in range(30) for r in range(3)}


def test_texts_of_few_hits_are_not_shuffled(spark):
    from quillspark.plans.retrieve import DOC_COLUMNS, Index

    points = spark.range(2_000_000).select(F.col("id").alias("cid"), *[F.col("id").cast("string").alias(c) for c in DOC_COLUMNS])
    hits = spark.range(2_000_000).where("id < 3").select(F.col("id").alias("cid"))
    docs = Index(points, None).with_text(hits)
    assert "BroadcastHashJoin" in plan_of(docs) and {r.text for r in docs.collect()} == {"0", "1", "2"}


def test_order_lines_are_shuffled_once(spark, tmp_path):
    from quillspark.catalog.graph import edges

    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    for name, row, ddl in (
        ("lineitem", (1, 2, 3, 1, 4.0, 5.0, "N", "O"), lines),
        ("orders", (1, 7, "1-URGENT"), "o_orderkey long, o_custkey long, o_orderpriority string"),
        ("customer", (7, "C7"), "c_custkey long, c_name string"),
    ):
        spark.createDataFrame([row], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = edges(spark, str(tmp_path))
    plan = plan_of(found)
    assert [tuple(r)[:4] for r in found.collect()] == [("C7", " Part#2", "1-URGENT O", 4.0)]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffled) == 4 and not any("RoundRobin" in line for line in shuffled)
