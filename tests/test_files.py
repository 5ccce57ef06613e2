import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark import service
from quillspark.functions.models import HashingEmbedder
from quillspark.functions.text import NEUTRAL
from quillspark.functions.vectors import pack, unpack
from quillspark.plans import evaluate, golden, index, ingest
from quillspark.sinks import tables
from quillspark.sources import files


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="quill-"))


def test_golden_lines(spark, folder):
    lines = [
        json.dumps({"question": "q1", "reference_context": ["c"], "reference_cids": [1]}), "", "{broken",
        json.dumps({"question": " ", "reference_context": ["c"]}), json.dumps({"question": "q2", "reference_context": []}),
    ]
    (folder / "g.jsonl").write_text("\n".join(lines), encoding="utf-8")
    assert [r.question for r in files.read_golden(spark, str(folder / "g.jsonl")).collect()] == ["q1"]
    with pytest.raises(Exception):
        files.read_golden(spark, str(folder / "g.jsonl"), strict=True).collect()


def test_question_file(spark, folder):
    (folder / "train.csv").write_text(
        'qid,question,context,cid\n1,"câu hỏi dài\nhai dòng","[\'một ngữ cảnh đủ dài\', \'hai\']","[1 2]"\n2,ngắn,x,3\n', encoding="utf-8"
    )
    row = evaluate.golden_rows(files.read_questions(spark, str(folder / "train.csv"))).collect()
    assert len(row) == 1 and row[0].ground_truth_context == "một ngữ cảnh đủ dài\n\nhai" and row[0].ground_truth_cids == [1, 2]


def test_review_file_has_a_mark_and_fixed_columns(spark, folder):
    rows = spark.range(1).select(
        F.lit('hỏi, "gì"').alias("question"), F.lit("a").alias("reference_answer"), F.lit("x" * 600).alias("text"),
        F.lit("i").alias("intent"), F.lit("l").alias("legal_type"),
        F.struct(F.lit(1).alias("answerability"), F.lit(2).alias("correctness"), F.lit(3).alias("clarity"), F.lit("r").alias("reasoning")).alias("critic"),
    )
    tables.write_review(rows, str(folder / "review"))
    part = max((folder / "review").glob("*.csv"), key=lambda f: f.stat().st_size).read_bytes()
    assert part.startswith("﻿question,".encode()) and b"x" * 500 in part and b"x" * 501 not in part


def test_keyed_writes_and_resume(spark, folder):
    path = str(folder / "t")
    first = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k int, v string, o int")
    tables.append_new(first, path, "k", ["o"], shard_rows=1)
    tables.append_new(first.withColumn("v", F.lit("z")), path, "k", ["o"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    newer = tables.replace_keys(spark.createDataFrame([(2, "x", 0), (2, "y", 1)], "k int, v string, o int"), path, "k", ["o"])
    assert {(r.k, r.v) for r in spark.read.parquet(newer).collect()} == {(1, "a"), (2, "y")}
    tables.create_table(first, path)
    assert tables.verify_tables(spark, {"t": path}) == {"t": 2}
    with pytest.raises(RuntimeError, match="missing tables: gone"):
        tables.verify_tables(spark, {"gone": str(folder / "gone")})


def test_metadata_and_resumed_ingestion(spark, folder):
    text = "A line that is long enough to count as meaningful text.\n" * 30
    spark.createDataFrame([("1", text), ("x", text), ("2", text), ("3", "short")], "id string, content string").write.parquet(f"{folder}/c")
    spark.createDataFrame(
        [("1", "old", "01/01/2000"), ("1", "new", "01/01/2001"), ("2", None, "01/01/1980")], "id string, title string, ngay_ban_hanh string"
    ).coalesce(1).write.parquet(f"{folder}/m")
    cfg = ingest.Settings()
    content = ingest.read_content(spark, f"{folder}/c", cfg, html=False)
    meta = ingest.read_metadata(spark, f"{folder}/m")
    run = ingest.ingest(content, meta, cfg, HashingEmbedder(8), profile=NEUTRAL)
    assert {r.doc_id: r.reject_reason for r in run.documents.collect()} == {1: None, 2: "too_old", 3: "corrupted"} or {
        r.doc_id: r.reject_reason for r in run.documents.collect()
    } == {1: None, 2: "too_old", 3: "too_short"}
    assert {r.title for r in run.children.collect()} == {"new"}
    c = run.counters.first()
    assert (c.total_seen, c.passed_filter, c.rejected_too_old) == (3, 1, 1)
    assert c.chunks_generated == run.children.count() and c.parents_generated == run.parents.count()
    done = spark.createDataFrame([(1,)], "doc_id long")
    assert ingest.ingest(content, meta, cfg, profile=NEUTRAL, done=done).children.count() == 0


def test_enrich_keeps_unmatched_points(spark):
    points = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c")], "doc_id int, cid int, title string")
    meta = spark.createDataFrame([(1, "new", "x"), (9, "n", "y")], "doc_id int, title string, kind string")
    assert {(r.cid, r.title, r.kind) for r in index.enrich(points, meta).collect()} == {(10, "new", "x"), (11, "new", "x"), (20, "c", None)}
    assert index.enrich_summary(points, meta).first().asDict() == {
        "metadata_docs": 2, "matched_docs": 1, "matched_points": 2, "skipped_docs": 1,
    }


@pytest.mark.parametrize(
    "intent,scores,tier",
    [
        ("X", (0, 5, 5), "kept"), ("X", (1, 5, 5), "rejected"), ("X", (2, 5, 5), "flagged"), ("X", (3, 3, 3), "kept"),
        ("NEGATIVE", (1, 5, 3), "kept"), ("NEGATIVE", (3, 5, 3), "flagged"), ("NEGATIVE", (1, 5, 1), "rejected"), ("X", None, "flagged"),
    ],
)
def test_critic(spark, intent, scores, tier):
    a, c, cl = [F.lit(x) for x in scores or (None, None, None)]
    got = spark.range(1).select(golden.critic_tier(F.lit(intent), a, c, cl, F.lit(scores is None)).alias("t")).first().t
    assert got == tier


def test_report(spark):
    rows = spark.createDataFrame(
        [(1, "backend", None, True, 1.0, 5.0, 4.0, 3.0, 0.0, 10.0, 20.0, 30), (2, None, "x", False, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 40.0, 10)],
        "qid int, source string, error string, context_hit boolean, cid_recall double, faithfulness double, answer_relevancy double, "
        "completeness double, citation_accuracy double, retrieval_ms double, generation_ms double, completion_tokens int",
    )
    text = evaluate.markdown_report(evaluate.composite(rows))
    assert "1/1 (100.0%)" in text and "missing=1" in text and "5 (Excellent) | 1 (50%)" in text and "1. qid 1: 4.00/5" in text


def test_requests():
    with pytest.raises(ValueError):
        service.Request("  ")
    with pytest.raises(ValueError):
        service.Request("hi there", top_k=21)


def test_respond(spark):
    from test_search import index as small_index

    from quillspark.plans.answer import Engine

    engine = Engine(small_index(spark))
    assert service.respond(spark, engine, service.Request("hi"))["intent"] == "CHITCHAT"
    reply = service.respond(spark, engine, service.Request("tax law one", top_k=2, include_content=True))
    assert len(reply["sources"]) == 2 and reply["sources"][0]["content"] == "whole parent" and not reply["used_web"]


def test_collection_and_metrics(spark, folder):
    vectors = HashingEmbedder(8).encode([f"word{i} text" for i in range(20)])
    points = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(vectors)], "cid long, text string, embedding array<float>")
    path = str(folder / "c")
    assert tables.create_collection(points, path, 8)
    assert not tables.create_collection(points.limit(0), path, 8)
    kept = spark.read.parquet(f"{path}/points")
    assert kept.count() == 20 and all(-127 <= c <= 127 for r in kept.collect() for c in r.code)
    about = spark.read.json(f"{path}/about").first()
    assert about.dim == 8 and 0 < about.bound <= 1.001
    with pytest.raises(Exception, match="expected 9"):
        tables.create_collection(points, str(folder / "d"), 9)
    m = spark.range(1).select(F.lit(1.0).alias("hit_rate"))
    assert not tables.log_metrics(m, {"k": 5}, str(folder / "runs"), None)
    assert tables.log_metrics(m, {"k": 5}, str(folder / "runs"), "r1")
    assert spark.read.json(str(folder / "runs")).first().params == '{"k": 5}'


def test_children_to_points(spark):
    rows = spark.createDataFrame(
        [(1, 2, "t", 3, "ti", "k", "u", bytearray(b"\x00\x00\x80?\x00\x00\x00@"))],
        "cid long, parent_id long, text string, doc_id long, title string, legal_type string, url string, dense_vector binary",
    )
    assert index.points_of(rows, 2).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 12"):
        index.points_of(rows, 3).collect()
