import pytest
from pyspark.sql import functions as F

from quillspark.functions.models import ElsewhereWriter, OverlapCritic
from quillspark.plans import golden, memory
from quillspark.plans.prompt import ERROR_REPLY, Instructions, messages, system_prompt

TOLD = Instructions("base", {"COMPARE": " {col_b}/{col_a}/{col_b}", "PROCEDURE": " steps"})


@pytest.mark.parametrize(
    "intent,things,want",
    [
        ("COMPARE", ["x", "y", "z"], "base y/x/y"), ("compare", ["{col_b}"], "base Quy định B/{col_b}/Quy định B"),
        ("COMPARE", None, "base Quy định B/Quy định A/Quy định B"), ("procedure", [], "base steps"), ("OTHER", [], "base"),
        (None, None, "base"), ("", ["x"], "base"), ("LEGAL_QUERY", None, "base"),
    ],
)
def test_system_prompt(spark, intent, things, want):
    row = spark.createDataFrame([(intent, things)], "i string, t array<string>")
    assert row.select(system_prompt(F.col("i"), F.col("t"), TOLD).alias("p")).first().p == want


def test_messages_order_and_missing_parts(spark):
    asked = spark.createDataFrame([(1, "q1", "PROCEDURE", []), (2, None, None, None)], "qid long, question string, intent string, sub_entities array<string>")
    contexts = spark.createDataFrame([(1, "ctx"), (9, "not asked")], "qid long, context string")
    history = spark.createDataFrame(
        [(1, 2, "assistant", "a"), (1, 10, "user", "late"), (1, 1, "user", "u"), (1, 11, "system", "s2"), (1, 0, "system", "s1")],
        "qid long, msg_no int, role string, content string",
    )
    made = {r.qid: [tuple(m) for m in r.messages] for r in messages(asked, contexts, history, TOLD).collect()}
    assert made[1] == [
        ("system", "base steps"), ("system", "s1"), ("system", "s2"), ("user", "u"), ("assistant", "a"), ("user", "late"),
        ("user", "Tài liệu pháp lý:\n\nctx\n\nCâu hỏi: q1"),
    ]
    assert made[2] == [("system", "base"), ("user", "Tài liệu pháp lý:\n\n\n\nCâu hỏi: ")] and len(made) == 2
    assert messages(asked.limit(0), contexts).count() == 0


def test_summary_comes_before_the_window(spark):
    turns = spark.createDataFrame([(1, i, f"u{i}", f"a{i}") for i in range(4)], "conv_id int, turn int, user_text string, assistant_text string")
    summaries = spark.createDataFrame([(1, "so far"), (2, "alone"), (3, None), (4, "")], "conv_id int, summary string")
    rows = sorted((r.conv_id, r.msg_no, r.role, r.content) for r in memory.context_messages(turns, summaries, 1).collect())
    assert rows == [
        (1, 0, "system", "[Tóm tắt hội thoại trước]\nso far"), (1, 1, "user", "u3"), (1, 2, "assistant", "a3"),
        (2, 0, "system", "[Tóm tắt hội thoại trước]\nalone"),
    ]


def test_a_failed_model_gives_the_error_text(spark):
    from quillspark.functions.routing import CHITCHAT_REPLY
    from quillspark.plans.answer import Engine, answers

    class Silent:
        def answer(self, question, context):
            return F.lit(None).cast("string")

    decided = spark.createDataFrame([(1, "q", "LEGAL_LOOKUP", 1.0, False), (2, "hi", "CHITCHAT", 1.0, False)], "qid long, question string, intent string, confidence double, used_web boolean")
    docs = spark.createDataFrame([], "qid long, rank int, cid long, text string")
    assert {r.qid: r.answer for r in answers(Engine(None, generator=Silent()), decided, docs).collect()} == {1: ERROR_REPLY, 2: CHITCHAT_REPLY}


def test_critic_and_negatives(spark):
    text = "the law of taxes names a rate"
    samples = spark.createDataFrame(
        [("taxes rate law", "names", text, "X"), ("other words here", "names", text, "X"), ("", "", text, "X"), (None, None, None, None)],
        "question string, reference_answer string, text string, intent string",
    )
    assert [r.tier for r in golden.triaged(samples, OverlapCritic()).collect()] == ["kept", "rejected", "flagged", "flagged"]
    chunks = spark.createDataFrame([(i, i, "law", "word text" if i else " ") for i in range(6)] + [(9, 9, None, None)], "cid long, doc_id long, legal_type string, text string")
    made = golden.negatives(chunks, ElsewhereWriter(), 100).collect()
    assert {r.cid for r in made} == {1, 2, 3, 4, 5} and {(r.question, r.is_negative, r.intent) for r in made} == {("word (law, 2999)?", True, "NEGATIVE")}
    few = golden.negatives(chunks, ElsewhereWriter(), 2).collect()
    assert len(few) <= 2 and [r.cid for r in few] == [r.cid for r in golden.negatives(chunks.repartition(3), ElsewhereWriter(), 2).collect()]


def test_graph_route_without_documents_falls_back_to_text(spark):
    from test_search import index as small_index

    from quillspark.plans.answer import Engine, Graph, route_documents

    base = small_index(spark)
    vector = "array<float>"
    entities = spark.createDataFrame([], f"id long, name string, description string, vector {vector}")
    reports = spark.createDataFrame([], f"community long, title string, full_content string, vector {vector}")
    edges = spark.createDataFrame([], "source string, target string, description string, weight double, edge_seq long")
    asked = spark.createDataFrame(
        [(i, "tax law one", "LEGAL_LOOKUP", [], [], route) for i, route in enumerate(("rag", "graphrag", "both", "none"))],
        "qid long, question string, intent string, expanded_queries array<string>, sub_entities array<string>, route string",
    )
    docs = route_documents(Engine(base, Graph(entities, reports, edges)), asked, 2).collect()
    found = {q: sorted((r.rank, r.cid) for r in docs if r.qid == q) for q in range(4)}
    assert found[0] and found[0] == found[1] == found[2] and found[3] == []
