import pytest
from pyspark.sql import functions as F

from quillspark.functions import parsing, routing


@pytest.mark.parametrize(
    "question,intent",
    [
        ("Nếu vượt đèn đỏ thì bị phạt bao nhiêu", "MULTI_HOP"),
        ("neu vuot den do thi bi phat", "MULTI_HOP"),
        ("Trong trường hợp nào được miễn thuế", "MULTI_HOP"),
        ("So sánh định nghĩa hộ kinh doanh", "COMPARE"),
        ("xe máy và ô tô bị phạt thế nào", "COMPARE"),
        ("xe máy bị phạt thế nào", None),
        ("mức phạt xe máy chở ba và mức phạt ô tô", "COMPARE"),
        ("Tóm tắt luật đất đai", "SUMMARIZE"),
        ("thu tuc ly hon", "PROCEDURE"),
        ("các bước đăng ký kết hôn", None),
        ("bước 1 làm gì", None),
        ("Hợp đồng là gì", "DEFINITION"),
        ("mức lương tối thiểu", None),
    ],
)
def test_rules(one, question, intent):
    assert one(routing.rule_intent, q=question) == intent


@pytest.mark.parametrize(
    "question,parts",
    [
        ("so sánh thuế và phí", ["so sánh thuế", "phí"]),
        ("A vs. B với C", ["A", "B với C"]),
        ("thuế hay phí", ["thuế", "phí"]),
        ("một mình", ["một mình", "một mình"]),
    ],
)
def test_compare_entities(one, question, parts):
    assert one(routing.compare_entities, q=question) == parts


def test_sub_questions(one):
    assert one(routing.sub_questions, q="nếu say rượu thì phạt gì") == ["nếu say rượu", "phạt gì"]
    assert one(routing.sub_questions, q="nếu say rượu thì phạt gì\nvà ở đâu") == ["nếu say rượu", "phạt gì\nvà ở đâu"]
    assert one(routing.sub_questions, q="không có điều kiện") == ["không có điều kiện"]


@pytest.mark.parametrize(
    "question,name",
    [
        ("tóm tắt Nghị định 100/2019 giúp tôi", "Nghị định 100/2019"),
        ("nghị định 15/2020/CP quy định gì", "nghị định 15/2020/CP"),
        ("nghị định 100/2019/NĐ-CP", "nghị định 100/2019/N"),
        ("Luật Giao thông đường bộ 2008", None),
    ],
)
def test_law_name(one, question, name):
    assert one(routing.law_name, q=question) == name


@pytest.mark.parametrize(
    "raw,intent,confidence,expanded,subs",
    [
        ('```json\n{"intent": "compare", "confidence": 0.9, "sub_entities": ["a","b","c","d","e"]}\n```', "COMPARE", 0.9, 0, 4),
        ('{"intent": "LEGAL_QUERY", "expanded_queries": ["1","2","3","4","5"]}', "LEGAL_LOOKUP", 0.7, 3, 0),
        ('{"intent": "OTHER", "expanded_queries": "x", "sub_entities": {"a": 1}}', "LEGAL_LOOKUP", 0.7, 0, 0),
        ("sorry, no", "LEGAL_LOOKUP", 0.4, 0, 0),
    ],
)
def test_parse_reply(one, raw, intent, confidence, expanded, subs):
    r = one(lambda x: parsing.parse_reply(x, F.lit("q")), x=raw)
    assert (r.intent, r.confidence, len(r.expanded_queries), len(r.sub_entities)) == (intent, confidence, expanded, subs)


def test_reflect(spark):
    rows = spark.createDataFrame(
        [(1, " a "), (2, "so sánh thuế và phí"), (3, "mức lương"), (4, "mức phạt")], "qid long, question string"
    )
    reply = F.when(F.col("qid") == 4, F.lit('{"intent": "COMPARE", "confidence": 0.9}'))
    asked = rows.withColumn("raw", reply).withColumn(
        "reply", F.when(F.col("raw").isNotNull(), parsing.parse_reply(F.col("raw"), F.col("question")))
    )
    got = {r.qid: r for r in routing.reflect(asked, "reply").collect()}
    assert (got[1].intent, got[1].confidence) == ("CHITCHAT", 1.0)
    assert (got[2].intent, got[2].source, got[2].sub_entities) == ("COMPARE", "rule", ["so sánh thuế", "phí"])
    assert (got[3].intent, got[3].confidence, got[3].source) == ("LEGAL_LOOKUP", 0.5, "fallback")
    assert (got[4].intent, got[4].confidence, got[4].sub_entities) == ("COMPARE", 0.9, ["mức phạt", "mức phạt"])


@pytest.mark.parametrize("raw,expected", [("[1, 2]", [1, 2]), ("[1 2]", [1, 2]), ("7", [7]), ("", []), (None, [])])
def test_parse_ids(one, raw, expected):
    assert one(parsing.parse_ids, x=raw) == expected


@pytest.mark.parametrize("raw,score", [("3.5", 3.5), ("9", 5.0), ("0.2", 1.0), ("-1", 0.0), ("NaN", 0.0), ("x", 0.0), (None, 0.0)])
def test_sanitize(one, raw, score):
    assert one(parsing.sanitize_score, x=raw) == score
