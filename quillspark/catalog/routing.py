"""Question classification, decomposition and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions import ids, parsing, routing
from quillspark.functions.text import strip

# Question openings put in front of the logged user texts, which hold no Vietnamese.
OPENINGS = (
    "", "so sánh xe máy và ô tô ", "tóm tắt nghị định 100/2019 ", "thủ tục đăng ký ", "khái niệm ",
    "nếu vượt đèn đỏ thì phạt ", "Trong trường hợp ", "SO SÁNH thuế với phí ", "Nghị định 15/2020/CP ",
)


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every user message of the log as a question; qid is unique per message."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return turns.select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("qid"), F.concat(opening, F.col("text")).alias("question")
    )


_LIST = "[" + ", ".join(Q.lit(o) for o in OPENINGS) + "]"
QUESTIONS = f"""questions AS (SELECT conv_id * 100000 + turn AS qid,
    {_LIST}[(conv_id + turn) % {len(OPENINGS)} + 1] || text AS question FROM conversations WHERE role = 'user')"""

# RE2 reads \\b as an ASCII boundary, so the counterparts match the folded text only.
_FOLDED = {
    "MULTI_HOP": r"\bneu\b.{5,120}\bthi\b|\btrong\s+truong\s+hop\b",
    "COMPARE": r"\b(so\s+sanh|khac\s+nhau|giong\s+nhau|khac\s+biet)\b",
    "SUMMARIZE": r"\b(tom\s+tat|tong\s+ket|noi\s+dung\s+chinh|tong\s+quan)\b",
    "PROCEDURE": r"\b(thu\s+tuc)\b",
    "DEFINITION": r"\b(la\s+gi|dinh\s+nghia|khai\s+niem|hieu\s+the\s+nao)\b",
}
INTENT = "CASE " + " ".join(f"WHEN regexp_matches({Q.fold('question')}, '{p}') THEN '{i}'" for i, p in _FOLDED.items()) + " END"


@query(f"WITH {QUESTIONS} SELECT qid, {INTENT} AS intent FROM questions")
def rule_intents(spark, sf):
    return user_questions(spark, sf).select("qid", routing.rule_intent(F.col("question")).alias("intent"))


@query(
    f"""WITH {QUESTIONS} SELECT coalesce({INTENT}, 'LEGAL_LOOKUP') AS intent,
      CASE coalesce({INTENT}, 'LEGAL_LOOKUP') WHEN 'SUMMARIZE' THEN 'both' ELSE 'rag' END AS route, count(*) AS n
    FROM questions GROUP BY 1, 2"""
)
def route_counts(spark, sf):
    intent = F.coalesce(routing.rule_intent(F.col("question")), F.lit("LEGAL_LOOKUP"))
    rows = user_questions(spark, sf).select(intent.alias("intent"))
    return rows.groupBy("intent", routing.route(F.col("intent")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


_Q = Q.strip("question")


@query(
    f"""WITH {QUESTIONS}, r AS (SELECT qid, {_Q} AS q, {INTENT} AS i FROM questions)
    SELECT qid, coalesce(i, 'LEGAL_LOOKUP') AS intent, CASE WHEN i IS NULL THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence,
      CASE WHEN i IS NULL THEN 'fallback' ELSE 'rule' END AS source,
      md5(CASE i WHEN 'DEFINITION' THEN 'định nghĩa pháp lý ' || q || '/' || q || ' theo bộ luật'
        WHEN 'PROCEDURE' THEN 'hồ sơ ' || q || '/' || 'cơ quan thực hiện ' || q
        WHEN 'SUMMARIZE' THEN 'nội dung ' || q || '/' || 'điều khoản chính ' || q ELSE '' END) AS expanded_md5,
      CASE WHEN starts_with(q, 'so sánh xe máy và') THEN 'so sánh xe máy' WHEN starts_with(q, 'SO SÁNH thuế với') THEN 'SO SÁNH thuế'
        WHEN starts_with(q, 'nếu vượt đèn đỏ thì') THEN 'nếu vượt đèn đỏ' WHEN i = 'MULTI_HOP' THEN q ELSE '' END AS first_part
    FROM r"""
)
def reflect_questions(spark, sf):
    return routing.reflect(user_questions(spark, sf)).select(
        "qid", "intent", "confidence", "source",
        F.md5(F.array_join("expanded_queries", "/")).alias("expanded_md5"),
        F.coalesce(F.get("sub_entities", F.lit(0)), F.lit("")).alias("first_part"),
    )


@query(
    f"""WITH {QUESTIONS}, r AS (SELECT qid, question, {_Q} AS q, {INTENT} AS i, CASE WHEN length({_Q}) < 3 THEN 'short' WHEN {INTENT} IS NOT NULL THEN 'rule'
        ELSE ['none', 'json', 'damaged'][qid % 3 + 1] END AS how FROM questions)
    SELECT qid, CASE how WHEN 'short' THEN 'CHITCHAT' WHEN 'rule' THEN i WHEN 'json' THEN 'PROCEDURE' ELSE 'LEGAL_LOOKUP' END AS intent,
      CASE how WHEN 'short' THEN 1.0 WHEN 'rule' THEN 0.8 WHEN 'json' THEN 0.9 WHEN 'damaged' THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence,
      CASE how WHEN 'json' THEN 'llm' WHEN 'short' THEN 'rule' WHEN 'rule' THEN 'rule' ELSE 'fallback' END AS source,
      md5(CASE how WHEN 'json' THEN 'refined ' || qid WHEN 'damaged' THEN question ELSE q END) AS refined_md5,
      CASE how WHEN 'json' THEN 2 WHEN 'rule' THEN CASE i WHEN 'COMPARE' THEN 2 WHEN 'MULTI_HOP' THEN CASE WHEN starts_with(q, 'nếu vượt') THEN 2 ELSE 1 END ELSE 0 END ELSE 0 END::BIGINT AS n_sub
    FROM r"""
)
def reflect_with_replies(spark, sf):
    """Decisions where a model answers what the rules leave open: a reply, a damaged one, or none."""
    asked = user_questions(spark, sf)
    name = F.col("qid").cast("string")
    body = F.concat(F.lit('{"intent": "procedure", "confidence": 0.9, "sub_entities": ["a", "b"], "refined_query": "refined '), name, F.lit('"}'))
    raw = F.when(F.col("qid") % 3 == 1, body).when(F.col("qid") % 3 == 2, F.lit('{"intent": '))
    replied = asked.withColumn("raw", raw).withColumn("reply", F.when(F.col("raw").isNotNull(), parsing.parse_reply(F.col("raw"), F.col("question"))))
    return routing.reflect(replied, "reply").select(
        "qid", "intent", "confidence", "source", F.md5("refined_query").alias("refined_md5"), F.size("sub_entities").cast("long").alias("n_sub")
    )


@query(
    f"""WITH {QUESTIONS} SELECT qid, CASE WHEN starts_with(question, 'Nghị định') THEN 'Nghị định 15/2020/CP'
      ELSE 'nghị định 100/2019' END AS law_name FROM questions
    WHERE starts_with(question, 'Nghị định') OR starts_with(question, 'tóm tắt nghị định')"""
)
def law_names(spark, sf):
    named = user_questions(spark, sf).select("qid", routing.law_name(F.col("question")).alias("law_name"))
    return named.where(F.col("law_name").isNotNull())


@query(
    f"""WITH {QUESTIONS} SELECT qid, (length({_Q}) BETWEEN 1 AND 4096) AS accepted, ({_Q} = '') AS blank FROM questions"""
)
def request_validation(spark, sf):
    message = strip(F.col("question"))
    return user_questions(spark, sf).select(
        "qid", F.length(message).between(1, 4096).alias("accepted"), (message == "").alias("blank")
    )


@query(
    """SELECT conv_id * 100000 + turn AS qid, CASE WHEN turn = 0 THEN 'default' ELSE md5('user' || text || 'assistant' || role) END AS conversation_key,
      'system/user/assistant' AS role_order FROM conversations"""
)
def request_keys(spark, sf):
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    asked = message("user", F.lit("now"))
    full = F.array(message("user", F.col("text")), message("assistant", F.col("role")), asked)
    request = F.when(F.col("turn") == 0, F.array(asked)).otherwise(full)
    mixed = F.array(message("user", F.col("text")), message("system", F.col("text")), message("assistant", F.col("text")))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("qid"),
        ids.conversation_id(request).alias("conversation_key"),
        F.array_join(F.transform(parsing.split_by_role(mixed), lambda m: m["role"]), "/").alias("role_order"),
    )
