"""Question classification and decomposition as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions.text import fold, strip

# Rule patterns by intent, tested in this order.
RULES: dict[str, tuple[str, ...]] = {
    "MULTI_HOP": (
        r"\bn[eế]u\b.{5,120}\bth[iì]\b",
        r"\bneu\b.{5,120}\bthi\b",
        r"\btrong\s+tr[uườ]ng\s+h[oợ]p\b",
        r"\btrong\s+truong\s+hop\b",
        r"\b(h[aậ]u\s+qu[aả]|h[eệ]\s+qu[aả]|d[aẫ]n\s+[dđ][eế]n|[aả]nh\s+h[uưở][oở]ng)\b"
        r".{0,80}\b(ph[aạ]t|x[uử]\s+l[yý]|tr[aá]ch\s+nhi[eệ]m)\b",
    ),
    "COMPARE": (
        r"\b(so\s+s[aá]nh|kh[aá]c\s+nhau|gi[oô]ng\s+nhau|kh[aá]c\s+bi[eê]t)\b",
        r"\bgi[uư]a\b.{1,80}\b(lu[aâ]t|ngh[ij]\s+[dđ][iị]nh|[dđ]i[eề]u|kho[aả]n)\b",
        r"\b(xe\s+m[aá]y|[oô]\s*t[oô]|xe\s+t[aả]i).{1,40}\b(v[aà]|hay)\b"
        r".{1,40}\b(xe\s+m[aá]y|[oô]\s*t[oô]|xe\s+t[aả]i)\b",
    ),
    "SUMMARIZE": (
        r"\b(t[oó]m\s+t[aắ]t|t[oổ]ng\s+k[eế]t|n[oộ]i\s+dung\s+ch[ií]nh|t[oổ]ng\s+quan)\b",
    ),
    "PROCEDURE": (
        r"\b(th[uủ]\s+t[uụ]c|quy\s+tr[iì]nh|c[aá]ch\s+l[aà]m|c[aá]c\s+b[uướ]c)\b"
        r".{0,60}\b([dđ][aă]ng\s+k[yý]|xin|n[oộ]p|c[aấ]p|l[aà]m)\b",
        r"\b(th[uủ]\s+t[uụ]c)\b",
        r"\b(b[uướ]c\s+\d|b[uướ]c\s+th[uứ])\b",
    ),
    "DEFINITION": (
        r"\b(l[aà]\s+g[iì]|[dđ][iị]nh\s+ngh[iĩ]a|kh[aá]i\s+ni[eệ]m|hi[eể]u\s+th[eế]\s+n[aà]o)\b",
    ),
}
# Connectors of compared things, conditional form, decree name.
COMPARE_SPLIT = r"\s+(?:v[aà]|v[oớ]i|vs\.?|so\s+v[oớ]i|hay)\s+"
CONDITIONAL = r"(n[eế]u\s+.+?)\s+th[iì]\s+((?s:.+))"
DECREE = r"(ngh[iị]\s+[dđ][iị]nh\s+\d+/\d{4}(?:/[A-Z\-]+)?)"
# Expansion templates; {} is the question.
EXPANSIONS: dict[str, tuple[str, str]] = {
    "DEFINITION": ("định nghĩa pháp lý {}", "{} theo bộ luật"),
    "PROCEDURE": ("hồ sơ {}", "cơ quan thực hiện {}"),
    "SUMMARIZE": ("nội dung {}", "điều khoản chính {}"),
}
# Intent to retrieval route.
ROUTES: dict[str, str] = {
    "LEGAL_LOOKUP": "rag",
    "DEFINITION": "rag",
    "PROCEDURE": "rag",
    "COMPARE": "rag",
    "MULTI_HOP": "rag",
    "SUMMARIZE": "both",
    "CHITCHAT": "none",
}
# Words whose presence marks an ordered procedure.
PROCEDURE_WORDS = ("bước", "thứ tự", "trình tự", "hồ sơ", "cơ quan")
# Fixed value: the answer to small talk.
CHITCHAT_REPLY = (
    "Xin chào! Tôi là trợ lý tư vấn pháp luật Việt Nam. "
    "Tôi có thể giúp bạn tra cứu quy định pháp luật, giải thích điều khoản, "
    "hoặc hướng dẫn thủ tục pháp lý. Bạn cần hỗ trợ gì?"
)

# Case-insensitive and Unicode-aware; "." stops at line feeds only, except in the second part of a condition, which reaches to the end.
_FLAGS = "(?iuUd)"


def rule_intent(question: Column, rules: Mapping[str, Sequence[str]] = RULES) -> Column:
    """First intent one of whose patterns occurs in the question, as written or folded."""
    written, plain = F.lower(question), fold(question)
    chosen = None
    for intent, patterns in rules.items():
        regex = "(?Ud)" + "|".join(f"(?:{p})" for p in patterns)  # both texts are lower case
        hit = written.rlike(regex) | plain.rlike(regex)
        chosen = F.when(hit, F.lit(intent)) if chosen is None else chosen.when(hit, F.lit(intent))
    return chosen


def compare_entities(question: Column) -> Column:
    parts = F.transform(F.split(question, _FLAGS + COMPARE_SPLIT, 2), strip)
    both = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(both, parts).otherwise(F.array(question, question))


def sub_questions(question: Column) -> Column:
    regex = _FLAGS + CONDITIONAL
    condition = strip(F.regexp_extract(question, regex, 1))
    consequence = strip(F.regexp_extract(question, regex, 2))
    return F.when(question.rlike(regex), F.array(condition, consequence)).otherwise(F.array(question))


def _template(pattern: str, question: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), question, F.lit(after))


def expansions(question: Column, intent: Column) -> Column:
    none = F.array().cast("array<string>")
    chosen = F.when(intent.isNull(), none)
    for name, pair in EXPANSIONS.items():
        chosen = chosen.when(intent == name, F.array(*[_template(p, question) for p in pair]))
    return chosen.otherwise(none)


def law_name(question: Column) -> Column:
    """Decree named in the question, null when there is none."""
    return F.nullif(strip(F.regexp_extract(question, _FLAGS + DECREE, 1)), F.lit(""))


def route(intent: Column, routes: Mapping[str, str] = ROUTES) -> Column:
    chosen = F.when(F.lit(False), F.lit("rag"))
    for name, target in routes.items():
        chosen = chosen.when(intent == name, F.lit(target))
    return chosen.otherwise(F.lit("rag"))


def reflect(questions: DataFrame, reply: str | None = None, rules: Mapping[str, Sequence[str]] = RULES) -> DataFrame:
    """Routing decision of every question: length guard, rules, then the model's parsed reply.

    Adds intent, refined_query, confidence, source, expanded_queries and sub_entities.
    ``reply`` names a column made by ``parse_reply`` (null: the model failed).
    """
    q, rule = F.col("_q"), F.col("_rule")
    none = F.array().cast("array<string>")
    short = F.length(q) < 3
    derived = (
        F.when(rule == "COMPARE", compare_entities(q)).when(rule == "MULTI_HOP", sub_questions(q)).otherwise(none)
    )
    answered = F.col(reply) if reply else None

    def pick(field, if_short, if_rule, if_failed):
        last = if_failed if answered is None else F.coalesce(answered[field], if_failed)
        return F.when(short, if_short).when(rule.isNotNull(), if_rule).otherwise(last)

    from_reply = none
    if answered is not None:
        subs = answered["sub_entities"]
        from_reply = (
            F.when(F.size(subs) > 0, subs)
            .when(answered["intent"] == "COMPARE", compare_entities(q))
            .when(answered["intent"] == "MULTI_HOP", sub_questions(q))
            .otherwise(none)
        )
    matched = questions.withColumn("_q", strip(F.col("question"))).withColumn("_rule", rule_intent(q, rules))
    return matched.withColumns(
        {
            "intent": pick("intent", F.lit("CHITCHAT"), rule, F.lit("LEGAL_LOOKUP")),
            "refined_query": pick("refined_query", q, q, q),
            "confidence": pick("confidence", F.lit(1.0), F.lit(S.RULE_CONFIDENCE), F.lit(S.MODEL_ERROR_CONFIDENCE)),
            "source": pick("source", F.lit("rule"), F.lit("rule"), F.lit("fallback")),
            "expanded_queries": pick("expanded_queries", none, expansions(q, rule), none),
            "sub_entities": F.when(short, none).when(rule.isNotNull(), derived).otherwise(from_reply),
        }
    ).drop("_q", "_rule")
