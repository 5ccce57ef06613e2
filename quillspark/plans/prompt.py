"""Chat messages for a model: instructions, history, documents and the question."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import or_empty

# Labels of a request, default columns of a comparison, the answer when a model fails.
DOCUMENTS_LABEL = "Tài liệu pháp lý:\n\n"
QUESTION_LABEL = "\n\nCâu hỏi: "
COMPARE_COLUMNS = ("Quy định A", "Quy định B")
ERROR_REPLY = "[Lỗi: không thể tạo phản hồi. Vui lòng thử lại.]"

MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Instructions:
    """What a deployment tells its model; ``{col_a}`` and ``{col_b}`` stand for compared things."""

    base: str = "Chỉ trả lời theo các tài liệu được cung cấp và nêu ID của tài liệu."
    by_intent: Mapping[str, str] = field(
        default_factory=lambda: {
            "COMPARE": "\nTrình bày bảng: | Tiêu chí | {col_a} | {col_b} |",
            "PROCEDURE": "\nTrình bày các bước có đánh số.",
            "DEFINITION": "\nNêu định nghĩa trước, căn cứ sau.",
            "SUMMARIZE": "\nTóm tắt bằng các gạch đầu dòng.",
            "MULTI_HOP": "\nTrả lời từng phần rồi kết luận.",
        }
    )
    aliases: Mapping[str, str] = field(default_factory=lambda: {"LEGAL_QUERY": "LEGAL_LOOKUP"})


def system_prompt(intent: Column, sub_entities: Column, told: Instructions = Instructions()) -> Column:
    """Base instruction and the format of the intent, whatever its case.

    A null or unknown intent adds no format but that of a lookup, if there is one; a comparison
    names its first two things, or the default columns where they are missing.
    """
    name = F.upper(F.coalesce(F.nullif(intent, F.lit("")), F.lit("LEGAL_LOOKUP")))
    for old, new in told.aliases.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    thing = [F.coalesce(F.get(sub_entities, F.lit(i)), F.lit(default)) for i, default in enumerate(COMPARE_COLUMNS)]
    formats = F.lit("")
    for key, text in told.by_intent.items():
        formats = F.when(name == key, _filled(text, *thing) if key == "COMPARE" else F.lit(text)).otherwise(formats)
    return F.concat(F.lit(told.base), formats)


def _filled(text: str, col_a: Column, col_b: Column) -> Column:
    """The template with both columns put in; a thing that looks like a placeholder is left as it is."""
    pieces = []
    for i, outer in enumerate(text.split("{col_a}")):
        pieces += [col_a] * (i > 0)
        for j, inner in enumerate(outer.split("{col_b}")):
            pieces += [col_b] * (j > 0) + [F.lit(inner)]
    return F.concat(*pieces)


def messages(asked: DataFrame, contexts: DataFrame, history: DataFrame | None = None, told: Instructions = Instructions()) -> DataFrame:
    """(qid, messages): system prompt, summaries, earlier turns, then documents and question.

    ``asked``: qid, question, intent, sub_entities.  ``contexts``: qid, context.  ``history``: qid,
    msg_no, role, content, bounded by the memory window; its system messages come first.  A null
    question or context counts as empty, a question without history has two messages.
    """
    joined = asked.join(contexts, "qid", "left")
    past = F.array().cast(MESSAGES)
    if history is not None:
        item = F.struct((F.col("role") != "system").alias("late"), "msg_no", "role", "content")
        turns = history.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_past"))
        joined = joined.join(turns, "qid", "left")
        plain = F.transform("_past", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        past = F.coalesce(plain.cast(MESSAGES), past)

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))).cast(MESSAGES)

    system = message("system", system_prompt(F.col("intent"), F.col("sub_entities"), told))
    user = message("user", F.concat(F.lit(DOCUMENTS_LABEL), or_empty(F.col("context")), F.lit(QUESTION_LABEL), or_empty(F.col("question"))))
    return joined.select("qid", F.concat(system, past, user).alias("messages"))
