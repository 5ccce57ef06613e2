"""Conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.plans import memory
from quillspark.plans.prompt import Instructions, messages
from quillspark.session import scratch_path
from quillspark.streaming.runner import drain, state_session, table_stream
from quillspark.streaming.state import conversation_memory

_TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, md5(user_text || assistant_text) AS pair_md5 FROM turns")
def recorded_exchanges(spark, sf):
    turns = memory.exchanges(table(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", F.md5(F.concat("user_text", "assistant_text")).alias("pair_md5"))


@query(
    f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns QUALIFY back <= 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r)
    SELECT conv_id, 2 * place - 1 AS msg_no, 'user' AS role, md5(user_text) AS content_md5 FROM p
    UNION ALL SELECT conv_id, 2 * place, 'assistant', md5(assistant_text) FROM p"""
)
def memory_window(spark, sf):
    """The last two exchanges (the fixtures' conversations are short) as messages."""
    out = memory.window_messages(memory.exchanges(table(spark, sf, "conversations")), 2)
    return out.select("conv_id", F.col("msg_no").cast("long").alias("msg_no"), "role", F.md5("content").alias("content_md5"))


_HISTORY = f"""{_TURNS}, counted AS (SELECT conv_id, CASE WHEN count(*) >= 3 THEN count(*) - 2 ELSE 0 END AS compactions FROM turns GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns QUALIFY back <= 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r),
    history AS (SELECT conv_id, 2 * place - 1 AS msg_no, 'user' AS role, user_text AS content FROM p
      UNION ALL SELECT conv_id, 2 * place, 'assistant', assistant_text FROM p
      UNION ALL SELECT conv_id, 0, 'system', '[Tóm tắt hội thoại trước]' || chr(10) || 'exchanges left out: ' || compactions FROM counted WHERE compactions > 0)"""


def _history(spark, sf):
    """The last two exchanges after a summary that names how many were compacted."""
    turns = memory.exchanges(table(spark, sf, "conversations"))
    told = F.concat(F.lit("exchanges left out: "), F.col("compactions").cast("string"))
    state = memory.compaction_state(turns, 3, 1)
    summaries = state.select("conv_id", F.when(F.col("compactions") > 0, told).alias("summary"))
    return memory.context_messages(turns, summaries, 2)


@query(f"WITH {_HISTORY} SELECT conv_id, msg_no, role, md5(content) AS content_md5 FROM history")
def memory_context(spark, sf):
    """The window with the summary ahead of it."""
    return _history(spark, sf).select("conv_id", F.col("msg_no").cast("long").alias("msg_no"), "role", F.md5("content").alias("content_md5"))


_KINDS = ("COMPARE", "compare", "PROCEDURE", "DEFINITION", "SUMMARIZE", "MULTI_HOP", "LEGAL_QUERY", "LEGAL_LOOKUP")
_FORMATS = " ".join(f"WHEN '{kind}' THEN {Q.lit(text)}" for kind, text in Instructions().by_intent.items())


@query(
    f"""WITH {_HISTORY}, past AS (SELECT conv_id, count(*) AS n, string_agg(role || ':' || content, chr(10) ORDER BY msg_no) || chr(10) AS t FROM history GROUP BY 1),
    asked AS (SELECT conv_id, arg_max(text, turn) AS question, {list(_KINDS)}[conv_id % {len(_KINDS)} + 1] AS intent FROM conversations WHERE role = 'user' GROUP BY 1),
    told AS (SELECT *, {Q.lit(Instructions().base)} || replace(replace(CASE upper(intent) {_FORMATS} ELSE '' END,
        '{{col_a}}', CASE WHEN conv_id % 3 = 0 THEN 'Quy định A' ELSE 'xe máy' END), '{{col_b}}', CASE WHEN conv_id % 3 = 2 THEN 'ô tô' ELSE 'Quy định B' END) AS system FROM asked)
    SELECT conv_id AS qid, 2 + coalesce(n, 0) AS n_messages, md5('system:' || system || chr(10) || coalesce(t, '') || 'user:' || 'Tài liệu pháp lý:' || chr(10) || chr(10)
        || coalesce(d.text, '') || chr(10) || chr(10) || 'Câu hỏi: ' || coalesce(question, '')) AS messages_md5
    FROM told LEFT JOIN past USING (conv_id) LEFT JOIN documents d ON d.doc_id = conv_id"""
)
def prompt_messages(spark, sf):
    """The messages a model is given for the last question of every conversation; 0 to 2 compared things."""
    asked = table(spark, sf, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.max_by("text", "turn").alias("question"))
    things = F.slice(F.array(F.lit("xe máy"), F.lit("ô tô")), F.lit(1), (F.col("qid") % 3).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("qid") % len(_KINDS) + 1).cast("int"))
    contexts = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("context"))
    history = _history(spark, sf).withColumnRenamed("conv_id", "qid")
    made = messages(asked.withColumns({"intent": kind, "sub_entities": things}), contexts, history)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return made.select("qid", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("messages_md5"))


@query(f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns) SELECT conv_id, turn FROM r WHERE back <= 5")
def memory_window_default(spark, sf):
    return memory.recent_window(memory.exchanges(table(spark, sf, "conversations"))).select("conv_id", "turn")


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, count(*) AS turns_total FROM turns GROUP BY 1)
    SELECT conv_id, turns_total, CASE WHEN turns_total >= 3 THEN turns_total - 2 ELSE 0 END AS compactions,
      CASE WHEN turns_total >= 3 THEN 2 ELSE turns_total END AS turns_kept FROM n"""
)
def memory_compaction(spark, sf):
    """Threshold 3 and batch 1, as the fixtures' conversations are short."""
    return memory.compaction_state(memory.exchanges(table(spark, sf, "conversations")), 3, 1)


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, user_text, assistant_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns),
    s AS (SELECT conv_id, turn, i AS turns_total, CASE WHEN i >= 3 THEN i - 2 ELSE 0 END AS compactions, CASE WHEN i >= 3 THEN 2 ELSE i END AS turns_kept FROM n)
    SELECT s.*, md5(coalesce(list_reduce(list_prepend('', list(n.user_text || ' | ' || n.assistant_text ORDER BY n.i) FILTER (WHERE n.i IS NOT NULL)), lambda x, y: md5(x || chr(10) || y)), '')) AS summary_md5
    FROM s LEFT JOIN n ON n.conv_id = s.conv_id AND n.i <= s.compactions GROUP BY ALL"""
)
def memory_stream(spark, sf):
    """The same memory as streaming state, one output row per recorded exchange."""
    folder = scratch_path(spark, "exchanges")
    memory.exchanges(table(spark, sf, "conversations")).write.parquet(f"{folder}/turns.parquet")
    stream = table_stream(state_session(spark), folder, "turns")
    path = drain(conversation_memory(stream, threshold=3, batch=1), "memory")
    return spark.read.parquet(path).select(
        "conv_id", "turn", "turns_total", "compactions", "turns_kept", F.md5("summary").alias("summary_md5")
    )
