"""Conversation memory over a message log, as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.operators.ranking import rank_bounded, top_k_per_key


def exchanges(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, user_text, assistant_text): questions with the answer right after.

    Joined on (conversation, turn), which is unique, so a very long conversation is
    spread over all tasks.  Unanswered questions are not recorded.
    """
    asked = messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    answered = messages.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text")
    )
    return asked.join(answered, ["conv_id", "turn"])


def recent_window(turns: DataFrame, n: int = S.MEMORY_WINDOW) -> DataFrame:
    """The last n exchanges of every conversation in order, ``place`` counted from 1."""
    last = top_k_per_key(turns, ["conv_id"], [F.col("turn").desc()], n, "_back").drop("_back")
    return rank_bounded(last, ["conv_id"], ["turn"], "place")


def window_messages(turns: DataFrame, n: int = S.MEMORY_WINDOW) -> DataFrame:
    """Alternating user and assistant messages of the window, ``msg_no`` counted from 1."""
    pair = F.posexplode(
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("assistant_text").alias("content")),
        )
    ).alias("_i", "_m")
    return recent_window(turns, n).select("conv_id", "place", pair).select(
        "conv_id", (F.col("place") * 2 - 1 + F.col("_i")).alias("msg_no"), "_m.role", "_m.content"
    )


# Fixed value: what stands before the summary of earlier exchanges.
SUMMARY_HEAD = "[Tóm tắt hội thoại trước]\n"


def context_messages(turns: DataFrame, summaries: DataFrame, n: int = S.MEMORY_WINDOW) -> DataFrame:
    """Messages a model is given: the summary, if there is one, as message 0, then the window.

    ``summaries``: conv_id (unique), summary.  Null and empty summaries give no message; a
    conversation with a summary and no exchanges has that one message.
    """
    heads = summaries.where(F.col("summary") != "").select(
        "conv_id", F.lit(0).alias("msg_no"), F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_HEAD), "summary").alias("content")
    )
    return window_messages(turns, n).unionByName(heads)


def compaction_state(
    turns: DataFrame,
    threshold: int = S.MEMORY_THRESHOLD,
    batch: int = S.MEMORY_BATCH,
) -> DataFrame:
    """State after all exchanges when every summary succeeds, from the count alone.

    The first compaction happens at ``threshold`` exchanges and every further one
    after ``batch`` more, so no per-conversation ordering is needed.
    """
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns_total"))
    done = F.when(
        F.col("turns_total") >= threshold,
        F.floor((F.col("turns_total") - threshold) / F.lit(batch)).cast("long") + 1,
    ).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("compactions", done).withColumn(
        "turns_kept", F.col("turns_total") - F.col("compactions") * batch
    )
