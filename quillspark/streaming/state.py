"""Circuit breaker and conversation memory as keyed state.

Each function keeps a state of constant size per key (the memory: at most the
compaction threshold of turns).  Rows of a key are taken in event order within a
micro-batch; what is held at once is one key's share of one bounded micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark import settings as S
from quillspark.functions.models import DigestSummarizer, Summarizer


def _in_order(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable")


def circuit_breaker(
    calls: DataFrame,
    failures: int = S.BREAKER_FAILURES,
    cooldown_us: int = S.BREAKER_COOLDOWN_SEC * 1_000_000,
) -> DataFrame:
    """Outcome of every call behind a breaker per ``key``.

    ``calls``: key LONG, seq LONG, at LONG (microseconds), failed BOOLEAN.  A call
    while the breaker is open is blocked and does not count.
    """

    def step(key, chunks, state):
        count, until = state.get if state.exists else (0, None)
        rows = _in_order(chunks, ["at", "seq"])
        outcome = []
        for at, failed in zip(rows["at"], rows["failed"]):
            if until is not None and at < until:
                outcome.append("blocked")
            elif not failed:
                count, until = 0, None
                outcome.append("ok")
            elif count + 1 >= failures:
                count, until = 0, int(at) + cooldown_us
                outcome.append("opened")
            else:
                count += 1
                outcome.append("failed")
        state.update((count, until))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "outcome": outcome})

    return calls.groupBy("key").applyInPandasWithState(
        step, "key long, seq long, outcome string", "count int, until long", "append", GroupStateTimeout.NoTimeout
    )


def conversation_memory(
    exchanges: DataFrame,
    summarizer: Summarizer | None = None,
    threshold: int = S.MEMORY_THRESHOLD,
    batch: int = S.MEMORY_BATCH,
    turn_chars: int | None = None,
) -> DataFrame:
    """Memory after each recorded exchange.

    ``exchanges``: conv_id LONG, turn LONG, user_text, assistant_text.  At the
    threshold the oldest ``batch`` turns move into the summary; when the summariser
    fails or returns nothing, everything is kept and the next turn tries again.
    """
    model = summarizer or DigestSummarizer()

    def step(key, chunks, state):
        summary, users, answers, total, compactions = state.get if state.exists else ("", [], [], 0, 0)
        users, answers = list(users), list(answers)
        rows = _in_order(chunks, ["turn"])
        out = []
        for turn, user, answer in zip(rows["turn"], rows["user_text"], rows["assistant_text"]):
            users.append(user)
            answers.append(answer)
            total += 1
            if len(users) >= threshold:
                oldest = [(u[:turn_chars], a[:turn_chars]) for u, a in zip(users[:batch], answers[:batch])]
                try:
                    fresh = model.summarize(summary, oldest).strip()
                except Exception:
                    fresh = ""
                if fresh:
                    summary, users, answers = fresh, users[batch:], answers[batch:]
                    compactions += 1
            out.append((key[0], int(turn), total, compactions, len(users), summary))
        state.update((summary, users, answers, total, compactions))
        yield pd.DataFrame(
            out, columns=["conv_id", "turn", "turns_total", "compactions", "turns_kept", "summary"]
        )

    return exchanges.groupBy("conv_id").applyInPandasWithState(
        step,
        "conv_id long, turn long, turns_total long, compactions long, turns_kept long, summary string",
        "summary string, users array<string>, answers array<string>, total long, compactions long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def counters(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Running request counters; partial counts are merged before the state is touched."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
