import pytest
from pyspark.sql import functions as F

from quillspark.operators.blocks import OrderedBlocks
from quillspark.plans import memory
from quillspark.plans.web import spaced_starts
from quillspark.session import scratch_path
from quillspark.streaming.runner import drain, state_session, table_stream
from quillspark.streaming.state import circuit_breaker, conversation_memory

SEC = 1_000_000


def streamed(spark, rows, schema, apply):
    """Write the rows as several files, run them through a stateful stream, collect."""
    folder = scratch_path(spark, "in")
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.parquet(f"{folder}/rows.parquet")
    stream = table_stream(state_session(spark), folder, "rows", 1)
    return spark.read.parquet(drain(apply(stream), "out")).collect()


def test_hot_key_running_values_match_brute_force(spark):
    # one key holds most rows, spread over many blocks
    rows = [(7 if i % 4 else i % 5, i, (i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    blocks = OrderedBlocks(df, ["k"], ["at"], 9)
    assert blocks.df.where("k = 7").select("_block").distinct().count() > 3
    got = blocks.position("p").running("s", "sum", F.col("v")).running("m", "max", F.col("v")).running("n", "min", F.col("v")).rows()
    state, want = {}, {}
    for k, at, v in sorted(rows):
        p, s, m, n = state.get(k, (0, 0, -1, 99))
        state[k] = want[at] = (p + 1, s + v, max(m, v), min(n, v))
    assert {r["at"]: (r.p, r.s, r.m, r.n) for r in got.collect()} == want


def test_spacing(spark):
    times = [0, 1, 2, 50, 51, 200, 200, 200, 201]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t long")
    got = {r.i: r.start_at for r in spaced_starts(df, ["t", "i"], "t", 10).collect()}
    free, want = 0, {}
    for i, t in enumerate(times):
        want[i] = max(free, t)
        free = want[i] + 10
    assert got == want


def test_breaker(spark):
    calls = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, False), (124, True), (125, False), (126, True)]
    rows = [(1, i, t * SEC, f) for i, (t, f) in enumerate(calls)] + [(2, 99, 5 * SEC, True)]
    got = {r.seq: r.outcome for r in streamed(spark, rows, "key long, seq long, at long, failed boolean", circuit_breaker)}
    assert [got[i] for i in range(10)] == [
        "failed", "failed", "ok", "failed", "failed", "opened", "blocked", "blocked", "ok", "failed",
    ]
    assert got[99] == "failed"


@pytest.mark.parametrize("total,compactions", [(7, 0), (8, 1), (9, 1), (11, 2), (12, 2), (14, 3)])
def test_memory_matches_closed_form(spark, total, compactions):
    rows = [(1, t, f"u{t}", f"a{t}") for t in range(1, total + 1)]
    schema = "conv_id long, turn long, user_text string, assistant_text string"
    last = max(streamed(spark, rows, schema, conversation_memory), key=lambda r: r.turn)
    closed = memory.compaction_state(spark.createDataFrame(rows, schema)).first()
    assert last.compactions == closed.compactions == compactions
    assert last.turns_kept == closed.turns_kept == total - 3 * compactions


def test_failed_summary_is_tried_again(spark):
    class FailsOnce:
        """Fails while the state still has exactly the threshold of turns."""

        def summarize(self, previous, turns):
            if not previous and turns[0][0] == "u1" and len(turns) == 3 and not getattr(self, "failed", False):
                self.failed = True
                raise RuntimeError("no model")
            return f"{previous}+{len(turns)}"

    rows = [(1, t, f"u{t}", f"a{t}") for t in range(1, 10)]
    schema = "conv_id long, turn long, user_text string, assistant_text string"
    got = {r.turn: (r.compactions, r.turns_kept) for r in streamed(spark, rows, schema, lambda s: conversation_memory(s, FailsOnce()))}
    assert got[8] == (0, 8) and got[9] == (1, 6)
