import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.session import scratch_path
from quillspark.sinks.keyed import KeyedTable

SCHEMA = "k int, v string, o int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


@pytest.fixture()
def table(spark):
    return KeyedTable(spark, scratch_path(spark, "keyed"), "k", 4)


def test_batches_with_a_replay_equal_one_run(spark, table):
    batches = [rows(spark, *[(i % 17, f"{b}-{i}", i) for i in range(b, 60, 3)]) for b in range(3)]
    for number in (0, 1, 1, 0, 2):
        table.append(batches[number], ["o"], ("s", number))
    one = KeyedTable(spark, scratch_path(spark, "one"), "k", 4)
    every = batches[0].withColumn("b", F.lit(0)).unionByName(batches[1].withColumn("b", F.lit(1))).unionByName(batches[2].withColumn("b", F.lit(2)))
    one.append(every, ["b", "o"])
    assert content(table.read()) == content(one.read()) and table.versions() == [1, 2, 3]


def test_replay_is_known_by_its_number(spark, table):
    assert table.append(rows(spark, (1, "a", 0)), ["o"], ("s", 4)) == 1
    assert table.append(rows(spark, (2, "b", 0)), ["o"], ("s", 4)) is None
    assert table.append(rows(spark, (2, "b", 0)), ["o"], ("t", 0)) == 2
    assert content(table.read()) == [(1, "a"), (2, "b")]


def test_a_write_killed_before_its_snapshot_changes_nothing(spark, table, monkeypatch):
    table.append(rows(spark, (1, "a", 0)), ["o"], ("s", 0))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", killed)
        for write in (table.append, table.replace):
            with pytest.raises(KeyboardInterrupt):
                write(rows(spark, (1, "z", 0), (2, "b", 0)), ["o"], ("s", 1))
    assert content(table.read()) == [(1, "a")]
    table.append(rows(spark, (1, "z", 0), (2, "b", 0)), ["o"], ("s", 1))
    assert content(table.read()) == [(1, "a"), (2, "b")]


def test_replace_writes_touched_buckets_only(spark, table):
    table.append(rows(spark, *[(i, "old", 0) for i in range(40)]), ["o"])
    before = {tuple(p) for p in table._snapshot()["parts"]}
    table.replace(rows(spark, (3, "x", 0), (3, "y", 1)), ["o"])
    after = {tuple(p) for p in table._snapshot()["parts"]}
    assert len(before) == len(after) == 4 and len(before & after) == 3
    assert dict(content(table.read())) == {i: "y" if i == 3 else "old" for i in range(40)}
    assert dict(content(table.read(1))) == dict.fromkeys(range(40), "old")


def test_null_keys_empty_batches_and_compaction(spark, table):
    table.append(rows(spark), ["o"])
    assert content(table.read()) == []
    for v in ("a", "b"):
        table.append(rows(spark, (None, v, 0), (1, v, 0)), ["o"])
        table.append(rows(spark, (ord(v), v, 0)), ["o"])
    kept = content(table.read())
    assert kept == sorted([(None, "a"), (1, "a"), (97, "a"), (98, "b")], key=repr)
    table.replace(rows(spark, (None, "n", 0)), ["o"])
    assert (None, "n") in content(table.read()) and len(content(table.read())) == 4
    table.compact()
    assert table.compact() is None and len(content(table.read())) == 4


def test_two_writers_cannot_take_the_same_version(spark, table):
    table.append(rows(spark, (1, "a", 0)), ["o"])
    stale = table._snapshot()
    table.append(rows(spark, (2, "b", 0)), ["o"])
    with pytest.raises(Exception, match="exist"):
        table._finish(stale, [], None)
    newest = Path(table.path.removeprefix("file:"), "snapshots", "2.json")
    assert json.loads(newest.read_text())["version"] == 2


def test_buckets_stay_as_created(spark, table):
    table.append(rows(spark, (1, "a", 0)), ["o"])
    assert KeyedTable(spark, table.path, "k", 99).buckets == 4
    with pytest.raises(RuntimeError, match="no table"):
        KeyedTable(spark, scratch_path(spark, "none"), "k").read()
