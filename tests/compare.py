"""Side-by-side check of registered queries against DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return x

    rows = [tuple(cell(x) for x in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def kind(t: str) -> str:
    t = str(t).lower()
    for name, words in {
        "bool": ("bool",), "int64": ("bigint", "long"), "int32": ("int",), "float": ("double", "float"),
        "text": ("varchar", "string"),
    }.items():
        if any(w in t for w in words):
            return name
    return t


def check(spark, db, q, folder: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got = q.run(spark, folder)
    mine = got.toPandas()
    if q.sql is None:
        return None if len(mine) else "no rows"
    rel = db.sql(q.sql)
    theirs = rel.df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    types = {n: kind(t) for n, t in zip(rel.columns, rel.types)}
    wrong = [(n, kind(t), types[n]) for n, t in got.dtypes if kind(t) != types[n]]
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)} {wrong}"
    if not a:
        return "no rows"
    for x, y in zip(a, b):
        if x != y:
            bad = sum(1 for p, q2 in zip(a, b) if p != q2)
            return f"{bad}/{len(a)} differ, first {str(x)[:300]} != {str(y)[:300]} {wrong}"
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    from quillspark.catalog.registry import all_queries
    from quillspark.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name, q in all_queries().items():
        if names and not any(name == n or (n.endswith(".") and q.run.__module__.endswith("." + n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            problem = check(spark, db, q, folder)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t:.1f}s {'' if q.sql else '(rows only)'} {problem or ''}", flush=True)
