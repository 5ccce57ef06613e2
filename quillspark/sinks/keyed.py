"""Keyed tables in hash buckets with snapshots.

A write puts its rows into a folder of its own, one subfolder per bucket, and then adds a
snapshot: a small file that names the bucket folders which make up the table.  The snapshot is
renamed into place last and never overwritten, so a write that is killed leaves the table as it
was, and readers keep the snapshot they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.dedup import first_per_key, last_per_key
from quillspark.settings import SHARD_ROWS


class KeyedTable:
    """A table with one row per key; rows with a null key are kept under the null key, once.

    ``buckets`` is fixed when the table is created.  Choose it so that a bucket fits a task:
    keys are hashed and unique, so no bucket grows faster than the others.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        newest = self._snapshot()
        self.buckets = newest["buckets"] if newest else buckets

    # -- snapshots -------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the finished snapshots in order."""
        _, folder, fs = self._hadoop(f"{self.path}/snapshots")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _snapshot(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        jvm, file, fs = self._hadoop(f"{self.path}/snapshots/{known[-1] if version is None else version}.json")
        stream = fs.open(file)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, snapshot: dict) -> int:
        """Add a snapshot; fails when another writer has taken the number meanwhile."""
        number = snapshot["version"]
        jvm, draft, fs = self._hadoop(f"{self.path}/snapshots/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(snapshot).encode()))
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/{number}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, final, no_options)
        return number

    # -- reading ---------------------------------------------------------------------------

    def _rows(self, snapshot: dict, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a snapshot; with ``buckets``, only their folders are opened."""
        schema = StructType.fromJson(snapshot["schema"])
        folders = [f"{self.path}/data/{part}" for part, bucket in snapshot["parts"] if buckets is None or bucket in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest rows, or those of an older version."""
        snapshot = self._snapshot(version)
        if snapshot is None:
            raise RuntimeError(f"no table at {self.path}")
        return self._rows(snapshot)

    # -- writing ---------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, shard_rows: int) -> list[list]:
        """Write rows bucket by bucket; returns (folder, bucket) of every bucket that has rows."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("_bucket", self._bucket())
        writer = placed.repartition("_bucket").write.option("maxRecordsPerFile", shard_rows)
        writer.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        _, folder, fs = self._hadoop(f"{self.path}/data/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return [[f"{name}/{f}", int(f.split("=")[1])] for f in sorted(found) if f.startswith("_bucket=")]

    def _touched(self, rows: DataFrame) -> set[int]:
        """Buckets the rows fall into, at most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def _base(self, rows: DataFrame) -> dict:
        empty = {"version": 0, "buckets": self.buckets, "schema": rows.schema.jsonValue(), "parts": [], "applied": {}}
        return self._snapshot() or empty

    def _applied(self, base: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and base["applied"].get(batch[0], -1) >= batch[1]

    def _finish(self, base: dict, parts: list[list], batch: tuple[str, int] | None) -> int:
        applied = {**base["applied"], **({batch[0]: batch[1]} if batch else {})}
        return self._publish({**base, "version": base["version"] + 1, "parts": parts, "applied": applied})

    def append(
        self, rows: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None, shard_rows: int = SHARD_ROWS
    ) -> int | None:
        """Add the first row (by ``order``) of every key the table does not hold; returns the version.

        ``batch`` is (stream, number), with numbers rising within a stream.  A batch that has been
        applied does nothing and returns None, without reading rows.  Only the buckets the rows
        fall into are probed for known keys.
        """
        base = self._base(rows)
        if self._applied(base, batch):
            return None
        fresh = first_per_key(rows, [self.key], order)
        if base["parts"]:
            held = self._rows(base, self._touched(rows)).select(F.col(self.key).alias("_held"))
            fresh = fresh.join(held, F.col(self.key).eqNullSafe(F.col("_held")), "left_anti")
        return self._finish(base, base["parts"] + self._write(fresh, shard_rows), batch)

    def replace(
        self, rows: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None, shard_rows: int = SHARD_ROWS
    ) -> int | None:
        """Put the last row (by ``order``) of every key in place of the table's; returns the version.

        Only touched buckets are written anew, each into one folder; the others stay as they are.
        """
        base = self._base(rows)
        if self._applied(base, batch):
            return None
        touched = self._touched(rows)
        fresh = last_per_key(rows, [self.key], order)
        names = fresh.select(F.col(self.key).alias("_new"))
        kept = self._rows(base, touched).join(names, F.col(self.key).eqNullSafe(F.col("_new")), "left_anti")
        untouched = [p for p in base["parts"] if p[1] not in touched]
        return self._finish(base, untouched + self._write(kept.unionByName(fresh), shard_rows), batch)

    def compact(self, shard_rows: int = SHARD_ROWS) -> int | None:
        """Bring buckets that many appends have split into one folder each; None if there are none."""
        base = self._snapshot()
        folders: dict[int, int] = {}
        for _, bucket in base["parts"] if base else []:
            folders[bucket] = folders.get(bucket, 0) + 1
        split = {b for b, n in folders.items() if n > 1}
        if not split:
            return None
        whole = [p for p in base["parts"] if p[1] not in split]
        return self._finish(base, whole + self._write(self._rows(base, split), shard_rows), None)
