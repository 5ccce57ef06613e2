"""Ordered running values without one task per key.

A plain window sorts each key in a single task.  Here rows are range-partitioned
by (keys, order), so a key with a third of all rows is spread over many blocks.
Running values are computed inside each block; per-block totals (at most one row
per key and block) give the carry of the keys that continue from an earlier block,
which is at most one key per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


class OrderedBlocks:
    """Rows laid out in key order; block numbers are fixed by a reliable checkpoint.

    Keys must not be null, and (keys, order) must be unique.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None):
        count = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order, self.derived = list(keys), list(order), False
        ranged = df.repartitionByRange(count, *self.keys, *self.order)
        # The range bounds come from sampling, so the layout must be stored before use.
        self.df = cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))

    def running(self, name: str, how: str, value: Column) -> "OrderedBlocks":
        """Add the inclusive running ``sum``, ``max`` or ``min`` of a value in key order."""
        fn, combine = _COMBINE[how]
        at = ["_block", *self.keys]
        # A chained running value reads its input twice; storing it keeps that from doubling per step.
        stored = cut_lineage(self.df) if self.derived else self.df
        df = stored.withColumn("_v", value)
        local = Window.partitionBy(*at).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        totals = df.groupBy(*at).agg(fn("_v").alias("_t"))
        earlier = (
            Window.partitionBy(*(self.keys or [F.lit(0)]))
            .orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.withColumn("_carry", fn("_t").over(earlier)).where(F.col("_carry").isNotNull())
        joined = df.withColumn("_local", fn("_v").over(local)).join(carry.drop("_t"), at, "left")
        out = OrderedBlocks.__new__(OrderedBlocks)
        out.keys, out.order, out.derived = self.keys, self.order, True
        out.df = joined.withColumn(name, combine(F.col("_local"), F.col("_carry"))).drop("_v", "_local", "_carry")
        return out

    def position(self, name: str = "position") -> "OrderedBlocks":
        """Add the 1-based position of each row within its key."""
        return self.running(name, "sum", F.lit(1).cast("long"))

    def rows(self) -> DataFrame:
        return self.df.drop("_block")
