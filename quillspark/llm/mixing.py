"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Sizes are summed by source and hash bucket; the cumulated sums show in which bucket a source's budget
ends, and only that boundary bucket is summed again, by finer buckets.  Documents are then kept or not by
comparing their own hash with the threshold: nothing is sorted.  A budget beyond a source's own size takes
every document once and its rest from a second pass over the thresholds, so no document is taken more
than twice.

Where the document at the threshold does not fit, further nested rounds fill what is left of the budget
with documents behind the threshold that are no larger than the gap.

Sources are ordered by code point, null last.  Rows that repeat a doc_id have the same hash and are taken
or left together; null texts have size 0.  The histograms hold at most 2^BITS rows a source and step.
Window functions run over one row per source, or over the buckets of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import stored

WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes; most that a source gives, as a multiple of its own.
SHARE, MOST = 1.5, 2
#: Bits of a histogram step, and steps: thresholds have 24 bits.
BITS, STEPS = 12, 2
ROUNDS = 3
SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")


def hash_value(doc_id: Column) -> Column:
    """BITS * STEPS bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * STEPS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target (double) from (source, size).

    Shares go by weight; a source's share stops at MOST times its size, and what it cannot give goes to the
    others by weight.  In ascending order of cap / weight the first sources are the capped ones.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(WEIGHTS))) + 1)
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    all_size, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    earlier_size, earlier_weight = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (SHARE * all_size - MOST * earlier_size) / (all_weight - earlier_weight)
    stepped = table.withColumn("level", level).withColumn("capped", MOST * F.col("source_size") <= F.col("level") * F.col("weight"))
    # the level that holds is the one at the first source that is not capped
    holds = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.coalesce("source", F.lit("")), "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.lit(float(MOST)) * F.col("source_size")).otherwise(holds * F.col("weight"))
    return stepped.select("source", "source_size", target.cast("double").alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, from, left: documents with a hash below ``from`` fit in the budget, which leaves so much.

    ``rows`` has source, size, h; ``budgets`` has source, budget.  Each source of ``budgets`` that has rows
    comes back once; where everything fits, ``from`` lies beyond all hashes.
    """
    everything = 1 << (BITS * STEPS)
    limits = budgets.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_from"), F.lit(everything).cast("long").alias("_to"), F.col("budget").cast("double").alias("_left"))
    for step in range(STEPS):
        width = 1 << (BITS * (STEPS - 1 - step))
        inside = rows.join(limits, rows["source"].eqNullSafe(limits["_s"]) & (F.col("h") >= F.col("_from")) & (F.col("h") < F.col("_to")))
        sums = inside.groupBy("source", "_to", "_left", F.floor(F.col("h") / width).alias("bucket")).agg(F.sum("size").alias("size"))
        summed = sums.withColumn("sum", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        over = F.col("sum") > F.col("_left")
        found = summed.groupBy("source", "_to", "_left").agg(
            F.min(F.when(over, F.col("bucket") * width)).alias("first"), F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("used")
        )
        start = F.coalesce("first", "_to")
        # a source that fits whole has no boundary bucket: its range becomes empty at its end
        limits = stored(found.select(F.col("source").alias("_s"), start.alias("_from"), F.when(F.col("first").isNull(), start).otherwise(start + width).alias("_to"), (F.col("_left") - F.col("used")).alias("_left")), "limits")
        done = limits.where("_from = _to") if step == 0 else done.unionByName(limits)
        limits = limits.where("_from < _to")
    return done.select(F.col("_s").alias("source"), F.col("_from").alias("from"), F.col("_left").alias("left"))


def _table(docs: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Sizes and hashes per document, thresholds per source, and the number of copies as a column over both."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_value(F.col("doc_id")).alias("h"))
    sized = stored(narrow, "sizes")
    goals = stored(targets(sized), "targets")
    twice = F.col("target") >= F.col("source_size")
    budgets = goals.select("source", F.when(twice, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget"))
    table, rows = goals.withColumn("base", F.when(twice, 1).otherwise(0)), sized.select("source", "size", "h")
    for k in range(ROUNDS):
        now = stored(_thresholds(rows, budgets), "thresholds")
        renamed = now.select(F.col("source").alias("_s"), F.col("from").alias(f"t{k}"), F.col("left").alias(f"left{k}"))
        table = table.join(renamed, table["source"].eqNullSafe(renamed["_s"]), "left").drop("_s")
        budgets = now.select("source", F.col("left").alias("budget"))
        # what the next round may still take: behind this threshold, and no larger than what is left
        behind = (F.col("h") >= F.col(f"t{k}")) & (F.col("size") <= F.col(f"left{k}"))
        rows = rows.join(renamed, rows["source"].eqNullSafe(renamed["_s"]) & behind).select("source", "size", "h")
    table = stored(table.withColumnRenamed("source", "_source"), "mix")
    reached, taken = F.lit(True), F.lit(False)
    for k in range(ROUNDS):
        taken = taken | (reached & (F.col("h") < F.col(f"t{k}")))
        reached = reached & (F.col("h") >= F.col(f"t{k}")) & (F.col("size") <= F.col(f"left{k}"))
    return sized, table, F.col("base") + F.coalesce(taken, F.lit(False)).cast("int")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of (doc_id, text, source)."""
    sized, table, copies = _table(docs)
    named = sized.join(table, sized["source"].eqNullSafe(table["_source"])).withColumn("copies", copies)
    return named.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes each of them: not at all, once or twice."""
    _, table, copies = _table(docs)
    keyed = docs.withColumn("_doc_size", word_count(F.col("text"))).withColumn("_doc_hash", hash_value(F.col("doc_id")))
    named = keyed.join(table.withColumnsRenamed({c: f"_mix_{c}" for c in table.columns}), keyed["source"].eqNullSafe(F.col("_mix__source")))
    inner = named.select(F.struct(*[named[c] for c in docs.columns]).alias("_doc"), F.col("_doc_size").alias("size"), F.col("_doc_hash").alias("h"), *[F.col(f"_mix_{c}").alias(c) for c in table.columns])
    times = inner.select("_doc", copies.alias("_copies")).where("_copies > 0")
    return times.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
