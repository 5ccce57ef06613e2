"""Building and triaging a golden question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions import models
from quillspark.functions.ids import hash_order
from quillspark.functions.text import or_empty, strip
from quillspark.operators.dedup import first_per_key
from quillspark.operators.ranking import top_k, top_k_per_key


def distinct_types(points: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed types; the blank one only when it is the only one."""
    types = points.select(strip(or_empty(F.col(col))).alias("type")).distinct()
    named = types.where(F.col("type") != "")
    return named if named.limit(1).count() else types


def stratified_sample(
    chunks: DataFrame,
    target: int = S.SAMPLE_TARGET,
    min_chars: int = S.SAMPLE_MIN_CHARS,
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    """First chunks of every type, one per document, topped up to ``target``, shuffled.

    ``chunks``: cid, doc_id, legal_type, text.  May exceed the target when the
    minimum per type does.
    """
    types = distinct_types(chunks, "legal_type")
    per_type = max(S.SAMPLE_MIN_PER_STRATUM, target // max(types.count(), 1))
    usable = chunks.withColumn("legal_type", strip(or_empty(F.col("legal_type")))).where(
        F.length("text") >= min_chars
    )
    slim = usable.select("cid", "doc_id", "legal_type", F.length("text").alias("text_len"))
    one_per_doc = first_per_key(slim, ["doc_id"], ["legal_type", "cid"])
    typed = one_per_doc.join(types, one_per_doc["legal_type"] == types["type"], "left_semi")
    strata = top_k_per_key(typed, ["legal_type"], ["cid"], per_type, "_n").drop("_n").withColumn("_stage", F.lit(1))
    unseen = one_per_doc.join(strata.select("doc_id"), "doc_id", "left_anti")
    extra = top_k(unseen, ["cid"], target).withColumn("_stage", F.lit(2))
    # At most (types x per_type + target) rows from here on.
    both = strata.unionByName(extra)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_stage", "cid"))
    chosen = both.withColumn("_place", place).where((F.col("_stage") == 1) | (F.col("_place") <= target))
    shuffled = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(seed, F.col("cid"))))
    return chosen.withColumn("sample_no", shuffled).select("sample_no", "cid", "doc_id", "legal_type", "text_len")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = S.SAMPLE_SEED) -> DataFrame:
    """n rows in a repeatable pseudo-random order."""
    return top_k(df, [hash_order(seed, F.col(key)), F.col(key)], n)


def chunk_statistics(samples: DataFrame) -> DataFrame:
    length = F.length("text")
    return samples.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct("doc_id").alias("unique_docs"),
        F.coalesce(F.min(length), F.lit(0)).alias("text_len_min"),
        F.coalesce(F.max(length), F.lit(0)).alias("text_len_max"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("text_len_mean"),
    )


def type_distribution(samples: DataFrame, col: str = "legal_type") -> DataFrame:
    return samples.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def critic_tier(intent: Column, answerability: Column, correctness: Column, clarity: Column, failed: Column) -> Column:
    """kept, flagged or rejected.  A score of 0 (or a missing one) is neither 1 nor 2."""
    a, c, cl = (F.coalesce(x, F.lit(0)) for x in (answerability, correctness, clarity))
    low = F.least(a, c, cl)
    negative = (
        F.when((a <= 2) & (cl >= 3), F.lit("kept")).when(cl < 2, F.lit("rejected")).otherwise(F.lit("flagged"))
    )
    other = F.when(low == 1, F.lit("rejected")).when(low == 2, F.lit("flagged")).otherwise(F.lit("kept"))
    return F.when(failed, F.lit("flagged")).when(intent == "NEGATIVE", negative).otherwise(other)


def negative_count(target: int) -> int:
    return max(1, int(target * S.NEGATIVE_RATIO))


def triaged(samples: DataFrame, critic: models.Critic) -> DataFrame:
    """Samples with the critic's scores in ``critic`` and the ``tier`` that follows from them.

    ``samples``: question, reference_answer, text, intent, any other columns.  A critic without
    a verdict gives null scores and the tier flagged.
    """
    reviewed = samples.withColumn("critic", critic.review(F.col("question"), F.col("reference_answer"), F.col("text")))
    scores = [F.col(f"critic.{c}") for c in ("answerability", "correctness", "clarity")]
    return reviewed.withColumn("tier", critic_tier(or_empty(F.col("intent")), *scores, F.col("critic").isNull()))


# Fixed value: the reference answer of a question that the text does not answer.
NO_ANSWER = "KHÔNG_CÓ_THÔNG_TIN"


def negatives(samples: DataFrame, writer: models.NegativeWriter, n: int, seed: int = S.SAMPLE_SEED) -> DataFrame:
    """Unanswerable questions about n samples, taken in a seeded order (``cid`` must be unique).

    Samples for which the writer finds no question are left out, so fewer than n may come back.
    """
    chosen = seeded_sample(samples.select("cid", "doc_id", "legal_type", "text"), "cid", n, seed)
    asked = chosen.withColumn("question", writer.question(F.col("text"), F.col("legal_type")))
    return asked.where(or_empty(F.col("question")) != "").withColumns(
        {"reference_answer": F.lit(NO_ANSWER), "intent": F.lit("NEGATIVE"), "is_negative": F.lit(True)}
    )


def flatten_generated(samples: DataFrame) -> DataFrame:
    """One record per generated question; samples without questions give a stub.

    ``samples``: cid, doc_id, legal_type, text, generated_qas (array of structs
    question, answer, intent; null when nothing was generated).
    """
    qa = F.col("qa")
    stub = F.col("generated_qas").isNull()
    rows = samples.where(stub | (F.size("generated_qas") > 0)).select(
        "*", F.explode_outer("generated_qas").alias("qa")
    )
    intent = F.when(stub, F.lit("")).otherwise(F.coalesce(qa["intent"], F.lit("UNKNOWN")))
    return rows.select(
        or_empty(qa["question"]).alias("question"),
        or_empty(qa["answer"]).alias("reference_answer"),
        F.array("text").alias("reference_context"),
        F.array("cid").alias("reference_cids"),
        intent.alias("intent"),
        F.coalesce(qa["intent"] == "NEGATIVE", F.lit(False)).alias("is_negative"),
        or_empty(F.col("legal_type")).alias("legal_type"),
        "doc_id",
    )


def flatten_ready(samples: DataFrame) -> DataFrame:
    """Records that already hold a question (negatives, triaged records), in the full schema."""
    return samples.select(
        or_empty(F.col("question")).alias("question"),
        or_empty(F.col("reference_answer")).alias("reference_answer"),
        F.array("text").alias("reference_context"),
        F.array("cid").alias("reference_cids"),
        F.coalesce("intent", F.lit("UNKNOWN")).alias("intent"),
        F.coalesce("is_negative", F.lit(False)).alias("is_negative"),
        or_empty(F.col("legal_type")).alias("legal_type"),
        "doc_id",
        "tier",
    )


# Columns of the human review file.
REVIEW_COLUMNS = (
    "question", "reference_answer", "source_chunk", "intent", "legal_type",
    "critic_answerability", "critic_correctness", "critic_clarity", "critic_reasoning", "sme_verdict",
)


def review_rows(flagged: DataFrame) -> DataFrame:
    critic = lambda f: or_empty(F.col(f"critic.{f}").cast("string"))
    return flagged.select(
        or_empty(F.col("question")).alias("question"),
        or_empty(F.col("reference_answer")).alias("reference_answer"),
        F.left(or_empty(F.col("text")), F.lit(500)).alias("source_chunk"),
        or_empty(F.col("intent")).alias("intent"),
        or_empty(F.col("legal_type")).alias("legal_type"),
        critic("answerability").alias("critic_answerability"),
        critic("correctness").alias("critic_correctness"),
        critic("clarity").alias("critic_clarity"),
        critic("reasoning").alias("critic_reasoning"),
        F.lit("").alias("sme_verdict"),
    )
