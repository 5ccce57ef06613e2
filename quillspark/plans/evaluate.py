"""Retrieval and answer quality: per-record scores, aggregates, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions import models
from quillspark.functions.parsing import parse_context, parse_ids, positive_mean, sanitize_score
from quillspark.functions.text import content_tokens, overlap_ratio, strip
from quillspark.operators.ranking import best_and_worst
from quillspark.plans.retrieve import context_block

# Judged dimensions, retrieval modes and histogram labels.
JUDGED = ("faithfulness", "answer_relevancy", "completeness", "citation_accuracy")
MODES = ("backend", "oracle_gt", "backend_error", "missing")
BUCKETS = ("1 (Poor)", "2 (Fair)", "3 (Good)", "4 (Very Good)", "5 (Excellent)")
BUCKET_ENDS = (1.5, 2.5, 3.5, 4.5)


def golden_rows(csv: DataFrame) -> DataFrame:
    """Usable rows of the question file, with parsed contexts and ids."""
    usable = csv.where(
        F.col("question").isNotNull()
        & F.col("context").isNotNull()
        & (F.length(strip(F.col("question"))) > 10)
        & (F.length(strip(F.col("context"))) > 20)
    )
    return usable.select(
        F.coalesce(F.col("qid").try_cast("long"), F.lit(0)).alias("qid"),
        strip(F.col("question")).alias("question"),
        parse_context(F.col("context")).alias("ground_truth_context"),
        parse_ids(F.col("cid")).alias("ground_truth_cids"),
    )


def context_hit(truth: Column, retrieved: Column) -> Column:
    """Token overlap of the true context with all retrieved texts of the question.

    ``truth`` and ``retrieved`` are token arrays from ``content_tokens``.
    """
    bar = F.when(F.size(truth) > S.HIT_LONG_TOKENS, F.lit(S.HIT_THRESHOLD_LONG)).otherwise(F.lit(S.HIT_THRESHOLD))
    some = (F.size(truth) > 0) & (F.size(retrieved) > 0)
    return F.coalesce(some & (overlap_ratio(truth, retrieved) >= bar), F.lit(False))


def id_recall(truth: Column, got: Column) -> Column:
    wanted = F.array_distinct(truth)
    found = F.size(F.array_intersect(wanted, got)).cast("double")
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def retrieved_per_question(docs: DataFrame) -> DataFrame:
    """Retrieved ids and tokens per question; k rows per group."""
    return docs.groupBy("qid").agg(
        F.collect_set("cid").alias("retrieved_cids"),
        F.array_distinct(F.flatten(F.collect_list(content_tokens(F.col("text"))))).alias("retrieved_tokens"),
    )


def score_retrieval(samples: DataFrame, docs: DataFrame) -> DataFrame:
    """Hit and recall of each sample (qid, ground_truth_context, ground_truth_cids)."""
    joined = samples.join(retrieved_per_question(docs), "qid", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "qid",
        context_hit(
            content_tokens(F.col("ground_truth_context")), F.coalesce("retrieved_tokens", none)
        ).alias("context_hit"),
        F.coalesce(id_recall(F.col("ground_truth_cids"), F.col("retrieved_cids")), F.lit(0.0)).alias("cid_recall"),
    )


def composite(records: DataFrame) -> DataFrame:
    """Sanitised judge scores and their mean over the positive ones."""
    clean = records.withColumns({c: sanitize_score(F.col(c)) for c in JUDGED})
    return clean.withColumn("overall_score", positive_mean(*[F.col(c) for c in JUDGED]))


def evaluation_records(samples: DataFrame, docs: DataFrame | None, generator: models.Generator, judge: models.Judge) -> DataFrame:
    """Scored records of samples (qid, question, ground_truth_context, ground_truth_cids).

    Without retrieved documents the true context is used, which isolates the answers;
    retrieval is then not scored.
    """
    real = docs is not None
    shown = docs if real else oracle_docs(samples).withColumn("rank", F.lit(1))
    texts = context_block(shown, samples)
    joined = samples.join(texts, "qid").withColumn("answer", generator.answer(F.col("question"), F.col("context")))
    judged = joined.withColumn(
        "_j", judge.scores(F.col("question"), F.col("ground_truth_context"), F.col("context"), F.col("answer"))
    )
    flat = judged.select("qid", "question", F.lit("backend" if real else "oracle_gt").alias("source"), "_j.*")
    if not real:
        return composite(flat).withColumns({"context_hit": F.lit(False), "cid_recall": F.lit(0.0)})
    return composite(flat).join(score_retrieval(samples, docs), "qid")


def positive_avg(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def summary(records: DataFrame) -> DataFrame:
    """Headline numbers from one pass.

    ``records``: source, error, context_hit, cid_recall, the judged scores,
    overall_score, retrieval_ms, generation_ms, completion_tokens.
    """
    real = F.col("source") == "backend"
    return records.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("n_errors"),
        F.count_if(real).alias("n_retrieval"),
        F.count_if(real & F.col("context_hit")).alias("context_hits"),
        F.try_divide(F.count_if(real & F.col("context_hit")), F.count_if(real)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(real, F.col("cid_recall"))), F.lit(0.0)).alias("avg_cid_recall"),
        *[positive_avg(c).alias(f"avg_{c}") for c in (*JUDGED, "overall_score")],
        F.avg(F.when(real & (F.col("retrieval_ms") > 0), F.col("retrieval_ms"))).alias("avg_retrieval_ms"),
        F.avg("generation_ms").alias("avg_generation_ms"),
        F.try_divide(F.coalesce(F.sum("completion_tokens"), F.lit(0)), F.count(F.lit(1))).alias("avg_tokens"),
    )


def _labels(df: DataFrame, values: Iterable[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def mode_counts(records: DataFrame, modes: Iterable[str] = MODES) -> DataFrame:
    """Records per retrieval mode, with zero rows for absent preset modes."""
    seen = records.select(F.coalesce("source", F.lit("missing")).alias("mode")).groupBy("mode").count()
    joined = _labels(records, modes, "mode").join(seen, "mode", "full_outer")
    return joined.select("mode", F.coalesce("count", F.lit(0)).alias("n"))


def bucket_of(score: Column) -> Column:
    chosen = F.when(score <= BUCKET_ENDS[0], F.lit(BUCKETS[0]))
    for end, label in zip(BUCKET_ENDS[1:], BUCKETS[1:]):
        chosen = chosen.when(score <= end, F.lit(label))
    return chosen.otherwise(F.lit(BUCKETS[-1]))


def histogram(records: DataFrame, score: str) -> DataFrame:
    """Count and share of the positive scores per bucket, zero-filled."""
    from pyspark.sql import Window

    seen = (
        records.where(F.col(score) > 0).groupBy(bucket_of(F.col(score)).alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    )
    filled = _labels(records, BUCKETS, "rating").join(seen, "rating", "left").select(
        "rating", F.coalesce("n", F.lit(0)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # five rows
    return filled.select("rating", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("pct"))


def float_means(df: DataFrame) -> DataFrame:
    """Mean of every floating-point column."""
    kinds = ("float", "double")
    return df.agg(*[F.avg(f.name).alias(f.name) for f in df.schema.fields if f.dataType.simpleString() in kinds])


def reranker_diagnosis(scores: DataFrame, score: str = "score", gates: tuple[float, ...] = (0.3, 0.1, 0.05)) -> DataFrame:
    """Distribution of reranker scores and pass rates at the given gates."""
    c = F.col(score)
    rates = [F.try_divide(F.count_if(c >= g), F.count(F.lit(1))).alias(f"pass_{str(g).replace('.', '_')}") for g in gates]
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("score_min"), F.max(c).alias("score_max"), F.avg(c).alias("score_mean"), *rates
    )


def sweep(run: Callable[[int], DataFrame], widths: Iterable[int] = (3, 5, 10)) -> DataFrame:
    """The same evaluation at several result widths."""
    out = None
    for k in widths:
        part = run(k).withColumn("top_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def oracle_docs(samples: DataFrame) -> DataFrame:
    """Stand-in retrieval: the true context itself, to isolate answer generation."""
    return samples.select(
        "qid",
        F.explode_outer("ground_truth_cids").alias("cid"),
        F.col("ground_truth_context").alias("text"),
        F.lit("oracle_gt").alias("source"),
    )


def markdown_report(records: DataFrame, title: str = "Evaluation report") -> str:
    """Report text from small aggregates; only the best and worst rows reach the driver."""
    s = summary(records).first().asDict()
    modes = {r["mode"]: r["n"] for r in mode_counts(records).collect()}
    hist = {r["rating"]: (r["n"], r["pct"]) for r in histogram(records, "faithfulness").collect()}
    sides = best_and_worst(records, "overall_score", "qid").collect()

    def bar(x: float) -> str:
        filled = int(x / 5.0 * 20)
        return "█" * filled + "░" * (20 - filled)

    def ms(x) -> str:
        return "N/A" if x is None else f"{x:.0f} ms"

    real = s["n_retrieval"]
    lines = [
        f"# {title}", "",
        f"Samples: {s['n_total']:,} (errors: {s['n_errors']})", "",
        f"Overall {bar(s['avg_overall_score'])} {s['avg_overall_score']:.2f}/5", "",
        "## Retrieval", "", "| Metric | Value |", "|---|---|",
        "| Modes | " + ", ".join(f"{m}={modes.get(m, 0)}" for m in MODES) + " |",
        f"| Context hit rate | {s['context_hits']}/{real} ({s['hit_rate']:.1%}) |" if real else "| Context hit rate | N/A |",
        f"| Id recall | {s['avg_cid_recall']:.2%} |" if real else "| Id recall | N/A |",
        f"| Mean retrieval time | {ms(s['avg_retrieval_ms'])} |", "",
        "## Answers", "", "| Metric | Score | |", "|---|---|---|",
        *[f"| {c} | {s['avg_' + c]:.2f}/5 | {bar(s['avg_' + c])} |" for c in JUDGED], "",
        "## Faithfulness distribution", "", "| Rating | Count |", "|---|---|",
        *[f"| {b} | {hist[b][0]} ({hist[b][1]:.0f}%) |" for b in BUCKETS], "",
        f"Mean generation time {ms(s['avg_generation_ms'])}, mean tokens {s['avg_tokens'] or 0:.0f}",
    ]
    for side in ("worst", "best"):
        rows = sorted((r for r in sides if r["side"] == side), key=lambda r: r["overall_score"], reverse=side == "best")
        lines += ["", f"## {side.title()} samples", ""]
        lines += [f"{i}. qid {r['qid']}: {r['overall_score']:.2f}/5" for i, r in enumerate(rows, 1)]
    return "\n".join(lines)
