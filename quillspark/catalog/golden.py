"""Golden set: strata, samples, critic triage, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog import sql as Q
from quillspark.catalog.registry import query, table
from quillspark.functions.models import ElsewhereWriter, OverlapCritic, SentenceWriter
from quillspark.plans import golden, memory


def _chunks(spark, sf, kind: str = "source"):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("cid"), "doc_id", F.col(kind).alias("legal_type"), "text"
    )


@query("SELECT DISTINCT CASE WHEN lang = 'en' THEN 'en' WHEN lang = 'fr' THEN source END AS type FROM documents WHERE lang IN ('en', 'fr')")
def distinct_types(spark, sf):
    kind = F.when(F.col("lang") == "en", F.lit(" en ")).when(F.col("lang") == "fr", F.col("source"))
    return golden.distinct_types(table(spark, sf, "documents").select(kind.alias("t")), "t")


def _sample_sql(kind: str, target: int) -> str:
    return f"""WITH usable AS (SELECT doc_id, {kind} AS legal_type, length(text) AS text_len FROM documents WHERE length(text) >= 100),
    per AS (SELECT greatest(3, {target} // count(DISTINCT {kind})) AS n FROM documents),
    strata AS (SELECT *, row_number() OVER (PARTITION BY legal_type ORDER BY doc_id) AS r FROM usable, per QUALIFY r <= n),
    extra AS (SELECT * FROM usable WHERE doc_id NOT IN (SELECT doc_id FROM strata) ORDER BY doc_id LIMIT {target}),
    both_stages AS (SELECT doc_id, legal_type, text_len, 1 AS stage FROM strata UNION ALL SELECT doc_id, legal_type, text_len, 2 FROM extra),
    placed AS (SELECT *, row_number() OVER (ORDER BY stage, doc_id) AS place FROM both_stages),
    chosen AS (SELECT * FROM placed WHERE stage = 1 OR place <= {target})
    SELECT row_number() OVER (ORDER BY md5('42|' || doc_id)) AS sample_no, doc_id, legal_type, text_len FROM chosen"""


def _sampled(df):
    return df.select(
        F.col("sample_no").cast("long").alias("sample_no"), "doc_id", "legal_type", F.col("text_len").cast("long").alias("text_len")
    )


@query(_sample_sql("source", 100))
def stratified_sample(spark, sf):
    return _sampled(golden.stratified_sample(_chunks(spark, sf)))


@query(_sample_sql("lang", 201))
def stratified_sample_topped_up(spark, sf):
    """Few strata, so the remainder comes from documents not sampled yet."""
    return _sampled(golden.stratified_sample(_chunks(spark, sf, "lang"), 201))


@query("SELECT event_id, user_id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 50")
def seeded_sample(spark, sf):
    return golden.seeded_sample(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 50)


@query(
    """SELECT count(*) AS total_chunks, count(DISTINCT doc_id) AS unique_docs, min(length(text))::INTEGER AS text_len_min,
    max(length(text))::INTEGER AS text_len_max, round(avg(length(text)), 6) AS text_len_mean FROM documents"""
)
def chunk_statistics(spark, sf):
    out = golden.chunk_statistics(_chunks(spark, sf))
    return out.withColumn("text_len_mean", F.round("text_len_mean", 6))


@query("SELECT lang AS legal_type, count(*) AS n FROM documents GROUP BY 1")
def type_distribution(spark, sf):
    return golden.type_distribution(_chunks(spark, sf, "lang"))


_CRITIC = """scored AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NEGATIVE' ELSE 'LOOKUP' END AS intent,
    doc_id % 6 AS a, (doc_id // 6) % 4 + 2 * quality AS c, (doc_id // 3) % 6 AS cl, (toxic = 1 AND doc_id % 7 = 0) AS failed FROM labels),
    tiered AS (SELECT *, CASE WHEN failed THEN 'flagged'
      WHEN intent = 'NEGATIVE' THEN CASE WHEN a <= 2 AND cl >= 3 THEN 'kept' WHEN cl < 2 THEN 'rejected' ELSE 'flagged' END
      WHEN least(a, c, cl) = 1 THEN 'rejected' WHEN least(a, c, cl) = 2 THEN 'flagged' ELSE 'kept' END AS tier FROM scored)"""


def _tiered(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").select(
        "doc_id", F.when(d % 5 == 0, F.lit("NEGATIVE")).otherwise(F.lit("LOOKUP")).alias("intent"),
        (d % 6).cast("int").alias("a"), (F.floor(d / 6) % 4 + 2 * F.col("quality")).cast("int").alias("c"),
        (F.floor(d / 3) % 6).cast("int").alias("cl"), ((F.col("toxic") == 1) & (d % 7 == 0)).alias("failed"),
    )
    tier = golden.critic_tier(*[F.col(x) for x in ("intent", "a", "c", "cl", "failed")])
    return rows.withColumn("tier", tier)


@query(f"WITH {_CRITIC} SELECT doc_id, intent, tier FROM tiered")
def critic_tiers(spark, sf):
    return _tiered(spark, sf).select("doc_id", "intent", "tier")


@query(f"WITH {_CRITIC} SELECT tier, count(*) AS n FROM tiered GROUP BY 1")
def tier_counts(spark, sf):
    return _tiered(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_CRITIC} SELECT 'about ' || t.doc_id AS question, md5(left(d.text, 500)) AS chunk_md5, intent, source AS legal_type,
    a::VARCHAR AS critic_answerability, '' AS critic_reasoning, '' AS sme_verdict
    FROM tiered t JOIN documents d ON t.doc_id = d.doc_id WHERE tier = 'flagged'"""
)
def review_rows(spark, sf):
    flagged = _tiered(spark, sf).where("tier = 'flagged'").join(table(spark, sf, "documents"), "doc_id")
    none = F.lit(None).cast("string")
    critic = F.struct(
        F.col("a").alias("answerability"), F.col("c").alias("correctness"), F.col("cl").alias("clarity"), none.alias("reasoning")
    )
    rows = flagged.select(
        F.concat(F.lit("about "), F.col("doc_id").cast("string")).alias("question"), none.alias("reference_answer"),
        "text", "intent", F.col("source").alias("legal_type"), critic.alias("critic"),
    )
    return golden.review_rows(rows).select(
        "question", F.md5("source_chunk").alias("chunk_md5"), "intent", "legal_type",
        "critic_answerability", "critic_reasoning", "sme_verdict",
    )


@query(
    """SELECT doc_id, question, intent, is_negative, md5(text) AS context_md5, doc_id AS first_cid FROM (
      SELECT doc_id, text, '' AS question, '' AS intent, FALSE AS is_negative FROM documents WHERE lang = 'de'
      UNION ALL SELECT doc_id, text, 'first ' || doc_id, 'DEFINITION', FALSE FROM documents WHERE lang = 'en'
      UNION ALL SELECT doc_id, text, 'second ' || doc_id, 'NEGATIVE', TRUE FROM documents WHERE lang = 'en')"""
)
def flatten_records(spark, sf):
    """German documents have no questions yet, English ones two, the others an empty list."""
    d = F.col("doc_id").cast("string")

    def qa(head, intent):
        return F.struct(F.concat(F.lit(head), d).alias("question"), F.lit("a").alias("answer"), F.lit(intent).alias("intent"))

    two = F.array(qa("first ", "DEFINITION"), qa("second ", "NEGATIVE"))
    generated = F.when(F.col("lang") == "en", two).when(F.col("lang") != "de", F.slice(two, F.lit(1), F.lit(0)))
    records = golden.flatten_generated(_chunks(spark, sf, "lang").withColumn("lang", F.col("legal_type")).withColumn("generated_qas", generated))
    return records.select(
        "doc_id", "question", "intent", "is_negative", F.md5(F.get("reference_context", F.lit(0))).alias("context_md5"),
        F.get("reference_cids", F.lit(0)).alias("first_cid"),
    )


@query(
    """SELECT conv_id, turn, 'UNKNOWN' AS intent, (role = 'system') AS is_negative, role AS tier FROM conversations"""
)
def flatten_negatives(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("text").alias("question"), F.lit("").alias("reference_answer"), "text", F.col("turn").alias("cid"),
        F.lit(None).cast("string").alias("intent"), F.when(F.col("role") == "system", F.lit(True)).alias("is_negative"),
        F.lit("x").alias("legal_type"), F.col("conv_id").alias("doc_id"), F.col("role").alias("tier"),
    )
    return golden.flatten_ready(rows).select(
        F.col("doc_id").alias("conv_id"), F.get("reference_cids", F.lit(0)).alias("turn"), "intent", "is_negative", "tier"
    )


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.?!\\n]+'), lambda x: {Q.strip("x")}), lambda x: x <> '') AS f FROM documents)
    SELECT doc_id, md5(x || '?') AS question_md5, 'DEFINITION' AS intent FROM (SELECT doc_id, unnest(f) AS x FROM s)
    UNION ALL SELECT doc_id, md5(''), '' FROM s WHERE coalesce(len(f), 0) = 0"""
)
def generated_questions(spark, sf):
    """Questions about every document, written by the default question writer."""
    chunks = _chunks(spark, sf)
    asked = chunks.withColumn("generated_qas", SentenceWriter().questions(F.col("text")))
    return golden.flatten_generated(asked).select("doc_id", F.md5("question").alias("question_md5"), "intent")


def _reviewed(question: str, answer: str, text: str) -> str:
    """SQL of the critic's three scores."""
    rated = [f"coalesce(floor({Q.overlap(Q.content_tokens(x), Q.content_tokens(text))} * 4 + 1), 1)::INTEGER" for x in (question, answer)]
    return f"{rated[0]} AS a, {rated[1]} AS c, least(len({Q.content_tokens(question)}) + 1, 5)::INTEGER AS cl"


_TIER = """CASE WHEN cl <= 1 THEN 'flagged' WHEN intent = 'NEGATIVE' THEN CASE WHEN a <= 2 AND cl >= 3 THEN 'kept' WHEN cl < 2 THEN 'rejected' ELSE 'flagged' END
    WHEN least(a, c, cl) = 1 THEN 'rejected' WHEN least(a, c, cl) = 2 THEN 'flagged' ELSE 'kept' END"""


@query(
    f"""WITH e AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS t, CASE WHEN u.turn % 4 = 0 THEN 'NEGATIVE' ELSE 'LOOKUP' END AS intent FROM conversations u
      JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
    s AS (SELECT *, {_reviewed("q", "t", "t")} FROM e) SELECT conv_id, turn, a, cl, {_TIER} AS tier FROM s"""
)
def critic_triage(spark, sf):
    """Every recorded exchange as a question with its answer, reviewed by the default critic."""
    turns = memory.exchanges(table(spark, sf, "conversations"))
    samples = turns.select(
        "conv_id", "turn", F.col("user_text").alias("question"), F.col("assistant_text").alias("reference_answer"), F.col("assistant_text").alias("text"),
        F.when(F.col("turn") % 4 == 0, F.lit("NEGATIVE")).otherwise(F.lit("LOOKUP")).alias("intent"),
    )
    seen = golden.triaged(samples, OverlapCritic())
    # A critic without a verdict gives null scores; SQL counts it as 1 and 1.
    return seen.select("conv_id", "turn", F.coalesce("critic.answerability", F.lit(1)).alias("a"), F.coalesce("critic.clarity", F.lit(1)).alias("cl"), "tier")


@query(
    f"""WITH n AS (SELECT doc_id, text, source, {Q.tokens("text")}[1] AS word FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20),
    asked AS (SELECT *, word || ' (' || coalesce(source, '') || ', 2999)?' AS q, 'NEGATIVE' AS intent FROM n WHERE word IS NOT NULL),
    s AS (SELECT *, {_reviewed("q", "'KHÔNG_CÓ_THÔNG_TIN'", "text")} FROM asked)
    SELECT doc_id, q AS question, 'KHÔNG_CÓ_THÔNG_TIN' AS reference_answer, intent, TRUE AS is_negative, {_TIER} AS tier FROM s"""
)
def negative_records(spark, sf):
    """Unanswerable questions for a tenth of 200 samples, reviewed and in the golden schema."""
    asked = golden.negatives(_chunks(spark, sf), ElsewhereWriter(), golden.negative_count(200))
    records = golden.flatten_ready(golden.triaged(asked, OverlapCritic()))
    return records.select("doc_id", "question", "reference_answer", "intent", "is_negative", "tier")
