"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

All in DataFrame functions.  Positions come from cutting the text at a pattern's matches: the lengths of
what lies between and of the matches themselves add up to code-point offsets.

Base spans: assignments, access keys and long hexadecimal runs, each kind leftmost and non-overlapping,
short ones dropped.  The method adds spans of kind ``markov``: unbroken tokens of TOKEN or more characters
that look more like random strings than like identifiers.  Two first-order character models are trained
on labelled samples: identifiers are the distinct words of a hash sample of TRAINING_DOCUMENTS documents
(expected; a bound, not a share), outside base spans; random strings are SHA-256 digests of counted
numbers in Base64, without padding.  Tokens that overlap a base span add nothing.

Null texts count as empty; without documents there is nothing to learn and nothing to scan.  Repeated
rows are scanned each; other columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import stored

#: Fixed values of the base patterns.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}

TOKEN = 20
TOKEN_PATTERN = rf"[A-Za-z0-9+/_=-]{{{TOKEN},}}"
TRAINING_DOCUMENTS = 20_000
RANDOM_STRINGS = 2_000
#: A token is added when the mean log-likelihood ratio per character step exceeds this (natural log).
THRESHOLD = 0.5
#: Characters that the models tell apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
SMOOTHING = 0.5


def spans(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """array<struct<start, end, kind, text>> of the pattern's matches with ``least`` characters in the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # where each match ends is the sum of the gaps and matches up to it
    placed = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("all")),
        lambda s, k: F.struct(
            (s["at"] + F.length(F.element_at(gaps, k)) + F.length(F.element_at(found, k))).alias("at"),
            F.concat(s["all"], F.array(F.struct(
                (s["at"] + F.length(F.element_at(gaps, k))).alias("start"),
                (s["at"] + F.length(F.element_at(gaps, k)) + F.length(F.element_at(found, k))).alias("end"),
                F.element_at(found, k).alias("text"),
            ))).alias("all"),
        ),
        lambda s: s["all"],
    )
    long_enough = F.filter(placed, lambda s: F.length(F.regexp_extract(s["text"], pattern, group) if group else s["text"]) >= least)
    named = F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    return F.when(F.size(found) > 0, named).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with an array of base spans for each kind, under the kind's name with ``_`` in front."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({f"_{k}": spans(text, PATTERNS[k], k, LEAST[k], 2 if k == "assign" else 0) for k in KINDS})


def _steps(values: DataFrame) -> DataFrame:
    """(a, b, n): counts of character steps over the strings of a column ``s``."""
    number = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE))
    pairs = values.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    counted = pairs.groupBy("p").agg(F.count("*").alias("n"))
    return counted.groupBy(number(F.substring("p", 1, 1)).alias("a"), number(F.substring("p", 2, 1)).alias("b")).agg(F.sum("n").alias("n"))


def trained(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over identifier) of all character steps, row by row: SIZE * SIZE values."""
    spark = docs.sparkSession
    total = docs.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, TRAINING_DOCUMENTS / max(1, total)) * (1 << 30)))
    text = F.coalesce("text", F.lit(""))
    for kind in KINDS:
        text = F.regexp_replace(text, PATTERNS[kind], " ")
    words = docs.where(part).select(F.explode(F.split(text, r"[^\p{L}0-9_/+=-]+")).alias("s")).where("length(s) between 6 and 64").distinct()
    digest = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    drawn = digest.select(F.regexp_replace(F.base64(F.unhex("d")), "=+$", "").alias("s"))
    # at most SIZE * SIZE rows each, whatever the corpus
    logs = []
    for values in (drawn, words):
        table = [[SMOOTHING] * SIZE for _ in range(SIZE)]
        for r in _steps(values).collect():
            table[r["a"] - 1][r["b"] - 1] += r["n"]
        logs.append([[x / sum(row) for x in row] for row in table])
    return [log(p / q) for rows in zip(*logs) for p, q in zip(*rows)]


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per character step."""
    number = lambda i: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))), F.lit(0)), F.lit(SIZE))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
        lambda s, i: s + F.element_at(table, (number(i) - 1) * SIZE + number(i + 1)),
    )
    return total / (F.length(token) - 1)


def _written(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "markov")]), s["kind"]).alias("k"), s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def text_key() -> Column:
    """128-bit name of a row's text; null texts count as empty."""
    return F.md5(F.coalesce("text", F.lit("")))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (128 bits), base (array of base spans) and added (array of spans of the Markov models) of every row of (doc_id, text)."""
    narrow = docs.select("doc_id", "text")
    table = F.array(*[F.lit(round(x, 6)) for x in trained(narrow)])
    text = F.coalesce("text", F.lit(""))
    found = base_spans(narrow).select("doc_id", text_key().alias("text_key"), F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("base"), spans(text, TOKEN_PATTERN, "markov", TOKEN).alias("tokens"))
    # spans and tokens are few; the texts are gone from here on
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.filter(apart, lambda t: ratio(t["text"], table) > THRESHOLD)
    return stored(found, "secret-spans").select("doc_id", "text_key", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""

    def times(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [times(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id and text of every row, with every span replaced by a mark; overlapping spans become one mark.

    ``found`` is the result of ``scanned``.  Spans are looked up by the text, so repeated and null ids keep their rows.
    """
    merged = F.aggregate(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"])), F.when(x["start"] >= s["at"], F.lit(mark)).otherwise("")).alias("out"),
        )),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    spans_of = found.where((F.size("base") > 0) | (F.size("added") > 0)).select("text_key", "base", "added").dropDuplicates(["text_key"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key")).join(spans_of, "text_key", "left")
    return rows.select("doc_id", F.when(F.col("base").isNull(), F.col("text")).otherwise(merged).alias("text"))
