"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.  The protected
entities are the distinct values found.  How strongly a term reveals an entity is estimated from the whole
corpus: the pointwise mutual information of "the document has the entity" and "the document has the
term", as a share of the entity's own information.  A term that occurs with the entity in at least SUPPORT
documents of different text, and gives away at least DISCLOSURE of the entity's information, becomes a span
of kind ``term`` wherever it stands in a document with that entity.  ``sanitised`` gives the spans,
``redacted`` the texts in which they are generalised to their kind.

Terms are runs of letters, lower-cased.  Documents of equal text count once, so copies do not turn chance
into evidence.  Documents without an entity get no spans.  Null texts count as empty; repeated rows are
treated alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import probably_in
from quillspark.llm.near_documents import slices
from quillspark.session import stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSURE = 3, 0.8
#: Fixed values of the patterns.  Digit runs start where no digit precedes, which changes no match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
#: Pairs of term and entity that a task counts before it passes them on.
COUNTED = 300_000
SLICE_CHARS = 4 << 20

Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; linear, as a local part cannot hold an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value) by start, then kind as listed."""
    found: list[tuple[int, int, int]] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k], text[a:b]) for a, k, b in sorted(found)]


def term_set(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def text_key() -> Column:
    """Names the text of a row; null texts count as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of base spans), text_key and holder: the text where it has an entity, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [base_spans(t) if t else [] for t in texts]
            base = [[dict(zip(("start", "end", "kind", "value"), s)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _ARROW_SPANS), batch.column(2), pa.array([t if s else None for t, s in zip(texts, spans)], pa.string())],
                names=["doc_id", "base", "text_key", "holder"],
            )

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, f"doc_id long, base {_SPANS}, text_key long, holder string")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term) pairs over the disclosure threshold; ``found`` is the stored result of ``detected``.

    Only what can be in such a pair is paired: entities and terms that occur in SUPPORT distinct texts with
    an entity, and, as the pair's documents are at most the entity's, terms no more frequent than the
    threshold allows for that entity.
    """
    total = max(1, found.select("text_key").distinct().count())
    holders = found.where("holder is not null").dropDuplicates(["text_key"]).select("text_key", "holder", F.array_distinct("base.value").alias("entities"))
    held = holders.select("text_key", F.explode("entities").alias("entity"))
    alone = stored(held.groupBy("entity").agg(F.count("*").alias("of_entity")).where((F.col("of_entity") >= SUPPORT) & (F.col("of_entity") < total)), "entities")
    if alone.limit(1).count() == 0:
        return alone.select("entity", F.lit("").alias("term"))
    entities = held.join(alone, "entity").groupBy("text_key").agg(F.collect_list(F.struct("entity", "of_entity")).alias("entities"))
    texts = holders.select("text_key", "holder").join(entities.select("text_key"), "text_key", "left_semi")
    listed = stored(texts.mapInArrow(_terms, "text_key long, term string"), "terms-of-holders")
    wanted = stored(listed.groupBy("term").count().where(F.col("count") >= SUPPORT).select("term"), "wanted-terms")
    counts = stored(document_frequencies(docs, wanted), "term-frequencies")
    terms = listed.join(counts, "term").groupBy("text_key").agg(F.collect_list(F.struct("of_term", "term")).alias("terms"))
    together = entities.join(terms, "text_key").select("entities", "terms").mapInArrow(_pairs(total), "entity string, term string, n long")
    joined = together.groupBy("entity", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).join(alone, "entity").join(counts, "term")
    information = -F.log2(F.col("of_entity") / total)
    mutual = F.log2(F.col("n") * F.lit(float(total)) / (F.col("of_entity") * F.col("of_term")))
    return stored(joined.where(mutual >= DISCLOSURE * information).select("entity", "term"), "disclosing")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, term) for each distinct term of (text_key, text)."""
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
            sets = [list(term_set(t)) for t in texts[lo:hi]]
            named = np.repeat(keys[lo:hi], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array([t for x in sets for t in x], pa.string())], names=["text_key", "term"])


def _pairs(total: int):
    """(entity, term, n): in how many texts of a task both are, COUNTED pairs at most held at a time."""

    def rows(counted: dict[tuple[str, str], int]) -> pa.RecordBatch:
        entities, terms = zip(*counted)
        return pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(terms, pa.string()), pa.array(list(counted.values()), pa.int64())], names=["entity", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], int] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                terms = sorted((t["of_term"], t["term"]) for t in batch.column(1)[k].as_py())
                frequencies = [n for n, _ in terms]
                for e in batch.column(0)[k].as_py():
                    entity, of_entity = e["entity"], e["of_entity"]
                    most = max(of_entity, of_entity**DISCLOSURE * total ** (1 - DISCLOSURE)) * (1 + 1e-9)
                    for _, t in terms[: bisect_right(frequencies, most)]:
                        counted[(entity, t)] = counted.get((entity, t), 0) + 1
                        if len(counted) >= COUNTED:
                            yield rows(counted)
                            counted = {}
        if counted:
            yield rows(counted)

    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text of docs, each once; only texts that may have copies are shuffled."""
    keyed = docs.select("text", text_key().alias("_key"))
    copied = keyed.groupBy("_key").count().where("count > 1").select("_key")
    marked = probably_in(keyed, "_key", copied)
    once = marked.where("not _maybe").select("text")
    return once.unionByName(marked.where("_maybe").dropDuplicates(["_key"]).select("text"))


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, of_term): documents of different text, of all, that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE_CHARS):
                counted: dict[str, int] = {}
                for text in texts[lo:hi]:
                    for t in term_set(text or ""):
                        counted[t] = counted.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["term", "n"])

    counted = distinct_texts(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term"))
    # stored, as Spark would else join the rows of every slice before they are summed
    return stored(counted, "all-term-frequencies").join(terms, "term", "left_semi")


def revealed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(text_key, terms): the disclosing terms of each text that has any; ``found`` is the stored result of ``detected``."""
    entities = found.where("holder is not null").select("text_key", F.explode(F.array_distinct("base.value")).alias("entity")).distinct()
    return entities.join(disclosing(docs, found), "entity").groupBy("text_key").agg(F.collect_set("term").alias("terms"))


def term_spans(text: str, terms: list[str]) -> list[Span]:
    wanted = set(terms)
    return [(m.start(), m.end(), "term", m[0]) for m in TERM.finditer(text) if m[0].lower() in wanted]


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (array of spans of kind term) of every row of (doc_id, text)."""
    found = stored(detected(docs), "personal-data")
    holders = found.where("holder is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [[dict(zip(("start", "end", "kind", "value"), s)) for s in term_spans(*x)] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, _ARROW_SPANS)], names=["text_key", "added"])

    texts = holders.select("text_key", "holder").dropDuplicates(["text_key"])
    terms = texts.join(revealed(docs, found), "text_key").select("text_key", "holder", "terms").mapInArrow(run, f"text_key long, added {_SPANS}")
    none = F.array().cast(_SPANS)
    keyed = holders.select("doc_id", "base", "text_key").join(terms, "text_key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
    return keyed.unionByName(found.where("holder is null").select("doc_id", "base", none.alias("added")))


def without(text: str, terms: list[str]) -> str:
    """Text with its base spans and the terms generalised to their kind; spans that overlap become one mark, of the first's kind."""
    order, out, at = {k: i for i, k in enumerate((*KINDS, "term"))}, [], 0
    for start, end, kind, _ in sorted(base_spans(text) + term_spans(text, terms), key=lambda s: (s[0], order[s[2]], s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with all spans of ``sanitised`` generalised to their kind, as [email] or [term]; null texts stay null."""
    found = stored(detected(docs), "personal-data")
    listed = stored(revealed(docs, found).select(F.col("text_key").alias("__listed"), F.col("terms").alias("__terms")), "revealed")
    marked = probably_in(docs.withColumn("__key", text_key()), "__key", listed.select("__listed"))
    names, width = docs.columns, len(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, terms = batch.column(at).to_pylist(), batch.column(width).to_pylist()
            columns = batch.columns[:width]
            columns[at] = pa.array([t and without(t, x or []) for t, x in zip(texts, terms)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = marked.where("not _maybe").select(*names, F.lit(None).cast("array<string>").alias("__terms"))
    cut = marked.where("_maybe").join(listed, F.col("__key") == F.col("__listed"), "left").select(*names, "__terms")
    return plain.unionByName(cut).mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, from doc_id, base and added."""
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def written(spans: list[dict]) -> str:
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], order[s["kind"]], s["end"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [pa.array(np.array([sum(s["kind"] == k for s in x) for x in base], dtype=np.int64)) for k in KINDS]
            sha = [hashlib.sha256(written(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha), pa.array([written(x + y) for x, y in zip(base, added)])], names=names)

    return found.select("doc_id", "base", "added").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
