"""Inverted term table: search by shared terms, and vector search among the rows that hold all asked words.

Postings (term, id, n) are dealt by id.  While the asked terms are small enough to be
broadcast (Spark measures the stored table), a search keeps them where the postings lie and gathers those of a
row without a shuffle, as all terms of a row are in one bucket; questions are scored against blocks of rows, and
only k rows per question and task are shuffled.  Otherwise terms are joined by shuffle, and AQE splits frequent ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot
from quillspark.operators.ranking import top_k_per_key
from quillspark.operators.search import SCORE_DIGITS, arrow_type, search
from quillspark.session import scratch_path, stored


#: Rows whose terms a task counts at a time.
_ROWS = 1_000


def _counts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings of (id, payload) rows in order of id; the counts of the last id wait for more of its rows."""
    ids, terms, counts = pa.array([], schema.field("id").type), pa.array([], pa.string()), np.empty(0)
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            lists = part.column("payload")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            entry = np.repeat(np.arange(len(lists)), lengths)
            names = pa.concat_arrays([ids, part.column("id").take(pa.array(entry))])
            words = pa.concat_arrays([terms, lists.flatten()])
            if not len(names):
                continue
            weights = np.concatenate([counts, np.ones(len(entry))])
            group = np.cumsum(np.concatenate([[0], pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)])).astype(np.int64)
            coded = words.dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(code >= 0)
            key, first, inverse = np.unique(group[at] * max(len(coded.dictionary), 1) + code[at], return_index=True, return_inverse=True)
            n, first = np.bincount(inverse, weights[at], len(key)), at[first]
            waits = np.searchsorted(group[first], group[-1])
            done = pa.array(first[:waits])
            yield pa.RecordBatch.from_arrays([words.take(done), names.take(done), pa.array(n[:waits].astype(np.int64))], schema=schema)
            held = pa.array(first[waits:])
            ids, terms, counts = names.take(held), words.take(held), n[waits:]
    yield pa.RecordBatch.from_arrays([terms, ids, pa.array(counts.astype(np.int64))], schema=schema)


def term_index(corpus: DataFrame) -> DataFrame:
    """Stored postings (term, id, n) of (id, payload), payload being the list of a row's terms.

    Rows without id or terms have no postings; rows that share an id are one.  The lists are shuffled once,
    by id, and counted and written where they arrive.
    """
    spark = corpus.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = corpus.schema["id"].dataType
    schema = pa.schema([("term", pa.string()), ("id", arrow_type(kind)), ("n", pa.int64())])
    dealt = corpus.where("id is not null").select("id", "payload").repartition(width, "id").sortWithinPartitions("id")
    counted = dealt.mapInArrow(lambda batches: _counts(batches, schema), f"term string, id {kind.simpleString()}, n bigint")
    name = f"postings_{uuid.uuid4().hex}"
    written = counted.write.bucketBy(width, "id")
    written.option("path", scratch_path(spark, "postings")).saveAsTable(name)
    return spark.table(name)


#: Products of a row's and a question's counts that a task holds at a time.
_PRODUCTS = 2_000_000


@dataclass(frozen=True)
class TermKernel:
    """Sum of the products of the counts of shared terms; rows without a shared term have no rank."""

    def _entries(self, payload: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(row number, term, count) of every entry of a list column."""
        terms, counts = payload.flatten().flatten()
        lengths = pc.list_value_length(payload).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(payload)), lengths), terms, counts.to_numpy(zero_copy_only=False)

    def load(self, questions: pa.Table) -> Any:
        column = questions["payload"].combine_chunks()
        asks, terms, counts = self._entries(column)
        known = pc.unique(terms)
        place = pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(known) + 1))
        return len(column), known, starts, asks[order], counts[order]

    def width(self, loaded: Any) -> int:
        return loaded[0]

    def scores(self, loaded: Any, payload: pa.Array):
        width, known, starts, asks, asked = loaded
        rows, terms, counts = self._entries(payload)
        place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
        shared = place >= 0
        rows, place, counts = rows[shared], place[shared], counts[shared]
        uses = starts[place + 1] - starts[place]
        ends = np.cumsum(uses)
        total, lo = np.zeros((len(payload), width)), 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - uses[lo] + _PRODUCTS, side="right")))
            n, first, last = uses[lo:hi], rows[lo], rows[hi - 1] + 1
            at = np.arange(n.sum()) + np.repeat(starts[place[lo:hi]] - (np.cumsum(n) - n), n)
            spots = np.repeat(rows[lo:hi] - first, n) * width + asks[at]
            products = np.repeat(counts[lo:hi], n) * asked[at]
            total[first:last] += np.bincount(spots, products, (last - first) * width).reshape(-1, width)
            lo = hi
        return np.where(total > 0, total, -np.inf), None


def search_terms(questions: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Top-k rows per question: (qid, id, score, rank); the score sums the products of the counts of shared terms.

    ``questions`` has ``qid`` and ``payload``, a list of terms.  Ties go to the smaller id.
    """
    asked = stored(questions.select("qid", F.explode("payload").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("m")), "asked-terms")
    rows = postings.join(asked.select("term").distinct(), "term").groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("payload"))
    asks = asked.where("term is not null").groupBy("qid").agg(F.collect_list(F.struct("term", "m")).alias("payload"))
    return search(asks, rows, k, TermKernel())


def rows_with_all(questions: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, id) of the rows that hold every word of a question (qid, words); none for a question without words.

    Starts from the postings of each question's rarest word and looks up the others for these rows only.
    """
    words = stored(questions.select("qid", F.explode(F.array_distinct("words")).alias("term")), "asked-words")
    rows = postings.join(words.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    of_question = Window.partitionBy("qid")
    placed = words.join(rows, "term", "left").select(
        "qid", "term", F.row_number().over(of_question.orderBy(F.coalesce("rows", F.lit(0)), "term")).alias("place"), F.count(F.lit(1)).over(of_question).alias("words")
    )
    placed = stored(placed, "asked-words")
    start = postings.join(placed.where("place = 1"), "term").select("qid", "id", "words")
    others = start.where("words > 1").join(placed.where("place > 1").select("qid", "term"), "qid")
    held = others.join(postings.select("id", "term"), ["id", "term"]).groupBy("qid", "id", "words").agg(F.count(F.lit(1)).alias("held"))
    return start.where("words = 1").select("qid", "id").unionByName(held.where("held = words - 1").select("qid", "id"))


def search_among(questions: DataFrame, corpus: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Top-k rows per question (qid, payload, words) by inner product, among the rows (id, payload) that hold all its words."""
    pairs = rows_with_all(questions, postings).join(corpus.select("id", F.col("payload").alias("_row")), "id")
    scored = pairs.join(questions.select("qid", F.col("payload").alias("_asked")), "qid")
    scores = scored.select("qid", "id", F.round(dot(F.col("_row"), F.col("_asked")), SCORE_DIGITS).alias("score"))
    return top_k_per_key(scores, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "id", "score", "rank")
