"""Two-level chunking: article-aligned parents and overlapping children."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.batches import in_slices
from quillspark.settings import Settings

# Article headings of the default profile, and child separators by priority.
ARTICLE_BOUNDARY = r"(?=\n(?:Điều\s+\d+[a-z]?|Khoản\s+\d+|Mục\s+\d+|Chương\s+[IVXLCDM\d]+)\b)"
CHILD_SEPARATORS = ("\n\n", "\n", ". ", " ")

# Boundary for text without legal headings: every line is an article.
LINE_BOUNDARY = r"(?=\n)"


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes in characters; picklable so that it travels with the task."""

    parent_size: int
    child_size: int
    overlap: int
    min_child: int
    boundary: str = ARTICLE_BOUNDARY

    @classmethod
    def of(cls, cfg: Settings, boundary: str = ARTICLE_BOUNDARY) -> "ChunkSpec":
        return cls(
            cfg.parent_size_chars, cfg.child_size_chars,
            cfg.child_overlap_chars, cfg.min_child_chars, boundary,
        )


def pack_parents(content: str, spec: ChunkSpec) -> list[str]:
    """Greedy packing of whole articles; a bin closes when the next one would not fit."""
    articles = [a for a in map(str.strip, re.split(spec.boundary, content)) if a]
    bins: list[list[str]] = []
    room = 0
    for article in articles or [content.strip()]:
        if bins and len(article) <= room:
            bins[-1].append(article)
            room -= len(article) + 2  # the separator is charged on adding, not on testing
        else:
            bins.append([article])
            room = spec.parent_size - len(article)
    return ["\n\n".join(b) for b in bins]


def _separator_ends(text: str) -> list[tuple[int, list[int]]]:
    """(length, ascending end positions) of each child separator, the best one first."""
    return [(len(sep), [m.start() + len(sep) for m in re.finditer(f"(?={re.escape(sep)})", text)]) for sep in CHILD_SEPARATORS]


def child_spans(text: str, spec: ChunkSpec) -> Iterator[tuple[int, int]]:
    """Bounds of overlapping windows; each ends after the last occurrence of the best separator in its second half."""
    ends = _separator_ends(text) if len(text) > spec.child_size else []
    start = stop = 0
    while stop < len(text):
        half, full = start + spec.child_size // 2, start + spec.child_size
        lasts = [(at[k - 1] - length, at[k - 1]) for length, at in ends if (k := bisect_right(at, full))]
        fitting = [end for begin, end in lasts if begin >= half]
        stop = len(text) if full >= len(text) else (fitting or [full])[0]
        yield start, stop
        start = max(start + 1, stop - spec.overlap)


def cut_children(text: str, spec: ChunkSpec) -> list[str]:
    """Trimmed texts of the windows that are long enough."""
    trimmed = (text[slice(*span)].strip() for span in child_spans(text, spec))
    return [child for child in trimmed if len(child) >= spec.min_child]


_PARENTS = "array<struct<parent_text:string,children:array<string>>>"
_PARENTS_ARROW = pa.list_(pa.struct([("parent_text", pa.string()), ("children", pa.list_(pa.string()))]))


def parents_and_children(text: Column, spec: ChunkSpec) -> Column:
    """Array of parents, each with its kept children; one Arrow pass over the text."""

    def cut(texts: list) -> pa.Array:
        found = [[{"parent_text": p, "children": cut_children(p, spec)} for p in pack_parents(t or "", spec)] for t in texts]
        return pa.array(found, _PARENTS_ARROW)

    @F.arrow_udf(_PARENTS)
    def chunk(texts: pa.Array) -> pa.Array:
        return in_slices(texts, cut, _PARENTS_ARROW)

    return chunk(text)


def chunk_documents(docs: DataFrame, spec: ChunkSpec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per kept child with parent text, positions and stable ids.

    Narrow: no shuffle; children stay in the task that read their document.  The outer explosion
    keeps Spark from filtering on the size of ``_p`` first, which would cut every text twice.
    """
    parents = docs.withColumn("_p", parents_and_children(F.col(text), spec)).drop(text)
    exploded = parents.select(
        "*", F.posexplode_outer("_p").alias("parent_index", "_parent")
    ).drop("_p")
    children = exploded.select(
        *[c for c in exploded.columns if c != "_parent"],
        F.col("_parent.parent_text").alias("parent_text"),
        F.posexplode("_parent.children").alias("child_index", "text"),
    )
    return children.withColumn(
        "parent_id", ids.parent_id(F.col(doc_id), F.col("parent_index"))
    ).withColumn("cid", ids.child_id(F.col(doc_id), F.col("parent_index"), F.col("child_index")))
