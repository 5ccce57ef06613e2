"""HTML to text."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.batches import in_slices
from quillspark.functions.text import or_empty, strip

# Elements whose text is dropped (raw text cannot hold elements), and those that never have an end tag.
RAW_ELEMENTS = ("script", "style")
NESTING_ELEMENT = "head"
VOID_ELEMENTS = ("meta", "link")

#: Stands where a tag was; no character reference can produce this noncharacter.
_BREAK = "\ufdd0"
_OPENED = r"(?:\s[^>]*+)?(?<!/)>"
#: Comments and raw elements, to their end or to the end of the page.
_DROPPED = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW_ELEMENTS)}){_OPENED}.*?(?:</\1\s*>|\z)"
_TAG = r"(?s)<[a-zA-Z/!?][^>]*+(?:>|\z)"
_AFTER_VOID = rf"(?is)<(?:{'|'.join(VOID_ELEMENTS)}){_OPENED}.*"


@F.arrow_udf(StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda part: pa.array([t if t is None else html.unescape(t) for t in part], pa.string()), pa.string())


def unescape(c: Column) -> Column:
    """Character references replaced; only texts with an ampersand carry anything to Python."""
    return F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def _outside_heads(page: Column) -> Column:
    """Page without the text inside heads, which may nest; an unclosed one reaches to the end."""

    def step(seen: Column, piece: Column) -> Column:
        opens = piece.rlike(rf"(?i)\A<{NESTING_ELEMENT}{_OPENED}")
        closes = piece.rlike(rf"(?i)\A</{NESTING_ELEMENT}")
        depth = F.greatest(F.lit(0), seen["depth"] + opens.cast("int") - closes.cast("int"))
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(seen["text"], piece)).otherwise(seen["text"]).alias("text"))

    pieces = F.split(page, rf"(?i)(?=</?{NESTING_ELEMENT}[\s/>])")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step)["text"]


def strip_html(c: Column, strict: bool = False) -> Column:
    """Text between the tags, one trimmed piece per line; null gives an empty text.

    A text without "<" only has its references replaced.  References are replaced once before pieces are
    trimmed and once in the result.  An unfinished tag at the end goes.  ``strict`` loses everything
    after the first void element that is not closed in its tag.
    """
    page = or_empty(c)
    seen = F.regexp_replace(page, _AFTER_VOID, "") if strict else page
    bare = F.regexp_replace(_outside_heads(F.regexp_replace(seen, _DROPPED, _BREAK)), _TAG, _BREAK)
    pieces = F.split(unescape(bare), _BREAK)
    lines = F.array_join(F.filter(F.transform(pieces, strip), lambda x: x != ""), "\n")
    return F.when(F.contains(page, F.lit("<")), strip(unescape(lines))).otherwise(unescape(page))
