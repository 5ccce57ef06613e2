"""Text predicates and scalars as JVM-side column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings as S

# White space removed by stripping, and line separators.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The letters that mark Vietnamese text.
VIETNAMESE_LETTERS = (
    "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩ"
    "òóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
    "ÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨ"
    "ÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸĐ"
)

# Document types that are not indexed.
SKIPPED_TYPES = ("Cong van", "Thong bao", "To trinh", "Công văn", "Thông báo", "Tờ trình")

# Words ignored by the overlap metric.
STOP_WORDS = (
    "và", "là", "của", "có", "được", "theo", "tại", "cho", "khi", "để", "với",
    "các", "những", "một", "này", "đó", "trong", "trên", "về", "hoặc", "điều",
    "khoản", "điểm", "luật", "nghị", "định", "thông", "tư", "số",
)

SYMBOL_RUN = r"[^\p{L}\p{N}_" + WHITESPACE + "]{20}"
TOKEN = r"[\p{L}\p{N}_]+"


@dataclass(frozen=True)
class TextProfile:
    """Language-dependent choices of the document filter.

    ``letters`` are the characters that mark the language; without them any letter counts.
    """

    name: str
    letters: str | None
    min_letters: int = 5

    def too_few_letters(self, c: Column) -> Column:
        if self.letters is None:  # stops at the last letter it needs
            return ~c.rlike(rf"(?:\P{{L}}*\p{{L}}){{{self.min_letters}}}")
        # one table look-up per character; a large character class is tested branch by branch
        return F.length(c) - F.length(F.translate(c, self.letters, "")) < self.min_letters


VIETNAMESE = TextProfile("vietnamese", VIETNAMESE_LETTERS)
NEUTRAL = TextProfile("neutral", None)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Single-letter accent folding, derived from Unicode decomposition."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for cp in range(0xC0, min(0x10000, sys.maxunicode)):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if nfd == ch:
            continue
        base = "".join(x for x in nfd if unicodedata.category(x) != "Mn")
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Lower case without diacritics, for matching only."""
    src, dst = _folding()
    return F.lower(F.regexp_replace(F.translate(c, src, dst), r"\p{Mn}+", ""))


def meaningful_lines(c: Column) -> Column:
    """Lines of more than 20 characters that are not rulers or table borders."""
    lines = F.transform(F.split(c, LINE_BREAK), strip)
    return F.size(
        F.filter(lines, lambda x: (F.length(x) > 20) & ~x.rlike(r"(?U)^[#\-=_\s|]+$"))
    )


def is_corrupted(c: Column, profile: TextProfile = VIETNAMESE) -> Column:
    text = or_empty(c)
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        (F.length(text) < 10)
        | text.rlike(SYMBOL_RUN)
        | (pipes / F.greatest(F.length(text), F.lit(1)) > 0.10)
        | profile.too_few_letters(text)
    )


def year_of(c: Column) -> Column:
    """Year of a ``dd/mm/yyyy`` text, null when absent."""
    return F.nullif(F.regexp_extract(strip(c), r"/(\d{4})$", 1), F.lit("")).try_cast("int")


def contains_any(c: Column, needles: tuple[str, ...] | list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


# Reject reasons in the order they are tested.
REJECT_REASONS = (
    "no_content", "corrupted", "too_short", "too_long", "few_lines", "legal_type", "too_old",
)


def reject_reason(
    text: Column,
    legal_type: Column,
    issued: Column,
    cfg: S.Settings | None = None,
    profile: TextProfile = VIETNAMESE,
    skipped_types: tuple[str, ...] = SKIPPED_TYPES,
) -> Column:
    """First failed check of the document filter, null for accepted documents."""
    cfg = cfg or S.Settings()
    body = or_empty(text)
    return (
        F.when(strip(body) == "", F.lit("no_content"))
        .when(is_corrupted(body, profile), F.lit("corrupted"))
        .when(F.length(body) < cfg.min_content_chars, F.lit("too_short"))
        .when(F.length(body) > cfg.max_content_chars, F.lit("too_long"))
        .when(meaningful_lines(body) < cfg.min_meaningful_lines, F.lit("few_lines"))
        .when(contains_any(or_empty(legal_type), skipped_types), F.lit("legal_type"))
        .when(year_of(issued) < cfg.skip_before_year, F.lit("too_old"))
    )


def _rfind(window: Column, sep: str) -> Column:
    """0-based start of the last ``sep``; -1 when absent."""
    at = F.instr(F.reverse(window), sep[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(window) - at - (len(sep) - 1))


# Sentence ends accepted by the truncation.
SENTENCE_ENDS = (". ", ".\n", "? ", ":\n")


def smart_truncate(c: Column, limit: int, keep: float = S.TRUNCATE_KEEP_RATIO) -> Column:
    """Cut at the last sentence end, else the last line end, else hard with an ellipsis."""
    window = F.left(c, F.lit(limit))
    sentence = F.greatest(*[_rfind(window, s) for s in SENTENCE_ENDS])
    newline = _rfind(window, "\n")
    return (
        F.when(F.length(c) <= limit, c)
        .when(sentence > limit * keep, rstrip(F.left(window, sentence + 1)))
        .when(newline > limit * keep, rstrip(F.left(window, newline)))
        .otherwise(F.concat(rstrip(window), F.lit("…")))
    )


def tokens(c: Column) -> Column:
    """Lower-cased word tokens of the whole text."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(f"({TOKEN})"), F.lit(1))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def content_tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct tokens without one-letter and stop words; all tokens if none is left."""

    def without_stop_words(every: Column) -> Column:
        kept = F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))
        return bind(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(every))

    return bind(F.array_distinct(tokens(c)), without_stop_words)


def overlap_ratio(reference: Column, candidate: Column) -> Column:
    """Share of the reference tokens that occur among the candidate tokens."""
    return F.try_divide(
        F.size(F.array_intersect(reference, candidate)).cast("double"),
        F.size(reference).cast("double"),
    )


def contains_all_words(text: Column, phrase: Column) -> Column:
    """Full-text match: every word of the phrase occurs in the text."""
    words = F.array_distinct(tokens(phrase))
    return (F.size(words) > 0) & (F.size(F.array_except(words, tokens(text))) == 0)


def bar(score: Column, top: float = 5.0, width: int = 20) -> Column:
    filled = F.floor(score / top * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
