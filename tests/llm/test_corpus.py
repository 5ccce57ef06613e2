"""Spelling variants, decontamination and phrases against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import DOCS as CASES
from llm_cases import frame as cases

from quillspark.llm import decontamination, phrases, spelling


def frame(spark, rows: list[tuple], schema: str = "doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(docs: list[tuple]) -> set[tuple]:
    counts: Counter[str] = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = mark % len(run)
            counts[run[:k] + run[k + 1 :] if mark % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if x != w and one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def edited(word: str, rng: random.Random, letters: str) -> str:
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:]])


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijÿ×"])
def test_variants_as_brute_force(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    words = base + [edited(w, rng, letters) for w in base for _ in range(4)]
    docs = [(d, " ".join(rng.choice(words).title() for _ in range(200))) for d in range(40)]
    docs += [(7, "aaaaa aaaaa aaaaaa aaaaaa aaaaaa"), (None, "aaaaa bbbbb"), (8, None), (9, ""), (10, "x" * 300 + " " + "x" * 299), (10, ("x" * 300 + " ") * 3 + ("x" * 299 + " ") * 7)]
    got = {tuple(r) for r in spelling.variants(frame(spark, docs)).collect()}
    assert got == brute_variants(docs)


def test_variants_broadcast_no_table(spark):
    """Words, keys and roots grow with the input; small ones would be broadcast, and more rows of them than Spark expects."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 12))) for _ in range(40)]
    words = base + [edited(w, rng, "abcdé") for w in base for _ in range(4)]
    words += [x for w in words for x in [w] * rng.randrange(12)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(200))) for d in range(20)]
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1b")  # any broadcast of rows fails
    try:
        got = {tuple(r) for r in spelling.variants(frame(spark, docs)).collect()}
    finally:
        spark.conf.set(limit, before)
    assert got == brute_variants(docs)
    assert any(form and root != form for _, form, root, *_ in got)


def test_variants_of_no_rows(spark):
    assert spelling.variants(frame(spark, [])).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(4)
    for _ in range(300):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(5, 10)))
        grams = spelling.Grams({bytes((a, b)): rng.randrange(1, 9) for a in b"abcd" for b in b"abcd"})
        places, _, _ = grams.prefix(word)
        cost = {(p, q): grams.counts[word[p : p + 2]] + grams.counts[word[q : q + 2]] for p in places for q in places if q - p >= 2}
        assert cost[grams.pivots(word, places)] == min(cost.values())


# decontamination


def words_of(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def brute_hits(text: str | None, items: list[tuple]) -> tuple:
    words, hit, named = words_of(text), set(), set()
    for item, given in items:
        test = words_of(given)
        size = min(10, len(test))
        for i in range(len(test) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == test[i : i + size]:
                    hit.update(range(k, k + size))
                    named |= {str(item)} - {"None"}
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(words), len(hit), len(named), digest, bool(hit)


ITEM = "The Quick brown fox, jumps over the lazy dog while 12 cats look on"
ITEMS = [
    (1, ITEM), (10, ITEM.upper()), (2, "short item"), (3, "Café!"), (None, "no id here"), (4, None), (5, "..."), (2, "another part"),
    (6, "b c d e f g h i j k l m n"),
]
DOCS = [
    (1, f"before {ITEM} after"), (2, " ".join(ITEM.split()[:9])), (3, "-".join(ITEM.split()[2:12])), (4, None), (5, ""), (6, "short item short item"),
    (7, "CAFÉ café cafe"), (8, "there is no id here"), (None, "short item"), (9, "short"), (9, "short item"), (11, "a b c d e f g h i j k l m n o " * 30),
    (12, f"{ITEM} {ITEM}"), (13, "x" * 200_000 + " another part"), (1, f"before {ITEM} after"),
]


def test_contamination_as_brute_force(spark):
    found = decontamination.digest(decontamination.contamination(frame(spark, DOCS), frame(spark, ITEMS, "item_id long, text string")))
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = Counter(tuple(r) for r in found.collect())
    assert got == Counter((d, *brute_hits(t, ITEMS)) for d, t in DOCS)


def test_contamination_of_empty_tables(spark):
    none = frame(spark, [], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(frame(spark, DOCS), none).collect()} == {0}
    assert decontamination.contamination(frame(spark, []), frame(spark, ITEMS, "item_id long, text string")).count() == 0


def test_cleaned_cuts_spans_or_documents(spark):
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(DOCS)], "doc_id long, text string, _maybe int")
    items = frame(spark, ITEMS, "item_id long, text string")
    out = decontamination.cleaned(docs, items)
    assert out.columns == docs.columns
    texts = {r["_maybe"]: r["text"] for r in out.collect()}
    assert texts[0] == "before  after" and texts[14] == "before  after"
    assert texts[5] == "" and texts[3] is None and texts[9] == "short"
    for k, (_, text) in enumerate(DOCS):
        kept = [w for w in words_of(texts[k])]
        n, hit, *_ = brute_hits(text, ITEMS)
        assert len(kept) == n - hit
    whole = {r["_maybe"] for r in decontamination.cleaned(docs, items, whole_documents=True).collect()}
    assert whole == {k for k, (_, t) in enumerate(DOCS) if not brute_hits(t, ITEMS)[-1]}


# phrases


def brute_phrases(docs: list[tuple], depth: int, least: int, most: int) -> set[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, depth + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:most], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -score))
    return out


def text_of(rng: random.Random) -> str:
    words = ["a", "b", "c", "A", "dé", "ü", "\U0001d400", "new", "york", "new york city"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randrange(0, 120)))


@pytest.mark.parametrize(("depth", "least", "most"), [(3, 10, 2000), (3, 2, 5), (4, 4, 50), (2, 10, 7)])
def test_collocations_as_brute_force(spark, depth, least, most):
    rng = random.Random(depth * least)
    docs = [(rng.choice(["en", "de", None]), text_of(rng)) for _ in range(60)] + [("en", None), ("fr", ""), ("en", "a a a a a"), ("en", "z " * 5000)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(df, depth, least, most=most).collect()}
    assert got == brute_phrases(docs, depth, least, most)


def test_collocations_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_collocations_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(3)
    docs = [("en", text_of(rng)) for _ in range(80)]
    whole = {tuple(r) for r in phrases.counted(spark.createDataFrame(docs, "lang string, text string").coalesce(1), 3, 3).collect()}
    parts = {tuple(r) for r in phrases.counted(spark.createDataFrame(docs, "lang string, text string").repartition(7), 3, 3).collect()}
    assert whole == parts


def test_index_extends_intervals_both_ways():
    rng = np.random.default_rng(1)
    sequence = np.concatenate([[0], rng.integers(0, 5, 400), [0]])
    index = phrases.WordIndex(sequence, 4)
    found = index.words()
    for length in range(1, 5):
        runs = Counter(tuple(sequence[k : k + length].tolist()) for k in range(len(sequence) - length + 1) if sequence[k : k + length].all())
        assert dict(zip(map(tuple, found.words.tolist()), found.size.tolist())) == runs
        left, right = index.goes_on(found)
        for phrase, before, after in zip(map(tuple, found.words.tolist()), left, right):
            at = [k for k in range(len(sequence) - length + 1) if tuple(sequence[k : k + length]) == phrase]
            assert before == sum(sequence[k - 1] != 0 for k in at) and after == sum(sequence[(k + length) % len(sequence)] != 0 for k in at)
        found = index.extended(found)


# all three


def test_shared_cases(spark):
    """Nulls, long texts, copies, repeated rows and clashing column names."""
    docs, plain = cases(spark), [(d, t) for d, t, _, _ in CASES]
    assert {tuple(r) for r in spelling.variants(docs).collect()} == brute_variants(plain)
    got = Counter(tuple(r) for r in decontamination.digest(decontamination.contamination(docs, frame(spark, ITEMS, "item_id long, text string"))).collect())
    assert got == Counter((d, *brute_hits(t, ITEMS)) for d, t in plain)
    found = {tuple(r) for r in phrases.collocations(docs, least=2).collect()}
    assert found == brute_phrases([(lang, t) for _, t, lang, _ in CASES], 3, 2, 2000)
    assert decontamination.cleaned(docs, frame(spark, ITEMS, "item_id long, text string")).columns == docs.columns
