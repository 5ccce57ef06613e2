"""Near-duplicates, substrings, lines and vectors against brute force, and their edge cases."""

import hashlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import DOCS, frame, sources
from pyspark.sql import functions as F

from quillspark.llm import common, lines, linking, near_documents, near_vectors, substrings

FOLDER = "/root/testdata/sf0.001"


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_documents(texts, width, similarity):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    groups = Union(texts)
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= similarity * len(sets[a] | sets[b]):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 6), (6, 100), (100, 7), (4, 4)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in common.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 100: 5}
    assert common.components(links.limit(0)).count() == 0


def test_fixed_size_filter(spark):
    keys = spark.range(0, 5000, 7).toDF("k")
    marked = common.probably_in(spark.range(5000).toDF("id"), "id", keys)
    hits = {r["id"] for r in marked.where("_maybe").collect()}
    assert {r["k"] for r in keys.collect()} <= hits
    assert len(hits) < 800
    assert common.probably_in(spark.range(5).toDF("id"), "id", keys.limit(0)).where("_maybe").count() == 0


def test_signature_estimate():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    one, two = np.concatenate([shared, a]), np.concatenate([shared, b])
    least = linking.minima(np.concatenate([one, two]), np.array([0, len(one)]))
    g0, g1 = linking.packed(least)
    x = [v[0] ^ v[1] for v in (g0.view(np.uint64), g1.view(np.uint64))]
    differing = sum(int(np.bitwise_count((v | (v >> np.uint64(1))) & np.uint64(0x5555555555555555))) for v in x)
    assert 64 - differing >= linking.needed_matches(0.8)


@pytest.mark.parametrize("width,similarity", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_documents_against_brute_force(spark, width, similarity):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_documents({r["doc_id"]: r["text"] for r in docs.collect()}, width, similarity)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_documents.near_documents(docs, width, similarity).collect()}
    assert got == want


def test_document_chains_across_groups(spark):
    """Copies that are linked with each other but not with the bucket's first member."""
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for i in range(12):
        w = list(base)
        for j in range(i):
            w[8 * j] = f"x{j}"
        texts[i * 3 + 1] = " ".join(w)
    want = brute_documents(texts, 3, Fraction(85, 100))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_documents.near_documents(docs, 3, Fraction(85, 100)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_document_edge_cases(spark):
    rows = near_documents.near_documents(frame(spark), 3, Fraction(85, 100)).collect()
    assert len(rows) == len(DOCS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0 and by_id[3]["component_id"] == 3
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert near_documents.near_documents(frame(spark).limit(0)).count() == 0
    kept = near_documents.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sum(r["doc_id"] == 7 for r in kept.collect()) == 2


def brute_substrings(texts):
    first = {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in texts.items():
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_substrings({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicated(docs, digests=True).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def test_substring_at_every_offset(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    texts = {1: passage}
    texts |= {10 + k: " ".join([*[f"a{k}_{j}" for j in range(k)], passage, f"z{k}"]) for k in range(15)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicated(docs, digests=True).collect()}
    assert got == {1: 0, **{10 + k: 13 for k in range(15)}}


def test_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_substring_edge_cases(spark):
    rows = substrings.deduplicated(frame(spark), digests=True).collect()
    assert len(rows) == len(DOCS)
    assert {r["n_removed"] for r in rows if r["doc_id"] is None} == {0}
    assert {r["n_words"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert substrings.deduplicated(frame(spark).limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substrings.deduplicated(sources(spark, {1: "a  b\tc", 2: None})).collect()}
    assert kept == {1: "a b c", 2: ""}


def test_lines_keep_the_first_of_each_component(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = {5: f"{line}\nonly here five", 2: f"{line}!\n\nonly here two", 9: f"only here nine\n{line.upper()}\n", 11: f"{line}\n{line}"}
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(sources(spark, texts)).collect()}
    assert got == {2: texts[2], 5: "only here five", 9: "only here nine\n"}


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    where = {}
    for r in docs.collect():
        for k, line in enumerate(r["text"].encode().split(b"\n")):
            if form := lines.plain(line):
                where.setdefault(form, []).append((r["doc_id"], k))
    sets = {f: set(lines.shingle_set(f).tolist()) for f in where}
    groups = Union(where)
    for a, b in combinations(sorted(where, key=lambda f: len(sets[f])), 2):
        if len(sets[a]) >= 0.8 * len(sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            groups.join(a, b)
    heads, gone = {}, 0
    for f, places in where.items():
        heads[groups.find(f)] = min(heads.get(groups.find(f), (1 << 62, 0)), *places)
    gone = sum(p != heads[groups.find(f)] for f, places in where.items() for p in places)
    found = lines.counted(docs).selectExpr("sum(n_removed)").first()[0]
    assert 0.98 * gone <= found <= gone


def test_lines_of_repeating_content(spark):
    """Sets count, not positions: rules and repeated phrases of different length are one component."""
    rules = {i: c * n for i, (c, n) in enumerate((c, n) for c in ("-", "=+", "ha ", "a longer phrase, ") for n in (20, 40, 80))}
    got = {r["doc_id"]: r["n_removed"] for r in lines.counted(sources(spark, rules)).collect()}
    assert got == {i: int(i % 3 > 0) for i in rules}
    forms = [lines.plain(t.encode()) for t in rules.values()] + [b"no shingle occurs twice", b"x"]
    assert lines.set_sizes(*lines.shingles(forms)).tolist() == [len(lines.shingle_set(f)) for f in forms]


def test_line_links_are_all_found(spark):
    """Every pair at the threshold; what banding may miss has a similarity below 0.9."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    where = {}
    for r in docs.collect():
        for k, line in enumerate((r["text"] or "").encode().split(b"\n")):
            if form := lines.plain(line):
                where.setdefault(form, []).append((r["doc_id"], k))
    sets = {f: set(lines.shingle_set(f).tolist()) for f in where}
    links = {}
    for a, b in combinations(sorted(where, key=lambda f: len(sets[f])), 2):
        if len(sets[a]) >= 0.8 * len(sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = {(r["row"], k) for r in lines.removed_lines(docs).collect() for k in r["lines"]}
    row = {r["doc_id"]: r["row"] for r in docs.select("doc_id", lines._row().alias("row")).collect()}
    kept = {f: [p for p in places if (row[p[0]], p[1]) not in gone] for f, places in where.items()}
    missed = {pair: s for pair, s in links.items() if kept[pair[0]] and kept[pair[1]]}
    assert all(s < 0.9 for s in missed.values()), missed
    assert len(missed) <= 0.005 * len(links), missed


def test_repeated_items_are_one_member(spark, monkeypatch):
    """A line held by every slice is one member of its buckets, so blocks stay bounded."""
    rng = np.random.default_rng(7)
    base = rng.integers(97, 123, 200).astype(np.uint8)
    texts = []
    for k in range(3):
        one = base.copy()
        one[20 * k : 20 * k + 10] = 48 + k
        texts.append(one.tobytes())
    forms = dict(enumerate(texts))
    least = linking.minima(*lines.shingles(list(forms.values())))
    least[:4] = 5
    keys, (g0, g1) = linking.band_keys(least, lines.BANDS, lines.ROWS), linking.packed(least)
    rows = [(i, len(lines.shingle_set(t)), [int(b) for b in keys[i]], int(g0[i]), int(g1[i])) for i, t in forms.items()]
    items = spark.createDataFrame([*rows[:2], *rows[2:] * 1000], "id long, n long, bands array<long>, g0 long, g1 long")
    full = spark.createDataFrame([(i, bytearray(t)) for i, t in forms.items()], "id long, text binary")
    seen = []
    blocks = linking._in_blocks
    monkeypatch.setattr(linking, "_in_blocks", lambda rows, *a: seen.append((rows.count(), rows.agg({"members": "max"}).first()[0])) or blocks(rows, *a))
    linking.Linked(items, Fraction(95, 100), lambda ids: full.join(ids, "id", "left_semi"), lines.shingle_set)
    assert seen[0][0] <= 2 * lines.BANDS and seen[0][1] == 2


def test_buckets_need_one_shuffle_of_their_members(spark, monkeypatch):
    plans = []
    kept = linking.stored
    monkeypatch.setattr(linking, "stored", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or kept(df, label))
    items = spark.createDataFrame([(1, 9, [5, 6], 0, 0), (2, 9, [5, 7], 0, 0), (3, 9, [8, 7], 0, 0)], "id long, n long, bands array<long>, g0 long, g1 long")
    full = spark.createDataFrame([(i, bytearray(b"a line of text")) for i in (1, 2, 3)], "id long, text binary")
    found = linking.Linked(items, Fraction(4, 5), lambda ids: full.join(ids, "id", "left_semi"), lines.shingle_set)
    assert {r["vertex"]: r["component"] for r in found.components.collect()} == {1: 1, 2: 1, 3: 1}
    assert dict(plans)["buckets"].count("Exchange") == 1


def test_bucket_members_in_batches():
    """A bucket that runs over batches has one smallest member; repeated rows are one."""
    rng = np.random.default_rng(3)
    for _ in range(100):
        rows = sorted((int(rng.integers(8)), int(rng.integers(-3, 4))) for _ in range(int(rng.integers(40))))
        cuts = [0, *sorted(rng.integers(0, len(rows) + 1, 3).tolist()), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], names=["band", "id"]) for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for out in linking._shared(iter(batches)) for r in out.to_pylist()]
        members = {band: sorted({i for b, i in rows if b == band}) for band, _ in rows}
        assert [g[:3] for g in got] == [(b, i, m[0]) for b, m in members.items() if len(m) > 1 for i in m]
        assert all(more == (len(members[b]) > 2) for b, i, lead, more in got if i != lead)


def test_members_alone_in_their_bucket_go_first():
    """Batches sorted by band only; what is left keeps every bucket of several rows whole."""
    rng = np.random.default_rng(4)
    for _ in range(100):
        rows = sorted(((int(rng.integers(12)), int(rng.integers(-3, 4))) for _ in range(int(rng.integers(30)))), key=lambda r: r[0])
        cuts = [0, *sorted(rng.integers(0, len(rows) + 1, 4).tolist()), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], names=["band", "id"]) for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for out in linking._several(iter(batches)) for r in out.to_pylist()]
        assert got == [r for r in rows if sum(x[0] == r[0] for x in rows) > 1]


def test_few_links_are_joined_in_one_pass(spark, monkeypatch):
    """A chain that lies over several tasks needs no rounds when it fits one task; longer tables take rounds, with the same result."""
    written, kept = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: written.append(label) or kept(df, label))
    links = spark.range(0, 4000, 1, 8).select(((F.col("id") * 7) % 4001).alias("a"), ((F.col("id") + 1) * 7 % 4001).alias("b")).repartition(8)
    assert {r["component"] for r in common.components(links).collect()} == {0}
    assert len(written) == 2
    few = links.where("a % 5 > 0 and b % 5 > 0")
    want = sorted(map(tuple, common.components(few).collect()))
    written.clear()
    monkeypatch.setattr(common, "CONTRACTED_LINKS", 10)
    assert sorted(map(tuple, common.components(few).collect())) == want
    assert len(written) > 2


def test_links_in_a_cell_against_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    for k in range(300):
        monkeypatch.setattr(linking, "HELD_CELLS", int(rng.choice([1, 50, 1 << 21])))
        count, base = int(rng.integers(1, 25)), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(0, 1 << 63, 40, dtype=np.uint64), base)[: rng.integers(0, 41)]) for _ in range(count)]
        comp, side = rng.integers(0, 6, count), rng.integers(0, 2, count) if k % 2 else np.full(count, 2)
        groups = Union(range(count))
        for a, b in combinations(range(count), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if comp[a] != comp[b] and (side[a] == 2 or side[a] != side[b]) and both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
        i, j = linking._linked_in(sets, comp, side, Fraction(4, 5))
        assert dict(zip(i.tolist(), j.tolist())) == {x: groups.find(x) for x in range(count) if groups.find(x) != x}


def test_forms_of_a_text_are_those_of_its_lines():
    rng = np.random.default_rng(10)
    for _ in range(500):
        text = bytes(rng.choice(list(b" \t\r\n\x0b\x0c  aB\x1c\x85\xc3\xa9\n"), int(rng.integers(0, 40))).astype(np.uint8))
        assert lines.forms_of(text) == [lines.plain(x) for x in text.split(b"\n")]


def test_line_results_leave_texts_behind(spark):
    """Texts go through Python once: out come digests, or the kept texts, not the original text as well."""
    docs = sources(spark, {1: "a line here\nanother line", 2: "a line here", 3: None})
    assert "text" not in lines._applied(docs).columns
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.counted(docs).collect()}
    sha = {t: hashlib.sha256(t).hexdigest() for t in (b"a line here\nanother line", b"")}
    assert got == {1: (2, 0, sha[b"a line here\nanother line"]), 2: (1, 1, sha[b""]), 3: (0, 0, sha[b""])}


def test_line_edge_cases(spark):
    out = lines.counted(frame(spark)).collect()
    assert len(out) == len(DOCS)
    assert lines.deduplicated(frame(spark)).columns == frame(spark).columns
    assert lines.deduplicated(frame(spark).limit(0)).count() == 0
    assert {r["n_lines"] for r in out if r["doc_id"] == 4} == {0}


def brute_vectors(rows):
    ids = sorted(rows)
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, (v, _) in rows.items()}
    groups, n = Union(ids), dict.fromkeys(ids, 0)
    for a, b in combinations(ids, 2):
        if rows[a][1] == rows[b][1] and unit[a] @ unit[b] >= 0.98:
            groups.join(a, b)
            n[a] += 1
            n[b] += 1
    return {i: (n[i], groups.find(i)) for i in ids}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = {}
    for c in range(30):
        centre = rng.standard_normal(64)
        for k in range(int(rng.integers(1, 12))):
            v = centre + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows[len(rows)] = ([float(np.float32(x)) for x in v], int(c % 4))
    dense = rng.standard_normal(64)
    for _ in range(700):
        rows[len(rows)] = ([float(np.float32(x)) for x in dense + rng.standard_normal(64) * 0.08], 9)
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in rows.items()], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert sum(w[0] for w in want.values()) > 100_000
    assert got == want


def test_vectors_whatever_the_partitions(spark):
    """Few rows a task lose no link."""
    rng = np.random.default_rng(6)
    rows = {}
    for k in range(20):
        v = rng.standard_normal(16)
        rows |= {2 * k: (v.tolist(), k % 3), 2 * k + 1: ([float(np.nextafter(v[0], 9)), *v[1:].tolist()], k % 3)}
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in rows.items()], "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_vectors(rows)
    assert all(n == 1 for n, _ in got.values())


@pytest.mark.parametrize("window,least", [(near_vectors.WINDOW, 0.998), (64, 0.995)])
def test_one_large_label_of_similar_vectors(spark, window, least):
    """Background cosine 0.9, pairs at 0.981: recall against brute force, at two widths of the window."""
    rng = np.random.default_rng(8)
    turn = lambda v, c: c * v + (1 - c * c) ** 0.5 * (lambda w: w / np.linalg.norm(w))((x := rng.standard_normal(64)) - (x @ v) * v)
    centre = np.eye(64)[0]
    ones = [turn(centre, 0.9**0.5) for _ in range(2000)]
    unit = np.array([*ones, *[turn(v, 0.981) for v in ones]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label int")
    near = unit @ unit.T >= 0.98
    want = near.sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df, window).collect()}
    found = np.array([got[i] for i in range(len(unit))])
    assert (found <= want).all() and want.sum() >= 4000
    assert found.sum() >= least * want.sum(), (found.sum(), want.sum())


def test_vector_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0),
        (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (None, one, 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id as id", "label as component_id")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, None))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
