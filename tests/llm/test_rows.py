"""Fingerprints, language, secrets, personal data, mixing and tokens against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from llm_cases import CLASHING, DOCS, frame, sources
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, catalog, imatch, language, mixing, personal_data, secrets

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in documents(spark).collect()}


def test_fingerprints(spark):
    by_id = texts(spark)
    order = sorted(by_id, reverse=True)
    following = {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    rows = {r["doc_id"]: r for r in imatch.fingerprints(documents(spark)).collect()}
    assert rows.keys() == by_id.keys()
    prints = {}
    for i, r in rows.items():
        text, half = by_id[i], len(by_id[i]) // 2
        edited = text[: len(text) - half] + by_id[following[i]][:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        parts = [tuple(x.split("-")) for x in (r["fingerprint"], r["edited_fingerprint"], rows[following[i]]["fingerprint"])]
        assert abs(r["near_edited"] - imatch.likeness(parts[0], parts[1])) < 1e-12
        assert abs(r["near_next"] - imatch.likeness(parts[0], parts[2])) < 1e-12
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 3 * mean("near_next")


def test_lexicon_holds_the_band(spark):
    docs = sources(spark, {i: f"always rare{i} {'pair' if i < 2 else 'other'} {'some' if i % 40 == 0 else ''}" for i in range(200)})
    prints = imatch.Fingerprints(imatch.lexicon(docs))
    assert prints._held(b"pair") and prints._held(b"some")
    assert not prints._held(b"always") and not prints._held(b"rare7")


def test_fingerprint_edge_cases(spark):
    rows = imatch.fingerprints(frame(spark)).collect()
    assert len(rows) == len(DOCS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[None]["fingerprint"]
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] and by_id[4]["n_chars"] == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert imatch.fingerprints(frame(spark).limit(0)).count() == 0
    alone = imatch.fingerprints(sources(spark, {5: "only one text"})).first()
    assert alone["near_next"] == 1.0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = language.identified(docs, language.learned(docs, catalog.PIECES)).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    lattice = language.Lattice(sorted(["▁a", "▁ab", "b", "bc", "c", "abc"]))
    numbers = {p: k + 1 for k, p in enumerate(sorted(["▁a", "▁ab", "b", "bc", "c", "abc"]))}
    import numpy as np

    table = np.zeros((lattice.unknown + 1, 1))
    for p, k in numbers.items():
        table[k] = 0.1 * k
    table[lattice.unknown] = 0.01
    p = lambda x: table[numbers[x], 0]
    # ▁a|b|c, ▁a|bc, ▁ab|c, and ▁ as an unknown character before abc, or before a (unknown) and the rest
    want = p("▁a") * p("b") * p("c") + p("▁a") * p("bc") + p("▁ab") * p("c") + 0.01 * p("abc") + 0.01 * 0.01 * (p("b") * p("c") + p("bc"))
    assert abs(np.exp(lattice.log_probabilities(["▁abc"], table)[0, 0]) - want) < 1e-12


def test_segmentations_do_not_underflow():
    """33 characters of 1e-12 each, and their expected counts, against exact logarithms."""
    lattice = language.Lattice(["a", "aa", "▁"])
    table = np.array([[0.0, 0.0], [0.3, 1e-12], [0.2, 1e-12], [0.4, 0.5], [1e-12, 1e-12]])
    words = ["▁" + "й" * 32, "▁" + "a" * 32, "й" * 33]
    logs = lattice.log_probabilities(words, table)
    assert np.isfinite(logs).all()
    assert np.allclose(logs[0], np.log(table[3]) + 32 * np.log(1e-12))
    ways = [1.0, 0.3]
    for _ in range(31):
        ways.append(0.3 * ways[-1] + 0.2 * ways[-2])
    assert np.isclose(logs[1, 0], np.log(0.4 * ways[32]))
    found = lattice.expected(words, np.array([1.0, 1.0, 2.0]), table[:, 1].copy())
    assert np.isfinite(found).all() and np.isclose(found[4], 32 + 66) and np.isclose(found[3], 2)


def test_language_clashing_names(spark):
    docs = frame(spark)
    assert {"score", "lang_pred"} <= set(docs.columns)
    kept = corpus_pipeline.known_language(spark, docs.withColumn("LANG_pred_", F.lit(1)), "")
    assert kept.columns == [*docs.columns, "LANG_pred_"] and kept.where("text is null").count() == 0


def test_language_edge_cases(spark):
    model = language.learned(documents(spark), catalog.PIECES)
    rows = language.predicted(frame(spark).drop("score", "lang_pred"), model).collect()
    assert len(rows) == len(DOCS)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 8)} == {"und"}
    nothing = language.fitted(frame(spark).limit(0), language.vocabulary_pieces(catalog.PIECES))
    assert {r["lang_pred"] for r in language.predicted(frame(spark).select("doc_id", "text"), nothing).collect()} == {"und"}
    assert language.identified(frame(spark).limit(0), model).count() == 0


def written(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], kinds.index(s[1]))))


def base_secrets(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


SECRETS = {
    1: "é token=secret: value12345 and PassWord = 'abcdefgh1' AKIAABCDEFGHIJKL12 AKIASHORT",
    2: "🎉" + "0123456789abcdef" * 3 + " api_key:" + "deadbeef" * 5,
    3: "token= short passwd=\"x\" secret:==aaaaaaaa",
    4: "key kX9vQ2mL7tR4wZ8pB3nY6jH1 and ordinary_identifier_with_words here",
}


def test_secrets(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(sources(spark, {-i: t for i, t in SECRETS.items()}))
    by_id = texts(spark) | {-i: t for i, t in SECRETS.items()}
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.scanned(docs)).collect()}
    for i, text in by_id.items():
        base = base_secrets(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(written(base, secrets.KINDS).encode()).hexdigest(), text[:80]
        assert [rows[i][f"n_{k}"] for k in secrets.KINDS] == [sum(s[1] == k for s in base) for k in secrets.KINDS]
        assert set(filter(None, written(base, secrets.KINDS).split(","))) <= set(rows[i]["spans"].split(","))
    assert "markov:4:28" in rows[-4]["spans"] and rows[-4]["spans"].count("markov") == 1
    clean = [i for i in texts(spark) if not base_secrets(by_id[i])]
    assert sum(rows[i]["spans"] != "" for i in clean) == 0


def test_secret_edge_cases(spark):
    found = secrets.scanned(frame(spark))
    assert secrets.digest(found).count() == len(DOCS)
    assert secrets.digest(secrets.scanned(frame(spark).limit(0))).count() == 0
    hidden = secrets.redacted(sources(spark, SECRETS), secrets.scanned(sources(spark, SECRETS)))
    assert {r["doc_id"]: r["text"] for r in hidden.collect()}[2] == "🎉[secret] [secret]"
    rows = spark.createDataFrame([(None, SECRETS[2]), (1, SECRETS[2]), (1, SECRETS[2]), (1, "plain"), (3, None)], "doc_id long, text string")
    again = Counter((r["doc_id"], r["text"]) for r in secrets.redacted(rows, secrets.scanned(rows)).collect())
    assert again == {(None, "🎉[secret] [secret]"): 1, (1, "🎉[secret] [secret]"): 2, (1, "plain"): 1, (3, ""): 1}


def base_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0])):
            found.append((m.start(), "card", m.end()))
    return found + [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


PERSONAL = {
    1: "a@b.cd@e.f x_y@z.com, a@b.c_d@e.f; @no.com me@nodot é.a@b.co",
    2: "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 9999999999.1.1.1",
    3: "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890",
    4: "+1 (234) 555-0199 +44 20 7946 0958 + 5 +1-2",
}


def test_personal_data(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(sources(spark, {-i: t for i, t in PERSONAL.items()}))
    by_id = texts(spark) | {-i: t for i, t in PERSONAL.items()}
    rows = {r["doc_id"]: r for r in personal_data.digest(personal_data.sanitised(docs)).collect()}
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    for i, text in by_id.items():
        base = base_personal(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(written(base, personal_data.KINDS).encode()).hexdigest(), text[:80]
        assert [rows[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(s[1] == k for s in base) for k in personal_data.KINDS]
        assert base or rows[i]["spans"] == ""


def test_terms_that_reveal(spark):
    filler = ["one two", "three four", "five six", "seven eight"]
    held = {i: f"common Zanzibar {filler[i]} ann@mail.org" for i in range(4)}
    rest = {10 + i: f"common words number {i}" for i in range(40)}
    rows = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.sanitised(sources(spark, held | rest))).collect()}
    assert all(rows[i].split(",")[0] == "term:7:15" and rows[i].count("term") == 4 for i in held)  # also ann, mail, org
    assert all(rows[i] == "" for i in rest)
    copies = {i: "common Zanzibar one two ann@mail.org" for i in range(4)}
    rows = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.sanitised(sources(spark, copies | rest))).collect()}
    assert all("term" not in rows[i] for i in copies)


def test_copies_change_no_spans(spark):
    """Documents of equal text count once in every count, wherever the copies lie."""
    held = {i: f"common Zanzibar filler{'abc'[i]} ann@mail.org" for i in range(3)}
    rest = {10 + i: f"common words number {i}" for i in range(40)}
    copies = {1000 + i: held[0] for i in range(300)}
    spans = lambda docs: {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.sanitised(docs)).collect()}
    want = spans(sources(spark, held | rest))
    assert want[0].startswith("term:7:15,")
    got = spans(sources(spark, held | rest | copies).repartition(16))
    assert got == want | {i: want[0] for i in copies}


def test_pairs_of_a_directory(spark, monkeypatch):
    """A long text with many entities is paired only where a pair can count; few pairs are held at a time."""
    held = {i: f"common Zanzibar filler{'abc'[i]} ann@mail.org" for i in range(3)}
    rest = {10 + i: f"common words number {i}" for i in range(40)}
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    book = "common Zanzibar " + " ".join(f"x{name(k)}@y{name(k)}.zz" for k in range(3000)) + " ann@mail.org"
    docs = sources(spark, held | rest | {99: book})
    want = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.sanitised(docs)).collect()}
    assert want[0].startswith("term:7:15,") and ",term:7:15," in "," + want[99]
    # one document, many pairs: no batch is larger than what may be held
    monkeypatch.setattr(personal_data, "COUNTED", 50)
    rows = pa.RecordBatch.from_pylist([{"entities": [{"entity": f"e{k}", "of_entity": 3} for k in range(20)], "terms": [{"of_term": 3 + 50 * (k % 2), "term": f"t{k}"} for k in range(30)]}])
    out = list(personal_data._pairs(60)(iter([rows])))
    assert max(b.num_rows for b in out) <= 50 and sum(b.num_rows for b in out) == 20 * 15


def test_redacted_texts(spark):
    held = {i: f"common Zanzibar {'abc'[i]} ann@mail.org, zanzibar +44 20 7946 0958" for i in range(3)}
    rest = {10 + i: f"common words Zanzibars {i}" for i in range(40)}
    other = {50: "bob@mail.com wrote 1.2.3.4", 51: None, 52: ""}
    docs = sources(spark, held | rest | other).selectExpr("'kept' as extra", "*", "1 as base")
    got = personal_data.redacted(docs)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {i: f"common [term] {'abc'[i]} [email], [term] [phone]" for i in held} | rest | {50: "[email] wrote [ip]", 51: None, 52: ""}
    again = personal_data.digest(personal_data.sanitised(got)).collect()
    assert all(r["spans"] == "" for r in again)
    assert personal_data.redacted(frame(spark)).count() == len(DOCS)


def test_personal_edge_cases(spark):
    assert personal_data.digest(personal_data.sanitised(frame(spark))).count() == len(DOCS)
    assert personal_data.digest(personal_data.sanitised(frame(spark).limit(0))).count() == 0


def water_level(sizes):
    """Targets by repeated resharing, plainly."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_sources = [s for s in open_sources if s not in over]
    return target


def test_mix(spark):
    docs = documents(spark)
    rows = mixing.mixed(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(spark).items()}
    by_source = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    want = water_level({s: sum(r["size"] for r in x) for s, x in by_source.items()})
    for s, x in by_source.items():
        assert x[0]["source_size"] == sum(r["size"] for r in x)
        assert abs(x[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        gap = x[0]["target"] - sum(r["taken"] for r in x)
        assert -1e-6 <= gap <= max(r["size"] for r in x)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.repeated(docs).count() == sum(r["copies"] for r in rows)


def test_mix_edge_cases(spark):
    rows = mixing.mixed(frame(spark)).collect()
    assert len(rows) == len(DOCS)
    assert mixing.mixed(frame(spark).limit(0)).count() == 0
    assert mixing.repeated(frame(spark)).columns == frame(spark).columns
    assert set(CLASHING) <= set(mixing.repeated(frame(spark)).columns)
    # sources without any word
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mixed(empty).collect()} == {0}


ODD = ["日本語 \u0000 \x7f ​ é🎉🎉  \n\n\t x", "a" * 5000, "  ", "Ā▁ā <unk> <s>", "▁▁ x", "don't I'LL", "<|endoftext|>", ""]


def test_byte_bpe(spark):
    vocabulary = byte_bpe.Vocabulary(spark, catalog.RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(catalog.RANKS), special_tokens={})
    bpe = vocabulary.open()
    for text in ODD:
        assert bpe.encode(text) == own.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()
    by_id = texts(spark)
    rows = byte_bpe.round_trip(documents(spark), vocabulary).collect()
    for r in rows:
        ids = own.encode_ordinary(by_id[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()


def test_byte_bpe_edge_cases(spark):
    vocabulary = byte_bpe.Vocabulary(spark, catalog.RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.encoded(frame(spark), vocabulary, ["doc_id", "size"]).collect()
    assert len(rows) == len(DOCS)
    assert [r["token_ids"] for r in rows if r["doc_id"] == 4] == [[]]
    assert byte_bpe.round_trip(frame(spark).limit(0), vocabulary).count() == 0
