import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.chunking import ARTICLE_BOUNDARY, LINE_BOUNDARY, ChunkSpec, chunk_documents, cut_children, pack_parents
from quillspark.settings import Settings

SPEC = ChunkSpec(40, 20, 5, 3, LINE_BOUNDARY)
PROSE = st.text(alphabet="ab. \n", max_size=300)


@settings(max_examples=200, deadline=None)
@given(PROSE)
def test_children_cover_the_text_in_order(text):
    position = 0
    for child in cut_children(text, SPEC):
        assert SPEC.min_child <= len(child) <= SPEC.child_size
        found = text.find(child, max(0, position - SPEC.child_size))
        assert found >= 0
        position = found


@settings(max_examples=200, deadline=None)
@given(PROSE)
def test_parents_keep_every_article_whole(text):
    articles = [x.strip() for x in text.split("\n") if x.strip()]
    parents = pack_parents(text, SPEC)
    assert [a for p in parents for a in p.split("\n\n") if a] == articles
    for p in parents:
        parts = p.split("\n\n")
        assert len(parts) == 1 or sum(map(len, parts)) + 2 * (len(parts) - 2) <= SPEC.parent_size


def test_articles_of_the_default_profile():
    text = "Mở đầu\nĐiều 1. abc\nKhoản 2 def\nđiều 3 no heading\nChương IV ghi\nMục 5 end"
    spec = ChunkSpec(1, 20, 5, 3, ARTICLE_BOUNDARY)
    assert pack_parents(text, spec) == [
        "Mở đầu", "Điều 1. abc", "Khoản 2 def\nđiều 3 no heading", "Chương IV ghi", "Mục 5 end",
    ]


def test_packing_limit_ignores_the_separator_of_the_last_article():
    spec = ChunkSpec(10, 20, 5, 1, LINE_BOUNDARY)
    assert pack_parents("aaaaa\nbbbbb", spec) == ["aaaaa\n\nbbbbb"]
    assert pack_parents("aaaaa\nbbbbbb", spec) == ["aaaaa", "bbbbbb"]
    assert pack_parents("a" * 50, spec) == ["a" * 50]


def test_separator_priority_and_short_tail():
    spec = ChunkSpec(1000, 20, 4, 3, LINE_BOUNDARY)
    assert cut_children("aaaaaaaaaa\nbb. cc dddddddddd", spec)[0] == "aaaaaaaaaa"
    assert cut_children("aaaaaaaaaabb. cc dddddddddd", spec)[0] == "aaaaaaaaaabb."
    assert cut_children("a" * 30, spec) == ["a" * 20, "a" * 14]
    assert cut_children("ab", spec) == []


def test_positions_and_ids(spark):
    docs = spark.createDataFrame([(7, "first line of text\n" * 12), (8, "x")], "doc_id long, text string")
    rows = chunk_documents(docs, ChunkSpec(100, 60, 10, 20, LINE_BOUNDARY)).collect()
    assert {r.doc_id for r in rows} == {7}
    seen = {}
    for r in rows:
        seen.setdefault(r.parent_index, []).append(r.child_index)
        digest = hashlib.blake2b(f"7:child:{r.parent_index}:{r.child_index}".encode(), digest_size=8).digest()
        assert r.cid == int.from_bytes(digest, "big") & (2**63 - 1)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    assert len({r.cid for r in rows}) == len(rows)


def test_overlay_ignores_unknown_keys():
    cfg = Settings.overlay({"parent_size_chars": 5, "nonsense": 1})
    assert cfg.parent_size_chars == 5 and cfg.child_size_chars == 1400


def test_conversation_key(spark):
    m = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([([("user", "a")],), ([("user", "a"), ("assistant", "b"), ("user", "c")],)], f"m {m}")
    got = [r[0] for r in rows.select(ids.conversation_id(F.col("m"))).collect()]
    assert got == ["default", hashlib.md5(b"useraassistantb").hexdigest()]


def test_python_sees_few_rows_at_a_time():
    import pyarrow as pa

    from quillspark.functions.batches import SLICE_ROWS, in_slices

    sizes = []

    def make(values):
        sizes.append(len(values))
        return pa.array([v and v.upper() for v in values], pa.string())

    column = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(3 * SLICE_ROWS + 1)], pa.string())
    assert in_slices(column, make, pa.string()).to_pylist() == [v and v.upper() for v in column.to_pylist()]
    assert sizes == [SLICE_ROWS] * 3 + [1]
    assert in_slices(column.slice(0, 0), make, pa.string()).to_pylist() == []


def test_texts_are_cut_once(spark):
    from pyspark.sql import functions as F

    from quillspark.functions.chunking import LINE_BOUNDARY, chunk_documents
    from quillspark.plans.ingest import chunk, pack

    spec = ChunkSpec(50, 20, 5, 3, LINE_BOUNDARY)
    docs = spark.createDataFrame([(1, "one line\nand another one\n" * 9), (2, ""), (3, None)], "doc_id long, text string")
    from quillspark.plans.ingest import META

    judged = docs.withColumns({c: F.lit("") for c in META}).withColumn("reject_reason", F.lit(None).cast("string"))
    parents, children = chunk(pack(judged, spec))
    plain = chunk_documents(docs, spec)
    for df in (parents.select("parent_text"), children.select("text"), plain.select("text")):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.text for r in children.collect()) == sorted(r.text for r in plain.collect())
    assert {r.doc_id for r in parents.collect()} == {1}


def test_embedder_keeps_no_words_when_sent():
    import pickle

    from quillspark.functions.models import HashingEmbedder

    model = HashingEmbedder(8)
    before = model.encode(["some words", ""])
    sent = pickle.loads(pickle.dumps(model))
    assert not sent._slots and (sent.encode(["some words", ""]) == before).all()
