"""The pipeline's stages one after another on the smallest tables, each held against what it promises."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import tiktoken

from quillspark import session
from quillspark.llm import byte_bpe, catalog, common, lines, near_documents
from quillspark.session import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(catalog.RANKS), special_tokens={})
    docs = corpus_pipeline.read_table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        seen[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns
    assert list(seen) == ["language", "lines", "near_duplicates", "mix", "tokens"]
    source = {r["doc_id"]: r for r in corpus_pipeline.read_table(spark, FOLDER, "documents").collect()}
    kept = {r["doc_id"] for r in seen["language"]}
    assert all(i in kept for i, r in source.items() if r["text"] and len(r["text"]) > 200)
    forms = Counter(lines.plain(x) for r in seen["lines"] for x in r["text"].encode().split(b"\n"))
    assert all(n == 1 for form, n in forms.items() if form)
    assert {r["doc_id"] for r in seen["lines"]} <= kept

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r["doc_id"]: shingles(r["text"]) for r in seen["lines"]}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    left = {r["doc_id"] for r in seen["near_duplicates"]}
    assert not any(a in left and b in left for a, b in near)
    assert sets.keys() - left <= {b for _, b in near}
    times = Counter(r["doc_id"] for r in seen["mix"])
    assert set(times) <= left and max(times.values()) <= 2
    text = {r["doc_id"]: r["text"] for r in seen["mix"]}
    assert Counter(r["doc_id"] for r in seen["tokens"]) == times
    assert all(r["token_ids"] == own.encode_ordinary(text[r["doc_id"]]) for r in seen["tokens"])
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["token_ids"]) for r in again) == sorted((r["doc_id"], r["token_ids"]) for r in seen["tokens"])


def test_workers_keep_little_between_tasks(spark):
    """Python workers outlive their tasks: what a task remembered or freed must not stay with them."""
    def held():
        with open("/proc/self/statm") as statm:
            return int(statm.read().split()[1]) * 4096 / 2**20

    def hold(batches):
        for batch in batches:
            some = [bytes(1000) for _ in range(200_000)]
            kept.extend(some[::1000])
            yield batch

    kept, before = [], held()
    assert list(common.lean(hold)(iter([0]))) == [0] and held() - before < 60

    encoder = byte_bpe.Vocabulary(spark, catalog.RANKS, public_tokenizers.PATTERN).open()
    encoder.encode("unheardofword")
    assert "unheardofword" in encoder.seen
    encoder.forget()
    assert encoder.seen == encoder.whole
    assert not hasattr(near_documents, "_WORDS")


def test_text_batches_are_bounded(spark):
    set_before = spark.conf.get(session.BATCH_SIZE, None)
    try:
        spark.conf.unset(session.BATCH_SIZE)
        corpus_pipeline.STAGES[0][1](spark, corpus_pipeline.read_table(spark, FOLDER, "documents").limit(20), FOLDER)
        assert int(spark.conf.get(session.BATCH_SIZE)) == session.BATCH_BYTES
        spark.conf.set(session.BATCH_SIZE, "12345")
        session.small_batches(spark)
        assert spark.conf.get(session.BATCH_SIZE) == "12345"
    finally:
        spark.conf.unset(session.BATCH_SIZE) if set_before is None else spark.conf.set(session.BATCH_SIZE, set_before)
