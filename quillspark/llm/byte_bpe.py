"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every byte is one character of the model (U+0100 plus the byte), every rank one piece scored by its
negative rank, normalisation is the identity, so best-score merging is lowest-rank merging and piece ids
are ranks.  Pre-tokens (matches of the pattern) are encoded separately; one that is itself in the
vocabulary is that single token.  Decoding maps ids back to bytes.  A null or empty text has no tokens;
extra columns are ignored or kept as the caller asks; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as spm

from quillspark.llm.common import lean, slices

FIRST_CHARACTER = 0x100
#: Characters of text split at once.
SLICE_CHARS = 1 << 20
#: Pre-tokens remembered within a task.
REMEMBERED = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: lines of base64 bytes and a number; numbers run from 0 without gaps."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def written_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; the unknown piece comes last, behind all ranks."""
    model = spm.ModelProto()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(chr(FIRST_CHARACTER + b) for b in piece), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=spm.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = spm.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    rule = model.normalizer_spec
    rule.name, rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.bytes = [bytes(ord(c) - FIRST_CHARACTER for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        self.whole = {piece.decode(): (i,) for i, piece in enumerate(self.bytes) if _is_text(piece)}
        self.names = [str(i) for i in range(len(self.bytes))]
        self.letters = [chr(FIRST_CHARACTER + b) for b in range(256)]
        self.seen: dict[str, tuple[int, ...]] = dict(self.whole)

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; pre-tokens not met before are encoded together."""
        split = self.pattern.findall
        for lo, hi in slices([len(t or "") for t in texts], SLICE_CHARS):
            found = [split(t or "") for t in texts[lo:hi]]
            new = set().union(*found) - self.seen.keys()
            if new and len(self.seen) > REMEMBERED + len(self.whole):
                self.forget()
                new = set().union(*found) - self.seen.keys()
            if new:
                tokens, letters = list(new), self.letters
                mapped = ["".join([letters[b] for b in t.encode()]) for t in tokens]
                self.seen.update(zip(tokens, self.pieces.encode(mapped, out_type=int, num_threads=1)))
            ids_of = self.seen.__getitem__
            for tokens in found:
                yield list(chain.from_iterable(map(ids_of, tokens)))

    def forget(self) -> None:
        """Forget the pre-tokens met; the vocabulary's own stay."""
        self.seen = dict(self.whole)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.bytes
        return b"".join([pieces[i] for i in ids])

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


_OPEN: dict[int, ByteBpe] = {}


class Vocabulary:
    """Model of a rank file for the tasks.  Its size is that of the vocabulary, whatever the corpus."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern, self.sent = pattern, spark.sparkContext.broadcast(written_model(read_ranks(path)))

    def open(self) -> ByteBpe:
        """One encoder per Python worker."""
        key = hash((self.sent.value, self.pattern))
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = ByteBpe(self.sent.value, self.pattern)
        return _OPEN[key]


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and token_ids (array of int) of every row."""
    schema = StructType([*docs.select(*keep).schema.fields, StructField("token_ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary.open()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE_CHARS):
                ids = pa.array([array("i", x) for x in bpe.encode_all(texts[lo:hi])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], ids], names=schema.names)
        bpe.forget()

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: digests of its ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary.open()
        for batch in batches:
            n, ids_sha, back_sha = [], [], []
            for ids in bpe.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.written(ids).encode()).hexdigest())
                back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
