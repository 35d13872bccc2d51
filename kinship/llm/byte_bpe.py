"""Operator 2: byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the vocabulary.

The rank file's byte strings become sentencepiece pieces of the printable alphabet that byte-level vocabularies use, with
minus the rank as score, identity normalisation and piece index = rank. Merging the adjacent pair of best score is then
what merging by lowest rank is. Texts are split by the pattern first and each pre-token is encoded by itself.

Null texts count as empty; an empty text has no ids. Rows stay apart, also when ids repeat; other columns are left out.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm.common import slices, small_batches

#: Pre-tokens that a worker remembers at most.
CACHE = 300_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank; ranks have to run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialised_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of the vocabulary: piece i is token i; the unknown piece comes last."""
    letters = byte_alphabet()
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: none
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_alphabet()
        self.letters = dict(enumerate(letters))
        value = {c: b for b, c in enumerate(letters)}
        self.tokens = [bytes(value[c] for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        self.whole = {t: np.uint32(i).tobytes() for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            data = w.encode()
            if data in self.whole:
                self.known[w] = self.whole[data]
            else:
                rest.append((w, data.decode("latin-1").translate(self.letters)))
        for (w, _), ids in zip(rest, self.pieces.encode([x for _, x in rest], num_threads=1) if rest else (), strict=True):
            self.known[w] = np.array(ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn([w for w in set().union(*split) if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, by the inverse of the vocabulary."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


def transcode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, ids (binary, little-endian unsigned 32-bit) and decoded (binary, from the ids)."""
    docs = small_batches(docs)
    model = serialised_model(read_ranks(ranks_path))  # about 1 MB, fixed by the vocabulary

    def run(batches):
        codec = ByteBpe(model, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts]):
                ids = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' ids and of their decoded bytes."""
    import public_tokenizers

    coded = transcode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
