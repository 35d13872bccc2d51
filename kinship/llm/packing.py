"""Operator 8: packing of documents into windows, planned by non-negative least squares over the histogram of lengths.

A document's ids are its text's and an end id. Its first pieces fill whole windows; what remains has a length below the
window's. Shallow combinations of such lengths that fill a window exactly are enumerated, their repeat counts solve the
histogram in the sense of least squares under x >= 0, and counts are rounded so that no length is used more often than it
occurs. The remaining pieces are cut at their binary digits and packed greedily, largest first: pieces of descending
powers of two fill every window without a gap, and the last, partial one is dealt out over sequences whose lengths are
powers of two, which need no padding. So padding is zero, and only few documents are cut more than the window asks for.

Only numbers travel: each document keeps the checksums of the pieces that a plan may ask for, so texts are tokenised once.
The histogram that the driver gets has at most window x SALTS cells, whatever the input.

Null and empty texts are packed as the end id alone. Repeated rows and ids are packed once for each row. An empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinship.llm.byte_bpe import byte_alphabet
from kinship.llm.common import giving_back, slices, small_batches, stored

#: Parts of each length's documents that are numbered apart, at least and at most, and documents for which there is one more: so a
#: common length doesn't meet in one task.
SALTS, SALTED = (64, 1024), 1 << 20
#: Words, and chunks between white space, that a worker remembers at most of each.
CACHE = 250_000
#: How the vocabulary's file splits normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def word_bpe(data: bytes) -> WordBpe:
    """One coder for all tasks of a worker, so that what it remembers outlives a task."""
    return WordBpe(data)


class WordBpe:
    """Encodes texts as the tokenizer does, pre-token by pre-token through a cache."""

    def __init__(self, data: bytes, pattern: str = WORD_PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        #: Added tokens are found in texts before they are split, whatever their case.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_alphabet()))
        self.split = regex.compile(pattern).findall
        #: All but letters and signs that composition leaves as they are and that Python lower-cases alike.
        self.odd = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027]").search
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(mapped)]).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """The ids of chunks between white space, which no pre-token spans; most are one word, with or without a sign."""
        if len(self.words) > CACHE:
            self.words.clear()
        words, known = self.words, self.known
        for chunk in chunks:
            ids = []
            for w in [chunk] if chunk.isalpha() else self.split(chunk):
                if (x := words.get(w)) is None:
                    x = words[w] = self._word(w)
                ids.append(x)
            known[chunk] = b"".join(ids)

    def _chunks(self, text: str) -> list[str] | None:
        """What lies between white space; None if the text has to go through the tokenizer as a whole."""
        if self.odd(text):
            return None
        small = text.lower()
        return None if any(t in small for t in self.added) else small.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Texts with rarer scripts or added tokens go through the tokenizer as a whole."""
        plain = [self._chunks(t) for t in texts]
        chunks = set().union(*(x for x in plain if x))
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn([x for x in chunks if x not in self.known])
        get = self.known.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() if x is None else b"".join(map(get, x)) for t, x in zip(texts, plain, strict=True)]


def lengths(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, tokens and the checksums of its whole windows, of the rest and of the rest's binary pieces."""
    docs = small_batches(docs)
    with open(tokenizer_path, "rb") as f:
        data = f.read()  # a vocabulary file, under 2 MB
    shared = docs.sparkSession.sparkContext.broadcast(data)
    end = np.uint32(end_id).tobytes()

    def run(batches):
        coder = word_bpe(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts]):
                n, whole, rest, bits = [], [], [], []
                for ids in coder.encode(texts[a:b]):
                    ids += end
                    n.append(len(ids) // 4)
                    full = n[-1] // window
                    whole.append([zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(full)])
                    rest.append(zlib.crc32(tail := ids[4 * window * full :]))
                    at, parts = 0, []
                    for size in binary_parts(len(tail) // 4):
                        parts.append(zlib.crc32(tail[4 * at : 4 * (at + size)]))
                        at += size
                    bits.append(parts)
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(whole, many), pa.array(rest, pa.int64()), pa.array(bits, many)], names=[id_col, "n", "whole", "rest", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(giving_back(run), f"`{id_col}` {kind}, n long, whole array<long>, rest long, bits array<long>")


def binary_parts(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def combinations(window: int, there: np.ndarray, spread: int = 8) -> list[tuple[int, ...]]:
    """Two to four lengths that fill the window, all of which occur; longer ones spread over the range of each first length."""
    found = {(a, window - a) for a in range(1, window // 2 + 1)}
    for a in range(1, window // 3 + 1):
        for b in np.unique(np.linspace(a, (window - a) // 2, spread).astype(int)):
            found.add((a, int(b), window - a - int(b)))
    for a in range(1, window // 4 + 1):
        for b in np.unique(np.linspace(a, (window - 2 * a) // 2, spread // 2).astype(int)):
            found.add(tuple(sorted((a, a, int(b), window - 2 * a - int(b)))))
    return sorted(c for c in found if min(c) > 0 and all(there[x] for x in c))


def least_squares(parts: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, where A's column j counts the lengths in parts[j] (0: none); accelerated projected gradient."""
    used = parts > 0
    spread = lambda x: np.bincount(parts[used], weights=np.broadcast_to(x[:, None], parts.shape)[used], minlength=len(counts))
    gather = lambda r: (r[parts] * used).sum(axis=1)
    v = np.ones(len(parts))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = gather(spread(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - gather(spread(y) - counts) / (1.02 * step))
        nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / nxt * (new - x)
        x, t = new, nxt
    return x


def plan(counts: np.ndarray, window: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Combinations and how often each is used; together they use no length more often than it occurs."""
    found = combinations(window, counts > 0)
    if not found:
        return [], np.zeros(0, np.int64)
    parts = np.array([c + (0,) * (4 - len(c)) for c in found])
    x = least_squares(parts, counts.astype(float))
    left, times = counts.astype(np.int64).copy(), np.zeros(len(found), np.int64)
    need = [[(p, c.count(p)) for p in set(c)] for c in found]
    for wish in (np.rint(x).astype(np.int64), None):  # first what the solution says, then what still fits
        for j in np.argsort(-x, kind="stable"):
            most = min(left[p] // k for p, k in need[j])
            if n := most if wish is None else min(most, wish[j]):
                times[j] += n
                for p, k in need[j]:
                    left[p] -= n * k
    return found, times


class Layout:
    """Where the k-th document of each remaining length goes."""

    def __init__(self, counts: np.ndarray, fulls: int, window: int):
        found, times = plan(counts, window)
        self.window, self.used, self.runs = window, np.zeros(len(counts), np.int64), [[] for _ in counts]
        sequence = fulls
        for c, n in zip(found, times.tolist(), strict=True):
            if n:
                at = 0
                for p in c:
                    self.runs[p].append((int(self.used[p]), sequence, at))  # from this rank on: first sequence, offset
                    self.used[p] += n
                    at += p
                sequence += n
        self.runs = [tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) if r else None for r in self.runs]
        left = counts - self.used
        sizes = 1 << np.arange(int(window).bit_length())
        has = (np.arange(len(counts))[:, None] & sizes) > 0
        many = has * left[:, None]
        self.before = np.cumsum(many, axis=0) - many  # among the pieces of a size, by length
        total = many.sum(axis=0) * sizes
        self.begin = total.sum() - np.cumsum(total)  # larger sizes come first
        self.first, tokens = sequence, int(total.sum())
        self.tail = tokens // window * window
        self.cuts = np.cumsum([0, *binary_parts(tokens - self.tail)])

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(size, sequence, offset) of each piece of what remains of a document."""
        if rank < self.used[length]:
            start, sequence, at = self.runs[length]
            i = np.searchsorted(start, rank, "right") - 1
            return [(length, int(sequence[i] + rank - start[i]), int(at[i]))]
        out = []
        for size in binary_parts(length):
            bit = size.bit_length() - 1
            at = int(self.begin[bit] + (self.before[length, bit] + rank - self.used[length]) * size)
            if at < self.tail:
                out.append((size, self.first + at // self.window, at % self.window))
            else:
                i = int(np.searchsorted(self.cuts, at - self.tail, "right")) - 1
                out.append((size, self.first + self.tail // self.window + i, int(at - self.tail - self.cuts[i])))
        return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The window is a power of two."""
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")
    rest = (F.col("n") % window).cast("int")
    coded = lengths(docs, tokenizer_path, window, end_id, id_col, text_col)
    # the hash is stored with the rows, as it takes the task into account: so rows that are alike are dealt out, too
    known = stored(coded.withColumn("hash", F.xxhash64(id_col, "n", "rest", F.monotonically_increasing_id())), "lengths")
    salts = min(SALTS[1], max(SALTS[0], known.count() // SALTED))
    known = known.withColumns({"length": rest, "salt": F.pmod("hash", F.lit(salts)).cast("int")})
    cells = known.groupBy("length", "salt").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / window)).alias("f")).toPandas()
    count, full = np.zeros((window, salts), np.int64), np.zeros((window, salts), np.int64)
    count[cells["length"], cells["salt"]] = cells["c"]
    full[cells["length"], cells["salt"]] = cells["f"]
    by_length = count.sum(axis=1)
    by_length[0] = 0
    layout = Layout(by_length, int(full.sum()), window)
    ranks = np.cumsum(count, axis=1) - count
    firsts = (np.cumsum(full.ravel()) - full.ravel()).reshape(full.shape)
    shared = docs.sparkSession.sparkContext.broadcast((layout, ranks, firsts))
    within = Window.partitionBy("length", "salt").orderBy(id_col, "n", "rest")
    numbered = known.withColumns({"k": F.row_number().over(within) - 1, "g": F.coalesce(F.sum(F.floor(F.col("n") / window)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})

    def run(batches):
        layout, ranks, firsts = shared.value
        for batch in batches:
            row, out = [], []
            for i, (n, whole, crc, bits, length, salt, k, g) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for j, x in enumerate(whole):
                    row.append(i)
                    out.append((j * window, window, x, n, int(firsts[length, salt]) + g + j, 0))
                if length:
                    places, start = layout.place(length, int(ranks[length, salt]) + k), len(whole) * window
                    for (size, sequence, at), x in zip(places, [crc] if len(places) == 1 else bits, strict=True):
                        row.append(i)
                        out.append((start, size, x, n, sequence, at))
                        start += size
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return numbered.select(id_col, "n", "whole", "rest", "bits", "length", "salt", "k", "g").mapInArrow(giving_back(run), f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
