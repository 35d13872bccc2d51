"""Helpers that the operators share: shared storage, byte-level words, hashing and folds."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.sources.storage import drop_stored, n_stored, shared_dir, stored  # noqa: F401

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch of texts, at most.
BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH rows at most: with the default of 10,000, batches of long texts, which executors hold several times, fill their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df


#: Bits of a map of keys for each key, and of one of Spark's bitmaps. MAP_BITS: of a whole map, at least and at most (1 and 64 MB).
KEY_BITS, PAGE_BITS, MAP_BITS = 16, 1 << 15, (1 << 23, 1 << 29)


def unused(name: str, df: DataFrame) -> str:
    """name, or name with underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: outputs of an operator replace columns that are called alike."""
    gone = {n.lower() for n in names}
    return df.select(*(df[c] for c in df.columns if c.lower() not in gone))


def with_membership(rows: DataFrame, keys: DataFrame, names: list[str], out: str) -> DataFrame:
    """rows with a column out that is true for all rows whose names are among keys', and for few others, found without a shuffle.

    All tasks get a map of KEY_BITS bits for each key, within MAP_BITS: with 2 ** 25 keys it holds one of 16 bits, so that a row of
    no key is taken for one in 16 cases, and with more keys more often. Only the speed depends on it.
    """
    count = keys.count()
    size = min(max(MAP_BITS[0], 1 << (KEY_BITS * count).bit_length()), MAP_BITS[1])
    number, page = unused("__page", rows), unused("__map", rows)
    place = F.pmod(F.xxhash64(*names), F.lit(size))
    bucket, bit = F.floor(place / PAGE_BITS), place % PAGE_BITS
    bits = stored(keys.select(bucket.alias(number), bit.alias("__bit")).groupBy(number).agg(F.bitmap_construct_agg("__bit").alias(page)), "map")
    byte = F.conv(F.hex(F.substr(page, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1, F.lit(False))
    return rows.withColumn(number, bucket).join(F.broadcast(bits), number, "left").withColumn(out, there).drop(number, page)


#: Keys that are split, at most, and rows of a key that isn't, at least.
HOT_KEYS, COOL_ROWS = 10_000, 4096


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], sizes: DataFrame, total: int) -> DataFrame:
    """rows joined with table on keys, inner; each common key's rows are dealt to parts that get table's rows of it each.

    sizes has the keys and n, their numbers of rows, which add up to total at most. A key is common from total / HOT_KEYS rows on,
    so there are at most HOT_KEYS such keys, which every task gets to know; a part has about that many rows. Rows are dealt by a hash
    of all their columns and of the partition that they come from, so that a task that runs again deals them alike.
    """
    part, parts = unused("__part", rows), unused("__parts", rows)
    limit = max(COOL_ROWS, total // HOT_KEYS)
    hot = stored(sizes.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias(parts)), "hot")
    deal = F.broadcast(hot)  # at most HOT_KEYS rows
    dealt = rows.join(deal, keys, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    spread = table.join(deal, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(spread, [*keys, part]).drop(part)


def release_memory() -> None:
    """Gives memory that is free back to the system: else the driver keeps what it fitted a model on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def giving_back(run):
    """run for mapInArrow; at the end of a task what is free goes back to the system: workers live on, and else keep it beside the tasks of later stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = CHUNK_BYTES):
    """(start, end) of runs of rows of at most this many bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: A-Z to lower case, other ASCII that is no letter or digit to a space; bytes from 0x80 stay, so letters beyond ASCII do.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The powers of an odd number and those of its inverse, n at least of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which each bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _pieces(data: bytes, most: int):
    """data in pieces of about most bytes, cut at spaces only."""
    start = 0
    while len(data) - start > most:
        cut = data.rfind(b" ", start, start + most)
        cut = cut if cut > start else data.find(b" ", start + most)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


def word_hashes(text: bytes, most: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word of a text in order: lower-case ASCII letters, digits and all beyond ASCII make words."""
    out = []
    with np.errstate(over="ignore"):
        for piece in _pieces(text.translate(WORD_BYTES), most):
            a = np.frombuffer(piece, np.uint8)
            inside = np.zeros(len(a) + 2, np.int8)
            inside[1:-1] = a != 32
            edges = np.flatnonzero(np.diff(inside))
            if len(edges):
                power, inverse = powers(len(a))
                sums = np.zeros(len(a) + 1, np.uint64)
                np.cumsum(_RANDOM[a] * power[: len(a)], out=sums[1:])
                out.append(mixed((sums[edges[1::2]] - sums[edges[::2]]) * inverse[edges[::2]]))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed_ranges(data: bytes, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each range of data, ranges in order; an empty one has 0. Worked off in parts of about most bytes."""
    a, out = np.frombuffer(data, np.uint8), np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            if ends[i] <= starts[i]:
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most)))
            used = np.arange(i, j)[ends[i:j] > starts[i:j]]
            low, high = starts[i], ends[used[-1]]
            power, inverse = powers(int(high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_RANDOM[a[low:high]] * power[: high - low], out=sums[1:])
            out[used] = mixed((sums[ends[used] - low] - sums[starts[used] - low]) * inverse[starts[used] - low])
            i = j
    return out


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct hashes of width consecutive words, sorted; a shorter text has one of all its words, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(min(width, len(words))):
            total = (total + words[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed(total))
