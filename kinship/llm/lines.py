"""Operator 10: line dedup by winnowing over line hashes.

A text is cut into lines: at newlines and, where sentences is set, after sentence ends too, and sentences of more than
LONG words before the word that hashes lowest (the last of equal ones) of each REACH consecutive words of the sentence. So
a sentence is cut by its own words only, no REACH words are without a cut, and of a passage in it at most LONG words at
either end are cut otherwise than elsewhere: of any passage of more than 2 x LONG + MIN_WORDS = 50 words that occurs earlier,
MIN_WORDS or more words go, wherever it begins (unless REACH of its words in a row are one).

A window is a shortest run of lines of at least min_words words: from a line on, or up to one. Every window selects its
smallest line hash (the last of equal ones) as a fingerprint, so equal windows select equal fingerprints at equal places; hashes
of lines of few words count as larger than others, as such lines recur by chance. Fingerprints that occur once drop out. The places of the others are joined: the windows that selected them are named by the
hash of all their lines, and a window is matched with the place where it occurs first (by id, then line). Matches of one
earlier document at one distance are one run, which so extends both ways along the pair. A run of lines is deleted exactly if
it has min_words words or more and occurs, as a whole, earlier: each of its lines lies in a window within it, and each
window within it occurs where it does; and no window is deleted that doesn't itself occur in one earlier place. So nothing is
stitched together from several documents, and a single line of min_words words is enough.

Only hashes and positions are shuffled until the last join, which brings the matches to their texts; texts of documents that
a map of bits shows to have none pass by it. Counts and first places are aggregated before they are shuffled, so common lines
don't meet in one task.

Null texts stay null and empty ones empty. Lines are compared without ASCII case and outer white space; lines without words
belong to the one before, or to the first one. Rows that agree in id and text are one document and treated alike; rows that agree in id only are told
apart by their texts' hash, by which ties are broken; null ids come first. Ids are integers or else compared as strings. Extra
columns stay as they are, but for those that are called like an output, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinship.llm.common import hashed_ranges, mixed, powers, slices, small_batches, stored, unused, with_membership, without

#: Words of the shortest run that is deleted.
MIN_WORDS = 20
#: Words of which one is cut before, and of the longest sentence that isn't cut: a passage's first word, the REACH - 1 words whose
#: cuts depend on what is before it, and REACH - 1 words without a cut.
REACH = 8
LONG = 2 * REACH - 1
#: Stands for a null id: before all others.
NO_ID = -(2**63)
#: What the operator adds.
OUTPUTS = ("n_removed", "words_removed", "runs")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space and sentences' ends among bytes.
_KIND = np.array([1 if b in b" \t\n\v\f\r" else 2 if b in b".!?" else 0 for b in range(256)], np.uint8)

#: The lower half of a number, and the bits of three bytes and a word's first ones.
_LAST, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_FIRST = np.array([(1 << 8 * (3 + n)) - 1 for n in range(6)], np.uint64)


def _words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run without white space begins and ends."""
    solid = np.zeros(len(a) + 2, np.int8)
    solid[1:-1] = _KIND[a] != 1
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def _chosen(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The places of the smallest key of each REACH consecutive places of one group; keys have their places in the lower half, from the highest down."""
    low = key
    for step in (1, 2, 4):  # minima of 2, 4 and REACH
        low = np.minimum(low[:-step], low[step:])
    inside = (group[: len(low)] == group[REACH - 1 :]) & (low <= ~_LAST)
    return np.unique(_LAST - (low[inside] & _LAST)).astype(np.int64)


@dataclass
class Lines:
    """The lines that have words of some texts, in order."""

    start: np.ndarray  # of each, in the bytes of its text
    words: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # the first line of each text, and after the last one


def cut_lines(texts: list[bytes], sentences: bool = True) -> Lines:
    """The lines of texts, which are worked off side by side, three spaces apart."""
    data = (b"   " + b"   ".join(texts) + b" " * 11).translate(_LOWER)
    a = np.frombuffer(data, np.uint8)
    begins = np.cumsum([3, *(len(t) + 3 for t in texts)])  # of texts
    begin, end = _words(a)
    marks = np.zeros(len(a) + 1, bool)
    marks[begins] = True
    marks[np.flatnonzero((a[:-1] == 10) & (a[1:] != 10)) + 1] = True
    if sentences and len(begin):
        stop = (_KIND[a[end[:-1] - 1]] == 2) & (begin[1:] - end[:-1] == 1)
        marks[begin[1:][stop]] = True
    at = np.flatnonzero(marks)
    first = np.searchsorted(begin, at)  # words before each mark
    count = np.diff(np.append(first, len(begin)))
    if sentences and (count > LONG).any():
        group = np.repeat(np.arange(len(count)), count)
        place = np.flatnonzero((count > LONG)[group])
        group = group[place]
        near = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each place on
        kept = _FIRST[np.minimum(end[place] - begin[place], 5)]  # three before the word, and its first five
        key = (mixed(near[begin[place] - 3] & kept) | _LAST) - np.arange(len(place), dtype=np.uint64)
        opens = np.append(True, group[1:] != group[:-1])  # no place to cut: a sentence begins there anyway
        opens[1:] |= key[1:] >> _HALF == key[:-1] >> _HALF  # as is a word that only repeats the one before
        key[opens] |= ~_LAST
        marks[begin[place[_chosen(key, group)]]] = True
        at = np.flatnonzero(marks)
        first = np.searchsorted(begin, at)
        count = np.diff(np.append(first, len(begin)))
    at, first, count = (x[count > 0] for x in (at, first, count))
    text = np.searchsorted(at, begins)
    hashes = hashed_ranges(data, begin[first], end[first + count - 1]) if len(at) else np.zeros(0, np.uint64)
    return Lines(at - np.repeat(begins[:-1], np.diff(text)), count, hashes, text)


def line_ends(text: bytes, sentences: bool = True) -> np.ndarray:
    """Where each line of a text ends; the lines together are the text."""
    return np.append(cut_lines([text], sentences).start[1:], len(text)) if text else np.zeros(0, np.int64)


def windows(words: np.ndarray, text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last line) of each shortest run of lines of at least min_words words that begins or that ends with a line; none reaches over the end of a text. Every line has a word at least."""
    before = np.append(0, np.cumsum(words))
    sizes = np.diff(text)
    ahead, back = before[:-1] + min_words, before[1:] - min_words
    first = np.flatnonzero(ahead <= np.repeat(before[text[1:]], sizes))
    last = np.flatnonzero(back >= np.repeat(before[text[:-1]], sizes))
    to, since = np.zeros(len(words), np.int64), np.searchsorted(before, back[last], "right") - 1
    to[first] = np.searchsorted(before, ahead[first]) - 1
    new = to[since] != last
    return np.concatenate((first, since[new])), np.concatenate((to[first], last[new]))


def winnowed(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of each window's smallest hash, the last one of equals; lines of fewer words come after all others."""
    few = np.array([3, 3, 2, 2, 1, 1, 0], np.uint64)[np.minimum(words, 6)] << np.uint64(62)
    low, out = ((hashes >> np.uint64(2) | few) & ~_LAST) | (_LAST - np.arange(len(hashes), dtype=np.uint64)), np.zeros(len(first), np.uint64)
    step, lines = 1, last - first + 1
    most = lines.max(initial=0)
    while step <= most:  # low: minima of `step` lines
        here = np.flatnonzero((lines >= step) & (lines < 2 * step))
        out[here] = np.minimum(low[first[here]], low[last[here] - step + 1])
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    return (_LAST - (out & _LAST)).astype(np.int64)


def window_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of all lines of each window."""
    power, inverse = powers(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(hashes * power[: len(hashes)]))
        return mixed((sums[last + 1] - sums[first]) * inverse[first])


def matched_runs(first: np.ndarray, last: np.ndarray, source: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last line) of each matched run and the place of one of its matches, from the windows that occur earlier: their lines, the number of the source, its first line, and the text. Windows of one text and source at one distance that touch are one run."""
    order = np.lexsort((first, first - at, source, text))
    f, to = first[order], last[order]
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (text, source, first - at):
        same &= np.diff(x[order]) == 0
    pair = np.append(0, np.cumsum(~same))[: len(order)]
    step = int(last.max(initial=0)) + 2
    reach = np.maximum.accumulate(pair * step + to) if len(order) else to  # the last line so far, of one pair
    new = np.append(True, ~same | (f[1:] + pair[1:] * step > reach[:-1] + 1))[: len(order)]
    starts = np.flatnonzero(new)
    return np.stack((f[starts], np.maximum.reduceat(to, starts) if len(starts) else to)), order[starts]


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, not null, and, only where ids repeat, its text's hash."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        ident = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    else:
        ident = F.concat(F.lit("."), F.coalesce(F.concat(F.lit("."), docs[id_col].cast("string")), F.lit("")))
    unique = docs.select(ident.alias("i")).groupBy("i").count().filter("count > 1").isEmpty()
    return ident, F.lit(0).cast("long") if unique else F.xxhash64(text_col)


def matched_windows(texts: DataFrame, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """(id, key, matches: first and last line, source and its first line of all windows that occur earlier) of each document that has any, from (id, key, text)."""

    def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def lined(batches):
        for batch in batches:
            data = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in slices([len(x) for x in data]):
                cut = cut_lines(data[a:b], sentences)
                few = np.minimum(cut.words, min_words)  # more make no difference to the windows
                first, last = windows(few, cut.text, min_words)
                place = np.zeros(len(few), bool)
                place[winnowed(cut.hash, few, first, last)] = True
                place = np.flatnonzero(place)
                ends = np.searchsorted(place, cut.text)
                place -= np.repeat(cut.text[:-1], np.diff(ends))
                some = pa.array(np.diff(ends) > 0)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists(cut.text, pa.array(cut.hash.view(np.int64))), lists(cut.text, pa.array(few, pa.int8())), lists(ends, pa.array(place, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "h", "c", "p"]).filter(some)

    def near(batches):
        for whole in batches:
            for a, b in slices((8 * pc.list_value_length(whole.column(2)).to_numpy()).tolist()):
                batch = whole.slice(a, b - a)
                (h, ends), (words, _), (at, spots) = ((c.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(c).to_numpy()))) for c in batch.columns[2:])
                h, words = h.view(np.uint64), words.astype(np.int64)
                first, last = windows(words, ends, min_words)
                wanted = np.zeros(len(h), bool)
                wanted[at + np.repeat(ends[:-1], np.diff(spots))] = True
                some = wanted[winnowed(h, words, first, last)]
                first, last = first[some], last[some]
                row = np.searchsorted(ends, first, "right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((first - ends[row]) * (min_words + 1) + last - first), pa.array(window_hashes(h, first, last).view(np.int64))], names=["id", "key", "w", "g"])

    key = f"id {texts.schema['id'].dataType.simpleString()}, key long"
    lines = stored(texts.filter("text IS NOT NULL").select("id", "key", "text").mapInArrow(lined, f"{key}, h array<long>, c array<tinyint>, p array<int>"), "lines")
    prints = lines.select("id", "key", F.explode("p").alias("p"), "h").select("id", "key", "p", F.get("h", "p").alias("f"))
    # tables of their own, so that both sides of a join are shuffled for it, and a common fingerprint's or window's rows can be split
    common = stored(prints.groupBy("f").count().filter("count > 1").select("f"), "common")
    places = prints.join(common, "f", "left_semi").groupBy("id", "key").agg(F.collect_set("p").alias("at"))
    found = stored(lines.select("id", "key", "h", "c").join(places, ["id", "key"]).mapInArrow(near, f"{key}, w long, g long"), "windows")
    first = stored(found.groupBy("g").agg(F.min(F.struct("id", "key", "w")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("g", "first"), "first")
    later = found.join(first, "g").filter(F.struct("id", "key", "w") > F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set(F.struct("w", F.col("first.id").alias("source"), F.col("first.w").alias("at"))).alias("matches"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines deleted from the texts, n_removed and words_removed, of lines and words, and runs: the first line, lines, words and source (the id of the earlier document) of each match."""
    if not 0 < min_words < 128:
        raise ValueError("runs have 1 to 127 words at least")
    docs = small_batches(without(docs, *OUTPUTS))
    ident, text_hash = _named(docs, id_col, text_col)
    matches = stored(matched_windows(docs.select(ident.alias("id"), text_hash.alias("key"), F.col(text_col).alias("text")), min_words, sentences), "matches")
    own = {n: unused(f"__{n}", docs) for n in ("id", "key", "matches", "maybe")}
    matches = matches.select(*(F.col(n).alias(own[n]) for n in ("id", "key", "matches")))
    shown = with_membership(docs.withColumns({own["id"]: ident, own["key"]: text_hash}), matches, [own["id"], own["key"]], own["maybe"])
    some, none = shown.filter(F.col(own["maybe"])), shown.filter(~F.col(own["maybe"]))
    both = some.join(matches, [own["id"], own["key"]], "left").select(*docs.columns, own["matches"])
    fields, integral = [*docs.columns], isinstance(docs.schema[id_col].dataType, T.IntegralType)
    at = fields.index(text_col)

    def original(source: pa.Array) -> pa.Array:
        """Ids as they were before they were made not null."""
        if integral:
            return pc.if_else(pc.equal(source, NO_ID), pa.scalar(None, pa.int64()), source)
        return pc.if_else(pc.equal(source, "."), pa.scalar(None, pa.string()), pc.utf8_slice_codeunits(source, 2))

    def without_runs(batch: pa.RecordBatch) -> list[pa.Array]:
        """The columns of a batch whose last one, of matches, is never null, and the outputs."""
        texts, found = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(fields))
        cut = cut_lines(texts, sentences)
        matches, ends = found.flatten(), np.append(0, np.cumsum(pc.list_value_length(found).to_numpy()))
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        w, there = (matches.field(k).to_numpy() for k in (0, 2))
        source = matches.field(1).dictionary_encode()
        first, before = w // (min_words + 1) + cut.text[row], there // (min_words + 1)
        last = first + w % (min_words + 1)
        (a, b), of = matched_runs(first, last, source.indices.to_numpy(), before + cut.text[row], row)
        change = np.bincount(a, minlength=len(cut.words) + 1) - np.bincount(b + 1, minlength=len(cut.words) + 1)
        gone = np.cumsum(change)[:-1] > 0
        words = np.append(0, np.cumsum(cut.words))
        left = []
        for text, x, y in zip(texts, cut.text[:-1].tolist(), cut.text[1:].tolist(), strict=True):
            edges = np.concatenate(([0], cut.start[x + 1 : y], [len(text)]))
            turns = np.diff(np.concatenate(([True], gone[x:y], [True])).astype(np.int8))  # where what stays begins and ends
            left.append(b"".join(text[i:j] for i, j in zip(edges[turns < 0].tolist(), edges[turns > 0].tolist(), strict=True)))
        total = lambda x: np.add.reduceat(np.append(x, 0), cut.text[:-1])
        runs = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in ((a - cut.text[row[of]], pa.int32()), (b - a + 1, pa.int32()), (words[b + 1] - words[a], pa.int64()))] + [original(source.dictionary.take(source.indices.take(pa.array(of))))], names=["line", "lines", "words", "source"])
        by_row = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[of], np.arange(len(texts) + 1)), pa.int32()), runs)
        columns = batch.columns[:-1]
        columns[at] = pa.array(left, pa.binary()).cast(columns[at].type)
        return [*columns, pa.array(total(gone)), pa.array(total(cut.words * gone)), by_row]

    def cut(batches):
        run_type = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("words", pa.int64()), ("source", pa.int64() if integral else pa.string())]))
        for batch in batches:
            changed = pc.is_valid(batch.column(len(fields)))
            same = batch.filter(pc.invert(changed))
            none = [pa.array(np.zeros(len(same), np.int64))] * 2 + [pa.array([[]] * len(same), run_type)]
            yield pa.RecordBatch.from_arrays([*same.columns[:-1], *none], names=[*fields, *OUTPUTS])
            some = batch.filter(changed)
            for a, b in slices(pc.binary_length(some.column(at)).to_pylist()):
                yield pa.RecordBatch.from_arrays(without_runs(some.slice(a, b - a)), names=[*fields, *OUTPUTS])

    run_schema = f"array<struct<line:int,lines:int,words:bigint,source:{'bigint' if integral else 'string'}>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    zero = F.lit(0).cast("long")
    return both.mapInArrow(cut, f"{schema}, n_removed long, words_removed long, runs {run_schema}").union(none.select(*fields, zero.alias("n_removed"), zero.alias("words_removed"), F.array().cast(run_schema).alias("runs")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that earlier ones have."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
