"""The best candidates by weighted keys: blocks of records meet all others of their group, and only the best pairs leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of a block, shared keys that are multiplied at a time, pairs that a pass holds before it cuts them, and rows of a batch returned.
BLOCK, PRODUCTS, HELD, ROWS = 16384, 1 << 18, 1 << 18, 1 << 16
#: Scores are kept as whole millionths, as they are rounded before they are ranked.
MICRO = 1_000_000
#: Bits of a pair's order in its pass: the other record's place, and the score.
PLACE, SCORE = 27, 21

SCORES = ("bs", "bsn", "bsa")


class _Best:
    """The k best others of each of n records by one score, ties by the place."""

    def __init__(self, n: int, score: int, k: int, least: int):
        self.score, self.k, self.least = score, k, np.full(n, least - 1, np.int64)  # what a pair has to exceed
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, own: np.ndarray, place: np.ndarray, micro: np.ndarray) -> None:
        # places only rise, so a pair as good as the k-th comes too late
        at = np.flatnonzero(micro[:, self.score] > self.least[own])
        if len(at):
            order = (own[at] << (PLACE + SCORE)) | ((1 << SCORE) - 1 - micro[at, self.score]) << PLACE | place[at]
            self.parts.append((order, micro[at].astype(np.int32)))
            self.held += len(at)
            if self.held > HELD:
                self.cut()

    def cut(self) -> None:
        if not self.parts:
            return
        order, micro = (np.concatenate(x) for x in zip(*self.parts))
        at = np.argsort(order)
        own = order[at] >> (PLACE + SCORE)
        rank = np.arange(len(at)) - np.searchsorted(own, own)
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[own[full]] = micro[at[full], self.score]
        self.parts, self.held = [(order[at[keep]], micro[at[keep]])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(own, place, micro, rank from 1)."""
        self.cut()
        if not self.parts:
            return *(np.zeros(0, np.int64),) * 2, np.zeros((0, len(SCORES)), np.int64), np.zeros(0, np.int64)
        order, micro = self.parts[0]
        own = order >> (PLACE + SCORE)
        return own, order & ((1 << PLACE) - 1), micro, np.arange(len(own)) - np.searchsorted(own, own) + 1


def _postings(batch: pa.RecordBatch, kinds: tuple[str, str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, key, weights scaled by the norms over all, name and address keys) of each key of a batch's records."""
    keys, w = (batch.column(c).flatten() for c in ("keys", "ws"))
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False))
    kind = pc.utf8_slice_codeunits(keys, 0, 1)
    w, scaled = w.to_numpy(zero_copy_only=False), []
    for norm, among in zip(("na", "nn", "nd"), (None, *kinds)):
        n = batch.column(norm).to_numpy(zero_copy_only=False)[row]
        mine = (n > 0) if among is None else (n > 0) & pc.is_in(kind, pa.array(list(among))).to_numpy(zero_copy_only=False)
        scaled.append(np.divide(w, n, out=np.zeros(len(w)), where=mine))
    return row, keys, np.stack(scaled, axis=1)


class _Tile:
    """A block's records, and the best of the others that have come by."""

    def __init__(self, rows: pa.RecordBatch, passes: list[tuple[int, int, int]], least: int, kinds: tuple[str, str], by_source: bool):
        self.passes, self.floor, self.kinds, self.by_source = passes, least, kinds, by_source
        self.rid, self.src, self.n = rows.column("rid"), rows.column("src").to_numpy(), rows.num_rows
        row, keys, w = _postings(rows, kinds)
        self.words = pc.unique(keys)
        code = pc.index_in(keys, self.words).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.row, self.w = row[order], w[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.words) + 1))
        self.best: dict[int, list[_Best]] = {}
        self.others: list[pa.Array] = []
        self.other_src: list[np.ndarray] = []
        self.noted: list[tuple] = []
        self.seen = 0

    def meet(self, rows: pa.RecordBatch) -> None:
        self.others.append(rows.column("rid"))
        src = rows.column("src").to_numpy()
        self.other_src.append(src)
        row, keys, w = _postings(rows, self.kinds)
        code = pc.fill_null(pc.index_in(keys, self.words), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(code >= 0)
        row, code, w = row[at], code[at], w[at]
        many = self.start[code + 1] - self.start[code]
        ends = np.cumsum(many)
        i = 0
        while i < len(row):  # whole records at a time
            j = np.searchsorted(ends, (ends[i - 1] if i else 0) + PRODUCTS, side="right")
            j = np.searchsorted(row, row[min(j, len(row) - 1)]) if j < len(row) else j
            j = np.searchsorted(row, row[i], side="right") if j <= i else j
            self._products(row[i:j], code[i:j], w[i:j], many[i:j], src)
            i = j
        self.seen += rows.num_rows
        if self.seen >= 1 << PLACE:
            raise ValueError(f"a group has more than {1 << PLACE} records of a side")

    def _products(self, row, code, w, many, src) -> None:
        total = int(many.sum())
        if not total:
            return
        at = np.repeat(self.start[code] - np.cumsum(many) + many, many) + np.arange(total)
        pair = np.repeat(row * self.n, many) + self.row[at]
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        products = (np.repeat(w, many, axis=0) * self.w[at])[order]
        micro = np.rint(np.add.reduceat(products, first, axis=0) * MICRO).astype(np.int64)
        row, own = np.divmod(pair[first], self.n)
        groups = src[row] if self.by_source else np.zeros(len(row), np.int64)
        for s in np.unique(groups):
            mine = slice(None) if (groups == s).all() else groups == s
            if s not in self.best:
                self.best[s] = [_Best(self.n, score, k, self.floor) for score, k, _ in self.passes]
            for b in self.best[s]:
                b.add(own[mine], row[mine] + self.seen, micro[mine])

    def note(self, rows: pa.RecordBatch) -> None:
        """Takes pairs that another way has found: the block's record as the only key, the scores as weights."""
        own = pc.index_in(rows.column("keys").flatten(), self.rid).to_numpy(zero_copy_only=False)
        place = pc.index_in(rows.column("rid"), pa.chunked_array(self.others).combine_chunks()).to_numpy(zero_copy_only=False)
        micro = np.rint(rows.column("ws").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SCORES)) * MICRO).astype(np.int64)
        self.noted.append((own.astype(np.int64), place.astype(np.int64), micro, rows.column("na").to_numpy(zero_copy_only=False).astype(np.int8)))

    def result(self) -> Iterator[tuple]:
        """(own id, own source, other id, other source, scores, mask, rank in the only pass) of the best pairs, and of those noted."""
        if not self.others:
            return
        others = pa.chunked_array(self.others)
        other_src = np.concatenate(self.other_src)
        noted = [np.concatenate(x) for x in zip(*self.noted)] if self.noted else None
        noted_src = other_src[noted[1]] if noted and self.by_source else np.zeros(len(noted[0]) if noted else 0, np.int64)
        for s in sorted({*self.best, *noted_src.tolist()}):  # a source at a time, for memory
            found = [(*b.result(), np.int8(bit)) for b, (_, _, bit) in zip(self.best.pop(s, []), self.passes)]
            found = [(own, place, micro, rank.astype(np.int32), np.full(len(own), bit)) for own, place, micro, rank, bit in found]
            if noted and (mine := noted_src == s).any():
                found.append((noted[0][mine], noted[1][mine], noted[2][mine].astype(np.int32), np.zeros(mine.sum(), np.int32), noted[3][mine]))
            own, place, micro, rank, bit = (np.concatenate(x) for x in zip(*found))
            del found
            order = np.argsort(pair := own << PLACE | place, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            mask = np.bitwise_or.reduceat(bit[order], first) if len(first) else first
            at = order[first]
            del order, first, pair, bit
            for i in range(0, len(at), ROWS):
                x = at[i : i + ROWS]
                yield self.rid.take(pa.array(own[x])), self.src[own[x]], others.take(pa.array(place[x])).combine_chunks(), other_src[place[x]], micro[x] / MICRO, mask[i : i + ROWS], rank[x]


def best(vectors: DataFrame, passes: list[tuple[str, int, int]], least: float, kinds: tuple[str, str], reverse: bool = False, more: DataFrame | None = None) -> DataFrame:
    """(grp, s1_id, cand_id, src2, bs, bsn, bsa, mask, rk) of the pairs that are among a pass's best: of each first-source record and source or, in reverse, of each candidate.

    vectors (grp, rid, src, keys, ws, na, nn, nd): a record's kept keys, their weights and its norms. passes: (score, k, bit);
    rk is the rank in the pass, if there is only one. more: such pairs of the other direction, which are added where they lie. Records that pairs are ranked for are cut into blocks; each block is
    joined with all records of the other side of its group, some at a time, so pairs are never shuffled.
    """
    spark, names = vectors.sparkSession, vectors.columns
    own = (F.col("src") != 1) if reverse else (F.col("src") == 1)
    sizes = F.broadcast(vectors.filter(own).groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))  # a row for each group
    spread = F.when(own, F.array(F.pmod(F.xxhash64("rid"), F.col("blocks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = vectors.join(sizes, "grp").select(*names, (~own).cast("int").alias("other"), F.explode(spread).alias("block"))
    if more is not None:
        mine, rid, src = ("cand_id", "s1_id", F.lit(1)) if reverse else ("s1_id", "cand_id", F.col("src2"))
        noted = more.join(sizes, "grp").select("grp", F.col(rid).alias("rid"), src.alias("src"), F.array(mine).alias("keys"), F.array(*SCORES).alias("ws"), F.col("mask").cast("double").alias("na"), F.lit(0.0).alias("nn"), F.lit(0.0).alias("nd"), F.lit(2).alias("other"), F.pmod(F.xxhash64(mine), F.col("blocks")).alias("block"))
        dealt = dealt.unionByName(noted)
    dealt = dealt.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "other", "rid")
    floor = int(np.ceil(round(least * MICRO, 3)))
    numbered = [(SCORES.index(score), k, bit) for score, k, bit in passes]

    def out(grp: str, tile: _Tile) -> Iterator[pa.RecordBatch]:
        for rid, src, other, other_src, scores, mask, rank in tile.result():
            s1, cand, src2 = (other, rid, src) if reverse else (rid, other, other_src)
            columns = [pa.repeat(grp, len(mask)), s1, cand, pa.array(src2, pa.int32()), *(pa.array(scores[:, i]) for i in range(len(SCORES))), pa.array(mask, pa.int32()), pa.array(rank, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "s1_id", "cand_id", "src2", *SCORES, "mask", "rk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, tile = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            grps, blocks, other = (batch.column(c) for c in ("grp", "block", "other"))
            code = pc.dictionary_encode(grps).indices.to_numpy(zero_copy_only=False)
            there = [code, blocks.to_numpy(), other.to_numpy(zero_copy_only=False)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in there], axis=0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                here, rows = (grps[i].as_py(), blocks[i].as_py()), batch.slice(i, j - i)
                if here != at:
                    if tile:
                        yield from out(at[0], tile)
                    at, mine, tile = here, [], None
                if other[i].as_py() == 0:
                    mine.append(rows)
                elif mine:
                    tile = tile or _Tile(pa.Table.from_batches(mine).combine_chunks().to_batches()[0], numbered, floor, kinds, not reverse)
                    tile.meet(rows) if other[i].as_py() == 1 else tile.note(rows)
        if tile:
            yield from out(at[0], tile)

    schema = "grp string, s1_id string, cand_id string, src2 int, bs double, bsn double, bsa double, mask int, rk int"
    return dealt.mapInArrow(run, schema)
