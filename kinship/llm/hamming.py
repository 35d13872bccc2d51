"""Operator 3: exact top-k search over binary codes by incremental multi-index hashing.

A code is an array of 64-bit words. Its bits are cut into m segments, and every segment value points to the codes that have it. Codes that differ in at
most m r + a - 1 bits differ in at most r bits in one of the first a, or in at most r - 1 in one of the others. So
a query probes all segment values within radius 0, then 1 and so on, segment by segment, until its k-th distance so far is
provably covered; a step takes as many segments as have MASKS values together, or a part of one segment's. Distances are
verified where the buckets lie, which meet the queries that probe them in blocks: tasks return the k best of each query.
Nothing else ends a search, whatever the size: at the last radius every code has been met.

Equal codes are one entry with their smallest k + 1 ids, which is all that ties by id can ask for; so copies don't pile up.
Buckets are cut into rows of about BUCKET codes, and so are the queries that probe one, so a common segment value isn't
gathered anywhere. Codes are the signs of a vector's components, of any number; shorter vectors than others have zeros, longer
ones than the code's bits are an error. Null vectors, and vectors with null or NaN components, neither search nor are found. The
row that searches is left out of its own result; of rows that repeat an id, the first code by value counts. Fewer than k other
rows give shorter results. Other columns are left out.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinship.llm.common import stored

TOP, WORD = 10, 64
#: Codes that a segment value has on average, and codes of a bucket's row, about.
SHARED, BUCKET = 32, 4096
#: Values that a query probes in a step, at most, and codes times queries of a matrix of distances.
MASKS, MATRIX = 4096, 1 << 21


def sign_code(vector: Column, bits: int = WORD) -> Column:
    """The signs of a vector's components as words: bit i of word w is set if component 64 w + i is positive. Null if one is null or NaN."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    word = lambda part: F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(zero)), zero, lambda a, b: a.bitwiseOR(b))
    words = F.array(*(word(F.slice(vector, w + 1, WORD)) for w in range(0, bits, WORD)))
    long = F.raise_error(F.format_string("codes have %d bits, and a vector has %d components", F.lit(bits), F.size(vector)))
    return F.when(vector.isNull(), None).when(F.size(vector) > bits, long.cast("array<long>")).when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), None).otherwise(words)


def _segments(bits: int, n: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each segment, so long that a value has about SHARED codes; none reaches over the end of a word."""
    want, out = max(4, min(22, math.log2(max(2, n / SHARED)))), []
    for word, start in enumerate(range(0, bits, WORD)):
        size = min(WORD, bits - start)
        m = max(1, min(size, round(size / want)))
        at = [size * i // m for i in range(m + 1)]
        out += [(word, a, b - a) for a, b in itertools.pairwise(at)]
    return out


def _part(code: Column, word: int, first: int, n: int) -> Column:
    return F.shiftrightunsigned(code[word], first).bitwiseAND(F.lit((1 << n) - 1 if n < 63 else -1 if n == 64 else (1 << 63) - 1))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best codes of each query, by distance and smallest id, which names the code; a code counts once."""
    near = Window.partitionBy("q").orderBy("d", "first")
    return found.dropDuplicates(["q", "first"]).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k).drop("r")


def _buckets(index: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(s, v, codes, firsts): the codes' words of each segment value, in rows of about BUCKET codes."""
    values = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), _part(F.col("code"), *p).alias("v")) for s, p in enumerate(parts))))
    rows = index.select("code", "first", values.alias("x")).select("code", "first", "x.s", "x.v")
    large = rows.groupBy("s", "v").agg(F.ceil(F.count("*") / BUCKET).alias("n")).filter("n > 1")
    dealt = rows.join(large, ["s", "v"], "left").withColumn("part", F.pmod(F.xxhash64("code"), F.coalesce("n", F.lit(1))))
    pair = dealt.groupBy("s", "v", "part").agg(F.collect_list(F.struct("code", "first")).alias("x"))
    return pair.select("s", "v", F.flatten("x.code").alias("codes"), F.col("x.first").alias("firsts"))


def _verified(k: int, words: int):
    """Of batches (queries, their codes' words, codes' words, firsts), the k best codes of each query that a task has seen."""

    def nearest(lists: list[tuple[np.ndarray, np.ndarray]]):
        first, d = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.lexsort((first, d))
        _, at = np.unique(first[order], return_index=True)
        top = order[np.sort(at)[:k]]
        return first[top], d[top]

    def out(best):
        if not best:
            return
        first, d = zip(*map(nearest, best.values()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best)), [len(x) for x in first])), pa.array(np.concatenate(first)), pa.array(np.concatenate(d), pa.int32())], names=["q", "first", "d"])

    def parts(column: pa.Array) -> list[np.ndarray]:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for qs, asked, code, first in zip(*map(parts, batch.columns), strict=True):
                order = np.argsort(first)  # ties go to smaller ids
                code, first, asked = code.reshape(-1, words)[order], first[order], asked.reshape(-1, words)
                for a in range(0, len(qs), max(1, MATRIX // len(code))):
                    some = slice(a, a + max(1, MATRIX // len(code)))
                    d = sum(np.bitwise_count((asked[some, w, None] ^ code[None, :, w]).view(np.uint64)).astype(np.int32) for w in range(words))
                    top = np.argsort(d, axis=1, kind="stable")[:, :k]
                    for q, at, near in zip(qs[some].tolist(), top, np.take_along_axis(d, top, axis=1), strict=True):
                        mine = best.setdefault(q, [])
                        mine.append((first[at], near))
                        if len(mine) > 64:
                            best[q] = [nearest(mine)]
                if len(best) > 4096:
                    yield from out(best)
                    best = {}
        yield from out(best)

    return run


def _steps(parts: list[tuple[int, int, int]], radius: int, most: int):
    """(masks of segments, segments that are done by then) of each step of a round."""
    masks: list[tuple[int, int]] = []
    for s, (_, _, bits) in enumerate(parts):
        if masks and len(masks) + math.comb(bits, radius) > most:
            yield masks, s
            masks = []
        for flipped in itertools.combinations(range(bits), radius):
            if len(masks) == most:
                yield masks, s
                masks = []
            masks.append((s, sum(1 << i for i in flipped)))
    if masks:
        yield masks, len(parts)


def top_k(codes: DataFrame, queries: DataFrame, k: int = TOP, bits: int = WORD, most: int = MASKS, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, id, distance) of the k codes nearest to each query but itself; ties go to smaller ids. Codes are arrays of words, of `bits` bits together."""
    clean = lambda df: df.filter(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(code_col).alias("code"))
    rows = clean(codes)
    # the k + 1 smallest ids of each code, in two steps, so that one code's copies are cut down where they lie
    salted = Window.partitionBy("code", "salt").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    index = stored(few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("first", F.col("ids")[0]), "codes")
    asked = stored(clean(queries).groupBy("code").agg(F.min("id").alias("q")), "asked")  # equal queries search once
    n, blocks = index.count(), 1 + asked.count() // BUCKET
    parts = _segments(bits, n)
    m = len(parts)
    buckets = stored(_buckets(index, parts), "buckets")
    keep = k + 1  # one entry may hold nothing but the query
    best, active = None, asked.select("q", F.col("code").alias("qc"))
    value = F.lit(None).cast("long")
    for s, p in enumerate(parts):
        value = F.when(F.col("s") == s, _part(F.col("qc"), *p)).otherwise(value)
    for masks, covered in ((x, m * radius + done - 1) for radius in range(max(b for _, _, b in parts) + 1) for x, done in _steps(parts, radius, most)):
        flips = F.from_json(F.lit(json.dumps([{"s": s, "mask": mask} for s, mask in masks])), "array<struct<s:int,mask:bigint>>")  # a constant of at most `most` entries
        probes = active.select("q", "qc", F.explode(flips).alias("x")).select("q", "qc", "x.s", "x.mask").select("q", "qc", "s", value.bitwiseXOR(F.col("mask")).alias("v"), F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("b"))
        asking = probes.groupBy("s", "v", "b").agg(F.collect_list(F.struct("q", "qc")).alias("x")).select("s", "v", F.col("x.q").alias("q"), F.flatten("x.qc").alias("qc"))
        met = asking.join(buckets, ["s", "v"]).select("q", "qc", "codes", "firsts").mapInArrow(_verified(keep, -(-bits // WORD)), "q long, first long, d int")
        best = stored(_best(met if best is None else best.unionByName(met), keep), "best")
        # a query is done when its last distance is covered, as soon as it has as many as it wants, or all there are
        worst = best.groupBy("q").agg(F.count("*").alias("c"), F.max("d").alias("w")).filter(F.col("c") >= min(keep, n)).select("q", "w")
        active = stored(active.join(worst, "q", "left").filter(F.col("w").isNull() | (F.col("w") > covered)).select("q", "qc"), "active")
        if active.isEmpty():
            break
    by_rank = Window.partitionBy("query_id").orderBy("distance", "id")
    same = clean(queries).withColumnRenamed("id", "query_id").join(asked, "code").select("query_id", "q")
    return best.join(same, "q").join(index.select("first", "ids"), "first").select("query_id", F.explode("ids").alias("id"), F.col("d").alias("distance")).filter("id <> query_id").withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors whose sign codes are nearest to each vector with an id divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    codes = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding"), max(1, bits)).alias("code"))
    return top_k(codes, codes.filter("id % 100 = 0"), bits=max(1, bits)).withColumnRenamed("id", "vec_id")


OP3_SQL = """
WITH codes AS (
  SELECT vec_id AS id, list_aggregate(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END), 'sum')::HUGEINT AS code
  FROM embeddings WHERE embedding IS NOT NULL
), near AS (
  SELECT q.id AS query_id, c.id AS vec_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM codes q JOIN codes c ON q.id <> c.id WHERE q.id % 100 = 0
)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM near
) WHERE rank <= 10
"""
