"""Operator 7: join of texts by the Jaccard similarity of their word n-grams, by chosen paths.

A text is the set of its shingles (hashes of five consecutive words, without case and signs). In each of several
independent runs a set chooses each of its shingles j with a chance of 1 / (threshold x size), by a hash that all sets
share, and goes into the bucket of every shingle chosen; a bucket of too many sets is split the same way, by hashes of
the path so far, SPLITS times independently, unless that leaves no fewer pairs to compare than the bucket has. Sets of
similarity s meet in a bucket with a chance that grows with s, and runs repeat until pairs at the threshold are missed with a
chance of 1 - recall at most, through all splits. A bucket that is small, isn't worth splitting, or whose depth is used up, is
compared by brute force: shared shingles are counted as a product of presence matrices, so similarities are exact.

Texts of equal sets are one class, compared once and weighted by its number of texts. A class has a number of its own and is
named by the smallest id (of equal ones, the smallest hash of a text) among its rows, so that ids may repeat. Buckets of one
class are dropped before any set is sent, and of buckets with the same members one is kept. A pair that meets in several buckets
is counted in the first, which both members know. Buckets of more than GROUP sets or CELLS shingles are cut into blocks, and each
pair of blocks is a task of its own: its memory is bounded and nothing is left out. Tasks return a row for each member,
how many texts it links with and a root of its component there, and no pairs.

Null ids, null texts and texts without words link with nothing; shorter texts than five words have one shingle. Rows that repeat
count as copies, and rows that share an id but not a text are compared each by its own text. Ids may be of any type that can be
ordered; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm.common import mixed, shingles, slices, small_batches, split_join, stored, texts, with_membership
from kinship.llm.components import smallest_names

THRESHOLD, WIDTH, RECALL = 0.8, 5, 0.9999
#: Sets and shingles of a bucket that is compared as it is, and how often a larger one is split.
GROUP, CELLS, DEPTH = 2048, 1 << 21, 2
#: Independent splits of a bucket: three keep the target at any depth within the same number of runs.
SPLITS = 3
#: The bits of a bucket's number that name its run.
RUN_BITS = 6


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with this chance, even if all its buckets are split to the full depth. A run's chosen common shingles are about Poisson, with a mean of 1 where one set contains the other, and more otherwise."""
    met = 1.0  # the chance that a pair of a bucket meets below it
    for _ in range(depth):
        met = 1 - math.exp(-SPLITS * met)
    return math.ceil(-math.log(1 - recall) / met)


def _chosen(sets: np.ndarray, key: np.ndarray, share: float) -> np.ndarray:
    """For each key whether each element is chosen: a hash of both is below the share."""
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    return mixed(sets[None, :] ^ key[:, None]) <= limit


def first_paths(sets: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """The buckets of each run, as numbers that start with the run."""
    if not len(sets):
        return np.zeros(0, np.int64)
    keys = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    run, j = np.nonzero(_chosen(sets, keys, 1 / (threshold * len(sets))))
    return (run.astype(np.int64) << (63 - RUN_BITS)) | (mixed(sets[j] + keys[run]) >> np.uint64(RUN_BITS + 1)).astype(np.int64)


def next_paths(sets: np.ndarray, node: int, threshold: float) -> np.ndarray:
    """The buckets that a set goes to within one bucket, of all its splits."""
    low = (1 << (63 - RUN_BITS)) - 1
    keys = mixed(np.uint64(node) + np.arange(1, SPLITS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    split, j = np.nonzero(_chosen(sets, keys, 1 / (threshold * len(sets))))
    return np.int64(node & ~low) | (mixed(sets[j] + keys[split]) >> np.uint64(RUN_BITS + 1)).astype(np.int64)


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, step: int = 1024) -> np.ndarray:
    """How many elements each set of rows has in common with each of columns."""
    n = len(sets)
    owner, value = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    times = np.diff(np.append(np.flatnonzero(new), len(value)))
    keep = np.repeat(times > 1, times)
    column = np.cumsum(np.repeat(times > 1, times) & new) - 1
    owner, column = owner[keep], column[keep]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (first, first + step))
        x = np.zeros((n, min(step, int(column[b - 1]) - first + 1)), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        out += x[rows] @ x[columns].T
    return out


def compare(sets: list[np.ndarray], nodes: list[np.ndarray], node: int, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, counted) of the members `rows` with `columns`: which link, and which of these pairs are counted here as no earlier bucket has both."""
    size = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets, rows, columns)
    linked = np.empty(shared.shape, bool)
    for i in range(0, len(rows), 256):  # counts up to 2 ** 24 are exact in single precision, but not their products
        linked[i : i + 256] = shared[i : i + 256].astype(np.float64) * (1 + threshold) >= threshold * (size[rows[i : i + 256], None] + size[columns][None]) - 1e-6
    linked &= rows[:, None] != columns[None, :]
    return linked, linked & (shared_counts([x[x < node] for x in nodes], rows, columns) == 0) if linked.any() else linked


def roots(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The smallest number that links of rows with columns reach from each member; worked off by some rows at a time, as most of a group may be linked."""
    root, none = number.copy(), np.iinfo(number.dtype).max
    while True:
        before = root.copy()
        for i in range(0, len(rows), 256):
            part, r = linked[i : i + 256], rows[i : i + 256]
            root[r] = np.minimum(root[r], np.where(part, root[columns][None], none).min(axis=1, initial=none))
            root[columns] = np.minimum(root[columns], np.where(part, root[r][:, None], none).min(axis=0, initial=none))
        if (root == before).all():
            return root


def weights(counted: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The sum of mult over each row's counted columns."""
    return np.concatenate([counted[i : i + 256] @ mult for i in range(0, len(counted), 256)])


def _sets(docs: DataFrame, id_col: str, text_col: str, runs: int, threshold: float) -> DataFrame:
    """One row per row of docs: id, t (a hash of its text), c1 and c2 (a hash of its set), n (its size) and nodes (its first buckets)."""

    def run(batches):
        for batch in batches:
            data = texts(batch, "text")
            for a, b in slices([len(x) for x in data]):
                rows = []
                for text in data[a:b]:
                    s = shingles(text, WIDTH)
                    with np.errstate(over="ignore"):
                        rows.append((int(s.sum().astype(np.int64)), int(mixed(s + np.uint64(7)).sum().astype(np.int64)), len(s), first_paths(s, runs, threshold)))
                c1, c2, n, nodes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "t", "c1", "c2", "n", "nodes"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, t long, c1 long, c2 long, n long, nodes array<long>")


def _content(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, s: its shingles as bytes) of wanted's classes, each once: from the text that names the class."""

    def run(batches):
        for batch in batches:
            data = texts(batch, "text")
            for a, b in slices([len(x) for x in data]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingles(x, WIDTH).tobytes() for x in data[a:b]], pa.binary())], names=["class", "s"])

    wanted = stored(wanted.select("name.id", "name.t", "class"), "wanted")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    once = with_membership(rows, wanted, ["id", "t"], "maybe").filter("maybe").groupBy("id", "t").agg(F.min("text").alias("text"))
    here = once.join(wanted.hint("merge"), ["id", "t"])  # a list that grows with the input isn't broadcast
    return here.select("class", "text").mapInArrow(run, "class long, s binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, group: int = GROUP, cells: int = CELLS, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text_hash (xxhash64 of its text), class_id (the smallest id with the same set), n_links (other rows linked directly), component_id (the smallest id that links reach) and first (whether the row is the component's first, by id and hash; equal rows are so together)."""
    docs = small_batches(docs)
    runs = runs_needed(recall, depth)
    if runs >= 1 << RUN_BITS:
        raise ValueError("too many runs")
    all_sets = stored(_sets(docs, id_col, text_col, runs, threshold), "sets")
    known = all_sets.filter("n > 0 AND id IS NOT NULL")
    # numbered as they are written: the numbers are read again with the rows
    classes = stored(known.groupBy("c1", "c2").agg(F.min(F.struct("id", "t")).alias("name"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("nodes").alias("nodes")).withColumn("class", F.monotonically_increasing_id()), "classes")
    members = classes.select("class", "n", F.explode("nodes").alias("node"))
    sized = lambda rows, *more: rows.groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("cells"), *more).filter("k > 1")
    small = (F.col("k") <= group) & (F.col("cells") <= cells)
    sizes = stored(sized(members, F.sum(F.xxhash64("class").cast("decimal(20,0)")).cast("string").alias("who")), "buckets")
    only = sizes.filter(small).groupBy("who", "k").agg(F.min("node").alias("node"), F.first("cells").alias("cells"))
    kept = [members.join(only, "node").select("class", "node", "k", "cells")]
    large = stored(members.join(sizes.filter(~small).select("node"), "node").select("class", "n", "node"), "large")
    wanted = classes.join(kept[0].select("class").unionByName(large.select("class")).distinct(), "class", "left_semi")
    content = stored(_content(docs, wanted, id_col, text_col), "shingles")

    def split(batches):
        for batch in batches:
            numbers, size, node, parent = [], [], [], []
            for r, xs, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(s, np.uint64)
                for x in xs:
                    found = next_paths(values, x, threshold)
                    numbers += [r] * len(found)
                    size += [len(values)] * len(found)
                    node += found.tolist()
                    parent += [x] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (numbers, size, node, parent)], names=["class", "n", "node", "parent"])

    for _ in range(depth):
        if large.isEmpty():
            break
        lists = large.groupBy("class").agg(F.collect_list("node").alias("nodes"))  # a few for each run
        below = stored(lists.join(content, "class").mapInArrow(split, "class long, n long, node long, parent long"), "below")
        counts = stored(sized(below, F.first("parent").alias("parent")), "buckets")
        pairs = counts.groupBy("parent").agg(F.sum(F.col("k") * F.col("k")).alias("pairs")).withColumnRenamed("parent", "node")
        whole = stored(sized(large).join(pairs, "node", "left").withColumn("apart", F.coalesce("pairs", F.lit(0)) < F.col("k") * F.col("k")), "whole")
        kept.append(large.join(whole.filter("NOT apart"), "node").select("class", "node", "k", "cells"))
        counts = counts.join(whole.filter("apart").select(F.col("node").alias("parent")), "parent", "left_semi")
        kept.append(below.join(counts.filter(small).select("node", "k", "cells"), "node").select("class", "node", "k", "cells"))
        large = stored(below.join(counts.filter(~small).select("node"), "node").select("class", "n", "node"), "large")
    if not large.isEmpty():
        kept.append(large.join(sized(large), "node").select("class", "node", "k", "cells"))
    placed = kept[0]
    for more in kept[1:]:
        placed = placed.unionByName(more)
    placed = stored(placed.dropDuplicates(["class", "node"]), "placed")
    found = _compared(placed, classes, content, threshold, group, cells)
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = smallest_names(found.select(F.col("class").alias("u"), F.col("root").alias("v")), classes.select(F.col("class").alias("node"), "name")).withColumnRenamed("node", "class")
    by_class = classes.join(sums, "class", "left").join(joined, "class", "left").select("c1", "c2", "name", F.coalesce("least", "name").alias("least"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    linked = split_join(known.select("id", "t", "c1", "c2"), by_class, ["c1", "c2"], classes.select("c1", "c2", F.col("mult").alias("n")), known.count())
    linked = linked.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("name.id").alias("class_id"), F.col("links").alias("n_links"), F.col("least.id").alias("component_id"), ((F.col("id") == F.col("least.id")) & (F.col("t") == F.col("least.t"))).alias("first"))
    alone = all_sets.filter("n = 0 OR id IS NULL").select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def _compared(placed: DataFrame, classes: DataFrame, content: DataFrame, threshold: float, group: int, cells: int) -> DataFrame:
    """(class, links, root) of the members that link, from every bucket or pair of blocks."""
    blocks = F.greatest(F.ceil(F.col("k") / group), F.ceil(F.col("cells") / cells)).cast("int")
    own = placed.groupBy("class").agg(F.collect_list(F.struct("node", blocks.alias("b"))).alias("at"))  # a few for each run
    # what a class brings along is joined once and then dealt to its buckets
    whole = classes.select("class", "mult").join(own, "class").join(content, "class").select("class", "mult", F.col("at.node").alias("nodes"), "s", F.explode("at").alias("x"))
    dealt = whole.select("class", "mult", "nodes", "s", "x.node", "x.b").withColumn("mine", F.pmod(F.xxhash64("class", F.lit(3)), F.col("b")).cast("int"))
    rows = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumns({"i": F.least("mine", "o"), "j": F.greatest("mine", "o")}).drop("b", "o")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        number, mult, mine = rows["class"].to_numpy(), rows["mult"].to_numpy(np.float64), rows["mine"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["s"]]
        nodes = [np.asarray(x, np.int64) for x in rows["nodes"]]
        i, j = int(rows["i"].iat[0]), int(rows["j"].iat[0])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        linked, counted = compare(sets, nodes, int(rows["node"].iat[0]), left, right, threshold)
        links, some = np.zeros(len(rows)), np.zeros(len(rows), bool)
        links[left] += weights(counted, mult[right])
        some[left] |= linked.any(axis=1)
        if i != j:
            links[right] += weights(counted.T, mult[left])
            some[right] |= linked.any(axis=0)
        return pd.DataFrame({"class": number[some], "links": links[some].astype(np.int64), "root": roots(linked, left, right, number)[some]})

    return stored(rows.groupBy("node", "i", "j").applyInPandas(run, "class long, links long, root long"), "found")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
