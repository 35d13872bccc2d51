"""Operator 5: embedding near-dedup by dual traversal of cover trees.

Vectors of one label (and one length) are scaled to the unit sphere, where a cosine of at least c is a distance of at most
sqrt(2 - 2 c). They are dealt to the upper levels of a cover tree: a cell of too many entries gets centres far apart, chosen
from a bounded sample of it, and every entry goes to the nearest one, until cells hold a chunk. Every chunk is a cover tree of
its own: a node's members lie within its covering radius, its children's centres are members more than half the radius apart,
and every member goes to a child within half the radius. The traversal starts above the chunks: pairs of cells whose balls
are farther apart than the limit go, level by level, so that only chunks that may have links are sent to one task. There,
node pairs are walked down together: pruned where the centres' distance less both radii exceeds the limit, taken as a whole
where the distance and both radii stay below it, opened otherwise; what remains is decided by the cosine in double precision.
How entries are dealt decides the speed alone: the pairs found are exact.

Equal vectors of a label are one entry with its number of rows and a number of its own, so that ids may repeat. Tasks return no
pairs, but for each entry how many vectors it links with and a root of its component there; components are joined afterwards.
A task holds two chunks of at most CHUNK entries. Where vectors have no structure (random ones of many dimensions: nearly equal
distances) no ball holds two of them without holding all, so no bound of balls prunes chunks, and a label of n vectors costs
(n / CHUNK)^2 / 2 chunk pairs, each a product of matrices.

Null labels, null, empty and zero vectors and such with null, NaN or infinite components link with nothing. Null ids keep
their rows, with no links of their own. Rows that repeat count as copies; other columns are left out. Ids may be of any type
that can be ordered.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinship.llm.common import split_join, stored
from kinship.llm.components import smallest_names

THRESHOLD = 0.93
#: Entries and numbers of a chunk, at most; entries of a leaf, at most.
CHUNK, CELLS, LEAF = 4096, 1 << 20, 24
#: Entries of a cell that its centres are chosen from, centres of a cell, at most, and levels above the chunks, at most.
SAMPLE, CENTRES, LEVELS = 512, 64, 8
#: Nodes whose distances are computed at a time.
STEP = 1024
#: Slack for rounding in the bounds; what lies within is decided by the cosine.
SLACK = 1e-7


def unit(rows) -> np.ndarray:
    """Vectors in double precision, scaled to length 1."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def centres_apart(x: np.ndarray, first: int, apart: float, most: int | None = None, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, the nearest of them to each row, its distance): rows more than `apart` from each other, the first one and then always some of the farthest, until every row is within `apart` of one, or there are `most`."""
    chosen, own, near = [first], np.zeros(len(x), np.int64), distances(x, x[first : first + 1]).ravel()
    while near.max() > apart and (most is None or len(chosen) < most):
        far = np.argpartition(-near, min(batch, len(near) - 1))[:batch]
        far = far[np.argsort(-near[far], kind="stable")]
        far = far[near[far] > apart]
        between, new = distances(x[far], x[far]), []
        for i in range(len(far)):
            if not new or between[i, new].min() > apart:
                new.append(i)
        new = new[: None if most is None else most - len(chosen)]
        d = distances(x, x[far[new]])
        best = d.argmin(axis=1)
        least = d[np.arange(len(x)), best]
        closer = least < near
        own[closer], near[closer] = best[closer] + len(chosen), least[closer]
        chosen += far[new].tolist()
    own[chosen] = np.arange(len(chosen))
    return np.array(chosen), own, near


class Tree:
    """A cover tree over unit vectors: nodes as arrays; a node's members are a range of order, its children a range of nodes."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int]] = []
        self._node(x, int((x @ x.mean(axis=0)).argmax()), 0, len(x))
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.range[node]
            if b - a > LEAF and self.radius[node] > SLACK:
                self._split(x, node)
                todo += range(*self.kids[node])
        self.pack()

    def pack(self) -> None:
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius, np.float64)
        self.range, self.kids = np.array(self.range, np.int64).reshape(-1, 2), np.array(self.kids, np.int64).reshape(-1, 2)

    def _node(self, x: np.ndarray, centre: int, a: int, b: int) -> None:
        self.centre.append(centre)
        self.radius.append(float(distances(x[centre : centre + 1], x[self.order[a:b]]).max()) if b - a > 1 else 0.0)
        self.range.append((a, b))
        self.kids.append((0, 0))

    def _split(self, x: np.ndarray, node: int) -> None:
        """Children around centres farther apart than half the radius: the node's own, then always the farthest members."""
        a, b = self.range[node]
        members = self.order[a:b].copy()
        chosen, own, _ = centres_apart(x[members], int(np.flatnonzero(members == self.centre[node])[0]), self.radius[node] / 2)
        by_child = np.argsort(own, kind="stable")
        self.order[a:b] = members[by_child]
        ends = a + np.cumsum(np.bincount(own, minlength=len(chosen)))
        first = len(self.centre)
        for c, lo, hi in zip(members[chosen].tolist(), [a, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self._node(x, c, lo, hi)
        self.kids[node] = (first, len(self.centre))


class Links:
    """Counts of linked vectors and a root for each entry, from pairs found anywhere."""

    def __init__(self, n: int, weight: np.ndarray):
        self.count, self.weight, self.edges = np.zeros(n), weight, []

    def add(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Pairs of entries a and b, which have none in common, where linked holds."""
        self.count[a] += linked @ self.weight[b]
        self.count[b] += linked.T @ self.weight[a]
        i, j = np.nonzero(linked)
        self.edges.append(np.stack((a[i], b[j])))

    def add_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each entry of a with the one of b at its place."""
        self.count += np.bincount(a, self.weight[b], len(self.count)) + np.bincount(b, self.weight[a], len(self.count))
        self.edges.append(np.stack((a, b)))

    def add_all(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        self.edges += [np.stack((a, np.full(len(a), b[0]))), np.stack((np.full(len(b), a[0]), b))]

    def add_within(self, a: np.ndarray, linked: np.ndarray) -> None:
        """Pairs among the entries a; linked is symmetric with nothing on its diagonal."""
        self.count[a] += linked @ self.weight[a]
        i, j = np.nonzero(linked)
        self.edges.append(np.stack((a[i], a[j])))

    def add_clique(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self.edges.append(np.stack((a, np.full(len(a), a[0]))))

    def roots(self, name: np.ndarray) -> np.ndarray:
        """The smallest name that links reach from each entry."""
        root = name.copy()
        if not self.edges:
            return root
        a, b = np.concatenate(self.edges, axis=1)
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            if (new == root).all():
                return root
            root = new


def traverse(x: np.ndarray, trees: list[Tree], starts: list[int], links: Links, threshold: float) -> None:
    """Links within one tree, or between two; starts: where each tree's entries begin among x."""
    limit = math.sqrt(2 - 2 * threshold)
    one, two, same = trees[0], trees[-1], len(trees) == 1
    members = lambda t, s, n: s + t.order[t.range[n, 0] : t.range[n, 1]]
    todo, within = [] if same else [(np.zeros(1, np.int64), np.zeros(1, np.int64), False)], [0] if same else []
    while within:
        p = within.pop()
        if one.range[p, 1] - one.range[p, 0] == 1:
            continue
        a, kids = members(one, starts[0], p), np.arange(*one.kids[p])
        if 2 * one.radius[p] <= limit - SLACK:
            links.add_clique(a)
        elif len(kids):
            within += kids.tolist()
            todo.append((kids, kids, True))
        else:
            linked = x[a] @ x[a].T >= threshold
            np.fill_diagonal(linked, False)
            links.add_within(a, linked)
    while todo:
        ps, qs, triangle = todo.pop()
        for i in range(0, len(ps), STEP):
            for j in range(i if triangle else 0, len(qs), STEP):
                _opened(x, one, two, starts, ps[i : i + STEP], qs[j : j + STEP], triangle and i == j, threshold, limit, links, todo, members)


def _opened(x, one, two, starts, ps, qs, triangle, threshold, limit, links, todo, members) -> None:
    """All pairs of nodes ps and qs: pruned, taken as a whole, decided, or left to do."""
    a, b = starts[0] + one.centre[ps], starts[-1] + two.centre[qs]
    cosine = x[a] @ x[b].T
    reach = limit + one.radius[ps].max() + two.radius[qs].max() + 2 * SLACK  # no pair of these nodes is near beyond
    i, j = np.nonzero(cosine >= 1 - reach * reach / 2) if reach < 2 else np.nonzero(np.ones_like(cosine))
    if triangle:
        i, j = i[i < j], j[i < j]
    cosine = cosine[i, j]
    d, reach = np.sqrt(np.maximum(0, 2 - 2 * cosine)), one.radius[ps[i]] + two.radius[qs[j]]
    near = d - reach <= limit + SLACK
    i, j, d, reach, cosine = i[near], j[near], d[near], reach[near], cosine[near]
    single = (np.diff(one.range[ps[i]])[:, 0] == 1) & (np.diff(two.range[qs[j]])[:, 0] == 1)
    linked = single & (cosine >= threshold)
    if linked.any():
        links.add_pairs(a[i[linked]], b[j[linked]])
    whole = d + reach <= limit - SLACK
    for p, q, all_linked in zip(ps[i[~single]].tolist(), qs[j[~single]].tolist(), whole[~single].tolist(), strict=True):
        if all_linked:
            links.add_all(members(one, starts[0], p), members(two, starts[-1], q))
            continue
        left, right = np.arange(*one.kids[p]), np.arange(*two.kids[q])
        if not len(left) and not len(right):
            e, f = members(one, starts[0], p), members(two, starts[-1], q)
            links.add(e, f, x[e] @ x[f].T >= threshold)
            continue
        # both are opened, unless one is so much larger that it is opened alone
        keep_p = not len(left) or len(right) and two.radius[q] > 2 * one.radius[p]
        keep_q = not len(right) or len(left) and one.radius[p] > 2 * two.radius[q]
        todo.append((np.array([p]) if keep_p else left, np.array([q]) if keep_q else right, False))


def _planted(rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk as a row: its root's ball and its tree, packed."""
    rows = rows.sort_values("class")
    raw = np.array(rows["v"].tolist(), np.float32 if rows["single"].iat[0] else np.float64)
    x = unit(raw)
    tree, data = Tree(x), io.BytesIO()
    np.savez(data, v=raw, name=rows["class"].to_numpy(), mult=rows["mult"].to_numpy(np.float64), order=tree.order.astype(np.int32), centre=tree.centre.astype(np.int32), radius=tree.radius, range=tree.range.astype(np.int32), kids=tree.kids.astype(np.int32))
    first = rows.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "cell": [first["cell"]], "n": [len(rows)], "centre": [x[tree.centre[0]].tolist()], "radius": [tree.radius[0]], "tree": [data.getvalue()]})


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree]:
    z = np.load(io.BytesIO(data))
    tree = Tree.__new__(Tree)
    tree.order, tree.centre, tree.radius, tree.range, tree.kids = z["order"].astype(np.int64), z["centre"], z["radius"], z["range"], z["kids"]
    tree.pack()
    return unit(z["v"]), z["name"], z["mult"], tree


KEY = ["label", "dim", "cell"]


def dealt(classes: DataFrame, chunk: int) -> DataFrame:
    """classes (label, v, dim and others) with cell: the numbers of the centres from the top down, joined by points. A cell has at most as many entries as a chunk."""
    most = F.greatest(F.lit(64), F.least(F.lit(chunk), F.floor(F.lit(CELLS) / F.col("dim")))).cast("long")
    label = classes.schema["label"].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)

    names = [*classes.columns, "cell"]

    def seeded(rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(rows["v"].tolist())
        wanted = min(CENTRES, 2 * -(-int(rows["k"].iat[0]) // int(rows["most"].iat[0])))
        chosen, _, _ = centres_apart(x, int((x @ x.mean(axis=0)).argmax()), SLACK, wanted, 1)
        return pd.DataFrame({"label": [rows["label"].iat[0]], "dim": [rows["dim"].iat[0]], "cell": [rows["cell"].iat[0]], "centres": [x[chosen].tobytes()]})

    def nearest(batches):
        for rows in batches:
            cell = rows["cell"].to_numpy(object)
            for data, at in rows.groupby("centres").indices.items():
                centres = np.frombuffer(data).reshape(-1, len(rows["v"].iat[at[0]]))
                own = (unit(rows["v"].iloc[at].tolist()) @ centres.T).argmax(axis=1)
                cell[at] = [f"{cell[i]}.{k}" for i, k in zip(at, own, strict=True)]
            yield rows.assign(cell=cell)[names]

    rest, done = classes.withColumn("cell", F.lit("")), []
    for _ in range(LEVELS):
        counts = stored(rest.groupBy(KEY).agg(F.count("*").alias("k")).withColumn("most", most), "cells")
        large = counts.filter("k > most")
        if large.isEmpty():
            return _together([*done, rest])
        done.append(rest.join(large, KEY, "left_anti"))
        here = rest.join(large, KEY).withColumn("r", F.xxhash64("class", F.lit(3)))
        # the sample in two steps: some of each cell wherever they lie, then SAMPLE of these
        few = here.filter(F.pmod("r", F.lit(1 << 30)) * F.col("k") < F.lit(float(1 << 30)) * 4 * SAMPLE)
        by = F.row_number().over(Window.partitionBy(KEY).orderBy("r", "class"))
        seeds = stored(few.withColumn("at", by).filter(F.col("at") <= SAMPLE).groupBy(KEY).applyInPandas(seeded, f"label {label}, dim int, cell string, centres binary"), "centres")
        rest = stored(rest.join(seeds, KEY).mapInPandas(nearest, f"{schema}, cell string"), "rest")
    # what no centres divide (vectors of one direction) is dealt by a hash
    counts = stored(rest.groupBy(KEY).agg(F.count("*").alias("k")).withColumn("most", most), "cells")
    part = F.pmod(F.xxhash64("class", F.lit(4)), 2 * F.ceil(F.col("k") / F.col("most")))
    return _together([*done, rest.join(counts, KEY).withColumn("cell", F.when(F.col("k") > F.col("most"), F.concat("cell", F.lit("."), part.cast("string"))).otherwise(F.col("cell"))).drop("k", "most")])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)))


def chunk_pairs(balls: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, p, q): the pairs of cells, p <= q, whose balls lie within the limit, from the chunks' balls (label, dim, cell, n, centre, radius); found from the top down, where a cell's ball holds those of its parts."""
    limit, group = math.sqrt(2 - 2 * threshold) + SLACK, ["label", "dim"]
    depth = balls.agg(F.max(F.size(F.split("cell", r"\.")))).first()[0] or 1  # a point more than levels
    pairs = balls.select(*group, F.lit("").alias("p"), F.lit("").alias("q")).distinct()  # at the top
    for level in range(1, max(2, depth)):
        named = balls.withColumns({"node": F.substring_index("cell", ".", level + 1), "parent": F.substring_index("cell", ".", level)})
        middle = named.groupBy(*group, "parent", "node").agg(F.max_by("centre", "n").alias("middle"))
        nodes = stored(named.join(middle, [*group, "parent", "node"]).groupBy(*group, "parent", "node").agg(F.first("middle").alias("middle"), F.max(_distance("centre", "middle") + F.col("radius")).alias("radius")), "nodes")
        side = lambda x: nodes.select(*group, F.col("parent").alias(x), F.col("node").alias(f"{x}_node"), F.col("middle").alias(f"{x}_middle"), F.col("radius").alias(f"{x}_radius"))  # noqa: E731, B023
        opened = pairs.join(side("p"), [*group, "p"]).join(side("q"), [*group, "q"]).filter("p <> q OR p_node <= q_node")
        near = opened.filter(_distance("p_middle", "q_middle") - F.col("p_radius") - F.col("q_radius") <= limit)
        pairs = stored(near.select(*group, F.least("p_node", "q_node").alias("p"), F.greatest("p_node", "q_node").alias("q")), "pairs")
    return pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id (the smallest id that links reach) and kept (whether that is its own)."""
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    single = "array<float>" in vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(fine & F.col("id").isNotNull(), F.lit(False)), F.transform(v, lambda x: x + 0)))  # + 0: no negative zeros
    known = rows.filter(v.isNotNull())
    # numbered as they are written: the numbers are read again with the rows
    classes = stored(known.groupBy("label", "v").agg(F.min("id").alias("name"), F.count("*").alias("mult")).withColumns({"dim": F.size("v"), "class": F.monotonically_increasing_id()}), "classes")
    label = vectors.schema[label_col].dataType.simpleString()
    celled = dealt(classes.select("class", "label", "dim", "v", "mult"), chunk).withColumn("single", F.lit(single))
    trees = stored(celled.groupBy(KEY).applyInPandas(_planted, f"label {label}, dim int, cell string, n long, centre array<double>, radius double, tree binary"), "trees")
    pairs = chunk_pairs(trees.drop("tree"), threshold)
    sides = pairs.select("label", "dim", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("cell"))
    both = sides.join(trees.select(*KEY, "tree"), KEY)

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_read(t) for t in rows.sort_values("cell")["tree"]]
        x, name, mult = (np.concatenate([f[i] for f in found]) for i in range(3))
        links = Links(len(x), mult)
        traverse(x, [f[3] for f in found], [0] if len(found) == 1 else [0, len(found[0][0])], links, threshold)
        some = links.count > 0
        return pd.DataFrame({"class": name[some], "links": links.count[some].astype(np.int64), "root": links.roots(name)[some]})

    found = stored(both.groupBy("label", "dim", "p", "q").applyInPandas(linked, "class long, links long, root long"), "found")
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = smallest_names(found.select(F.col("class").alias("u"), F.col("root").alias("v")), classes.select(F.col("class").alias("node"), "name")).withColumnRenamed("node", "class")
    by_class = classes.join(sums, "class", "left").join(joined, "class", "left").select("label", "v", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "name").alias("least"))
    out = split_join(known, by_class, ["label", "v"], classes.select("label", "v", F.col("mult").alias("n")), known.count())
    out = out.select("id", "links", "least").unionByName(rows.filter(v.isNull()).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("least")))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))


def op5_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings of a label: cosine of 0.93 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
