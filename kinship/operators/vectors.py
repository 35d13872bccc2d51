"""Vector passes: exact top-k by inner product within a group, and cosines of given pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block on either side, and of a product: either side is copied once for each block of the other.
BLOCK, STRIP = 16384, 512


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k largest, ties by place."""
    if s.shape[1] <= 4 * k:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]  # all that reach the k-th largest, of which ties may be many
    row, place = np.nonzero(s >= least)
    order = np.lexsort((place, -s[row, place], row))
    starts = np.searchsorted(row, np.arange(len(s)))
    return place[order][starts[:, None] + np.arange(k)]


def top_k(left: DataFrame, right: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(s1_id, cand_id, src2, score) of the k nearest candidates of each record and source in its group.

    left (grp, s1_id, v), right (grp, cand_id, src2, v). Both are cut into blocks; a task multiplies a block by a block, some
    rows at a time, and keeps k for each record, and a second step keeps the k best of these, so no more than k rows per block
    are shuffled.
    """
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # so that both may come from one table
    n_left = left.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("p"))
    n_right = right.groupBy("grp", "src2").agg(F.ceil(F.count("*") / BLOCK).alias("q"))
    blocks = n_left.join(n_right, "grp")
    a = left.join(n_left, "grp").withColumn("i", F.pmod(F.xxhash64("s1_id"), F.col("p"))).drop("p").join(blocks, "grp").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    b = right.join(n_right, ["grp", "src2"]).withColumn("j", F.pmod(F.xxhash64("cand_id"), F.col("q"))).drop("q").join(blocks, ["grp", "src2"]).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    columns = ["s1_id", "cand_id", "src2", "score"]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=columns)
        y = y.sort_values("cand_id")
        names, other = y["cand_id"].to_numpy(), np.stack(y["v"].to_list()).astype(np.float64).T
        out = []
        for i in range(0, len(x), STRIP):
            part = x.iloc[i : i + STRIP]
            s = np.stack(part["v"].to_list()).astype(np.float64) @ other
            order = _first(np.round(s, 6), k)
            value = np.take_along_axis(s, order, 1)
            keep = value >= least
            row = np.broadcast_to(np.arange(len(part))[:, None], order.shape)[keep]
            out.append(pd.DataFrame({"s1_id": part["s1_id"].to_numpy()[row], "cand_id": names[order[keep]], "src2": y["src2"].iat[0], "score": value[keep]}))
        return pd.concat(out)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    own = lambda df, *columns: df.select(*(F.col(c).alias(c) for c in ("grp", "src2", "i", "j", *columns))).groupBy("grp", "src2", "i", "j")
    part = own(a, "s1_id", "v").cogroup(own(b, "cand_id", "v"))
    found = part.applyInPandas(best, f"s1_id {kind(left, 's1_id')}, cand_id {kind(right, 'cand_id')}, src2 {kind(right, 'src2')}, score double")
    near = Window.partitionBy("s1_id", "src2").orderBy(F.round("score", 6).desc(), "cand_id")
    return found.withColumn("rk", F.row_number().over(near)).filter(F.col("rk") <= k)


def pair_cosines(pairs: DataFrame, vectors: DataFrame, out: str = "es") -> DataFrame:
    """pairs (s1_id, cand_id) with the inner product of their vectors (entity_id, v); null where one has none."""
    one = vectors.select(F.col("entity_id").alias("s1_id"), F.col("v").alias("__v1"))
    two = vectors.select(F.col("entity_id").alias("cand_id"), F.col("v").alias("__v2"))
    return pairs.join(one, "s1_id", "left").join(two, "cand_id", "left").withColumn(out, dot(F.col("__v1"), F.col("__v2"))).drop("__v1", "__v2")


def hashed_text_vectors(texts: DataFrame, dims: int = 1 << 12) -> DataFrame:
    """(entity_id, v) of (entity_id, text): unit vectors of hashed character trigrams weighted by rarity, where no encoder is at hand."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    s = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    grams = F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3)))).otherwise(F.array(s))
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=dims).transform(texts.select("entity_id", grams.alias("grams")))
    rare = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="unit").transform(rare).select("entity_id", vector_to_array("unit", "float32").alias("v"))


def record_texts(profile: DataFrame, raw: bool = False) -> DataFrame:
    """(entity_id, text) for an encoder: the normalised or the original name and address."""
    a, b = ("raw_name", "raw_addr") if raw else ("core_text", "addr_text")
    return profile.select("entity_id", F.concat_ws(" | ", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))).alias("text"))
