"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinship.llm.common import stored


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of links (u, v): the smallest node that links reach from it.

    Every round joins each node's neighbours to the smallest of them, first the larger ones and then the smaller ones
    (alternating large-star and small-star), which halves the depth of what remains and keeps the number of links linear.
    Minima are aggregated before they are shuffled, so a node of very many links isn't gathered anywhere. Each round is
    written to the shared folder.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("a"), "m", "u")
        edges = stored(small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not converged")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest_names(links: DataFrame, names: DataFrame) -> DataFrame:
    """(node, least) for each node of links (u, v): the smallest name of its component, from names (node, name), which has each node once."""
    found = stored(components(links).join(names, "node"), "named")
    least = stored(found.groupBy("component").agg(F.min("name").alias("least")), "least")
    return found.join(least, "component").select("node", "least")
