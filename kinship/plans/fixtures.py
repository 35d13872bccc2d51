"""Entity views of the driver's tables, as SQL that Spark and DuckDB read alike; table names stand in braces."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One record per part; the size is the house number.
PROFILES = """
SELECT concat('S', CAST(1 + p_partkey % 3 AS STRING), '-', CAST(p_partkey AS STRING)) AS entity_id, CAST(1 + p_partkey % 3 AS INT) AS src,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE lower(p_type) END AS country_key,
  concat(p_name, ' ', CASE WHEN p_partkey % 5 = 0 THEN 'holdings' WHEN p_partkey % 5 = 1 THEN 'inc' ELSE lower(p_type) END) AS core_text,
  concat(CAST(p_size AS STRING), ' ', lower(replace(p_brand, '#', ' ')), ' street ', CAST(10000 + p_partkey % 97 AS STRING)) AS addr_text,
  CAST(10000 + p_partkey % 97 AS STRING) AS postal, CAST(p_size AS BIGINT) AS house, p_partkey AS num
FROM {part}
"""
#: Pairs of records with the same name and size; truth: the same brand. p and q are scores from the ids.
PAIRS = f"""
SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.src AS src2, a.country_key AS country_key, a.num AS num1, b.num AS num2,
  a.core_text AS core_text1, b.core_text AS core_text2, a.addr_text AS addr_text1, b.addr_text AS addr_text2, a.postal AS postal1, b.postal AS postal2,
  a.house + (a.num % 3) * 7 AS house1, CASE WHEN b.num % 11 = 0 THEN NULL ELSE b.house + (b.num % 4) * 9 END AS house2,
  ((a.num * 7919 + b.num * 104729) % 10007) / 10007.0D AS p, ((a.num * 31 + b.num * 977) % 997) / 997.0D AS q,
  a.num % 25 = b.num % 25 OR (a.num + b.num) % 5 = 0 AS label
FROM ({PROFILES}) a JOIN ({PROFILES}) b ON split_part(a.core_text, ' ', 1) = split_part(b.core_text, ' ', 1) AND split_part(a.core_text, ' ', 2) = split_part(b.core_text, ' ', 2) AND a.house = b.house
WHERE a.src = 1 AND b.src <> 1
"""
#: What the two records of a pair have in common; null where PAIRS finds none.
BLOCK = "concat(split_part(core_text, ' ', 1), ' ', split_part(core_text, ' ', 2), ' ', CAST(house AS STRING))"
VECTORS = "SELECT vec_id, CAST(1 + vec_id % 3 AS INT) AS src, embedding AS v FROM {embeddings}"


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("10007.0D", "CAST(10007 AS DOUBLE)").replace("997.0D", "CAST(997 AS DOUBLE)").replace("AS STRING", "AS VARCHAR")


class Tables:
    """The views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        return self.spark.sql(sql, **{t: self.table(t) for t in set(re.findall(r"\{(\w+)\}", sql))})

    def profiles(self) -> DataFrame:
        empty = F.array().cast("array<string>")
        split = lambda c: F.split(c, " ")
        return self.view(PROFILES).withColumns({"core": split("core_text"), "addr": split("addr_text"), "alias": F.lit(""), "legal": empty, "extra": empty})

    def pairs(self, made: dict[str, Column] | None = None) -> DataFrame:
        """made: more columns of records, computed once for each and not for each pair; pairs have them with 1 and 2."""
        if not made:
            return self.view(PAIRS)
        both = "".join(f"a.{c} AS {c}1, b.{c} AS {c}2, " for c in made)
        sql = PAIRS.replace(f"({PROFILES})", "{records}").replace("SELECT ", f"SELECT {both}", 1)
        return self.spark.sql(sql, records=self.view(PROFILES).withColumns(made))

    def in_blocks(self, records: DataFrame) -> DataFrame:
        """records partitioned by their block. Blocks multiply in tasks, so there are more of these than for a plain shuffle."""
        # what is partitioned by the block is joined by the block and an id without another shuffle
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return records.repartition(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), "block")

    def block_pairs(self, made: dict[str, Column] | None = None) -> DataFrame:
        """The pairs with their block, partitioned by it: no pair is shuffled. made: as for pairs()."""
        both = "".join(f"a.{c} AS {c}1, b.{c} AS {c}2, " for c in made or {})
        join = PAIRS[PAIRS.index(" ON ") : PAIRS.index("\nWHERE")]
        sql = PAIRS.replace(f"({PROFILES})", "{records}").replace(join, " ON a.block = b.block").replace("SELECT ", f"SELECT a.block AS block, {both}", 1)
        return self.spark.sql(sql, records=self.in_blocks(self.view(PROFILES).withColumns({"block": F.expr(BLOCK)} | (made or {}))))

    def s1(self) -> DataFrame:
        return self.view(PROFILES).filter("src = 1").select(F.col("entity_id").alias("s1_id"), "country_key")

    def truth(self) -> DataFrame:
        return self.pairs().filter("label").select("s1_id", F.col("cand_id").alias("match_id"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of sums doesn't show."""
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits)), [c for c, t in df.dtypes if t == "double"], df)
