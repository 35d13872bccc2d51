"""Tab-separated sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header, all strings, null nowhere. If a first column isn't an id (S1-, S2-, S3-), quotes are taken as text."""
    read = lambda quote: spark.read.csv(path, sep="\t", header=True, quote=quote, escape=quote or "\\", multiLine=bool(quote)).na.fill("")
    quoted = read('"')
    odd = quoted.filter(~F.col(quoted.columns[0]).rlike("^S[123]-")).limit(1)
    return read("") if not odd.isEmpty() else quoted


def union_sources(sources: dict[int, DataFrame]) -> DataFrame:
    """All sources' records with src; missing columns are an error, extra ones are left out."""
    out = None
    for src, df in sources.items():
        if missing := [c for c in SOURCE_COLUMNS if c not in df.columns]:
            raise ValueError(f"source {src}: missing columns {missing}")
        part = df.select(*SOURCE_COLUMNS, F.lit(src).alias("src"))
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_ids(records: DataFrame, column: str = "entity_id") -> DataFrame:
    """(id, n) of ids that stand more than once."""
    return records.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources of a split; an id that stands twice is an error."""
    records = union_sources({k: read_tsv(spark, f"{folder}/{split}/{split}_source{k}.tsv") for k in (1, 2, 3)})
    if not (twice := duplicate_ids(records).limit(1)).isEmpty():
        raise ValueError(f"{split}: id {twice.first()[0]} stands more than once")
    return records


def exploded_truth(lists: DataFrame, s1: str = "source1_entity_id", matched: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, match_id) of comma-separated lists; blanks go, repeated ids count once."""
    ids = F.filter(F.transform(F.split(matched, ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col(s1).alias("s1_id"), F.explode(F.array_distinct(ids)).alias("match_id")).distinct()


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    return exploded_truth(read_tsv(spark, f"{folder}/train/train_ground_truth.tsv"))


def fetch(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given ids (entity_id)."""
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def write_lists(lists: DataFrame, path: str) -> None:
    """Lists as one sorted, tab-separated folder with a header."""
    lists.orderBy(lists.columns[0]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def check_lists(matches: DataFrame, candidates: DataFrame, s1: DataFrame) -> list[str]:
    """What is wrong with a result: records missing or repeated, or matches that are no candidates."""
    found = []
    if not matches.select(F.col("source1_entity_id").alias("s1_id")).exceptAll(s1.select("s1_id")).isEmpty() or not s1.select("s1_id").exceptAll(matches.select(F.col("source1_entity_id").alias("s1_id"))).isEmpty():
        found.append("each first-source record has to stand once")
    stray = exploded_truth(matches).join(exploded_truth(candidates, matched="candidate_entity_ids"), ["s1_id", "match_id"], "left_anti")
    if not stray.isEmpty():
        found.append("every match has to be a candidate")
    return found
