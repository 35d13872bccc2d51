"""The corpus pipeline: language, toxicity, repeated lines, near copies, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs, whatever these are called.
  language   rows go whose text has no letter, or isn't like the texts of any language that the model was fitted on
  toxicity   rows go that score 0.5 or more
  lines      runs of lines that earlier documents have are cut out; rows go that this leaves without a word
  near       of each group of near copies the document with the smallest id (then the smallest hash of its text) stays, and of rows
             that agree in id and text, if that has words, one; rows without an id or without words stay
  packing    what is left, in sequences of at most 2048 tokens: one row per piece
Null columns are passed on; an empty table stays empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm import common, jaccard, language, lines, packing, toxicity


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs with columns named by their places, so that no name clashes; what each is called there; and how to name them back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, ~common.held_out(F.col("doc_id")))
    if model is None:  # nothing to learn from: nothing to reject by
        return docs
    rows, at, back = _numbered(docs)
    return language.identify(rows, model, text_col=at["text"]).filter("learned").select(back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, at, back = _numbered(docs)
    return toxicity.score(rows, model, text_col=at["text"]).filter("score < 0.5").select(back)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at, back = _numbered(docs)
    cut = lines.dedup(rows, id_col=at["doc_id"], text_col=at["text"])
    return cut.filter((F.col("n_removed") == 0) | F.col(at["text"]).rlike(r"[^ \t\n\x0B\f\r]")).select(back)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text, so that rows which only share an id are judged each by its own text."""
    ident, text_hash, gone, maybe = (common.unused(f"__{n}", docs) for n in ("id", "hash", "gone", "maybe"))
    found = common.stored(jaccard.near_duplicates(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(ident), F.col("text_hash").alias(text_hash), "first", "n_links"), "near")
    key = [ident, text_hash]
    twice = found.filter("first AND n_links > 0").groupBy(key).count().filter("count > 1").select(*key, F.lit(False).alias(gone))
    touched = common.stored(found.filter("NOT first").select(*key, F.lit(True).alias(gone)).distinct().unionByName(twice), "touched")
    # rows that link with an earlier one, and rows that are alike: only these are shuffled
    rows = common.with_membership(docs.withColumns({ident: F.col("doc_id"), text_hash: F.xxhash64("text")}), touched, key, maybe)
    some = F.col(maybe) & F.col(ident).isNotNull()
    judged = rows.filter(some).join(touched, key, "left")
    once = judged.filter(~F.col(gone)).dropDuplicates(key)  # of rows with one id and text any one
    kept = [rows.filter(~some), judged.filter(F.col(gone).isNull()), once]
    return functools.reduce(DataFrame.unionByName, (k.select(docs.columns) for k in kept))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


_FUNCTIONS = [("language", language_stage), ("toxicity", toxicity_stage), ("lines", lines_stage), ("near", near_stage), ("packing", packing_stage)]
_last: list[tuple[int, int]] = []


def _alone(stage):
    """A stage that is called by itself: the work tables of the one before are deleted, as its result has been written."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            common.drop_stored(*_last.pop())
        first = common.n_stored()
        out = stage(spark, docs, sf_dir)
        _last.append((first, common.n_stored()))
        return out

    return call


STAGES = [(name, _alone(stage)) for name, stage in _FUNCTIONS]
#: Models and packing plans have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in _FUNCTIONS[:-1]:
        first = common.n_stored()
        out = stage(spark, docs, sf_dir)
        end = common.n_stored()
        docs = common.stored(out, f"stage-{name}")
        common.drop_stored(first, end)
    return _FUNCTIONS[-1][1](spark, docs, sf_dir)
