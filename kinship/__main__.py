"""python -m kinship --data-dir DIR --out-dir DIR: train on a labelled split and match a test split."""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinship.config import Config
from kinship.operators import evaluate, split
from kinship.plans import pipeline
from kinship.sources import tsv


def _named(name: str):
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data-dir", required=True)
    parser.add_argument("--out-dir", required=True)
    parser.add_argument("--work-dir", help="where finished steps are kept (default: work beside the out-dir)")
    parser.add_argument("--dev", type=int, help="query so many first-source records only, and no test split")
    for flag, name, kind in (("--k-forward", "k_all", int), ("--k-name", "k_name", int), ("--k-addr", "k_addr", int), ("--k-reverse", "k_reverse", int), ("--k-emb", "k_emb", int), ("--max-key-pairs", "max_key_pairs", int), ("--min-block-score", "min_block_score", float), ("--train-sample", "train_s1", int), ("--folds", "folds", int), ("--max-train-rows", "max_train_rows", int), ("--holdout", "holdout", float), ("--ce-topn", "top_pairs", int), ("--tree-depth", "tree_depth", int), ("--tree-rounds", "tree_rounds", int)):
        parser.add_argument(flag, dest=name, type=kind)
    parser.add_argument("--no-country-block", action="store_true")
    parser.add_argument("--blocking-only", action="store_true", help="stop after the blocking report")
    parser.add_argument("--cross-encoder", action="store_true", help="add a second opinion on texts")
    parser.add_argument("--no-emb", action="store_true")
    parser.add_argument("--no-decoy", action="store_true")
    parser.add_argument("--no-calibrate", action="store_true")
    parser.add_argument("--encoder", type=_named, default=pipeline.trigrams, help="module:function that turns (entity_id, text) into (entity_id, v)")
    parser.add_argument("--validator", type=_named, help="module:function that is given the paths of both results and returns a list of problems")
    args = parser.parse_args(argv)
    given = {k: v for k, v in vars(args).items() if v is not None and k in Config.__dataclass_fields__}
    cfg = replace(Config(), block_within_country=not args.no_country_block, **given)
    spark = spark or SparkSession.builder.appName("kinship").getOrCreate()
    work = args.work_dir or f"{args.out_dir.rstrip('/')}/../work"

    records, truth = tsv.read_split(spark, args.data_dir, "train"), tsv.read_truth(spark, args.data_dir)
    query = split.sample(records.filter("src = 1").select(F.col("entity_id").alias("s1_id")), args.dev) if args.dev else None
    options = {"embed": not args.no_emb, "words": not args.no_decoy, "encoder": args.encoder}
    if args.blocking_only:
        profile, pairs, _ = pipeline.featured(spark, work, "train", records, cfg, None, query, **options)
        s1 = profile.filter("src = 1").select(F.col("entity_id").alias("s1_id"))
        s1 = s1.join(query, "s1_id", "left_semi") if query is not None else s1
        report = {r["measure"]: r["value"] for r in evaluate.blocking_report(pairs, truth.join(s1, "s1_id", "left_semi"), s1, profile.filter("src <> 1")).collect()}
    else:
        trained = pipeline.train(spark, work, records, truth, cfg, args.cross_encoder, query, **options)
        pipeline.save(trained, f"{work}/models")
        report = {"train": trained.report}
        if not args.dev:
            report["test"] = pipeline.match(spark, work, args.out_dir, tsv.read_split(spark, args.data_dir, "test"), trained, cfg, not args.no_calibrate, **options, validator=args.validator)
    print(json.dumps(report, indent=1, default=str))
    return report


if __name__ == "__main__":
    main()
