"""Files in, files out; the queries' contract; a stream of records."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinship.__main__ import main
from kinship.config import Config
from kinship.plans import pipeline
from kinship.sources import tsv
from kinship.streaming.profiles import profile_stream, to_parquet

NAMES = ["Acme Robotics", "Blue River Foods", "Keystone Daedalus", "Golden Gate Bakery", "Sunrise Textile Mills", "Northern Light Labs", "Harbor Tools", "Silver Oak Press"]


def write(folder, split, countries=("us", "in")):
    os.makedirs(f"{folder}/{split}", exist_ok=True)
    rows, truth = {1: [], 2: [], 3: []}, []
    for i in range(64):
        name, number, country = f"{NAMES[i % 8]} {chr(97 + i // 8)}{chr(97 + i % 7)}x", 10 + 3 * i, countries[i % len(countries)]
        rows[1].append((f"S1-{i}", f"{name} Inc", f"{number} Main Street, Springfield {10000 + i}", country))
        matches = []
        if i % 4:
            rows[2].append((f"S2-{i}", f"{name.upper()} L.L.C.", f"No. {number} Main St Springfield {10000 + i}", country))
            matches.append(f"S2-{i}")
        rows[3].append((f"S3-{i}", f"{NAMES[i % 8]} zz Group", f"{number + 5} Main Street Springfield {10000 + i}", country))
        if i % 3 == 0:
            rows[3].append((f"S3-{i + 500}", f"{name} Incorporated", f"{number} Main Street", country if i % 6 else ""))
            matches.append(f"S3-{i + 500}")
        truth.append((f"S1-{i}", ",".join(matches)))
    for k, part in rows.items():
        with open(f"{folder}/{split}/{split}_source{k}.tsv", "w") as f:
            f.write("\n".join("\t".join(r) for r in [("entity_id", "business_name", "business_address", "country"), *part]) + "\n")
    with open(f"{folder}/{split}/{split}_ground_truth.tsv", "w") as f:
        f.write("\n".join("\t".join(r) for r in [("source1_entity_id", "matched_entity_ids"), *truth]) + "\n")


def test_whole_run(spark, tmp_path):
    write(tmp_path / "data", "train")
    write(tmp_path / "data", "test", ("us", "fr"))
    args = ["--data-dir", str(tmp_path / "data"), "--out-dir", str(tmp_path / "out"), "--work-dir", str(tmp_path / "work"), "--tree-rounds", "3", "--tree-depth", "3", "--folds", "2", "--k-forward", "5", "--k-name", "3", "--k-addr", "3", "--k-emb", "3"]
    report = main(args, spark)
    assert report["train"]["pair_recall"] > 0.95 and report["train"]["macro_f_train"] > 0.5
    assert report["test"]["problems"] == []
    lists = spark.read.csv(str(tmp_path / "out" / "matching_results"), sep="\t", header=True)
    assert lists.count() == 64 and lists.filter("matched_entity_ids is not null").count() > 20
    assert os.path.isdir(tmp_path / "out" / "matching_results_calibrated") and os.path.isdir(tmp_path / "work" / "artifacts" / "oof_errors")
    again = pipeline.load(spark, str(tmp_path / "work" / "models"))
    assert again.rule == report["train"]["rule"] and "fr" not in again.countries and again.opinion == []


def own_check(matches, candidates):
    return [f"seen: {os.path.basename(matches)} {os.path.basename(candidates)}"]


def test_second_opinion_is_given_when_matching_too(spark, tmp_path, monkeypatch):
    write(tmp_path / "data", "train")
    write(tmp_path / "data", "test")
    stacked = []
    plain = pipeline.features.stacked
    monkeypatch.setattr(pipeline.features, "stacked", lambda pairs, second=None: stacked.append(plain(pairs, second)) or stacked[-1])
    cfg = Config(tree_rounds=3, tree_depth=3, folds=2, k_all=5, k_name=3, k_addr=3, seeds=(1, 2), threshold_grid=(0.2, 0.4, 0.6), bias_grid=(0.0,))
    records, truth = tsv.read_split(spark, str(tmp_path / "data"), "train"), tsv.read_truth(spark, str(tmp_path / "data"))
    pipeline.save(pipeline.train(spark, str(tmp_path / "w"), records, truth, cfg, True, embed=False), str(tmp_path / "models"))
    trained = pipeline.load(spark, str(tmp_path / "models"))
    assert len(trained.first) == len(trained.second) == len(trained.opinion) == 2
    report = pipeline.match(spark, str(tmp_path / "w"), str(tmp_path / "out"), tsv.read_split(spark, str(tmp_path / "data"), "test"), trained, cfg, embed=False, validator=own_check)
    assert report["problems"] == ["seen: matching_results candidate_pairs"]
    for rows in stacked:  # of training and of matching
        n, some, ahead = rows.select(F.count("*"), F.sum("has_ce"), F.sum((F.col("ce") >= 0).cast("int"))).first()
        assert 0 < some == ahead <= n and "ce_rk" in rows.columns
    assert len(stacked) == 2


def test_blocking_only(spark, tmp_path):
    write(tmp_path, "train")
    report = main(["--data-dir", str(tmp_path), "--out-dir", str(tmp_path / "out"), "--work-dir", str(tmp_path / "w"), "--blocking-only", "--dev", "10", "--no-emb", "--no-decoy"], spark)
    assert report["s1_entities"] == 10 and report["pair_recall"] > 0.9


def test_quotes_and_missing_columns(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "a.tsv").write_text(head + 'S1-1\t"A ""B"" C"\tx\tus\nS1-2\tB\t\t\n')
    (tmp_path / "b.tsv").write_text(head + 'S1-1\t"A\tx\tus\nodd\tB"\ty\tus\n')
    rows = tsv.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert {r.business_name for r in rows.collect()} == {'A "B" C', "B"} and rows.filter("business_address = ''").count() == 1
    assert {r.business_name for r in tsv.read_tsv(spark, str(tmp_path / "b.tsv")).filter("entity_id = 'S1-1'").collect()} <= {'"A', "A\tx\tus\nodd\tB"}
    with pytest.raises(ValueError):
        tsv.union_sources({1: rows.drop("country")})
    assert tsv.duplicate_ids(rows.unionByName(rows)).count() == 2


def test_truth_lists(spark):
    df = spark.createDataFrame([("a", " x, y ,,x"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(tuple(r) for r in tsv.exploded_truth(df).collect()) == [("a", "x"), ("a", "y")]


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"s1_id", "cand_id", "bs", "mask"} <= set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_profiles_of_a_stream(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    spark.createDataFrame([("S1-1", "Acme Tools Inc", "12 Main Street 10001", "US", 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    to_parquet(profile_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).select("core_text", "postal", F.col("house")).first()
    assert tuple(row) == ("acme tool", "10001", 12)
