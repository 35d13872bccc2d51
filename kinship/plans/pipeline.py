"""The whole linkage run: profiles, candidates, features, two stages, a tuned decision, and result files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.config import Config
from kinship.functions import text
from kinship.operators import blocking, decide, decoy, evaluate, features, model, profiles, split, vectors
from kinship.sources import cache, tsv

#: Columns of pairs that are no features.
_NOT_FEATURES = {"s1_id", "cand_id", "label", "fold", "mask", "fwd", "rev", "src2", "weight", "p1", "p2", "ce", "p", "house1", "house2", "house_digits1", "house_digits2", "landmark1", "landmark2"}
_STACK = ["bs", "qn", "qa", "n_cand_s1", "n_s1_for_cand", "es", "er", "hn_small", "hn_digits", "hn_sup_s1", "hn_sup_cand", "hn_sup_gap", "tw_name_num2", "tw_s1_name1", "is_s3"]


@dataclass
class Trained:
    """What a test split needs from training."""

    first: list[PipelineModel]
    second: list[PipelineModel]
    features: list[str]
    stacked: list[str]
    rule: dict
    variant: str
    countries: list[str]
    translit: dict[str, str] = field(default_factory=dict)
    report: dict = field(default_factory=dict)
    opinion: list[LogisticRegressionModel] = field(default_factory=list)


#: Turns (entity_id, text) into (entity_id, v), unit vectors.
Encoder = Callable[[DataFrame], DataFrame]


def trigrams(texts: DataFrame) -> DataFrame:
    """The encoder that is used where no other one is given."""
    return vectors.hashed_text_vectors(texts, 512)


def feature_columns(df: DataFrame) -> list[str]:
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, kind in df.dtypes if kind in numeric and c not in _NOT_FEATURES]


def featured(spark: SparkSession, folder: str, name: str, records: DataFrame, cfg: Config, translit: dict[str, str] | None = None, query: DataFrame | None = None, embed: bool = True, words: bool = True, encoder: Encoder = trigrams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, candidates, features) of a split; statistics are the split's own."""
    keep = lambda step, make, *more: cache.cached(spark, folder, f"{name}-{step}", [cfg, translit, embed, words, encoder.__qualname__, *more], make)
    table = text.table_of(translit) if translit else None
    profile = keep("profiles", lambda: profiles.weighted_profiles(decoy.with_twins(profiles.profiles(records, table))))

    def found() -> DataFrame:
        passes, cosines = [], {}
        if embed:
            for raw, bit, out in ((False, blocking.PASS_BIT["emb"], "es"), (True, blocking.PASS_BIT["emb_raw"], "er")):
                v = keep(f"vectors-{out}", lambda raw=raw: encoder(vectors.record_texts(profile, raw)))
                member = blocking.grouped(profile, cfg.block_within_country).select("entity_id", "grp", "src").join(v, "entity_id")
                near = vectors.top_k(member.filter("src = 1").select("grp", F.col("entity_id").alias("s1_id"), "v"), member.filter("src <> 1").select("grp", F.col("entity_id").alias("cand_id"), F.col("src").alias("src2"), "v"), cfg.k_emb, cfg.min_emb_score)
                passes.append(near.select("s1_id", "cand_id", "src2", F.lit(bit).alias("bit")))
                cosines[out] = v
        pairs = blocking.candidates(profile, cfg, query, passes)
        for out, v in cosines.items():
            pairs = vectors.pair_cosines(pairs, v, out)
        return pairs

    pairs = keep("pairs", found, query is not None)

    def made() -> DataFrame:
        paired = features.global_context(features.quick_scores(features.with_records(features.block_context(pairs), profile)), cfg)
        table = None
        if words:
            table = decoy.learn_decoy_words(paired.withColumns({"country_key": F.col("country_key1"), "words1": F.array_union("core1", "extra1"), "words2": F.array_union("core2", "extra2")}), cfg)
        full = features.pair_features(paired, table)
        return full.select("s1_id", "cand_id", "src2", *feature_columns(full))

    return profile, pairs, keep("features", made, query is not None)


def stack_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in ("p1", "ce", "has_ce", *_STACK) or c.startswith(("p1_", "ce_"))]


def train(spark: SparkSession, folder: str, records: DataFrame, truth: DataFrame, cfg: Config = Config(), opinion: bool = False, query: DataFrame | None = None, embed: bool = True, words: bool = True, learn_translit: bool = True, encoder: Encoder = trigrams) -> Trained:
    """Models and a decision rule. Records of the hold-out teach nothing, the transliteration included, and are only measured on."""
    s1 = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), text.country_key(F.col("country")).alias("country_key"))
    s1 = s1 if query is None else s1.join(query, "s1_id", "left_semi")
    held = split.held_out(F.col("s1_id"), cfg.holdout)
    translit = {}
    if learn_translit:
        names = records.select("entity_id", "business_name")
        true = truth.filter(~held).join(names.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("name_s1")), "s1_id").join(names.select(F.col("entity_id").alias("match_id"), F.col("business_name").alias("name_match")), "match_id")
        learned = cache.cached(spark, folder, "translit", [cfg], lambda: profiles.learn_translit(true, cfg.translit_count, cfg.translit_share, cfg.translit_latin))
        translit = {r["token"]: r["english"] for r in learned.collect()}  # a word list
    profile, pairs, table = featured(spark, folder, "train", records, cfg, translit, query, embed, words, encoder)
    truth = truth.join(s1, "s1_id", "left_semi")
    rows = evaluate.label_pairs(table, truth)
    columns = feature_columns(table)
    report = {r["measure"]: r["value"] for r in evaluate.blocking_report(pairs, truth, s1, profile.filter("src <> 1")).collect()}

    sampled = split.part(F.col("s1_id"), seed=11) < min(1.0, cfg.train_s1 / max(1, s1.count()))
    learn, rest = rows.filter(~held & sampled), rows.filter(held | ~sampled)
    scored, first = model.out_of_fold(learn, columns, cfg, "p1", cfg.max_train_rows)
    both = scored.drop("fold").unionByName(model.predict(rest, first, columns, "p1"))
    both = cache.cached(spark, folder, "train-p1", [cfg, translit, embed, words, query is not None], lambda: both)
    opinions = []
    if opinion:
        texts = competition_texts(both, profile, cfg)
        opinions = model.opinion_models(texts.join(both.select("s1_id", "cand_id", "label"), ["s1_id", "cand_id"]).filter(~held))
        both = both.join(model.text_opinion(texts, opinions, True).select("s1_id", "cand_id", "ce"), ["s1_id", "cand_id"], "left")
    second_rows = features.stacked(both, "ce" if opinion else None)
    stacked = stack_columns(second_rows)
    scored2, second = model.out_of_fold(second_rows.filter(~held & sampled), stacked, cfg, "p2", cfg.max_train_rows)
    final = scored2.drop("fold").unionByName(model.predict(second_rows.filter(held | ~sampled), second, stacked, "p2"))
    final = cache.cached(spark, folder, "train-p2", [cfg, translit, embed, words, opinion, query is not None], lambda: final.withColumn("blend", (F.col("p1") + F.col("p2")) / 2))

    counts = truth.groupBy("s1_id").agg(F.count("*").alias("ntrue"))
    entities = s1.join(counts, "s1_id", "left").select("s1_id", F.coalesce("ntrue", F.lit(0).cast("long")).alias("ntrue"))
    best = None
    for variant, p in (("stage1", "p1"), ("stage2", "p2"), ("blend", "blend")):
        # one-to-one is decided among all pairs, thresholds on records that may be tuned on
        kept = decide.one_to_one(final, p) if cfg.one_to_one else final
        rule = decide.tune(kept.filter(~held), entities.filter(~held), cfg, p)
        if best is None or rule["score"] > best[0]["score"] + 1e-9:
            best = (rule, variant, p)
    rule, variant, p = best
    chosen = decide.apply(final, rule, cfg, p)
    each = evaluate.per_entity(chosen, truth, s1, cfg.beta).join(s1, "s1_id").withColumn("held_out", held)
    report |= {"rule": rule, "variant": variant} | {f"macro_f_{'holdout' if r['held_out'] else 'train'}": r["f"] for r in each.groupBy("held_out").agg(F.avg("f").alias("f")).collect()} | {f"macro_f_{r['country_key']}": r["f"] for r in each.groupBy("country_key").agg(F.avg("f").alias("f")).collect()}
    evaluate.error_types(chosen, truth, s1, cfg.beta).orderBy(F.col("loss").desc(), "s1_id").limit(cfg.max_errors).write.mode("overwrite").csv(f"{folder}/artifacts/oof_errors", sep="\t", header=True)
    evaluate.explain_misses(evaluate.missed_pairs(pairs, truth), profile, cfg.max_misses).write.mode("overwrite").csv(f"{folder}/artifacts/blocking_misses", sep="\t", header=True)
    model.importances({"first": (first, columns), "second": (second, stacked)}, spark).write.mode("overwrite").csv(f"{folder}/artifacts/feature_importance", sep="\t", header=True)
    labels = [r[0] for r in s1.select("country_key").distinct().collect()]
    return Trained(first, second, columns, stacked, rule, variant, labels, translit, report, opinions)


def competition_texts(pairs: DataFrame, profile: DataFrame, cfg: Config) -> DataFrame:
    """(s1_id, cand_id, text1, text2) of the pairs that are worth a second opinion."""
    from kinship.operators.competition import best_pairs

    few = best_pairs(pairs, "p1", cfg.top_pairs, cfg.min_pair_p).select("s1_id", "cand_id")
    raw = profile.select("entity_id", F.concat_ws(" ; ", "raw_name", "raw_addr").alias("t"))
    side = lambda c, t: raw.select(F.col("entity_id").alias(c), F.col("t").alias(t))
    return few.join(side("s1_id", "text1"), "s1_id").join(side("cand_id", "text2"), "cand_id")


def match(spark: SparkSession, folder: str, out: str, records: DataFrame, trained: Trained, cfg: Config = Config(), calibrate: bool = True, embed: bool = True, words: bool = True, encoder: Encoder = trigrams, validator: Callable[[str, str], list[str]] | None = None) -> dict:
    """Writes matching_results and candidate_pairs of a split (and results with unseen countries calibrated); returns its report.

    validator: is called with the paths of both results, and returns what it finds wrong with them.
    """
    profile, pairs, table = featured(spark, folder, "test", records, cfg, trained.translit, None, embed, words, encoder)
    s1 = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), text.country_key(F.col("country")).alias("country_key"))
    for c in trained.features:
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast("double"))
    one = model.predict(table, trained.first, trained.features, "p1")
    if trained.opinion:
        one = cache.cached(spark, folder, "test-p1", [cfg, trained.rule, trained.translit, embed, words], lambda: one)
        second = model.text_opinion(competition_texts(one, profile, cfg), trained.opinion, False)
        one = one.join(second.select("s1_id", "cand_id", "ce"), ["s1_id", "cand_id"], "left")
    second_rows = features.stacked(one, "ce" if trained.opinion else None)
    scored = model.predict(second_rows, trained.second, trained.stacked, "p2").withColumn("blend", (F.col("p1") + F.col("p2")) / 2)
    p = {"stage1": "p1", "stage2": "p2", "blend": "blend"}[trained.variant]
    scored = cache.cached(spark, folder, "test-scored", [cfg, trained.rule, trained.variant, trained.translit], lambda: scored.select("s1_id", "cand_id", "src2", F.col(p).alias("p")))
    chosen = decide.apply(scored, trained.rule, cfg)
    lists = decide.match_lists(s1, chosen)
    candidates = decide.match_lists(s1, pairs, "candidate_entity_ids")
    tsv.write_lists(lists, f"{out}/matching_results")
    tsv.write_lists(candidates, f"{out}/candidate_pairs")
    report = {r["country_key"]: r.asDict() for r in evaluate.match_summary(chosen, s1).collect()}
    unseen = [c for c in report if c not in trained.countries]
    if calibrate and unseen and len(unseen) < len(report) and trained.rule["method"] == "threshold":
        known = s1.filter(~F.col("country_key").isin(unseen))
        target = evaluate.match_summary(chosen, known.withColumn("g", F.lit(1)), "g").first()["matched_share"]
        bias = decide.country_bias(scored, s1.filter(F.col("country_key").isin(unseen)), target, trained.rule, cfg)
        shifted = scored.join(s1, "s1_id").join(bias, "country_key", "left").withColumn("p", F.when(F.col("bias").isNull(), F.col("p")).otherwise(decide.logit_shift(F.col("p"), F.col("bias")))).drop("country_key", "bias")
        # one-to-one holds within an unseen country's pairs, as it does for all others together
        tsv.write_lists(decide.match_lists(s1, decide.apply(shifted, trained.rule, cfg)), f"{out}/matching_results_calibrated")
    report["problems"] = tsv.check_lists(lists, candidates, s1) + (validator(f"{out}/matching_results", f"{out}/candidate_pairs") if validator else [])
    return report


def save(trained: Trained, folder: str) -> None:
    models = {"first": trained.first, "second": trained.second, "opinion": trained.opinion}
    for name, group in models.items():
        for i, m in enumerate(group):
            m.write().overwrite().save(f"{folder}/{name}-{i}")
    spark = SparkSession.getActiveSession()
    plain = {k: getattr(trained, k) for k in ("features", "stacked", "rule", "variant", "countries", "translit", "report")} | {"counts": {k: len(v) for k, v in models.items()}}
    spark.createDataFrame([(json.dumps(plain),)], "j string").coalesce(1).write.mode("overwrite").text(f"{folder}/plain")


def load(spark: SparkSession, folder: str) -> Trained:
    plain = json.loads(spark.read.text(f"{folder}/plain").first()[0])
    kinds = {"first": PipelineModel, "second": PipelineModel, "opinion": LogisticRegressionModel}
    return Trained(**{name: [kinds[name].load(f"{folder}/{name}-{i}") for i in range(n)] for name, n in plain.pop("counts").items()}, **plain)
