"""From probabilities to match lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinship.config import Config
from kinship.operators.evaluate import fbeta


def one_to_one(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Each candidate's pairs of the highest probability; ties stay."""
    return pairs.withColumn("__best", F.max(p).over(Window.partitionBy("cand_id"))).filter(F.col(p) >= F.col("__best")).drop("__best")


def above(p: Column, src2: Column, t2: float, t3: float) -> Column:
    """Whether a probability reaches its source's threshold."""
    return p >= F.when(src2 == 2, t2).otherwise(t3)


def logit_shift(p: Column, bias: Column | float) -> Column:
    """The probability whose log odds are higher by bias."""
    q = F.least(F.greatest(p.cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + bias)))


def count_distribution(ps: np.ndarray) -> np.ndarray:
    """Chances of 0, 1, ... of independent events."""
    out = np.ones(1)
    for p in ps:
        out = np.append(out, 0) * (1 - p) + np.append(0, out) * p
    return out


def best_counts(ps: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """How many of the likeliest candidates to choose for the highest expected F-beta; of equals the fewest. A row of ps for each record, likeliest first.

    Distributions of the first k grow by one event each, those of the rest are made once from the end.
    """
    (rows, n), b = ps.shape, beta * beta
    grown = lambda x, p: np.pad(x, ((0, 0), (0, 1))) * (1 - p[:, None]) + np.pad(x, ((0, 0), (1, 0))) * p[:, None]
    rest = [np.ones((rows, 1))]
    for k in reversed(range(n)):
        rest.append(grown(rest[-1], ps[:, k]))
    best, value, head = np.zeros(rows, np.int64), np.prod(1 - ps, axis=1), np.ones((rows, 1))
    for k in range(1, n + 1):
        head = grown(head, ps[:, k - 1])
        tp, fn = np.arange(k + 1)[:, None], np.arange(n - k + 1)[None, :]
        expected = np.einsum("ri,ij,rj->r", head, (1 + b) * tp / (b * (tp + fn) + k), rest[n - k], optimize=True)
        more = expected > value + 1e-15
        best[more], value[more] = k, expected[more]
    return best


def best_count(ps: np.ndarray, beta: float = 0.5) -> int:
    """best_counts of one record."""
    return int(best_counts(np.asarray(ps, float)[None], beta)[0])


def expected_f(pairs: DataFrame, bias: float = 0.0, cfg: Config = Config(), p: str = "p") -> DataFrame:
    """Each record's pairs that maximise its expected F-beta, after a shift of all log odds."""
    q = pairs.withColumn("__q", logit_shift(F.col(p), bias)).filter(F.col("__q") >= cfg.min_expected_p)
    sorted_q = F.reverse(F.array_sort(F.collect_list("__q")))
    beta = cfg.beta

    @F.pandas_udf("int")
    def count(qs: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(qs), np.int32), qs.map(len).to_numpy()
        for n in np.unique(sizes):  # records of as many candidates side by side
            at = np.flatnonzero(sizes == n)
            for i in range(0, len(at), 1024):
                out[at[i : i + 1024]] = best_counts(np.stack(qs.iloc[at[i : i + 1024]].to_list()).astype(float), beta)
        return pd.Series(out)

    kept = q.groupBy("s1_id").agg(sorted_q.alias("qs")).withColumn("__k", count("qs")).select("s1_id", "__k")
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("__q").desc(), "cand_id"))
    return q.withColumn("__r", rank).join(kept, "s1_id").filter(F.col("__r") <= F.col("__k")).drop("__q", "__r", "__k")


def _grid_scores(pairs: DataFrame, entities: DataFrame, grid: list[tuple[float, float]], beta: float, p: str) -> DataFrame:
    """(t2, t3, score): macro F-beta of every pair of thresholds, in one job.

    Each record's counts are summed once for every threshold of either source; the grid's sums are then made where the
    records lie, so a task returns a row for each pair of thresholds, and pairs aren't multiplied by the grid.
    """
    spark = pairs.sparkSession
    axes = {2: sorted({a for a, _ in grid}), 3: sorted({b for _, b in grid})}
    true = F.col("label").cast("boolean")

    def counts(src: int, also: Column) -> Column:
        mine = (F.col("src2") == 2) if src == 2 else (F.col("src2") != 2)
        return F.array(*(F.sum((mine & also & (F.col(p) >= t)).cast("int")) for t in axes[src]))

    made = pairs.groupBy("s1_id").agg(counts(2, F.lit(True)).alias("n2"), counts(2, true).alias("c2"), counts(3, F.lit(True)).alias("n3"), counts(3, true).alias("c3"))
    rows = entities.join(made, "s1_id", "left").select("ntrue", "n2", "c2", "n3", "c3")
    at2, at3 = ([axes[src].index(g[i]) for g in grid] for i, src in ((0, 2), (1, 3)))
    b = beta * beta

    def summed(frames):
        total, n = np.zeros(len(grid)), 0
        for f in frames:
            none = {c: np.zeros(len(axes[int(c[1])]), np.int64) for c in ("n2", "c2", "n3", "c3")}
            x = {c: np.stack([v if v is not None else none[c] for v in f[c]]) for c in none} if len(f) else none
            true = f["ntrue"].to_numpy()[:, None]
            if len(f):
                predicted, hit = x["n2"][:, at2] + x["n3"][:, at3], x["c2"][:, at2] + x["c3"][:, at3]
                total += np.where((predicted == 0) & (true == 0), 1.0, (1 + b) * hit / np.maximum(1e-12, b * true + predicted)).sum(axis=0)
            n += len(f)
        yield pd.DataFrame({"i": np.arange(len(grid)), "f": total, "n": n})

    sums = rows.mapInPandas(summed, "i int, f double, n long").groupBy("i").agg((F.sum("f") / F.sum("n")).alias("score"))
    table = spark.createDataFrame([(i, float(a), float(c)) for i, (a, c) in enumerate(grid)], "i int, t2 double, t3 double")
    return table.join(sums, "i").select("t2", "t3", "score")


def threshold_scores(pairs: DataFrame, entities: DataFrame, grid: list[tuple[float, float]], beta: float = 0.5, p: str = "p") -> DataFrame:
    """(t2, t3, score) over a grid; pairs (s1_id, src2, p, label) after the one-to-one step, entities (s1_id, ntrue)."""
    return _grid_scores(pairs, entities, grid, beta, p)


def tune(pairs: DataFrame, entities: DataFrame, cfg: Config = Config(), p: str = "p") -> dict:
    """The decision rule of the best macro F-beta: thresholds by a coarse and then a fine grid, or expected F with a bias if strictly better."""
    kept = (one_to_one(pairs, p) if cfg.one_to_one else pairs).persist()
    best = lambda df: df.orderBy(F.col("score").desc(), "t2", "t3").first()
    coarse = cfg.threshold_grid[::2]
    top = best(_grid_scores(kept, entities, [(a, b) for a in coarse for b in coarse], cfg.beta, p))
    fine = lambda c: [x for i in range(-4, 5) if 0.02 <= (x := round(c + 0.0125 * i, 4)) <= 0.99]
    near = best(_grid_scores(kept, entities, [(a, b) for a in fine(top["t2"]) for b in fine(top["t3"])], cfg.beta, p))
    top = near if near["score"] > top["score"] else top
    rule = {"method": "threshold", "t2": top["t2"], "t3": top["t3"], "score": top["score"]}
    for bias in cfg.bias_grid:
        chosen = expected_f(kept, bias, cfg, p).groupBy("s1_id").agg(F.count("*").alias("npred"), F.sum(F.col("label").cast("long")).alias("tp"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        value = entities.join(chosen, "s1_id", "left").agg(F.avg(fbeta(zero("tp"), zero("npred"), F.col("ntrue"), cfg.beta))).first()[0]
        if value is not None and value > rule["score"]:
            rule = {"method": "expected_f", "bias": bias, "score": value}
    kept.unpersist()
    return rule


def apply(pairs: DataFrame, rule: dict, cfg: Config = Config(), p: str = "p") -> DataFrame:
    """The matches that a rule chooses."""
    kept = one_to_one(pairs, p) if cfg.one_to_one else pairs
    if rule["method"] == "threshold":
        return kept.filter(above(F.col(p), F.col("src2"), rule["t2"], rule["t3"]))
    return expected_f(kept, rule["bias"], cfg, p)


def country_bias(pairs: DataFrame, s1: DataFrame, target: float, rule: dict, cfg: Config = Config(), p: str = "p") -> DataFrame:
    """(country_key, bias): the shift of log odds under which a country's matched share is the target.

    With thresholds, a record matches as soon as its best pair, after the one-to-one step, reaches one; so the bias is minus
    the quantile of the records' best margins, in closed form, within -4 and 4. s1 (s1_id, country_key).
    """
    odds = lambda c: F.log(c / (1 - c))
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    margin = odds(q) - odds(F.when(F.col("src2") == 2, F.lit(rule["t2"])).otherwise(F.lit(rule["t3"])))
    joined = pairs.join(s1, "s1_id")
    best = Window.partitionBy("country_key", "cand_id")
    held = joined.withColumn("__b", F.max(p).over(best)).filter((F.col(p) >= F.col("__b")) | F.lit(not cfg.one_to_one))
    margins = held.groupBy("country_key", "s1_id").agg(F.max(margin).alias("m"))
    ranked = margins.withColumn("r", F.row_number().over(Window.partitionBy("country_key").orderBy(F.col("m").desc(), "s1_id")))
    sizes = s1.groupBy("country_key").agg(F.count("*").alias("n"))
    wanted = ranked.join(sizes, "country_key").withColumn("want", F.greatest(F.lit(1), F.round(F.col("n") * target).cast("int")))
    cut = wanted.groupBy("country_key").agg(F.min(F.when(F.col("r") <= F.col("want"), F.col("m"))).alias("m"))
    return cut.select("country_key", F.least(F.greatest(-F.col("m"), F.lit(-4.0)), F.lit(4.0)).alias("bias"))


def match_lists(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, column): the sorted, comma-joined candidates of every first-source record, empty if none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("__l"))
    return s1.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("__l", F.lit("")).alias(column))
