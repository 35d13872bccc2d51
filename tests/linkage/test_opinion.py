"""The second opinion: parts of pairs of texts add up to hashed vectors, and the fit is that of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from kinship.operators import model, opinion, split
from kinship.plans import queries

DATA = "/root/testdata/sf0.001"
WORDS = ["Blue", "ring", "", "İnc", "Kelvin", "é", "a_b", "12", "7", "10000", "hot", "cold", "bolt", "plate", "street"]


def pairs(spark, n=400):
    random = np.random.default_rng(3)
    text = lambda: " ; ".join(random.choice(WORDS, random.integers(0, 12)))
    texts = [text() for _ in range(30)]
    rows = [(f"S{i % 37}", f"C{i}", texts[random.integers(30)], texts[random.integers(30)]) for i in range(n)]
    return spark.createDataFrame([(*r, len(set(r[2].split()) & set(r[3].split())) + i % 3 > 4) for i, r in enumerate(rows)], "s1_id string, cand_id string, text1 string, text2 string, label boolean")


def vectors(rows, bits):
    """The features as HashingTF makes them of each pair."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    signs = lambda kind, a: F.transform(a, lambda w: F.concat(F.lit(kind), w))
    both = F.array_intersect(words("text1"), words("text2"))
    grams = F.concat(signs("=", both), signs("<", F.array_except(words("text1"), both)), signs(">", F.array_except(words("text2"), both)), F.array(F.concat(F.lit("#"), F.least(F.lit(9), F.size(both)).cast("string"))))
    return HashingTF(inputCol="g", outputCol="x", numFeatures=1 << bits, binary=True).transform(rows.withColumn("g", grams))


@pytest.mark.parametrize("bits", [4, 6, 14])
def test_parts_add_up_to_hashed_vectors(spark, bits):
    rows = vectors(pairs(spark), bits).collect()
    texts = sorted({t for r in rows for t in (r.text1, r.text2)})
    at = np.array([[texts.index(r.text1), texts.index(r.text2)] for r in rows])
    made = opinion.Pairs([t.encode() for t in texts], at[:, 0], [t.encode() for t in texts], at[:, 1], opinion.Grams(bits))
    x = np.array([r.x.toArray() for r in rows])
    w, total = np.random.default_rng(1).normal(size=(2, 1 << bits))
    want = total + x.T @ np.arange(len(x))
    made.add_to(total, np.arange(len(x), dtype=float))
    assert np.allclose(made.sums(w), x @ w) and np.allclose(total, want)


def test_fit_is_that_of_spark(spark):
    rows, bits = pairs(spark), 8
    known = vectors(rows, bits).withColumns({"y": F.col("label").cast("double"), "half": (split.part(F.col("s1_id"), seed=7) < 0.5).cast("int")}).persist()
    own = {r.cand_id: r.ce for r in model.text_opinion(rows.drop("label"), model.opinion_models(rows, bits), True, bits).collect()}
    assert len(own) == rows.count() and all(r.half == opinion.half(r.s1_id) for r in known.collect())
    for half in (0, 1):
        fitted = LogisticRegression(featuresCol="x", labelCol="y", maxIter=30, regParam=1e-3).fit(known.filter(F.col("half") != half))
        for r in fitted.transform(known.filter(F.col("half") == half)).collect():
            assert abs(own[r.cand_id] - r.probability[1]) < 1e-6
    known.unpersist()


def test_halves_of_one_kind_and_none(spark):
    rows = pairs(spark, 60).withColumn("label", split.part(F.col("s1_id"), seed=7) < 0.5)
    ce = lambda r: [x.ce for x in model.text_opinion(r, model.opinion_models(r, 6), True, 6).collect()]
    assert set(ce(rows)) == {0.0, 1.0} and ce(rows.limit(0)) == []


def test_opinions_shuffle_no_pairs(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen, plain = [], opinion.packed
    with pytest.MonkeyPatch.context() as m:
        m.setattr(opinion, "packed", lambda train, bits: seen.append(train) or plain(train, bits))
        queries.queries()["text_second_opinion"](spark, DATA)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == plan.count("Exchange hashpartitioning(") > 0
