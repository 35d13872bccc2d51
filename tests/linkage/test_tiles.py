"""The best pairs by weighted keys, against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinship.config import Config
from kinship.operators import blocking, tiles

WORDS = "blue red old new hot cold ring bolt plate gear".split()


def profiles(spark, n=90, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        src = 1 + i % 3
        core, addr = [str(x) for x in r.choice(WORDS, 2)], [str(r.integers(1, 6)), str(r.choice(WORDS)), "street"]
        rows.append((f"S{src}-{i}", src, str(r.choice(["us", "fr", ""])), core, "", addr, str(10000 + r.integers(0, 4))))
    return spark.createDataFrame(rows, "entity_id string, src int, country_key string, core array<string>, alias string, addr array<string>, postal string")


def all_scores(of):
    """Every pair's three scores, by plain loops."""
    sides = defaultdict(lambda: ([], []))
    for r in of.collect():
        scaled = {}
        for key, w in zip(r["keys"], r["ws"], strict=True):
            one = (w / r.na, w / r.nn if key[0] in blocking.NAME_KINDS and r.nn else 0.0, w / r.nd if key[0] in blocking.ADDRESS_KINDS and r.nd else 0.0)
            scaled[key] = np.array(one)
        sides[r.grp][r.src != 1].append((r.rid, r.src, scaled))
    for grp, (left, right) in sides.items():
        for a, _, x in left:
            for b, src, y in right:
                if x.keys() & y.keys():
                    yield grp, a, b, src, tuple(np.round(sum(x[k] * y[k] for k in x.keys() & y.keys()), 6))


def brute(pairs, by, k, score, least, tie):
    groups = defaultdict(list)
    for p in pairs:
        if p[4][score] >= least:
            groups[by(p)].append(p)
    return {(p[1], p[2], i + 1) for g in groups.values() for i, p in enumerate(sorted(g, key=lambda p: (-p[4][score], p[tie]))[:k])}


@pytest.mark.parametrize("block", [4, 16384])
def test_best_pairs_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    of = blocking.vectors(blocking.with_groups(profiles(spark)), 150)
    pairs = list(all_scores(of))
    for score, name in enumerate(tiles.SCORES):
        got = {(r.s1_id, r.cand_id, r.rk) for r in blocking.top(of, 3, name, 0.05).collect()}
        assert got == brute(pairs, lambda p: (p[0], p[1], p[3]), 3, score, 0.05, 2)
    got = {(r.s1_id, r.cand_id, r.rk) for r in blocking.top(of, 2, "bs", 0.05, reverse=True).collect()}
    assert got == brute(pairs, lambda p: (p[0], p[2]), 2, 0, 0.05, 1)


def test_candidates_have_all_passes_and_no_pair_twice(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 4)
    cfg, profile = Config(k_all=2, k_name=1, k_addr=1, k_reverse=1, max_key_pairs=150), profiles(spark)
    pairs = list(all_scores(blocking.vectors(blocking.with_groups(profile), 150)))
    want = defaultdict(int)
    for score, k, bit in ((0, 2, 1), (1, 1, 2), (2, 1, 4)):
        for a, b, _ in brute(pairs, lambda p: (p[0], p[1], p[3]), k, score, 0.05, 2):
            want[a, b] |= bit
    for a, b, _ in brute(pairs, lambda p: (p[0], p[2]), 1, 0, 0.05, 1):
        want[a, b] |= 8
    scores = {(p[1], p[2]): p[4] for p in pairs}
    rows = blocking.candidates(profile, cfg).collect()
    assert {(r.s1_id, r.cand_id): r["mask"] for r in rows} == want and len(rows) == len(want)
    assert all((r.bs, r.bsn, r.bsa) == pytest.approx(scores[r.s1_id, r.cand_id], abs=2e-6) for r in rows)
    some = profile.filter("country_key = 'us' and src = 1").select(F.col("entity_id").alias("s1_id"))
    names = {r.s1_id for r in some.collect()}
    assert {(r.s1_id, r.cand_id): r["mask"] for r in blocking.candidates(profile, cfg, some).collect()} == {p: m for p, m in want.items() if p[0] in names}
    near = spark.createDataFrame([(*p, 2, 16) for p in list(scores)[:5]] + [("S1-0", "S2-nothing", 2, 16)], "s1_id string, cand_id string, src2 int, bit int")
    more = {(r.s1_id, r.cand_id): (r.bs, r.bsn, r.bsa) for r in blocking.candidates(profile, cfg, embedded=[near]).filter("mask >= 16").collect()}
    assert more.keys() == {(r.s1_id, r.cand_id) for r in near.collect()} and more["S1-0", "S2-nothing"] == (0, 0, 0)
    assert all(more[p] == pytest.approx(scores[p], abs=2e-6) for p in list(scores)[:5])


def test_pairs_are_not_shuffled(spark):
    """20,000 pairs of a common key leave no more than the best of each block."""
    profile = spark.range(300).select(F.concat(F.lit("S"), 1 + F.col("id") % 3, F.lit("-"), "id").alias("entity_id"), (1 + F.col("id") % 3).cast("int").alias("src"), F.lit("us").alias("country_key"), F.split(F.lit("blue ring"), " ").alias("core"), F.lit("").alias("alias"), F.array().cast("array<string>").alias("addr"), F.lit("").alias("postal"))
    found = blocking.candidates(profile, Config())
    assert found.count() == 100 * 2 * 20 + 200 * 3 - 20 * 3 * 2  # the first 3 records have the candidates' back passes, 20 of each source both
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s1_id" not in plan and "hashpartitioning(cand_id" not in plan


def test_few_pairs_held_at_a_time(monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 5)
    monkeypatch.setattr(tiles, "PRODUCTS", 4)
    r = np.random.default_rng(1)

    def rows(n, start):
        keys = [sorted({f"n{x}" for x in r.integers(0, 6, 3)}) for _ in range(n)]
        ws = [[float(w) for w in r.integers(1, 4, len(k))] for k in keys]
        norms = [float(np.linalg.norm(w)) for w in ws]
        return pa.RecordBatch.from_pydict({"rid": [f"{start}{i:03}" for i in range(n)], "src": pa.array([2 + i % 2 for i in range(n)], pa.int32()), "keys": keys, "ws": ws, "na": norms, "nn": norms, "nd": [0.0] * n})

    left, right = rows(9, "a"), rows(60, "b")
    tile = tiles._Tile(left, [(0, 4, 1)], 50_000, (blocking.NAME_KINDS, blocking.ADDRESS_KINDS), True)
    for i in range(0, 60, 13):
        tile.meet(right.slice(i, 13))
    got = {(a, b, int(k)) for x in tile.result() for a, b, k in zip(x[0].to_pylist(), x[2].to_pylist(), x[6], strict=True)}
    pairs = []
    for x in left.to_pylist():
        for y in right.to_pylist():
            u, v = (dict(zip(z["keys"], z["ws"], strict=True)) for z in (x, y))
            if u.keys() & v.keys():
                pairs.append(("", x["rid"], y["rid"], y["src"], (round(sum(u[k] * v[k] for k in u.keys() & v.keys()) / x["na"] / y["na"], 6),)))
    assert got == brute(pairs, lambda p: (p[1], p[3]), 4, 0, 0.05, 2)
