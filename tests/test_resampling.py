"""Resamples of scenes and permutations against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.operators import resampling as rs
from echoweave.operators.scores import anderson_darling

B, SIZE = 25, 16
SCHEMA = "scenario_id long, drop_id long, target_id long, p double, y int, m string"


def rows(scenes):
    rng = random.Random(1)
    return [(0, d, i, round(rng.random(), 1) if d % 2 else rng.random(), int(rng.random() < 0.4), "x" if i % 2 else "y") for d in range(scenes) for i in range(rng.randrange(1, 9))]


def weights(scenes, b):
    """How often replicate b draws each scene, straight from the definition."""
    hits = np.bincount(rs.draw(1, b, 0, np.arange(scenes), scenes, 42) // SIZE, minlength=-(-scenes // SIZE))
    w = np.zeros(scenes, int)
    for k, n in enumerate(hits):
        here = min(SIZE, scenes - k * SIZE)
        w[k * SIZE : k * SIZE + here] += np.bincount(rs.draw(2, b, k, np.arange(n), here, 42), minlength=here)
    assert w.sum() == scenes
    return w


def murphy(p, y, bins):
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    edges = np.round(np.linspace(0, len(p), bins + 1)).astype(int)
    _, first, inverse = np.unique(p, return_index=True, return_inverse=True)
    at = (np.searchsorted(edges, np.arange(len(p)), side="right") - 1)[first][inverse]
    each = [(np.sum(at == i), p[at == i].mean(), y[at == i].mean()) for i in np.unique(at)]
    o = y.mean()
    return sum(n * (a - r) ** 2 for n, a, r in each) / len(p), sum(n * (r - o) ** 2 for n, _, r in each) / len(p), o * (1 - o)


@pytest.mark.parametrize("scenes", [1, 2, 40])
def test_resamples_equal_brute_force(spark, monkeypatch, scenes):
    monkeypatch.setattr(rs, "STRATUM", SIZE)
    own = rows(scenes)
    df = spark.createDataFrame(own, SCHEMA)
    made = rs.Resamples(df, B)
    ranked = {(r.m, r.b): r for r in made.ranked(df, "p", "y", 5, ["m"]).collect()}
    sums = {(r.m, r.b): r for r in made.sums(df, {"n": F.lit(1), "e": (F.col("p") - F.col("y")) ** 2}, ["m"]).collect()}
    w1 = {r.b: r.w1 for r in made.wasserstein(df.withColumn("real", F.col("y") == 1), "p", "real").collect()}
    for b in range(B):
        w = weights(scenes, b)
        for m in {r[5] for r in own}:
            p = np.array([r[3] for r in own if r[5] == m for _ in range(w[r[1]])])
            y = np.array([r[4] for r in own if r[5] == m for _ in range(w[r[1]])])
            if not len(p):
                assert sums[m, b].n == 0
                continue
            assert sums[m, b].n == len(p) and sums[m, b].e == pytest.approx(((p - y) ** 2).sum())
            got = ranked[m, b]
            assert (got.reliability, got.resolution, got.uncertainty) == pytest.approx(murphy(p, y, 5), abs=1e-9)
            pos, neg = p[y == 1], p[y == 0]
            if len(pos) and len(neg):
                assert got.auroc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
            else:
                assert got.auroc is None
        a, c = (np.sort([r[3] for r in own if r[4] == k for _ in range(w[r[1]])]) for k in (1, 0))
        if len(a) and len(c):
            z = np.unique(np.concatenate([a, c]))
            area = sum(abs(np.searchsorted(a, x, side="right") / len(a) - np.searchsorted(c, x, side="right") / len(c)) * (after - x) for x, after in zip(z, z[1:], strict=False))
            assert w1[b] == pytest.approx(area, abs=1e-9)
        else:
            assert w1[b] is None


def test_one_tied_score_leaves_tasks_as_few_rows(spark):
    df = spark.range(20_000).select(F.lit(0).cast("long").alias("scenario_id"), (F.col("id") % 100).alias("drop_id"), F.col("id").alias("target_id"), F.lit(0.5).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    got = rs.Resamples(df, 5).ranked(df, "p", "y", 10).collect()
    assert len(got) == 5 and all(r.auroc == 0.5 and r.resolution == pytest.approx(0) for r in got)


def test_intervals_leave_out_missing_values(spark):
    df = spark.createDataFrame([(b, None if b % 2 else float(b)) for b in range(11)], "b int, x double")
    row = rs.intervals(df, ["x"], alpha=0.2).first()
    assert (row.metric, row.low, row.high) == ("x", pytest.approx(1.0), pytest.approx(9.0))


def statistic(p, y):
    n, total = len(p), 0.0
    for v in np.unique(p):
        tied = (p == v).sum()
        if tied == n:
            return 0.0
        below = (p < v).sum() + tied / 2
        for k in (0, 1):
            own = p[y == k]
            gap = n * ((own < v).sum() + (own == v).sum() / 2) - len(own) * below
            total += tied / n * gap * gap / (below * (n - below) - n * tied / 4) / len(own)
    return (n - 1) / n * total


@pytest.mark.parametrize("digits", [1, 6])
def test_permutations_follow_their_distribution(spark, digits):
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.4).astype(int)
    p = np.round(rng.random(60) + 0.15 * y, digits)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")
    got = rs.permuted_anderson_darling(df, "p", "y", 1500).first()
    assert got.statistic == pytest.approx(statistic(p, y)) == pytest.approx(anderson_darling(df, "p", "y").first()[0])
    null = [statistic(p, rng.permutation(y)) for _ in range(1500)]
    assert got.p_value == pytest.approx((1 + sum(x >= got.statistic - 1e-9 for x in null)) / 1501, abs=0.06)


def test_permutations_of_one_class(spark):
    assert tuple(rs.permuted_anderson_darling(spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int"), "p", "y", 5).first()) == (None, None)


def test_observed_replicate_has_every_scene_once(spark, monkeypatch):
    """Values come from the sweep that makes the intervals: replicate -1 equals the plain metrics, ties and all."""
    from echoweave.operators.scores import branch_metrics, wasserstein

    monkeypatch.setattr(rs, "STRATUM", SIZE)
    df = spark.createDataFrame(rows(40), SCHEMA).withColumn("mutual", F.col("m") == "x").persist()
    made = rs.Resamples(df, 3, observed=True)
    own = df.withColumn("branch", F.explode(F.array(F.when(F.col("mutual"), "mutual").otherwise("non_mutual"), F.lit("pooled"))))
    found = made.ranked(own, "p", "y", 5, ["branch"])
    assert sorted(r.b for r in found.where("branch = 'pooled'").collect()) == [-1, 0, 1, 2]
    got, want = ({r.branch: [r[c] for c in ("brier", "auroc", "reliability", "resolution", "uncertainty")] for r in x.collect()} for x in (found.where("b = -1"), branch_metrics(df, "p", "y", "mutual", 5)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    sides = [df.where(f"y = {k}").select(F.col("p").alias("value")) for k in (1, 0)]
    assert made.wasserstein(df.withColumn("real", F.col("y") == 1), "p", "real").where("b = -1").first().w1 == pytest.approx(wasserstein(*sides).first().w1)
    assert made.sums(df, {"n": F.lit(1)}).where("b = -1").first().n == df.count()


@pytest.mark.parametrize("name", ["branch_intervals", "draw_intervals"])
def test_intervals_derive_each_table_once(spark, name):
    from echoweave.plans import resampling_queries
    from echoweave.plans.fixtures import table

    asked = []
    found = getattr(resampling_queries, name)(lambda n: (asked.append(n), table(spark, "/root/testdata/sf0.001", n))[1])
    assert len(asked) == len(set(asked)) and found.where("low > high or value is null").isEmpty()
    # what is read after that are files, not the joins that made them
    assert "orders" not in found._jdf.queryExecution().optimizedPlan().toString().replace("orderkey", "")
