import os

import duckdb
import pytest
from pyspark.sql import functions as F

from echoweave.functions.keyed_random import uniform
from echoweave.operators import draws, features, models, pairs, ranks, scores
from echoweave.plans import draw_queries, evaluation_queries, queries, resampling_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ["geometry_features", "multipath_features", "reassemble", "ece", "auroc", "murphy", "sample_categorical", "crps", "sample_bulk", "sample_nonbulk", "sample_angles", "sample_gaussian", "anderson_darling", "w1_null", "slip_rows", "feature_table", "pair_set", "branch_metrics", "position_draws", "range_draws", "draw_slices", "scene_bootstrap", "ks_2samp"])
def test_against_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    rel = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())


def test_branches_cover_all_rows_once(spark):
    rows = [(0, 0, i, x) for i, x in enumerate([1.0, 1.0, 2.0, 3.0, 3.0, 3.0, None, None])]
    df = spark.createDataFrame(rows, "scenario_id long, drop_id long, target_id long, nn_norm_range_sep double")
    counts = {r["branch"]: r["count"] for r in pairs.branch(df).groupBy("branch").count().collect()}
    assert counts == {"mutual": 4, "independent": 1, "ambiguous": 3}
    # null never matches null
    assert [(r.target_id_a, r.target_id_b) for r in pairs.pairs(df, []).collect()] == [(0, 1)]


def test_uv_round_trip(spark):
    df = spark.createDataFrame([(10.0, 5.0), (30.0, 0.0), (75.0, -20.0)], "az double, el double")
    az, el = features.from_uv(*features.uv(F.col("az"), F.col("el")))
    for r in df.select("az", "el", az.alias("a"), el.alias("e")).collect():
        assert r.a == pytest.approx(r.az) and r.e == pytest.approx(r.el)


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_ordinal_equals_sorting(spark, n):
    rows = [(0, 0, i, float((i * 7) % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "scenario_id long, drop_id long, target_id long, v double")
    got = {r.target_id: (r.row, r["rank"]) for r in ranks.ordinal(df, "v", ["target_id"], buckets=4).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[2]))
    assert got == {r[2]: (i + 1, 1 + sum(x[3] < r[3] for x in rows)) for i, r in enumerate(order)}


def test_single_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "p double, y int")
    assert scores.auroc(df, "p", "y").first()["auroc"] is None


def test_uniform_ignores_partitions(spark):
    df = spark.range(50).select("id", uniform("a", "id").alias("u"))
    assert sorted(df.repartition(1).collect()) == sorted(df.repartition(13).collect())


def test_wasserstein_of_a_shift(spark):
    x = spark.range(20).select((F.col("id") * 1.5).alias("value"))
    assert scores.wasserstein(x, x.select((F.col("value") + 2).alias("value"))).first()["w1"] == pytest.approx(2.0)


def test_path_without_power_is_counted_not_used(spark):
    rows = [(0, 0, 1, -60.0, 1.0, 10.0, 90.0), (0, 0, 1, None, 0.5, 20.0, 91.0), (0, 0, 2, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id long, drop_id long, target_id long, PathRSS double, PathDelay double, PathAOA double, PathZOA double")
    (r,) = features.multipath(df).collect()
    assert (r.target_id, r.n_mpc, r.n_mpc_dropped, r.rss_std, r.delay_min, r.k_factor_db) == (1, 1, 1, 0.0, 1.0, 60.0)


def test_rate_bounds_of_known_counts(spark):
    rows = [(0, 0, i, float(i), 0.5, int(i < 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "scenario_id long, drop_id long, target_id long, f double, p double, y int")
    (r,) = scores.rate_bounds(df, "f", "p", "y", 1).collect()
    assert (r.low, r.high) == (pytest.approx(0.066740, abs=1e-5), pytest.approx(0.652453, abs=1e-5))
    ends = scores.rate_bounds(df, "f", "p", "y", 10).collect()
    assert all((r.low == 0.0 if r.hits == 0 else r.high == 1.0) for r in ends)


def test_pick_from_empty_stratum_is_null(spark):
    table = draws.empirical(spark.createDataFrame([(0, 0, 1, 1, 5.0)], "scenario_id long, drop_id long, target_id long, s int, error double"), "error", ["s"])
    df = spark.createDataFrame([(1,), (2,)], "s int")
    assert {r.s: r.error for r in draws.pick(df, table, F.lit(0.7), ["s"]).collect()} == {1: 5.0, 2: None}


@pytest.mark.parametrize(("region", "error", "u", "wanted"), [(0, 0.1, 0.9, 0.1), (1, 1.84, 1.0, 1.81), (1, 1.6, 1.0, 1.63), (2, -2.24, 0.0, -2.18), (4, -2.3, 1.0, -2.45), (5, 1.39, 1.0, 1.36), (5, -1.54, 0.0, -1.51), (3, 1.9, 0.0, 2.0)])
def test_jitter_stays_in_its_regime(spark, region, error, u, wanted):
    df = spark.createDataFrame([(error, region, u)], "e double, r int, u double")
    assert df.select(draws.jittered(F.col("e"), F.col("r"), F.col("u")).alias("x")).first().x == pytest.approx(wanted)


def test_bias_restores_class_shares(spark):
    rows = [([0.0, 0.0, 0.0], c) for c, n in enumerate((6, 3, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "raw array<double>, y int")
    bias = models.fit_bias(df, "raw", "y", 3)
    shares = df.select(*[p.alias(str(i)) for i, p in enumerate(models.biased("raw", bias))]).first()
    assert list(shares) == pytest.approx([0.6, 0.3, 0.1], abs=1e-3)


def test_quantile_draws_are_linear_and_clamped(spark):
    df = spark.createDataFrame([(0.05,), (0.5,), (0.99,)], "u double")
    q = F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))
    got = [r.x for r in df.select(F.ln(draws.quantile_draws([0.1, 0.4, 0.6], q, F.col("u"))).alias("x")).collect()]
    assert got == pytest.approx([0.0, 2.0, 3.0])


def test_replicates_of_the_reference(spark):
    from pyspark.sql import functions as F

    from echoweave.operators import scores
    from echoweave.plans.fixtures import table
    from echoweave.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    (null,) = QUERIES["mc_null_ece"](spark, sf).collect()
    assert 1 / 1001 - 1e-6 <= null.p_value <= 1 and 0 < null.observed < 1 and 0 < null.null_mean < 1
    losses = table(spark, sf, "fx_pred").withColumn("loss", (F.col("p") - F.col("detected")) ** 2)
    want, got = scores.scene_bootstrap(losses, "loss", 1000).first(), QUERIES["scene_bootstrap"](spark, sf).first()
    assert all(abs(want[c] - got[c]) < 1e-6 for c in ("low", "high"))


def test_one_tied_value(spark):
    """A constant prediction: one range holds all rows, and each score is that of a constant."""
    df = spark.createDataFrame([(0, 0, i, 0.25, int(i % 4 == 0)) for i in range(400)], "scenario_id long, drop_id long, target_id long, p double, detected int")
    (r,) = scores.murphy(df, "p", "detected", 15).collect()
    assert (r.reliability, r.resolution, r.reconstructed) == pytest.approx((0.0, 0.0, 0.1875), abs=1e-12)
    assert scores.auroc(df, "p", "detected").first().auroc == pytest.approx(0.5)


def _plain_ranks(rows):
    """(row, rank) by id, from a sort; None stands first."""
    key = lambda r: (r[1] is not None, r[1] or 0.0)
    order = sorted(rows, key=lambda r: (*key(r), r[0]))
    return {r[0]: (i + 1, 1 + sum(key(q) < key(r) for q in rows)) for i, r in enumerate(order)}


@pytest.mark.parametrize("kind", ["constant", "mixed", "distinct", "null"])
def test_ranks_spread_ties(spark, kind):
    """Ranks are those of a sort, and no range holds more than a few shares of the rows, however many are tied."""
    from echoweave.operators.ranks import dealt, ordinal

    value = {"constant": lambda i: 2.5, "mixed": lambda i: [0.5, 0.5, 0.25, None, i / 7][i * 7 % 5], "distinct": lambda i: i * 37 % 900 / 3, "null": lambda i: None}[kind]
    rows = [(i, value(i), i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double, g int")
    got = {r.id: (r.row, r["rank"], r.n) for r in ordinal(df, "v", ["id"], buckets=8).collect()}
    assert got == {k: (*x, 900) for k, x in _plain_ranks(rows).items()}
    parts = {r.id: (r.row, r["rank"]) for r in ordinal(df, "v", ["id"], ["g"], 8).collect()}
    assert parts == _plain_ranks(rows[::2]) | _plain_ranks(rows[1::2])
    assert dealt(df, "v", ["id"], 8).groupBy("__b").count().agg(F.max("count")).first()[0] <= 3 * 900 / 8


def test_copies_are_released(spark):
    from echoweave.operators import ranks

    df = spark.range(30).select("id", (F.col("id") % 3).alias("v"))
    spark.catalog.clearCache()
    for i in range(ranks.HELD + 3):
        ranks.ordinal(df.withColumn("x", F.lit(i)), "v", ["id"]).count()
    assert len(ranks._held) == ranks.HELD
    ranks.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_null_ece_draws_pairs_together(spark):
    """Two rows of a pair that agree in every outcome: in one bin their errors add up, drawn apart they would not."""
    rows = [(0, i // 2, i % 2, 0.5, int(i % 4 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "scenario_id long, drop_id long, target_id long, p double, y int")
    joint = spark.createDataFrame([(0, i, 0, 1, 0.5, 0.0, 0.0, 0.5) for i in range(200)], "scenario_id long, drop_id long, target_id_a long, target_id_b long, p0 double, p1 double, p2 double, p3 double")
    names = ["p0", "p1", "p2", "p3"]
    (both,) = scores.null_ece(df, "p", "y", 1, 200, joint=joint, joint_p=names).collect()
    (apart,) = scores.null_ece(df, "p", "y", 1, 200).collect()
    assert both.observed == apart.observed == 0.0 and both.p_value == apart.p_value == 1.0
    # mean absolute deviation of a normal: sqrt(2/pi) times its deviation, 0.5/sqrt(200) and 0.5/sqrt(400)
    assert both.null_mean == pytest.approx(0.0282, rel=0.15) and apart.null_mean == pytest.approx(0.0199, rel=0.15)


def test_chi2_tail(spark):
    df = spark.createDataFrame([(7.5,)], "x double")
    got = df.select(scores.chi2_tail(F.col("x"), 8).alias("even"), scores.chi2_tail(F.col("x"), 3).alias("odd")).first()
    assert (got.even, got.odd) == pytest.approx((0.483768, 0.057556), abs=1e-5)
