"""Typed readers, sets by role, tables in buckets of scenes, fits that stop early, repeated draws of fitted parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.operators import models, pairs, pipelines
from echoweave.schemas import CLASSIFIER, INDEP_FEATURES, INDEPENDENT, KEYS, PAIRS, POSITION, SCENE
from echoweave.sources import cache, raw, sets


@pytest.fixture(scope="module")
def rows(spark):
    """Targets of 120 scenes, some of them in pairs, with every column of the sets."""
    rng = np.random.default_rng(3)
    names = sorted({*INDEP_FEATURES, *POSITION.features, *POSITION.labels} - {"nn_norm_range_sep"})
    data = [(0, i // 6, i % 6, None if i % 13 == 0 else float((i % 6) // 2 if i % 4 else i), int(i % 3 == 0), *rng.random(len(names)).tolist()) for i in range(720)]
    return spark.createDataFrame(data, "scenario_id long, drop_id long, target_id long, nn_norm_range_sep double, detected int, " + ", ".join(f"{c} double" for c in names)).cache()


def everything(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_sets_are_read_back_by_role(spark, rows, tmp_path, kind):
    made = {INDEPENDENT: sets.independent_set(rows), PAIRS: sets.pair_set(rows), POSITION: sets.position_set(rows), CLASSIFIER: sets.classifier_set(rows)}
    for i, (roles, df) in enumerate(made.items()):
        path = f"{tmp_path}/{i}.{kind}"
        kept = df.withColumn("extra", F.lit(1)).drop("score") if roles is PAIRS else df.withColumn("extra", F.lit(1))
        kept.write.option("header", True).format(kind).save(path)
        found = sets.load(spark, path, roles, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes))
        assert found.columns == [*roles.tags, *roles.features, *roles.labels] and df.count() > 0
        assert everything(found) == everything(df.select(found.columns))
        tags, labels, features = sets.split(found, roles)
        assert (tags.columns, labels.columns, features.columns) == ([*roles.tags], [*roles.tags, *roles.labels], [*roles.tags, *roles.features])
    with pytest.raises(ValueError):
        raw.read_raw(spark, f"{tmp_path}/0.csv")


def test_nan_is_read_as_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "a long, b double").write.parquet(f"{tmp_path}/t.parquet")
    assert {(r.a, r.b) for r in raw.read_raw(spark, f"{tmp_path}/t.parquet").collect()} == {(1, None), (2, 0.5), (3, None)}
    spark.createDataFrame([(7, 1.0)], "scenario_id long, b double").withColumn("c", F.lit("x")).createOrReplaceTempView("own")
    assert [tuple(r) for r in raw.write_cache(spark.table("own"), f"{tmp_path}/cache").collect()] == [(7, 1.0, "x")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_from_buckets_need_no_shuffle(spark, rows, tmp_path):
    path = f"file://{tmp_path}/features"
    with pytest.raises(FileNotFoundError):
        cache.read(spark, path)
    cache.write(rows, path, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert everything(cache.read(spark, path)) == everything(rows)
        found = sets.pair_set(cache.read(spark, path))
        assert exchanges(found) == 0 and exchanges(sets.pair_set(rows)) > 0
        assert everything(found) == everything(sets.pair_set(rows)) and found.count() > 0
        # another session has no such table yet, and learns of its buckets from the manifest
        other = spark.newSession()
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.sql(f"drop table {cache._name(path)}")
        again = sets.pair_set(cache.read(other, path))
        assert exchanges(again) == 0 and everything(again) == everything(sets.pair_set(rows))
        # written anew with other rows and another number of buckets
        cache.write(rows.where("drop_id < 10"), path, 3)
        assert cache.read(spark, path).count() == 60
        assert cache.write(rows.limit(0), f"{path}-empty", 3).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fits_stop_on_held_back_scenes(spark):
    rng = np.random.default_rng(5)
    x = rng.random((3000, 2))
    data = [(0, i // 3, i % 3, float(x[i, 0]), float(x[i, 1]), int(rng.random() < 0.2 + 0.6 * (x[i, 0] > 0.5))) for i in range(3000)]
    df = spark.createDataFrame(data, "scenario_id long, drop_id long, target_id long, a double, b double, detected int").withColumn("held", pairs.is_validation()).cache()
    held = df.where("held")
    assert 150 < held.count() < 450 and held.select(*SCENE).distinct().count() * 3 == held.count()
    model = models.fit_detection(df, ["a", "b"], validation="held", rounds=12)
    taken, losses = models.rounds_taken(model), models.loss_by_round(model, held, ["a", "b"], F.col("detected"))
    whole = models.loss_by_round(models.fit_detection(df.where("not held"), ["a", "b"], rounds=12), held, ["a", "b"], F.col("detected"))
    assert len(losses) == taken == whole.index(min(whole)) + 1 and losses == pytest.approx(whole[:taken])
    # the loss of the library is that of the probabilities that rows get
    plain = models.predict(model, held, ["a", "b"]).agg(F.avg(-F.ln(F.when(F.col("detected") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    assert losses[-1] == pytest.approx(2 * plain)
    tree = lambda fitted: fitted.stages[-1].trees[0].toDebugString.split("\n", 1)[1]
    # nothing is learned from rows held back: their labels turned round only change where it stops
    turned = df.withColumn("detected", F.when(F.col("held"), 1 - F.col("detected")).otherwise(F.col("detected")))
    other = models.fit_detection(turned, ["a", "b"], validation="held", rounds=12)
    assert tree(other) == tree(model) and models.rounds_taken(other) <= taken
    # without rows held back all rounds are kept
    assert models.rounds_taken(models.fit_detection(df.withColumn("held", F.lit(None).cast("boolean")), ["a", "b"], validation="held", rounds=3)) == 3
    outcomes = models.fit_outcomes(df, ["a", "b"], "detected", 2, 5, validation="held")
    total = models.predict_outcomes(outcomes, held, ["a", "b"]).select((F.col("p0") + F.col("p1")).alias("s")).distinct().collect()
    assert all(r.s == pytest.approx(1) for r in total)


def test_draws_of_angles_are_those_of_the_whole_model(spark, rows):
    grid = rows.select(*KEYS, "log_R", "rss_max", "nn_norm_range_sep", "rx_azimuth_deg", "rx_elevation_deg", F.col("u_true") * 0.5, F.col("v_true") * 0.5, "frac_u", "frac_v", (F.col("frac_u") / 2).alias("abs_frac_u"), (F.col("frac_v") / 2).alias("abs_frac_v"), F.floor(F.col("frac_u") * 1.5).alias("slip_u"), F.floor(F.col("frac_v") * 3).alias("slip_v"))
    grid = grid.withColumnsRenamed({"(u_true * 0.5)": "u_true", "(v_true * 0.5)": "v_true"})
    drawn = pipelines.draw_angles(pipelines.fit_angles(grid), grid, 4)
    assert drawn.count() == 4 * grid.count() and drawn.where("az_err is null or el_err is null").isEmpty()
    assert everything(drawn.select(*KEYS, "draw", "az_err")) == everything(pipelines.draw_angles(pipelines.fit_angles(grid), grid, 4).select(*KEYS, "draw", "az_err"))
    assert pipelines.draw_angles(None, grid, 4).groupBy(*KEYS).agg(F.count_distinct("az_err").alias("n")).where("n <> 1").isEmpty()
