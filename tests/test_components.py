"""Components that are saved and loaded, cross-fitted outputs that are resumed, biases of folds."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from echoweave.operators import components, models, pipelines

SCHEMA = "scenario_id long, drop_id long, target_id long, a double, b double, y int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 2))
    return spark.createDataFrame([(0, i // 5, i % 5, float(x[i, 0]), None if i % 11 == 0 else float(x[i, 1]), int(x[i, 0] * 2.5 + rng.random() / 3)) for i in range(300)], SCHEMA).cache()


def everything(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_models_draw_the_same_after_loading(spark, rows, tmp_path):
    single = models.fit_detection(rows.withColumn("detected", (F.col("y") > 0).cast("int")), ["a", "b"], kind="logistic")
    outcomes = [models.fit_detection(rows.withColumn("detected", (F.col("y") == k).cast("int")), ["a", "b"], kind="logistic") for k in range(2)]
    path = f"file://{tmp_path}/branches"
    components.save(pipelines.Branches(single, outcomes), path, spark)
    loaded = components.load(path, spark, pipelines.Branches)
    assert everything(models.predict(loaded.single, rows, ["a", "b"])) == everything(models.predict(single, rows, ["a", "b"]))
    assert everything(models.predict_outcomes(loaded.outcomes, rows, ["a", "b"])) == everything(models.predict_outcomes(outcomes, rows, ["a", "b"]))
    with pytest.raises(TypeError):
        components.load(path, spark, pipelines.Range)


def test_nested_parts_keep_their_kinds(spark, rows, tmp_path):
    forests, bias = models.fit_regimes(rows, ["a"], "y", 3, folds=2, trees=2)
    ranges = pipelines.Range(0.5, -1.0, rows.select("a"), rows.select("b"), [1.0, 2.0])
    slip = forests[0]
    path = f"file://{tmp_path}/position"
    components.save(pipelines.Position((forests, bias), ranges, slip, slip, 7.5), path, spark)
    loaded = components.load(path, spark)
    assert isinstance(loaded.regimes, tuple) and loaded.regimes[1] == bias and loaded.farthest == 7.5
    assert (loaded.ranges.slope, loaded.ranges.intercept, loaded.ranges.breaks) == (0.5, -1.0, [1.0, 2.0])
    assert everything(loaded.ranges.residuals) == everything(rows.select("a"))
    assert everything(models.predict_regimes(loaded.regimes, rows, ["a"], 3)) == everything(models.predict_regimes((forests, bias), rows, ["a"], 3))


def test_unfinished_or_missing_saves_do_not_load(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        components.load(f"file://{tmp_path}/none", spark)
    components.save([1, "x", None, (2.5,)], f"file://{tmp_path}/plain", spark)
    assert components.load(f"file://{tmp_path}/plain", spark) == [1, "x", None, (2.5,)]
    with pytest.raises(TypeError):  # its table is written, its manifest is not
        components.save([spark.range(3), object()], f"file://{tmp_path}/cut", spark)
    with pytest.raises(FileNotFoundError):
        components.load(f"file://{tmp_path}/cut", spark)
    monkeypatch.setattr(components, "VERSION", 2)
    with pytest.raises(ValueError):
        components.load(f"file://{tmp_path}/plain", spark)


def test_cross_fit_resumes(spark, rows, tmp_path, monkeypatch):
    path, fits, plain = f"file://{tmp_path}/cross", [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a, **b: fits.append(1) or plain(self, *a, **b))
    first = components.cross_fit(rows, ["a", "b"], "y", 3, path, folds=3, trees=2)
    before = everything(first.rows)
    assert len(fits) == 3 and first.rows.count() == 300
    again = components.cross_fit(rows, ["a", "b"], "y", 3, path, folds=3, trees=2)
    assert len(fits) == 3 and everything(again.rows) == before and again.biases == first.biases and again.bias == first.bias
    # the stored table gives the ensemble that a fresh fit gives
    fresh = models.fit_regimes(rows, ["a", "b"], "y", 3, folds=3, trees=2)
    assert again.bias == pytest.approx(fresh[1])
    stored, made = ([r[6:] for r in sorted(models.predict_regimes(x, rows, ["a", "b"], 3).collect(), key=lambda r: r[:3])] for x in ((again.models, again.bias), fresh))
    assert np.array(stored) == pytest.approx(np.array(made), abs=1e-9)
    assert first.rows.where("abs(aggregate(cal, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    fits.clear()
    components.cross_fit(rows.where("target_id > 0"), ["a", "b"], "y", 3, path, folds=3, trees=2)
    assert len(fits) == 3  # other rows: nothing is taken over


def newton(raw, y, classes):
    b = np.zeros(classes)
    for _ in range(60):
        e = np.exp(raw + b)
        q = e / e.sum(1, keepdims=True)
        b[1:] -= np.linalg.solve(((np.diag(q.mean(0)) - q.T @ q / len(y)) + 1e-9 * np.eye(classes))[1:, 1:], (q - np.eye(classes)[y]).mean(0)[1:])
    return b


def test_biases_of_folds(spark):
    rng = np.random.default_rng(0)
    raw, y, fold = np.log(rng.dirichlet(np.ones(4), 400)), rng.integers(0, 4, 400), rng.integers(0, 3, 400)
    df = spark.createDataFrame([(raw[i].tolist(), int(y[i]), int(fold[i])) for i in range(400)], "raw array<double>, y int, fold int")
    got = models.fit_biases(df, "raw", "y", 4, 3)
    for k in range(3):
        assert got[k] == pytest.approx(newton(raw[fold != k], y[fold != k], 4).tolist(), abs=1e-6)
    assert got[3] == pytest.approx(newton(raw, y, 4).tolist(), abs=1e-6) and models.fit_bias(df, "raw", "y", 4) == pytest.approx(got[3])
    assert models.fit_biases(df.where("false"), "raw", "y", 4, 3) == [[0.0] * 4] * 4
