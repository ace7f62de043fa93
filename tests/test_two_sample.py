"""Two-sample tests whose fits grow together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoweave.operators import forests, models, pipelines

KEYED = "scenario_id long, drop_id long, target_id long, a double, b double, c double, test int, real int"


def sample(spark, n=3000):
    """Test 0 differs in ``a``, test 1 in nothing; ``b`` misses some values, ``c`` is the same everywhere."""
    rng = np.random.default_rng(1)
    rows = [(0, i % 200, i, float(rng.normal(0.8 if t == 0 and r else 0.0)), None if i % 7 == 0 else float(rng.random()), 1.0, t, r) for t in (0, 1) for r in (0, 1) for i in range(n)]
    return spark.createDataFrame(rows, KEYED)


@pytest.mark.parametrize("cells", [1 << 20, 1])
def test_forests_tell_a_shift(spark, monkeypatch, cells):
    """Rows that meet in cells and rows that stay apart give the same forests."""
    monkeypatch.setattr(forests, "CELLS", cells)
    results, gains = models.two_sample_tests(sample(spark), ("a", "b", "c"), kind="forest")
    found = {r.test: r for r in results.collect()}
    assert 0.68 < found[0].auroc < 0.74 and found[0].accuracy > 0.62 and 0.46 < found[1].auroc < 0.54
    top = {r.feature: r.gain for r in gains.where("test = 0").collect()}
    assert max(top, key=top.get) == "a" and top["c"] == 0 and sum(top.values()) == pytest.approx(5)


def test_copies_of_rows_change_no_test(spark):
    rows, found = sample(spark, 600), []
    for copies in (1, 3):
        df = rows.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        ends = forests.bin_ends(rows, ("a", "b"), ["target_id"])
        placed = df.withColumn("fold", (F.col("drop_id") % 5).cast("int"))
        made, met = forests.cells(placed, ("a", "b"), ends)
        assert met and made.agg(F.sum("n")).first()[0] == df.count()
        found.append([tuple(r) for r in models.forest_tests(made, met, ("a", "b"))[0].orderBy("test").collect()])
    assert [x[0] for x in found[0]] == [0, 1] and all(x == pytest.approx(y) for x, y in zip(*found, strict=True))


def test_one_side_alone_has_no_test(spark):
    results, _ = models.two_sample_tests(sample(spark, 50).where("real = 1"), ("a", "b"), kind="forest")
    assert [(r.auroc, r.accuracy) for r in results.collect()] == [(None, None)] * 2


def test_boosted_fits_read_cells(spark, monkeypatch):
    """Few features: the fits see counts of bins, not rows."""
    seen, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    df = sample(spark).where("test = 0")
    row = models.two_sample(df.where("real = 1"), df.where("real = 0"), ("a",), folds=2, trees=3).first()
    assert 0.68 < row.auroc < 0.74 and len(seen) == 2 and max(seen) <= 2 * (forests.BINS + 1)


def test_detection_has_twenty_nulls(spark):
    from echoweave.plans import evaluation_queries as queries
    from echoweave.plans.fixtures import table

    asked, made, seen = [], pipelines._against_null, []
    pipelines._against_null, kept = (lambda results, gains: (seen.append(results), made(results, gains))[1]), made
    try:
        row = queries.detection_two_sample(lambda n: (asked.append(n), table(spark, "/root/testdata/sf0.001", n))[1]).first()
    finally:
        pipelines._against_null = kept
    assert seen[0].where("test > 0 and auroc is not null").count() == 20 and sorted(asked) == ["fx_pair_pred", "fx_pred"]
    assert row.auroc > row.null_max and row.p_value == pytest.approx(1 / 21)
