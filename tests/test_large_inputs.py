"""What must not be made again for every pass, replicate or fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fits_read_a_written_table(spark):
    """Rows of the fits come from a file, not from the joins that made them."""
    from echoweave.plans.evaluation_queries import _regime_rows
    from echoweave.plans.fixtures import table

    rows = _regime_rows(lambda name: table(spark, SMALL, name))
    assert "Join" not in _plan(rows) and "Exchange" not in _plan(rows) and rows.count() > 0


def test_null_of_ece_repeats_no_row(spark):
    """Replicates are made as arrays of a row; their counts have the mean and spread of independent labels."""
    from echoweave.operators.scores import _hits_of, null_ece

    rows = spark.range(4000).select((F.col("id") % 5).alias("scenario_id"), F.col("id").alias("drop_id"), F.col("id").alias("target_id"), ((F.col("id") % 97) / 97 + 0.005).alias("p"), (F.col("id") % 2).alias("y"))
    found = null_ece(rows, "p", "y", 15, 200)
    assert "Generate" not in _plan(found)
    once, again = found.first(), null_ece(rows.repartition(7), "p", "y", 15, 200).first()
    assert again.null_mean == pytest.approx(once.null_mean, rel=1e-9) and once.p_value == again.p_value == pytest.approx(1 / 201) and 0.01 < once.null_mean < 0.04

    rng = np.random.default_rng(1)
    p, key, at = rng.random(9000), rng.integers(-(2**63), 2**63 - 1, 9000), rng.integers(0, 3, 9000)
    hits = _hits_of(at, p, key, 3, 501)
    mean, spread = np.bincount(at, p), np.sqrt(np.bincount(at, p * (1 - p)))
    assert hits.shape == (3, 501) and (abs(hits.mean(axis=1) - mean) < 4 * spread / 501**0.5).all() and (abs(hits.std(axis=1) / spread - 1) < 0.15).all()
    assert (_hits_of(np.zeros(9, int), np.array([0.0, 1.0, 1.0] * 3), key[:9], 1, 7) == 6).all()


def test_folds_of_two_sample_tests_fill_many_tasks(spark, monkeypatch):
    from echoweave.operators import models

    monkeypatch.setattr(models, "MATRIX_ROWS", 100)
    rows = spark.range(4000).select(F.lit(1).alias("scenario_id"), F.col("id").alias("drop_id"), F.col("id").alias("target_id"), F.lit(0).alias("test"), (F.col("id") % 2).alias("fold"), F.lit(1).alias("real"), F.lit(0.5).alias("x"))
    sizes = models._by_fold(rows, 2, 2000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 600


def test_buckets_hold_the_columns_of_pairs_alone(spark, monkeypatch):
    from echoweave.plans import component_queries as queries

    seen, write = [], queries.cache.write
    monkeypatch.setattr(queries.cache, "write", lambda df, *rest: (seen.append(df.columns), write(df, *rest))[1])
    assert queries.pair_set_cached(lambda name: queries_table(spark, name)).count() > 0
    assert len(seen[0]) == 25 and "position_error_3d_m" not in seen[0]


def queries_table(spark, name):
    from echoweave.plans.fixtures import table

    return table(spark, SMALL, name)


@pytest.mark.parametrize("replicates", [1, 2, 7, 100])
def test_weights_are_packed(replicates):
    """Four bits a replicate; larger weights come back as well."""
    from echoweave.operators.resampling import packed, unpacked

    weights = np.random.default_rng(0).poisson(1, (500, replicates))
    weights[3, 0], weights[5, -1] = 16, 70_000
    rows = packed(weights)
    assert (unpacked(rows, replicates) == weights).all() and sum(len(x) for x in rows) <= 498 * (replicates + 1) // 2 + 8 * replicates
    assert unpacked([], replicates).shape == (0, replicates)


def test_ranges_are_found_by_halving(spark):
    """A row looks at the digits of a range's number, not at every end; ends, ties, null and NaN fall as a filter has them."""
    from echoweave.operators.ranks import bisected

    values = [*range(-1, 22), None, float("nan"), 3.5]
    for ends in ([], [3.0], [float(x) for x in range(0, 20, 2)], [1.0, 5.0, float("nan")]):
        rows = spark.createDataFrame([(x if x is None else float(x),) for x in values], "v double")
        found = bisected(rows, "n", [F.lit(e) for e in ends], lambda e: F.col("v") >= e)
        plain = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: F.col("v") >= e))
        assert found.where(F.col("n") != plain).count() == 0 and "filter(" not in _plan(found)


def test_draws_are_read_once(spark):
    """Scores of draws read them once: they join no table again, and ranges of values don't come from quantiles of all rows."""
    from echoweave.operators import ranks, scores

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ranks.release()
    made = spark.range(6000).selectExpr("1L scenario_id", "id div 60 drop_id", "id div 10 target_id", "id % 10 draw", "(id * 7919 % 1000) / 100 value", "(id div 10) % 7 / 1.0 real", "(id div 10) * 1.5 x", "'a' model")
    rows = made.mapInArrow(count, made.schema)
    assert scores.draw_scores(rows, "real").count() == 1 and read.value == 6000
    assert scores.draw_slices(rows, "real", "x", 4).count() == 4 and read.value == 12000
    ranks.release()


def test_batches_of_words_are_sliced(monkeypatch):
    """A task joins a bounded number of words at once, in whole rows, all of them and in order."""
    import pyarrow as pa

    from echoweave.llm import collocations

    monkeypatch.setattr(collocations, "SLICE", 4)
    rows = [["a"], ["b", "c"], [], ["d", "e"], [str(i) for i in range(9)], [], ["f"]]
    batch = pa.record_batch([pa.array(rows)], names=["words"])
    found = [b.column("words").to_pylist() for b in collocations._slices([batch, batch.slice(3, 0)], "words")]
    assert [x for part in found for x in part] == rows and all(len(part) == 1 or sum(map(len, part)) <= 4 for part in found)
    assert len(found) > 1


def test_tables_of_counts_are_packed(spark):
    """Tables of mostly zero bytes take less than half of what the default codec leaves."""
    from pathlib import Path

    from echoweave.llm.common import Tables

    made = np.random.default_rng(0).integers(1, 90, 200_000).astype("<i8").tobytes()
    rows, sizes = spark.createDataFrame([(bytearray(made),)], "counts binary"), []
    for codec in (None, "zstd"):
        with Tables(spark, codec) as tables:
            out = tables.keep(rows)
            sizes.append(sum(f.stat().st_size for f in Path(tables.paths[id(out)][1].removeprefix("file://").removeprefix("file:")).glob("*.parquet")))
            assert bytes(out.first().counts) == made
    assert sizes[1] < sizes[0] / 2


@pytest.mark.parametrize(("rows", "chosen"), [(1, 0), (1, 1), (5, 2), (40, 39), (7, 7), (3000, 1), (3000, 1700)])
def test_permuted_labels_are_subsets(rows, chosen):
    """Labels of a permutation are drawn a byte each: always as many ones, and every place and pair of places as often as the others."""
    from itertools import combinations

    from echoweave.operators.resampling import subset

    rng = np.random.default_rng(3)
    drawn = np.array([subset(rng, rows, chosen) for _ in range(2000)])
    assert (drawn.sum(axis=1) == chosen).all() and set(np.unique(drawn)) <= {0, 1}
    share = chosen / rows
    assert (abs(drawn.mean(axis=0) - share) <= 6 * (share * (1 - share) / 2000) ** 0.5 + 1e-12).all()
    if rows == 5:
        times = [int((drawn[:, i] & drawn[:, j]).sum()) for i, j in combinations(range(5), 2)]
        assert min(times) > 140 and max(times) < 260


def test_paths_are_dealt_in_as_many_parts_as_they_need(spark, monkeypatch):
    """A fixed number of partitions made the sorts of a task grow with the table."""
    from echoweave.operators.features import multipath
    from echoweave.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_PATHS", 100, raising=False)
    paths = fixtures.table(spark, "/root/testdata/sf0.001", "fx_snr")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    found = multipath(paths)
    assert found.rdd.getNumPartitions() == paths.rdd.getNumPartitions() == -(-rows // 100)
    assert paths.count() == rows


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_values_of_ensembles_travel_once(spark, monkeypatch, most):
    """W1 of points with their draws as arrays: ranges without values, ties, single points and a group without draws."""
    from echoweave.operators import scores

    monkeypatch.setattr(scores, "RANGE_VALUES", most)
    rng = np.random.default_rng(2)
    rows = [("wide", float(rng.integers(0, 9)), [float(x) for x in rng.normal(3, 40, 5)]) for _ in range(300)]
    rows += [("near", float(rng.random()), [float(x) for x in rng.integers(0, 3, 4)]) for _ in range(200)]
    rows += [("one", 2.0, [5.0]), ("none", 1.0, []), ("unreal", None, [1.0, 2.0])]
    points = spark.createDataFrame(rows, "model string, __real double, __x array<double>")
    found = scores.ensemble_wasserstein(points, "model")
    got = {r.model: r.w1 for r in found.collect()}
    for model in ("wide", "near", "one"):
        a, b = np.array([r[1] for r in rows if r[0] == model]), np.array([x for r in rows if r[0] == model for x in r[2]])
        z = np.sort(np.concatenate([a, b]))
        want = sum(abs((a <= x).mean() - (b <= x).mean()) * (y - x) for x, y in zip(z, z[1:], strict=False))
        assert got[model] == pytest.approx(want)
    assert got["none"] is None and got["unreal"] is None and "Window" not in _plan(found)


def test_drawn_rows_meet_their_values_in_one_join(spark):
    """Bulk and other regimes are one table, and what is shuffled is the place, not the row's columns."""
    from echoweave.operators import pipelines

    table = lambda *rows: spark.createDataFrame(rows, "stratum int, k long, size long, x double")
    model = pipelines.Range(0.5, 1.0, table((0, 0, 1, 7.0)).withColumnRenamed("x", "residual"), table((30, 0, 1, 9.0)).withColumnRenamed("x", "error"), [1.0])
    df = spark.createDataFrame([(1, 1, i, i % 4, 2.0, 0.5, "wide") for i in range(8)], "scenario_id long, drop_id long, target_id long, region int, bistatic_range_m double, nn_norm_range_sep double, other string")
    drawn = pipelines.range_draws(df, model).select("target_id", "region", "sampled_error")
    assert {(r.region, r.sampled_error) for r in drawn.collect()} == {(0, 9.0), (1, None), (2, None), (3, 9.0)}
    joins = [x for x in drawn._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 2  # the sizes of the strata, and the values


def test_boosted_fits_hold_one_copy_of_many_rows(spark, monkeypatch):
    """Flags that no tree could split on are left out, and fits of many rows run one after the other."""
    from echoweave.operators import models

    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    threads, pool = [], models.ThreadPool
    monkeypatch.setattr(models, "ThreadPool", lambda n: (threads.append(n), pool(n))[1])
    side = models.fit_outcomes(df, ["a", "b"], "y", 2, 2)
    monkeypatch.setattr(models, "APART", 100)
    apart = models.fit_outcomes(df, ["a", "b"], "y", 2, 2)
    assert threads == [2, 1] and apart[0].stages[1].getInputCols() == ["a_filled", "b_filled", "b_missing"]
    got = [[r.p0 for r in models.predict_outcomes(m, df.limit(20), ["a", "b"]).collect()] for m in (side, apart)]
    assert got[0] == got[1]
    assert sum(models.gain(apart[0].stages[-1], ["a", "b"], ["b"]).values()) == pytest.approx(1)
