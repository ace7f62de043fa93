"""Fitted models: closed forms as aggregates, the rest by Spark ML."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.storagelevel import StorageLevel

from ..functions.keyed_random import uniform
from ..schemas import KEYS
from . import forests
from .pairs import fold
from .scores import auroc, auroc_of_counts

#: Least distance to a cell's edge, and the separation at which closeness falls to 1/e.
EDGE_MIN, CLOSE_SCALE = 1e-3, 5.0


def bulk_fit(df: DataFrame, distance: str, error: str) -> DataFrame:
    """Slope and intercept of the bulk range error; short ranges with tiny errors are left out."""
    used = df.where(~((F.col(distance) < 110) & (F.abs(error) < 0.03)))
    return used.agg(F.regr_slope(error, distance).alias("slope"), F.regr_intercept(error, distance).alias("intercept"), F.count("*").alias("n"))


def gaussian_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means and sample covariances of error columns, in one pass; rows with a null in any are left out."""
    own = df.na.drop(subset=list(columns))
    return own.agg(*[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"cov_{i}{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])


def with_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})


def prepare(features: Sequence[str], scale: bool = False, flags: Sequence[str] | None = None) -> list:
    """Stages that fill and assemble features and the flags of missing ones, of all or of those in ``flags``."""
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(strategy="mean", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled + [f"{c}_missing" for c in (features if flags is None else flags)], outputCol="raw_x" if scale else "x")]
    return stages + ([StandardScaler(inputCol="raw_x", outputCol="x", withMean=True)] if scale else [])


#: Rows from which boosted models are fitted one after the other: a pass then fills all cores, and each fit holds its own binned copy of the rows.
APART = 2_000_000


def fit_boosted(train: DataFrame, features: Sequence[str], labels: Sequence[Column], rounds: int, validation: str | None = None, **params) -> list[PipelineModel]:
    """A boosted model for each of ``labels`` (0 or 1), fitted on one assembled matrix, which is let go again; side by side where rows are few.

    ``validation`` names a boolean column: no model, mean or split is fitted on its rows. A model then takes as many of
    the ``rounds`` as have the least loss on them (the first of equals): its rounds are drawn by the seed, so a second
    fit of fewer rounds repeats the first ones. Null counts as false; without such rows all rounds are kept.

    Flags of features that no row lacks are left out: no tree could split on them.
    """
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    flagged = with_flags(train, features).withColumn("__held", held)
    own_rows = flagged.where("not __held")
    sizes = own_rows.agg(F.count("*").alias("n"), *[F.max(f"{f}_missing").alias(f) for f in features]).first()
    first = Pipeline(stages=prepare(features, flags=[f for f in features if sizes[f] != 0])).fit(own_rows)
    whole = first.transform(flagged).select("x", "__held", *[y.cast("int").alias(f"__y{i}") for i, y in enumerate(labels)])
    whole = whole.persist(StorageLevel.DISK_ONLY)
    try:
        stop = validation is not None and not flagged.where("__held").isEmpty()

        def fit(i: int):
            own = lambda n: GBTClassifier(featuresCol="x", labelCol=f"__y{i}", maxIter=n, **params).fit(whole.where("not __held"))
            fitted = own(rounds)
            losses = fitted.evaluateEachIteration(whole.where("__held")) if stop else [0.0]
            least = losses.index(min(losses)) + 1
            return own(least) if least < len(losses) else fitted

        with ThreadPool(min(4, len(labels)) if sizes["n"] < APART else 1) as pool:
            found = pool.map(fit, range(len(labels)))
    finally:
        whole.unpersist()
    return [PipelineModel([*first.stages, model]) for model in found]


def rounds_taken(model: PipelineModel) -> int:
    """Rounds of a boosted model."""
    return model.stages[-1].getNumTrees


def loss_by_round(model: PipelineModel, df: DataFrame, features: Sequence[str], label: Column) -> list[float]:
    """Mean log loss of a boosted model on ``df`` after each of its rounds, in one pass (twice the negative log-likelihood, as it is fitted)."""
    *first, boosted = model.stages
    return boosted.evaluateEachIteration(PipelineModel(first).transform(with_flags(df, features)).withColumn(boosted.getLabelCol(), label.cast("int")))


def fit_detection(train: DataFrame, features: Sequence[str], label: str = "detected", kind: str = "trees", seed: int = 42, validation: str | None = None, rounds: int = 20) -> PipelineModel:
    """P(detected): boosted trees, a small network (``network``) or logistic regression (``logistic``); missing values are flagged.

    Boosted trees take ``rounds``, or fewer where ``validation`` names rows held back to choose their number (:func:`fit_boosted`).
    """
    if kind == "trees":
        return fit_boosted(train, features, [F.col(label)], rounds, validation, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=50, seed=seed)[0]
    last = {
        "network": MultilayerPerceptronClassifier(featuresCol="x", labelCol=label, layers=[2 * len(features), 16, 2], maxIter=40, seed=seed),
        "logistic": LogisticRegression(featuresCol="x", labelCol=label, regParam=1e-4),
    }[kind]
    return Pipeline(stages=[*prepare(features, kind == "network"), last]).fit(with_flags(train, features))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Adds the probability of label 1; every column of ``df`` stays."""
    return model.transform(with_flags(df, features)).select(*df.columns, vector_to_array("probability")[1].alias(name))


def fit_outcomes(train: DataFrame, features: Sequence[str], label: str, classes: int, trees: int = 10, seed: int = 42, validation: str | None = None) -> list[PipelineModel]:
    """One boosted model for each of the outcomes 0 to classes - 1 against all others, as for pairs of targets; ``trees`` rounds at most with ``validation``."""
    return fit_boosted(train, features, [F.col(label) == c for c in range(classes)], trees, validation, maxDepth=3, seed=seed)


def predict_outcomes(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str], prefix: str = "p") -> DataFrame:
    """Adds ``p0``, ``p1``, ...: the models' probabilities divided by their sum."""
    out = df
    for c, model in enumerate(models):
        out = predict(model, out, features, f"__{c}")
    total = sum((F.col(f"__{c}") for c in range(1, len(models))), F.col("__0"))
    return out.select(*df.columns, *[(F.col(f"__{c}") / total).alias(f"{prefix}{c}") for c in range(len(models))])


def cross_fit(df: DataFrame, features: Sequence[str], label: str, classes: int, folds: int = 5, trees: int = 20, seed: int = 42) -> tuple[list[PipelineModel], DataFrame]:
    """Forests fitted without each fold of scenes in turn, and the rows with ``raw``: log probabilities from the forest that has not seen them."""
    placed = with_flags(df, features).withColumn("fold", fold(folds))
    # a class that a fold lacks still has its place in the vector
    models, scored = [], []
    for k in range(folds):
        forest = RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=5, seed=seed)
        models.append(Pipeline(stages=[*prepare(features), forest]).fit(placed.where(F.col("fold") != k)))
        scored.append(models[k].transform(placed.where(F.col("fold") == k)).select(*df.columns, "fold", log_probabilities(classes).alias("raw")))
    return models, reduce(DataFrame.unionByName, scored)


def log_probabilities(classes: int) -> Column:
    p = vector_to_array("probability")
    return F.array(*[F.ln(F.greatest(F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)), F.lit(1e-6))) for i in range(classes)])


def biased(raw: str, bias: Sequence[float]) -> list[Column]:
    """softmax(raw + bias)."""
    e = [F.exp(F.col(raw)[i] + float(b)) for i, b in enumerate(bias)]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def fit_bias(df: DataFrame, raw: str, label: str, classes: int, steps: int = 25) -> list[float]:
    """Biases (the first is 0) that minimise the mean negative log-likelihood of softmax(raw + bias)."""
    return fit_biases(df.withColumn("fold", F.lit(0)), raw, label, classes, 0, steps=steps)[-1]


def fit_biases(df: DataFrame, raw: str, label: str, classes: int, folds: int, fold: str = "fold", steps: int = 25) -> list[list[float]]:
    """Biases fitted without each fold in turn, then on all rows: ``folds`` + 1 problems, solved together.

    Damped Newton steps. A step takes loss, gradient and Hessian of every open problem from one aggregate, in which a
    row counts for the problems that do not leave out its fold; only a row of sums for each problem is shuffled. Each
    problem ends with the best point that was evaluated; one without rows keeps 0.
    """
    count, ridge = folds + 1, 1e-6
    best, trial, step = np.zeros((count, classes)), np.zeros((count, classes)), np.zeros((count, classes))
    loss, open_ = np.full(count, np.inf), np.ones(count, bool)
    upper = [(i, j) for i in range(1, classes) for j in range(i, classes)]
    for _ in range(steps):
        offered = [F.struct(F.lit(int(k)).alias("problem"), F.array(*[F.lit(float(x)) for x in trial[k]]).alias("bias")) for k in np.flatnonzero(open_)]
        each = df.select(F.col(fold).alias("__fold"), F.col(label).alias("__y"), F.col(raw).alias("__raw"), F.inline(F.array(*offered))).where("problem <> __fold or problem = " + str(folds))
        e = [F.exp(F.col("__raw")[i] + F.col("bias")[i]) for i in range(classes)]
        each = each.withColumn("__e", F.array(*e)).withColumn("__q", F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda s, v: s + v)))
        q = [F.col("__q")[i] for i in range(classes)]
        picked = F.coalesce(*[F.when(F.col("__y") == i, q[i]) for i in range(classes)])
        gradients = [F.avg(q[i] - (F.col("__y") == i).cast("int")) for i in range(1, classes)]
        found = each.groupBy("problem").agg(F.avg(-F.ln(picked + 1e-12)).alias("loss"), *gradients, *[F.avg((q[i] if i == j else F.lit(0.0)) - q[i] * q[j]) for i, j in upper]).collect()
        open_[:] = False
        for row in found:
            k = row["problem"]
            if row["loss"] is None:
                continue
            if row["loss"] > loss[k] + 1e-12:  # too far: half the way back
                step[k] /= 2
                trial[k], open_[k] = best[k] + step[k], bool(np.abs(step[k]).max() > 1e-12)
                continue
            best[k], loss[k] = trial[k], row["loss"]
            gradient, hessian = np.array(row[2 : classes + 1]), np.zeros((classes - 1, classes - 1))
            for (i, j), h in zip(upper, row[classes + 1 :], strict=True):
                hessian[i - 1, j - 1] = hessian[j - 1, i - 1] = h
            if np.abs(gradient).max() >= 1e-12:
                step[k, 1:] = -np.linalg.solve(hessian + ridge * np.eye(classes - 1), gradient)
                trial[k], open_[k] = best[k] + step[k], True
        if not open_.any():
            break
    return best.tolist()


def calibrated(df: DataFrame, raw: str, biases: Sequence[Sequence[float]], name: str, fold: str = "fold") -> DataFrame:
    """Adds softmax(raw + the bias of the row's fold), an array."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in biases])
    e = F.transform(F.zip_with(raw, F.get(table, F.col(fold)), lambda x, b: x + b), lambda x: F.exp(x))
    share = F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda s, v: s + v))
    return df.withColumn("__e", e).withColumn(name, share).drop("__e")


def slip_features(df: DataFrame, farthest: float) -> DataFrame:
    """Two rows a target, one for each axis: ``edge``, ``close``, ``rss`` and whether it ``slipped``.

    ``farthest`` is the largest separation in training; it stands for that of a target without neighbour.
    """
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"abs_frac_{a}").alias("abs_frac"), F.col(f"slip_{a}").alias("slip")) for a in "uv"])
    kept = [c for c in df.columns if c not in ("axis", "abs_frac", "slip")]
    return df.select(*kept, F.inline(sides)).withColumns(
        {
            "edge": F.ln(0.5 - F.col("abs_frac") + EDGE_MIN),
            "close": F.exp(-F.coalesce("nn_norm_range_sep", F.lit(farthest)) / CLOSE_SCALE),
            "rss": F.col("rss_max"),
            "slipped": (F.col("slip") != 0).cast("int"),
        }
    )


def fit_slip(train: DataFrame) -> tuple[PipelineModel, PipelineModel]:
    """P(slip) from rows of :func:`slip_features`, and the size of slips (1 to 4, larger ones as 4) from range and power."""
    rows = train.where("slipped is not null")
    whether = LogisticRegression(featuresCol="x", labelCol="slipped", regParam=1 / (10 * max(1, rows.count())), standardization=False)
    own = rows.where("slipped = 1").withColumn("size", F.least(F.abs("slip"), F.lit(4)).cast("int"))
    size = LogisticRegression(featuresCol="x", labelCol="size", family="multinomial", regParam=1 / max(1, own.count()))
    made = []
    for model, data, features in ((whether, rows, ("edge", "close", "rss")), (size, own, ("log_R", "rss_max"))):
        made.append(Pipeline(stages=[*prepare(features), model]).fit(with_flags(data, features)))
    return made[0], made[1]


def fit_quantiles(train: DataFrame, features: Sequence[str], target: str, levels: Sequence[float], trees: int = 10, depth: int = 4, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A quantile forest: the trees split for the mean, and each leaf keeps quantiles of the targets that reach it.

    Leaf quantiles are approximate aggregates with bounded state, so a large leaf needs no task to hold its rows.
    """
    forest = RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, leafCol="leaf", seed=seed)
    model = Pipeline(stages=[*prepare(features), forest]).fit(with_flags(train, features))
    leaves = _leaves(model, train, features).groupBy("tree", "leaf").agg(F.percentile_approx(target, [float(x) for x in levels], 10000).alias("q"))
    return model, leaves


def _leaves(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    assert isinstance(model.stages[-1], RandomForestRegressionModel)
    return model.transform(with_flags(df, features)).select(*df.columns, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))


def predict_quantiles(model: PipelineModel, leaves: DataFrame, df: DataFrame, features: Sequence[str], keys: Sequence[str], levels: int) -> DataFrame:
    """(keys, ``q``): the trees' quantiles averaged level by level and put in order. There are at most trees x 2^depth leaves."""
    hit = _leaves(model, df.select(*keys, *features), features).join(F.broadcast(leaves), ["tree", "leaf"])
    return hit.groupBy(*keys).agg(F.array_sort(F.array(*[F.avg(F.col("q")[i]) for i in range(levels)])).alias("q"))


#: Rows of a task of the matrix that the fits of two-sample tests share, and fits at a time.
MATRIX_ROWS, PARALLEL = 50_000, 8


def _by_fold(rows: DataFrame, groups: int, largest: int) -> DataFrame:
    """(test, real, fold, x) dealt by test and fold, and by keys where a fold has more than ``MATRIX_ROWS``: else each fold would be one task."""
    parts = -(-largest // MATRIX_ROWS)
    placed = rows.withColumn("__part", F.pmod(F.xxhash64(*KEYS), F.lit(parts)))
    return placed.repartition(max(1, groups * parts), "test", "fold", "__part").select("test", "real", "fold", "x")


def two_sample_tests(rows: DataFrame, features: Sequence[str], folds: int = 5, trees: int = 20, seed: int = 42, parallel: int = PARALLEL, kind: str = "boosted") -> tuple[DataFrame, DataFrame]:
    """How well trees tell real rows from drawn ones, in each test of ``rows(KEYS, features, test, real)``.

    (test, auroc, accuracy) out of fold, and (test, feature, gain) summed over the folds. Copies of a scene share a
    fold. ``kind``: boosted trees, or a ``forest``; all forests of all tests grow together (:mod:`.forests`). Boosted
    trees are fitted on cells of equal bins and their counts where features are few, else on one matrix of all tests.
    """
    rows = rows.select(*KEYS, *[F.col(f).cast("double").alias(f) for f in features], F.col("test").cast("int").alias("test"), "real", fold(folds).alias("fold"))
    if kind == "forest":
        return forest_tests(*forests.cells(rows, features, forests.bin_ends(rows, features, KEYS)), features, folds, trees, seed)
    return _tables(rows, _boosted_tests(rows, features, folds, trees, seed, parallel))


def _tables(df: DataFrame, found: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    results = df.sparkSession.createDataFrame([x[:3] for x in found], "test int, auroc double, accuracy double")
    return results, df.sparkSession.createDataFrame([(i, f, g) for i, _, _, gains in found for f, g in gains.items()], "test int, feature string, gain double")


def forest_tests(cells: DataFrame, met: bool, features: Sequence[str], folds: int = 5, trees: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The tables of :func:`two_sample_tests` by forests on the counts of equal rows (:func:`.forests.cells`)."""
    scored, gains = forests.two_sample_forests(cells, met, features, folds, trees, 5, seed)
    right = F.try_divide(F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))), F.sum(F.col("pos") + F.col("neg")))
    by_test = auroc_of_counts(scored, "p", ["test"]).join(scored.groupBy("test").agg(right.alias("accuracy")), "test")
    found = {r["test"]: (r["auroc"], r["accuracy"]) for r in by_test.collect()}
    scored.unpersist()
    return _tables(cells, [(i, *found.get(i, (None, None)), g) for i, g in gains.items()])


def _boosted_tests(rows: DataFrame, features: Sequence[str], folds: int, trees: int, seed: int, parallel: int) -> list[tuple[int, float | None, float | None, dict[str, float]]]:
    """(test, auroc, accuracy, gains) by boosted trees, ``parallel`` tests at a time."""
    met, counted = forests.cells(rows, features, forests.bin_ends(rows, features, KEYS))
    if counted:  # a cell is a row of codes, its count the weight
        codes = F.array(*[F.conv(F.hex(F.substring("codes", i + 1, 1)), 16, 10).cast("double") for i in range(len(features))])
        matrix = met.select("test", "real", "fold", array_to_vector(codes).alias("x"), F.col("n").cast("double").alias("n")).coalesce(8).persist()
        groups = matrix.groupBy("test", "fold").agg(F.collect_set("real").alias("sides")).collect()
    else:
        held = with_flags(rows, features).persist()
        groups = held.groupBy("test", "fold").agg(F.count("*").alias("n"), F.collect_set("real").alias("sides")).collect()
        filled = Pipeline(stages=prepare(features)).fit(held).transform(held).select(*KEYS, "test", "real", "fold", "x")
        matrix = _by_fold(filled, len(groups), max((g["n"] for g in groups), default=1)).withColumn("n", F.lit(1.0)).persist()
        matrix.count()
        held.unpersist()
    names = sorted({g["test"] for g in groups})
    learner = GBTClassifier(featuresCol="x", labelCol="real", weightCol="n", maxIter=trees, maxDepth=3, maxBins=2 * forests.BINS if counted else 32, seed=seed)

    def run(i: int) -> tuple[int, float | None, float | None, dict[str, float]]:
        own, scored, gains = matrix.where(F.col("test") == i), [], dict.fromkeys(features, 0.0)
        for k in range(folds):
            if len({x for g in groups if g["test"] == i and g["fold"] != k for x in g["sides"]}) < 2:
                continue  # nothing to tell apart
            model = learner.fit(own.where(F.col("fold") != k))
            scored.append(model.transform(own.where(F.col("fold") == k)).select("real", "n", vector_to_array("probability")[1].alias("p")))
            for f, g in gain(model, features).items():
                gains[f] += g
        if not scored:
            return i, None, None, gains
        # scores of equal value are counted together, so only distinct ones are ordered
        out = reduce(DataFrame.unionByName, scored).groupBy("p").agg(F.sum(F.col("real") * F.col("n")).alias("pos"), F.sum((1 - F.col("real")) * F.col("n")).alias("neg")).persist()
        area = auroc_of_counts(out, "p").first()["auroc"]
        right = out.agg(F.try_divide(F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))), F.sum(F.col("pos") + F.col("neg")))).first()[0]
        out.unpersist()
        return i, area, right, gains

    with ThreadPool(parallel) as pool:
        found = pool.map(run, names)
    matrix.unpersist()
    return found


def gain(model, features: Sequence[str], flags: Sequence[str] | None = None) -> dict[str, float]:
    """Each feature's share of the loss that the splits of a tree model remove, its flag of missing values included."""
    each, names = model.featureImportances.toArray(), [*features, *(features if flags is None else flags)]
    return {f: float(sum(x for x, name in zip(each, names, strict=False) if name == f)) for f in features}


def two_sample(real: DataFrame, drawn: DataFrame, features: Sequence[str], folds: int = 5, trees: int = 20, seed: int = 42) -> DataFrame:
    """One test: (auroc, accuracy)."""
    side = lambda df, label: df.select(*KEYS, *features, F.lit(0).alias("test"), F.lit(label).alias("real"))
    return two_sample_tests(side(real, 1).unionByName(side(drawn, 0)), features, folds, trees, seed)[0].drop("test")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(feature, loss, gain): the loss of AUROC when the feature's values are dealt anew among the rows, and its gain in the fit.

    Rows are put in a random order once; a feature's values come from as many places further on as its name says. So
    all features are dealt by one join, scored in one pass, and their AUROCs are groups of one aggregate.
    """
    from .ranks import ordinal

    order = ordinal(df.select(*keys, label, *features).withColumn("__u", uniform("deal", *keys)), "__u", keys).drop("__u", "rank").persist()
    n = order.count()
    steps = {f: 1 + zlib.crc32(f.encode()) % max(1, n - 1) for f in features}
    asked = F.array(F.struct(F.lit("").alias("feature"), F.lit(0).alias("step")), *[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("step")) for f, s in steps.items()])
    rows = order.select("*", F.inline(asked)).withColumn("__from", (F.col("row") + F.col("step") - 1) % F.lit(n) + 1)
    values = order.select(F.col("row").alias("__from"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("__value")) for f in features])))
    dealt = rows.join(values, ["__from", "feature"], "left").withColumns({f: F.when(F.col("feature") == f, F.col("__value")).otherwise(F.col(f)) for f in features})
    found = {r["feature"]: r["auroc"] for r in auroc(predict(model, dealt.select("feature", label, *features), features), "p", label, ["feature"]).collect()}
    order.unpersist()
    base, shares = found.get(""), gain(model.stages[-1], features, [c.removesuffix("_missing") for c in model.stages[-2].getInputCols()[len(features) :]]) if hasattr(model.stages[-1], "featureImportances") else {}
    loss = lambda f: None if base is None or found.get(f) is None else base - found[f]
    return df.sparkSession.createDataFrame([(f, loss(f), shares.get(f)) for f in features], "feature string, loss double, gain double")


def constant_predictions(df: DataFrame, label: str = "detected") -> DataFrame:
    """One row: the rate of targets without partner, and the shares f0 to f3 of the outcomes of pairs."""
    from .pairs import branch, pairs

    rate = branch(df).where("branch = 'independent'").agg(F.avg(label).alias("rate"))
    score = 2 * F.col(f"{label}_a") + F.col(f"{label}_b")
    shares = pairs(df, [label], symmetric=True).agg(*[F.avg((score == i).cast("int")).alias(f"f{i}") for i in range(4)])
    return rate.withColumns({name: F.lit(value) for name, value in shares.first().asDict().items()})


def fit_pair_network(train: DataFrame, features: Sequence[str], label: str, classes: int, hidden: int = 64, steps: int = 60, seed: int = 42) -> PipelineModel:
    """A network of two hidden layers over all outcomes of a pair."""
    network = MultilayerPerceptronClassifier(featuresCol="x", labelCol=label, layers=[2 * len(features), hidden, hidden, classes], maxIter=steps, seed=seed)
    return Pipeline(stages=[*prepare(features, True), network]).fit(with_flags(train, features))


def predict_classes(model: PipelineModel, df: DataFrame, features: Sequence[str], classes: int, prefix: str = "p") -> DataFrame:
    """Adds the probability of every class; 0 for classes beyond those that training had."""
    p = vector_to_array("probability")
    return model.transform(with_flags(df, features)).select(*df.columns, *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(classes)])


def fit_regimes(train: DataFrame, features: Sequence[str], label: str, classes: int, folds: int = 5, trees: int = 20) -> tuple[list[PipelineModel], list[float]]:
    """The folds' forests, and the biases that calibrate them, from rows that each forest has not seen."""
    fitted, scored = cross_fit(train, features, label, classes, folds, trees)
    held = scored.select("raw", label).persist()
    try:
        return fitted, fit_bias(held, "raw", label, classes)
    finally:
        held.unpersist()


def predict_regimes(fitted: tuple[list[PipelineModel], list[float]], df: DataFrame, features: Sequence[str], classes: int, prefix: str = "p") -> DataFrame:
    """Adds the average of the calibrated probabilities of all forests."""
    forests, bias = fitted
    out = df
    for k, forest in enumerate(forests):
        raw = forest.transform(with_flags(out, features)).select(*out.columns, log_probabilities(classes).alias("__raw"))
        out = raw.withColumn(f"__p{k}", F.array(*biased("__raw", bias))).drop("__raw")
    mean = lambda i: sum((F.col(f"__p{k}")[i] for k in range(1, len(forests))), F.col("__p0")[i]) / len(forests)
    return out.select(*df.columns, *[mean(i).alias(f"{prefix}{i}") for i in range(classes)])
