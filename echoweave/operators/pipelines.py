"""Models made of models: both branches of detection, the range error, the 3D error, and their two-sample tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed_random import categorical, hashed, uniform
from ..schemas import INDEP_FEATURES, KEYS, PAIR_FEATURES, POSITION_FEATURES, SCENE
from ..sources.sets import independent_set, pair_set
from . import draws, forests, models
from .features import position_error, regime
from .pairs import fold, is_validation, reassemble


def points(df: DataFrame, joint: DataFrame, p: str, joint_p: Sequence[str]) -> DataFrame:
    """Adds ``p_point``, the marginal of the pair's joint for rows that have one and ``p`` for others, and ``mutual``."""
    both = joint.select(*SCENE, "target_id_a", "target_id_b", (F.col(joint_p[2]) + F.col(joint_p[3])).alias("m_a"), (F.col(joint_p[1]) + F.col(joint_p[3])).alias("m_b"))
    none = df.select(*KEYS, F.lit(None).cast("double").alias("m")).limit(0)
    return reassemble(df, none, both, "m").withColumns({"p_point": F.coalesce("m", p), "mutual": F.col("m").isNotNull()}).drop("m")


@dataclass
class Branches:
    single: PipelineModel
    outcomes: list[PipelineModel]


def fit_branches(train: DataFrame, trees: int = 10, stop_early: bool = False) -> Branches:
    """Detection of single targets, and the joint outcome of pairs, from the table of features.

    ``stop_early``: a tenth of the scenes is held back, and each model stops when it no longer gains on them.
    """
    single, paired, held = independent_set(train), pair_set(train), None
    if stop_early:
        held = "__validation"
        single, paired = single.withColumn(held, is_validation()), paired.withColumn(held, is_validation())
    return Branches(models.fit_detection(single, INDEP_FEATURES, validation=held), models.fit_outcomes(paired, PAIR_FEATURES, "score", 4, trees, validation=held))


def draw_branches(model: Branches, df: DataFrame, seed: int = 42) -> DataFrame:
    """(KEYS, branch, p, drawn) of every target that is alone or in a pair."""
    alone = models.predict(model.single, independent_set(df), INDEP_FEATURES).select(*KEYS, F.lit("independent").alias("branch"), "p", (uniform("det", *KEYS, seed=seed) < F.col("p")).cast("int").alias("drawn"))
    joint = models.predict_outcomes(model.outcomes, pair_set(df, symmetric=False), PAIR_FEATURES)
    outcome = categorical([F.col(f"p{i}") for i in range(4)], uniform("pair", *SCENE, "target_id_a", seed=seed))
    joint = joint.withColumn("outcome", outcome)
    sides = F.array(
        F.struct(F.col("target_id_a").alias("target_id"), (F.col("p2") + F.col("p3")).alias("p"), F.floor(F.col("outcome") / 2).cast("int").alias("drawn")),
        F.struct(F.col("target_id_b").alias("target_id"), (F.col("p1") + F.col("p3")).alias("p"), (F.col("outcome") % 2).cast("int").alias("drawn")),
    )
    paired = joint.select(*SCENE, F.inline(sides)).select(*KEYS, F.lit("mutual").alias("branch"), "p", "drawn")
    return alone.unionByName(paired)


@dataclass
class Range:
    slope: float
    intercept: float
    residuals: DataFrame
    others: DataFrame
    breaks: list[float]


def fit_range(train: DataFrame, distance: str = "bistatic_range_m", error: str = "range_error_m", separation: str = "nn_norm_range_sep") -> Range:
    """Trend and residuals of the bulk, and the errors of the other regimes by stratum."""
    rows = train.select(*KEYS, distance, F.col(error).alias("error"), separation, regime(F.col(error)).alias("region"))
    bulk = rows.where("region = 0")
    fit = models.bulk_fit(bulk, distance, "error").first()
    slope, intercept = fit["slope"] or 0.0, fit["intercept"] or 0.0
    used = bulk.where(~((F.col(distance) < 110) & (F.abs("error") < 0.03))).withColumn("residual", F.col("error") - (F.lit(intercept) + F.lit(slope) * F.col(distance)))
    rest = rows.where("region <> 0")
    breaks = draws.neighbour_breaks(rest)
    placed = rest.withColumn("stratum", draws.stratum(F.col("region"), F.col(separation), breaks))
    return Range(slope, intercept, draws.empirical(used, "residual"), draws.empirical(placed, "error", ["stratum"]), breaks)


def range_draws(df: DataFrame, model: Range, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``sampled_error``: of the bulk where ``region`` is 0, else of the row's regime.

    Both tables are one, whose stratum 0 is the bulk, so a row meets its value in one join. What is known of the row
    before (its trend, its jitter) is one number.
    """
    values = [table.select(stratum.cast("int").alias("__stratum"), "k", "size", F.col(c).alias("__picked")) for table, stratum, c in ((model.residuals, F.lit(0), "residual"), (model.others, F.col("stratum"), "error"))]
    bulk, regime_ = F.col("region") == 0, F.floor(F.col("__stratum") / 10)
    own = F.when(bulk, F.lit(model.intercept) + F.lit(model.slope) * F.col("bistatic_range_m")).otherwise(uniform("jitter", *keys))
    placed = df.withColumns({"__stratum": draws.stratum(F.col("region"), F.col("nn_norm_range_sep"), model.breaks).cast("int"), "__own": own})
    met = draws.pick(placed, values[0].unionByName(values[1]), F.when(bulk, uniform("bulk", *keys)).otherwise(uniform("other", *keys)), ["__stratum"], few=True)
    moved = F.when(regime_ == 3, F.col("__picked")).otherwise(draws.jittered(F.col("__picked"), regime_, F.col("__own")))
    return met.withColumn("sampled_error", F.when(regime_ == 0, F.col("__own") + F.col("__picked")).otherwise(moved)).drop("__stratum", "__own", "__picked")


def position_draws(df: DataFrame, range_error: str, p_u: Column, p_v: Column, magnitudes: Sequence[Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds angle errors from slips and the 3D error; half of the bistatic range error lies on the way to the receiver."""
    angled = draws.angle_draws(df, p_u, p_v, magnitudes, keys).withColumn("__one_way", F.col(range_error) / 2)
    return position_error(angled, "__one_way", "az_err", "el_err", "rx_target_distance_m", "rx_elevation_deg").drop("__one_way")


@dataclass
class Angles:
    slip: PipelineModel
    size: PipelineModel
    farthest: float


def fit_angles(train: DataFrame) -> Angles:
    """Chance and size of slips along both axes of the grid."""
    farthest = train.agg(F.max("nn_norm_range_sep")).first()[0] or 0.0
    return Angles(*models.fit_slip(models.slip_features(train, farthest)), farthest)


@dataclass
class Position:
    regimes: tuple[list[PipelineModel], list[float]]
    ranges: Range
    slip: PipelineModel
    size: PipelineModel
    farthest: float


def fit_position(train: DataFrame, folds: int = 5, trees: int = 20) -> Position:
    """All parts of the 3D error, from rows of the table of features with errors and ``region``."""
    angles = fit_angles(train)
    return Position(models.fit_regimes(train, POSITION_FEATURES, "region", 6, folds, trees), fit_range(train), angles.slip, angles.size, angles.farthest)


#: Folds of scenes of a two-sample test.
FOLDS = 5
#: What a draw is told by.
DRAW_KEYS = (*KEYS, "draw")


def _slips(model: Angles | Position, df: DataFrame) -> DataFrame:
    """(KEYS, p_slip_u, p_slip_v, s1 to s4) of each row."""
    sides = models.predict(model.slip, models.slip_features(df, model.farthest), ("edge", "close", "rss"), "p_slip")
    sides = models.predict_classes(model.size, sides, ("log_R", "rss_max"), 5, "s")
    return sides.groupBy(*KEYS).agg(*[F.max(F.when(F.col("axis") == a, F.col("p_slip"))).alias(f"p_slip_{a}") for a in "uv"], *[F.first(f"s{i}").alias(f"s{i}") for i in range(1, 5)])


def tiled_ranges(model: Position, scored: DataFrame, n: int) -> DataFrame:
    """``n`` range errors of rows that have the chances ``p0`` to ``p5`` of their regimes."""
    drawn = draws.tiled(scored, n).withColumn("region", categorical([F.col(f"p{i}") for i in range(6)], uniform("regime", *DRAW_KEYS)))
    return range_draws(drawn, model.ranges, DRAW_KEYS)


def draw_ranges(model: Position, df: DataFrame, n: int) -> DataFrame:
    """``n`` range errors of each row: the chances of its regimes once, then every draw by its number."""
    return tiled_ranges(model, models.predict_regimes(model.regimes, df.drop("region"), POSITION_FEATURES, 6), n)


def draw_angles(model: Angles | Position | None, df: DataFrame, n: int) -> DataFrame:
    """``n`` pairs of angle errors of each row; without a model nothing slips: only what the grid does, the same in every draw."""
    if model is None:
        return draws.angle_draws(draws.tiled(df, n), F.lit(0.0), F.lit(0.0), keys=DRAW_KEYS)
    tiled = draws.tiled(df.join(_slips(model, df), list(KEYS)), n)
    return draws.angle_draws(tiled, F.col("p_slip_u"), F.col("p_slip_v"), [F.col(f"s{i}") for i in range(1, 5)], DRAW_KEYS)


def draw_position(model: Position, df: DataFrame, n: int) -> DataFrame:
    """``n`` draws of each row: probabilities once, then every draw by its number. Range and angle errors are those of :func:`draw_ranges` and :func:`draw_angles`."""
    scored = models.predict_regimes(model.regimes, df.drop("region"), POSITION_FEATURES, 6)
    drawn = tiled_ranges(model, scored.join(_slips(model, df), list(KEYS)), n)
    return position_draws(drawn, "sampled_error", F.col("p_slip_u"), F.col("p_slip_v"), [F.col(f"s{i}") for i in range(1, 5)], DRAW_KEYS)


def detection_two_sample(df: DataFrame, p: str, label: str, features: Sequence[str], nulls: int = 20) -> DataFrame:
    """AUROC of a classifier that tells (features, own and partner's outcome) of true detections from drawn ones.

    ``df`` has ``partner_id``. One row: the test, the mean of ``nulls`` tests of draws against draws, and p.
    """
    # features are cut into bins once for a target, so that its samples meet in cells where they are drawn
    ends = forests.bin_ends(df, features, KEYS)
    own = forests.coded(df.withColumn("fold", fold(FOLDS)), features, ends, [*KEYS, "partner_id", label, p, "fold"])
    partner = df.select(*SCENE, F.col("target_id").alias("partner_id"), F.col(label).alias("__y"), F.col(p).alias("__p"))
    # number -1 is what was seen; every draw of a target is the same whether it is met as itself or as a partner
    numbered = own.join(partner, [*SCENE, "partner_id"], "left").withColumn("number", F.explode(F.sequence(F.lit(-1), F.lit(2 * nulls))))
    hit = lambda y, chance, target: F.when(F.col("number") < 0, F.col(y)).otherwise((hashed("c2st", *SCENE, target, "number") < F.col(chance)).cast("int"))
    outcomes = numbered.select("fold", "codes", hit(label, p, "target_id").alias("outcome"), F.when(F.col("__p").isNotNull(), hit("__y", "__p", "partner_id")).alias("partner_outcome"), *_places(F.col("number")))
    met = outcomes.groupBy("test", "fold", F.col("real").cast("int").alias("real"), "codes", "outcome", "partner_outcome").agg(F.count("*").alias("n"))
    code = lambda c: F.when(F.col(c).isNull(), F.unhex(F.lit("00"))).when(F.col(c) == 0, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("02")))
    cells = met.select("test", "fold", "real", F.concat("codes", code("outcome"), code("partner_outcome")).alias("codes"), "n")
    return _against_null(*models.forest_tests(cells, True, (*features, "outcome", "partner_outcome"), FOLDS))


def _places(number: Column) -> list[Column]:
    """Test and side of a sample: -1 (real) and 0 are the first test, 1 and 2 the first null, and so on."""
    return [F.floor((number + 1) / 2).cast("int").alias("test"), (F.pmod(number, F.lit(2)) == 1).cast("int").alias("real")]


def draws_two_sample(drawn: DataFrame, rows: DataFrame, features: Sequence[str], nulls: int) -> DataFrame:
    """The same for errors: draw 0 against the real ones (``real``), draws (1, 2), (3, 4), ... against each other."""
    kept = drawn.where(F.col("draw") <= 2 * nulls).select(*KEYS, F.col("draw").cast("int").alias("number"), F.col("value").alias("error"))
    kept = kept.unionByName(drawn.where("draw = 0").select(*KEYS, F.lit(-1).alias("number"), F.col("real").alias("error")))
    tested = kept.join(rows.select(*KEYS, *features), list(KEYS)).select(*KEYS, *features, "error", *_places(F.col("number")))
    return _against_null(*models.two_sample_tests(tested, (*features, "error"), FOLDS, kind="forest"))


def _against_null(results: DataFrame, gains: DataFrame) -> DataFrame:
    """Test 0 against the others, the nulls: their mean, largest and 95 % quantile, p, and the feature with the largest gain."""
    first, null = F.col("test") == 0, F.when(F.col("test") > 0, F.col("auroc"))
    row = results.agg(F.max(F.when(first, F.col("auroc"))).alias("auroc"), F.max(F.when(first, F.col("accuracy"))).alias("accuracy"), F.avg(null).alias("null_mean"), F.max(null).alias("null_max"), F.percentile(null, F.lit(0.95)).alias("null_95"), F.collect_list(null).alias("null"))
    top = gains.where(first).agg(F.max_by("feature", F.struct("gain", "feature")).alias("top_feature"))
    p = (1 + F.size(F.filter("null", lambda x: x >= F.col("auroc")))) / (1 + F.size("null"))
    return row.withColumn("p_value", p).drop("null").crossJoin(F.broadcast(top))  # one row each
