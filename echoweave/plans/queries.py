"""The engine's operators over the derived tables, each with its statement for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_random import categorical, uniform
from ..operators import features as ft
from ..operators import models, pairs, scores
from ..operators.ranks import release
from ..schemas import INDEP_FEATURES, KEYS, POSITION_FEATURES, POSITION_LABELS, REGIMES, SCENE, union
from ..sources.raw import clean_detections
from .fixtures import oracle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FEATURES = INDEP_FEATURES


def _rounded(df: DataFrame) -> DataFrame:
    """Floating-point columns to six places: sums of doubles differ in their last digits between engines."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "boolean") else F.col(c) for c, t in df.dtypes])


def _query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()  # copies that the query before kept
            return _rounded(f(lambda name: table(spark, sf_dir, name)))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return register


def _r(*terms: str) -> str:
    """``expression name`` each, rounded."""
    return ", ".join(f"round(({t.rsplit(' ', 1)[0]})::double, 6)+0e0 {t.rsplit(' ', 1)[1]}" for t in terms)


_K = "scenario_id::bigint scenario_id, drop_id::bigint drop_id, target_id::bigint target_id"
_TD = "(select t.*, d.estimated_bistatic_range_m, d.estimated_rx_azimuth_deg, d.estimated_rx_elevation_deg from fx_target t left join fx_detection d on t.scenario_id = d.scenario_id and t.drop_id = d.drop_id and t.target_id = d.associated_target_id) x"


def _targets(t) -> DataFrame:
    found = clean_detections(t("fx_detection")).drop("err")
    return t("fx_target").join(found, list(KEYS), "left")


@_query(f"""select {_K}, {_r('estimated_bistatic_range_m-bistatic_range_m range_err_bi', 'ln(rx_target_distance_m) log_R', '2*target_v_x_ms*target_v_x_ms speed', 'rx_azimuth_deg-30 az_off_boresight',
 'abs(bistatic_doppler_hz) abs_bistatic_doppler_hz', 'log10(tx_target_distance_m*rx_target_distance_m) log_range_product', '-20*log10(tx_target_distance_m)-20*log10(rx_target_distance_m) path_loss_proxy',
 'sqrt(greatest(0, target_v_x_ms*target_v_x_ms+target_v_y_ms*target_v_y_ms+target_v_z_ms*target_v_z_ms-radial_velocity*radial_velocity)) tangential_velocity')} from {_TD}""")
def geometry_features(t) -> DataFrame:
    return ft.geometry(_targets(t)).select(*KEYS, "range_err_bi", "log_R", "speed", "az_off_boresight", "abs_bistatic_doppler_hz", "log_range_product", "path_loss_proxy", "tangential_velocity")


@_query(f"""select {_K}, {_r('nearest_neighbor_xyz_distance_m nn_dist', 'abs(nearest_neighbor_bistatic_range_sep_m) nn_range_sep', 'abs(nearest_neighbor_rx_az_sep_deg) nn_az_sep',
 'abs(nearest_neighbor_rx_el_sep_deg) nn_el_sep', 'nearest_neighbor_norm_range_sep nn_norm_range_sep', 'nearest_neighbor_norm_rx_angle_sep nn_norm_ang_sep')}, num_targets_in_sample::bigint n_targets from fx_target""")
def neighbour_features(t) -> DataFrame:
    return ft.neighbours(t("fx_target")).select(*KEYS, "nn_dist", "nn_range_sep", "nn_az_sep", "nn_el_sep", "nn_norm_range_sep", "nn_norm_ang_sep", "n_targets")


_UV = "cos(radians({e}))*sin(radians({a}-30))", "sin(radians({e}))"
_GRID = f"""(select *, {_UV[0].format(a='rx_azimuth_deg', e='rx_elevation_deg')} u_true, {_UV[1].format(e='rx_elevation_deg')} v_true,
 {_UV[0].format(a='estimated_rx_azimuth_deg', e='estimated_rx_elevation_deg')} u_coord, {_UV[1].format(e='estimated_rx_elevation_deg')} v_coord from {_TD}) g"""


_GRID_COLUMNS = ("u_true", "v_true", "u_coord", "v_coord", "ku_true", "kv_true", "ku_est", "kv_est", "frac_u", "frac_v", "slip_u", "slip_v", "abs_frac_u", "abs_frac_v")


@_query(f"select {_K}, {_r(*[f'{c} {c}' for c in _GRID_COLUMNS])} from fx_features")
def angle_grid(t) -> DataFrame:
    return ft.angle_grid(_targets(t)).select(*KEYS, *_GRID_COLUMNS)


@_query(f"select {_K}, case when range_error_m between -0.52 and 0.82 then 0 when range_error_m between 1.40 and 1.85 then 1 when range_error_m between -2.25 and -1.55 then 2 when range_error_m > 1.85 then 3 when range_error_m < -2.25 then 4 else 5 end::bigint region, ['bulk','sideband+','sideband-','far+','far-','near'][case when range_error_m between -0.52 and 0.82 then 1 when range_error_m between 1.40 and 1.85 then 2 when range_error_m between -2.25 and -1.55 then 3 when range_error_m > 1.85 then 4 when range_error_m < -2.25 then 5 else 6 end] region_txt from fx_error")
def regime_label(t) -> DataFrame:
    names = F.array(*[F.lit(x) for x in REGIMES])
    return t("fx_error").withColumn("region", ft.regime(F.col("range_error_m"))).select(*KEYS, "region", F.element_at(names, F.col("region") + 1).alias("region_txt"))


_FAR = "(r+range_error_m)", "(e+radians(rx_elevation_error_deg))", "radians(rx_azimuth_error_deg)"


@_query(f"""select {_K}, {_r('range_error_m err_along', f'r*cos(e)*{_FAR[2]} err_cross_h', 'r*radians(rx_elevation_error_deg) err_cross_v',
 f'sqrt(pow({_FAR[0]}*cos({_FAR[1]})*cos({_FAR[2]})-r*cos(e),2)+pow({_FAR[0]}*cos({_FAR[1]})*sin({_FAR[2]}),2)+pow({_FAR[0]}*sin({_FAR[1]})-r*sin(e),2)) err_3d', f'sqrt(pow(range_error_m,2)+pow(r*cos(e)*{_FAR[2]},2)+pow(r*radians(rx_elevation_error_deg),2)) err_3d_approx')}
 from (select x.*, rx_target_distance_m r, radians(rx_elevation_deg) e from fx_error x join fx_target using (scenario_id, drop_id, target_id) where range_error_m is not null) y""")
def position_error_3d(t) -> DataFrame:
    joined = t("fx_error").where("range_error_m is not null").join(t("fx_target"), list(KEYS))
    out = ft.position_error(joined, "range_error_m", "rx_azimuth_error_deg", "rx_elevation_error_deg", "rx_target_distance_m", "rx_elevation_deg")
    return out.select(*KEYS, "err_along", "err_cross_h", "err_cross_v", "err_3d", "err_3d_approx")


_MULTIPATH = (
    "rss_max", "rss_min", "rss_mean", "rss_std", "rss_total_db", "delay_min", "delay_max", "delay_spread_raw", "aoa_std", "zoa_std", "dom_delay", "dom_zoa", "aoa_mean_circ", "dom_aoa_offset", "dom_aoa_sin", "dom_aoa_cos",
    "dom_excess_delay", "first_rss_minus_dom", "mean_delay_w", "rms_delay_spread", "aoa_spread_w", "zoa_spread_w", "k_factor_db",
)


@_query(f"select {_K}, n_mpc, {_r(*[f'{c} {c}' for c in _MULTIPATH])}, n_mpc_dropped from fx_mp")
def multipath_features(t) -> DataFrame:
    return ft.multipath(t("fx_snr")).select(*KEYS, "n_mpc", *_MULTIPATH, "n_mpc_dropped")


def _feature_table(t) -> DataFrame:
    error = t("fx_error").select(*KEYS, "position_error_x_m", "position_error_3d_m", "range_error_m", "rx_azimuth_error_deg", "rx_elevation_error_deg")
    joined = _targets(t).join(error, list(KEYS), "left").join(ft.multipath(t("fx_snr")), list(KEYS), "left")
    return ft.angle_grid(ft.neighbours(ft.geometry(joined))).withColumn("detected", F.col("position_error_x_m").isNotNull().cast("int"))


def _folder(spark: SparkSession) -> str:
    """A new path in the folder that all machines share; where none is named and all runs on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/component-{uuid.uuid4().hex}"


def _stored(df: DataFrame) -> DataFrame:
    """Written once and read again: each pass of a fit would otherwise derive the table of features anew.

    Spark deletes the shuffle files of a finished job when the driver's collector finds it gone, which may take half an
    hour; they are as large as the table, so the collector is called.
    """
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLE = union(INDEP_FEATURES, POSITION_FEATURES, POSITION_LABELS, _MULTIPATH)


def _typed(*names: str) -> str:
    return ", ".join(f"{c}::bigint {c}" if c in ("n_mpc", "n_targets", "detected", "detected_a", "detected_b", "score") or c.startswith("n_mpc") or c.startswith("n_targets") else _r(f"{c} {c}") for c in names)


@_query(f"select {_K}, detected::bigint detected, {_typed(*_TABLE)} from fx_features")
def feature_table(t) -> DataFrame:
    return _feature_table(t).select(*KEYS, "detected", *_TABLE)


@_query(f"select {_K}, case when g=2 then 'mutual' when g=1 then 'independent' else 'ambiguous' end branch from (select *, count(*) over (partition by scenario_id, drop_id, nn_norm_range_sep) g from fx_pred) x")
def mutual_split(t) -> DataFrame:
    return pairs.branch(t("fx_pred")).select(*KEYS, "branch")


_PAIRS = "(select a.scenario_id, a.drop_id, a.target_id target_id_a, b.target_id target_id_b, a.p p_a, b.p p_b, a.detected detected_a, b.detected detected_b from g a join g b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id and a.nn_norm_range_sep=b.nn_norm_range_sep where a.target_id {op} b.target_id and a.n=2 and b.n=2)"
_G = "(select *, count(*) over (partition by scenario_id, drop_id, nn_norm_range_sep) n from fx_pred)"
_PK = "scenario_id::bigint scenario_id, drop_id::bigint drop_id, target_id_a::bigint target_id_a, target_id_b::bigint target_id_b"


@_query(f"select {_PK}, (2*detected_a+detected_b)::bigint score from {_PAIRS.format(op='<>').replace(' g ', f' {_G} ')} x")
def pair_features(t) -> DataFrame:
    return pairs.pairs(t("fx_pred"), ["detected"], symmetric=True).select(*SCENE, "target_id_a", "target_id_b", (2 * F.col("detected_a") + F.col("detected_b")).alias("score"))


@_query(f"select {_PK}, {_r('(1-p_a)*(1-p_b) p0', '(1-p_a)*p_b p1', 'p_a*(1-p_b) p2', 'p_a*p_b p3')} from {_PAIRS.format(op='<').replace(' g ', f' {_G} ')} x")
def independent_joint(t) -> DataFrame:
    a, b = F.col("p_a"), F.col("p_b")
    return pairs.pairs(t("fx_pred"), ["p"]).select(*SCENE, "target_id_a", "target_id_b", ((1 - a) * (1 - b)).alias("p0"), ((1 - a) * b).alias("p1"), (a * (1 - b)).alias("p2"), (a * b).alias("p3"))


@_query(f"select {_K}, round(p, 6) p_back from {_G} x where n <= 2 and not (n = 2 and nn_norm_range_sep is null)")
def reassemble(t) -> DataFrame:
    own = t("fx_pred")
    alone = pairs.branch(own).where("branch = 'independent'").withColumnRenamed("p", "p_back")
    both = pairs.pairs(own.withColumnRenamed("p", "p_back"), ["p_back"])
    return pairs.reassemble(own.select(*KEYS), alone, both, "p_back").where("p_back is not null")


@_query(f"select scenario_id::bigint scenario_id, drop_id::bigint drop_id, target_id_a::bigint target_id, target_id_b::bigint partner_id from {_PAIRS.format(op='<>').replace(' g ', f' {_G} ')} x")
def partner_outcome(t) -> DataFrame:
    return pairs.partners(pairs.pairs(t("fx_pred"), ["detected"])).drop("slot")


@_query("select distinct scenario_id::bigint scenario_id, drop_id::bigint drop_id, (substr(md5(concat_ws('|','split',scenario_id,drop_id)),1,8) < '33333333')::bigint held_out from fx_geo")
def scene_split(t) -> DataFrame:
    return t("fx_geo").select(*SCENE, pairs.is_held_out().alias("held_out")).distinct()


@_query(f"select {_K}, (substr(md5(concat_ws('|','split',scenario_id,drop_id,target_id)),1,8) < '33333333')::bigint held_out from fx_geo")
def row_split(t) -> DataFrame:
    return t("fx_geo").select(*KEYS, pairs.is_held_out(KEYS).alias("held_out"))


@_query("select distinct scenario_id::bigint scenario_id, drop_id::bigint drop_id, ('0x'||substr(md5(concat_ws('|','fold',scenario_id,drop_id)),1,8))::bigint % 5 fold from fx_geo")
def scene_folds(t) -> DataFrame:
    return t("fx_geo").select(*SCENE, pairs.fold(5).alias("fold")).distinct()


@_query("select round(avg(pow(p-detected,2)),6) brier from fx_pred")
def brier(t) -> DataFrame:
    return scores.brier(t("fx_pred"), "p", "detected")


@_query("select round(avg(pow(p0-(score=0)::int,2)+pow(p1-(score=1)::int,2)+pow(p2-(score=2)::int,2)+pow(p3-(score=3)::int,2)),6) brier from fx_pair_pred")
def brier_joint(t) -> DataFrame:
    return scores.brier_joint(t("fx_pair_pred"), ["p0", "p1", "p2", "p3"], "score")


@_query("select round(sum((detected-p)*(1-2*p))/sqrt(sum(pow(1-2*p,2)*p*(1-p))),6) z from fx_pred")
def spiegelhalter(t) -> DataFrame:
    return scores.spiegelhalter(t("fx_pred"), "p", "detected")


@_query("select round(threshold::double,6) threshold, detected::bigint as label, (p>=threshold)::bigint predicted, count(*) n from fx_pred, (select unnest([0.3e0,0.5e0,0.7e0]) threshold) h group by all")
def confusion(t) -> DataFrame:
    return scores.confusion(t("fx_pred"), "p", "detected", [0.3, 0.5, 0.7])


@_query("select score::bigint score, count(*) n from fx_pair_pred group by all")
def class_histogram(t) -> DataFrame:
    return t("fx_pair_pred").groupBy("score").agg(F.count("*").alias("n"))


@_query("select least(floor((p-0)/0.05),19)::bigint bin, count(*) n from fx_pred group by all")
def histogram(t) -> DataFrame:
    return scores.histogram(t("fx_pred"), "p", 0.0, 1.0, 20)


_BIN = "(select *, case when r0 < round_even(b*n/15.0,0) then b-1 when r0 >= round_even((b+1)*n/15.0,0) then b+1 else b end bin from (select *, floor(r0*15/n) b from (select *, {r} - 1 r0, count(*) over () n from fx_pred) x) y) z"
_EDGES, _TIES = (_BIN.format(r=f"{f} over (order by {o})") for f, o in (("row_number()", "p, scenario_id, drop_id, target_id"), ("rank()", "p")))
_TILE = "(select *, ntile(15) over (order by p, scenario_id, drop_id, target_id) - 1 bin from fx_pred) z"


@_query(f"select round(sum(abs(sp-sy))/sum(n),6) ece from (select bin, sum(p) sp, sum(detected) sy, count(*) n from {_EDGES} group by all) b")
def ece(t) -> DataFrame:
    return scores.ece(t("fx_pred"), "p", "detected", 15)


@_query(f"select bin::bigint bin, count(*) n, {_r('avg(p) mean_p', 'avg(detected) rate')} from {_TILE} group by all")
def reliability(t) -> DataFrame:
    return scores.calibration_bins(t("fx_pred"), "p", "detected", 15, "tile")


_TAIL8 = "exp(-x/2)*(1+x/2+pow(x/2,2)/2+pow(x/2,3)/6)"
_TAIL10 = "exp(-x/2)*(1+x/2+pow(x/2,2)/2+pow(x/2,3)/6+pow(x/2,4)/24)"


@_query(f"select {_r('x statistic', f'{_TAIL8} p_value')} from (select sum(n*(y-m)*(y-m)/(m*(1-m))) x from (select bin, avg(p) m, avg(detected) y, count(*) n from {_TILE.replace('ntile(15)', 'ntile(10)')} group by all) b) c")
def hosmer_lemeshow_stat(t) -> DataFrame:
    return scores.hosmer_lemeshow(t("fx_pred"), "p", "detected", 10)


@_query(f"select {_r('sum(n*(m-y)*(m-y))/sum(n) reliability', 'sum(n*(y-o)*(y-o))/sum(n) resolution', 'max(o*(1-o)) uncertainty', 'sum(n*(m-y)*(m-y))/sum(n)-sum(n*(y-o)*(y-o))/sum(n)+max(o*(1-o)) reconstructed')} from (select bin, avg(p) m, avg(detected) y, count(*) n, (select avg(detected) from fx_pred) o from {_TIES} group by all) b")
def murphy(t) -> DataFrame:
    return scores.murphy(t("fx_pred"), "p", "detected", 15)


@_query("select bin::bigint bin, count(*) n, round((sum(detected)-sum(p))/sqrt(sum(p*(1-p))),6) z from (select *, ntile(10) over (order by nn_norm_range_sep, scenario_id, drop_id, target_id) - 1 bin from fx_pred where nn_norm_range_sep is not null) z group by all")
def chi2_slices(t) -> DataFrame:
    return scores.slice_chi2(t("fx_pred"), "nn_norm_range_sep", "p", "detected", 10)


_U = "select round((sum(case when detected=1 then k end) - a*(a+1)/2)/(a*b), 6) auroc from (select *, rank() over (order by p) + (count(*) over (partition by p) - 1)/2.0 k, sum(detected) over ()::double a, sum(1-detected) over ()::double b from fx_pred) x group by a, b"


@_query(_U)
def auroc(t) -> DataFrame:
    return scores.auroc(t("fx_pred"), "p", "detected")


@_query("select round(threshold,6) threshold, round(f1,6) f1 from (select p threshold, 2*tp/(called+total) f1 from (select distinct p, sum(detected) over (order by p desc)::double tp, count(*) over (order by p desc) called, (select sum(detected) from fx_pred) total from fx_pred) x) y order by round(2*0+f1,9) desc, threshold limit 1")
def best_f1(t) -> DataFrame:
    return scores.best_f1(t("fx_pred"), "p", "detected")


@_query("""with k as (select max(abs(a-b)) ks, max(n) n, max(m) m from (select sum(detected) over (order by p)::double/sum(detected) over () a, sum(1-detected) over (order by p)::double/sum(1-detected) over () b, sum(detected) over ()::double n, sum(1-detected) over ()::double m from fx_pred) x)
 select round(ks,6) ks, round(greatest(0e0,least(1e0,(select sum((case when i%2=1 then 2e0 else -2e0 end)*exp(-2e0*i*i*ks*ks*n*m/(n+m))) from (select unnest(range(1,101)) i) s))),6) p_value from k""")
def ks_2samp(t) -> DataFrame:
    return scores.ks_two_sample(t("fx_pred"), "p", "detected")


@_query(f"select {_K}, ({{U(concat_ws('|',scenario_id,drop_id,target_id);det2)}} < p)::bigint drawn from fx_pred")
def sample_bernoulli(t) -> DataFrame:
    return t("fx_pred").select(*KEYS, (uniform("det2", *KEYS) < F.col("p")).cast("int").alias("drawn"))


@_query(f"select {_PK}, ((p0 <= u)::int + (p0+p1 <= u)::int + (p0+p1+p2 <= u)::int)::bigint drawn from (select *, {{U(concat_ws('|',scenario_id,drop_id,target_id_a);cat)}} u from fx_pair_pred) x")
def sample_categorical(t) -> DataFrame:
    drawn = categorical([F.col(f"p{i}") for i in range(4)], uniform("cat", *SCENE, "target_id_a"))
    return t("fx_pair_pred").select(*SCENE, "target_id_a", "target_id_b", drawn.alias("drawn"))


@_query("with v as (select range_error_m x, 1.0 r, 0.0 d from fx_error where range_error_m is not null union all select value, 0, 1 from fx_draws), c as (select x, sum(r) r, sum(d) d from v group by x), w as (select x, lead(x) over (order by x) nx, sum(r) over (order by x)/(sum(r) over ()) f, sum(d) over (order by x)/(sum(d) over ()) g from c) select round(sum(abs(f-g)*(nx-x)),6) w1 from w")
def w1(t) -> DataFrame:
    return scores.wasserstein(t("fx_error").where("range_error_m is not null").select(F.col("range_error_m").alias("value")), t("fx_draws"))


@_query(f"select {_K}, round(avg(abs(value-range_error_m)) - sum((2*i-m-1)*value)/max(m*(m-1)),6) crps from (select *, row_number() over (partition by scenario_id, drop_id, target_id order by value) i, count(*) over (partition by scenario_id, drop_id, target_id) m from fx_draws) x group by all")
def crps(t) -> DataFrame:
    return scores.crps(t("fx_draws"), "range_error_m")


@_query(f"select {_r('regr_slope(range_error_m, bistatic_range_m) slope', 'regr_intercept(range_error_m, bistatic_range_m) intercept')}, count(*) n from fx_error join fx_target using (scenario_id, drop_id, target_id) where range_error_m between -0.52 and 0.82 and not (bistatic_range_m < 110 and abs(range_error_m) < 0.03)")
def bulk_fit(t) -> DataFrame:
    return models.bulk_fit(t("fx_error").where("range_error_m between -0.52 and 0.82").join(t("fx_target"), list(KEYS)), "bistatic_range_m", "range_error_m")


_E = ("range_error_m", "rx_azimuth_error_deg", "rx_elevation_error_deg")


@_query("select " + _r(*[f"avg({c}) mean_{i}" for i, c in enumerate(_E)], *[f"covar_samp({a}, {b}) cov_{i}{j}" for i, a in enumerate(_E) for j, b in enumerate(_E) if i <= j]) + " from fx_error where range_error_m is not null")
def gaussian_error_fit(t) -> DataFrame:
    return models.gaussian_fit(t("fx_error"), _E)


@_query()
def mc_null_ece(t) -> DataFrame:
    return scores.null_ece(t("fx_pred"), "p", "detected", 15, 1000)


def _fitted(t, kind: str) -> DataFrame:
    """Held-out rows; the trees stop on scenes that are neither fitted nor held out."""
    rows = _stored(_feature_table(t).select(*KEYS, "detected", *FEATURES).withColumns({"held_out": pairs.is_held_out(), "__validation": pairs.is_validation()}))
    model = models.fit_detection(rows.where("not held_out"), FEATURES, kind=kind, validation="__validation", rounds=30)
    return models.predict(model, rows.where("held_out"), FEATURES).select(*KEYS, "detected", "p")


@_query()
def detection_model(t) -> DataFrame:
    return _fitted(t, "trees")


@_query()
def mlp_baseline(t) -> DataFrame:
    return _fitted(t, "network")

