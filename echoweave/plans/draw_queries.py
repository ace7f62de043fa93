"""Queries of the operators that draw errors or fit models, beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed_random import uniform
from ..operators import draws, models, pairs, scores
from ..operators import features as ft
from ..schemas import KEYS, LEVELS, PAIR_FEATURES
from ..sources.sets import pair_set
from .queries import _E, _GRID, _K, FEATURES, _feature_table, _query, _r, _stored, _targets

_U = "{U(concat_ws('|',scenario_id,drop_id,target_id);%s)}"
_ORDER = "scenario_id, drop_id, target_id"
_REGIME = "case when range_error_m between -0.52 and 0.82 then 0 when range_error_m between 1.40 and 1.85 then 1 when range_error_m between -2.25 and -1.55 then 2 when range_error_m > 1.85 then 3 when range_error_m < -2.25 then 4 else 5 end"


@_query(f"""with b as (select e.*, bistatic_range_m x, range_error_m y from fx_error e join fx_target using ({_ORDER}) where range_error_m between -0.52 and 0.82 and not (bistatic_range_m < 110 and abs(range_error_m) < 0.03)),
 f as (select regr_slope(y,x) s, regr_intercept(y,x) i from b),
 r as (select y-(i+s*x) residual, row_number() over (order by y-(i+s*x), {_ORDER})-1 k, count(*) over () n from b, f)
 select {_K}, round(i+s*bistatic_range_m+residual,6) sampled_error from (select *, {_U % 'bulk'} u from fx_target) t, f, (select max(n) n from r) m, r where r.k = floor(u*m.n)""")
def sample_bulk(t) -> DataFrame:
    rows = t("fx_error").where("range_error_m between -0.52 and 0.82").join(t("fx_target"), list(KEYS))
    fit = models.bulk_fit(rows, "bistatic_range_m", "range_error_m").first()
    used = rows.where("not (bistatic_range_m < 110 and abs(range_error_m) < 0.03)").withColumn("residual", F.col("range_error_m") - (F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("bistatic_range_m")))
    return draws.bulk_draws(t("fx_target"), fit["slope"], fit["intercept"], draws.empirical(used, "residual"), uniform("bulk", *KEYS)).select(*KEYS, "sampled_error")


def _others(t) -> DataFrame:
    rows = t("fx_error").where("range_error_m is not null").join(t("fx_target"), list(KEYS))
    return rows.select(*KEYS, F.col("range_error_m").alias("error"), F.col("nearest_neighbor_norm_range_sep").alias("nn_norm_range_sep"), ft.regime(F.col("range_error_m")).alias("region")).where("region <> 0")


@_query(f"""with e as (select x.scenario_id, x.drop_id, x.target_id, range_error_m error, coalesce(nearest_neighbor_norm_range_sep,1e18) nn, {_REGIME} region from fx_error x join fx_target using ({_ORDER}) where range_error_m is not null),
 f as (select q, max(nn) b from (select nn, ntile(5) over (order by nn, {_ORDER}) q from e where region=3) a where q<5 group by q),
 s as (select *, region*10 + case when region=3 then (select count(*) from f where b < e.nn) else 0 end stratum, {_U % 'other'} u, 2*{_U % 'jitter'}-1 j from e where region<>0),
 p as (select stratum, error picked, row_number() over (partition by stratum order by error, {_ORDER})-1 k, count(*) over (partition by stratum) n from s),
 d as (select s.*, picked, picked+j*(case region when 1 then 0.03 when 2 then 0.06 when 4 then 0.15 else 0.03 end) m from s join (select distinct stratum, n from p) z on s.stratum=z.stratum join p on p.stratum=s.stratum and p.k=floor(u*z.n))
 select {_K}, round((case when region=3 then picked when case region when 1 then m between 1.40 and 1.85 when 2 then m between -2.25 and -1.55 when 4 then m<=-2.25 else case when picked>=0.82 then m<=1.40 else m>=-1.55 end end then m else 2*picked-m end)::double,6) sampled_error from d""")
def sample_nonbulk(t) -> DataFrame:
    rows = _others(t)
    breaks = draws.neighbour_breaks(rows)
    table = draws.empirical(rows.withColumn("stratum", draws.stratum(F.col("region"), F.col("nn_norm_range_sep"), breaks)), "error", ["stratum"])
    return draws.other_draws(rows.drop("error"), table, breaks, uniform("other", *KEYS), uniform("jitter", *KEYS)).select(*KEYS, "sampled_error")


def _slip_sql(a: str) -> str:
    u = {w: _U % f"slip_{w}_{a}" for w in ("hit", "toward", "size", "coin")}
    edge = f"case when frac_{a}=0 then case when {u['coin']}<0.5 then -1 else 1 end else sign(frac_{a}) end"
    size = f"(1+({u['size']}>=0.933e0)::int+({u['size']}>=0.933e0+0.043e0)::int+({u['size']}>=0.933e0+0.043e0+0.015e0)::int)"
    return f"case when {u['hit']}<0.3 then {size}*({edge})*(case when {u['toward']}<0.935 then 1 else -1 end) else 0 end"


_FRAC = f"(select *, 32*u_true-round_even(32*u_true,0) frac_u, 32*v_true-round_even(32*v_true,0) frac_v from {_GRID}) h"
_DRAWN = f"(select *, {_slip_sql('u')} su, {_slip_sql('v')} sv from {_FRAC}) s"


@_query(f"""select {_K}, su::bigint drawn_slip_u, sv::bigint drawn_slip_v, {_r('az_est-rx_azimuth_deg+180-360*floor((az_est-rx_azimuth_deg+180)/360)-180 az_err', 'el_est-rx_elevation_deg el_err')} from (
 select *, 30+degrees(asin(greatest(-1e0,least(1e0,ue/greatest(cos(asin(ve)),1e-9))))) az_est, degrees(asin(ve)) el_est from (
  select *, (32*u_true-frac_u+su)/32 ue, greatest(-1e0,least(1e0,(32*v_true-frac_v+sv)/32)) ve from {_DRAWN}) a) b""")
def sample_angles(t) -> DataFrame:
    grid = ft.angle_grid(_targets(t))
    return draws.angle_draws(grid, F.lit(0.3), F.lit(0.3)).select(*KEYS, "drawn_slip_u", "drawn_slip_v", "az_err", "el_err")


_Z = [f"sqrt(-2*ln(1-{_U % f'gauss{i}1'}))*cos(2*pi()*{_U % f'gauss{i}2'}) z{i}" for i in range(3)]
_COV = ", ".join(f"covar_samp({_E[i]},{_E[j]}) c{i}{j}" for i in range(3) for j in range(3) if i <= j)


@_query(f"""with m as (select avg({_E[0]}) m0, avg({_E[1]}) m1, avg({_E[2]}) m2, {_COV} from fx_error where range_error_m is not null),
 a as (select *, sqrt(c00) l00, c01/sqrt(c00) l10, c02/sqrt(c00) l20 from m), b as (select *, sqrt(c11-l10*l10) l11 from a), c as (select *, (c12-l20*l10)/l11 l21 from b), d as (select *, sqrt(c22-l20*l20-l21*l21) l22 from c)
 select {_K}, {_r('m0+l00*z0 e0', 'm1+l10*z0+l11*z1 e1', 'm2+l20*z0+l21*z1+l22*z2 e2')} from (select *, {', '.join(_Z)} from fx_error where range_error_m is not null) x, d""")
def sample_gaussian(t) -> DataFrame:
    fit = models.gaussian_fit(t("fx_error"), _E).first()
    covariance = [[fit[f"cov_{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)]
    found = t("fx_error").where("range_error_m is not null").select(*KEYS)
    return draws.gaussian_draws(found, [fit[f"mean_{i}"] or 0.0 for i in range(3)], covariance, ["e0", "e1", "e2"])


@_query("""with c as (select p, sum(detected)::double a, sum(1-detected)::double b, count(*)::double l from fx_pred group by p),
 r as (select *, sum(a) over w - a/2 ma, sum(b) over w - b/2 mb, sum(l) over w - l/2 h, sum(a) over () na, sum(b) over () nb, sum(l) over () n from c window w as (order by p))
 select round((max(n)-1)/max(n)*sum(l/n/(h*(n-h)-n*l/4)*(pow(n*ma-na*h,2)/na+pow(n*mb-nb*h,2)/nb)),6) statistic from r where l<n""")
def anderson_darling(t) -> DataFrame:
    return scores.anderson_darling(t("fx_pred"), "p", "detected")


_MEMBERS = "(select scenario_id, drop_id, target_id, draw m, value z from fx_draws union all select distinct scenario_id, drop_id, target_id, -1, range_error_m from fx_draws)"


@_query(f"""with r as (select m, z, row_number() over (partition by m order by z, {_ORDER}) i from {_MEMBERS} v), d as (select a.m, sum(abs(a.z-b.z))/(select count(*) from r where m=-1)/(select count(distinct m)-1 from r) d from r a join r b on a.i=b.i group by a.m)
 select round(max(d) filter (m=-1),6) observed, round((1.0+count(*) filter (m<>-1 and d >= (select d from d where m=-1)))/(1+count(*) filter (m<>-1)),6)::double p from d""")
def w1_null(t) -> DataFrame:
    drawn = t("fx_draws")
    real = drawn.where("draw = 0").select(*KEYS, F.lit(-1).cast("long").alias("m"), F.col("range_error_m").alias("z"))
    members = drawn.select(*KEYS, F.col("draw").cast("long").alias("m"), F.col("value").alias("z")).unionByName(real)
    return scores.wasserstein_null(members, "z", "m", -1)


@_query(f"""select {_K}, axis, {_r('ln(0.5-f+1e-3) edge', "exp(-coalesce(nearest_neighbor_norm_range_sep,(select max(nearest_neighbor_norm_range_sep) from fx_target))/5.0) as_close")}, (slip<>0)::bigint slipped from (
 select *, 'u' axis, abs(32*u_true-round_even(32*u_true,0)) f, round_even(32*u_coord,0)-round_even(32*u_true,0) slip from {_GRID} union all
 select *, 'v', abs(32*v_true-round_even(32*v_true,0)), round_even(32*v_coord,0)-round_even(32*v_true,0) from {_GRID}) y""")
def slip_rows(t) -> DataFrame:
    rows = ft.angle_grid(ft.neighbours(_targets(t))).withColumn("rss_max", F.lit(0.0))
    farthest = rows.agg(F.max("nn_norm_range_sep")).first()[0] or 0.0
    return models.slip_features(rows, farthest).select(*KEYS, "axis", "edge", F.col("close").alias("as_close"), "slipped")


@_query()
def clopper_pearson(t) -> DataFrame:
    return scores.rate_bounds(t("fx_pred"), "nn_norm_range_sep", "p", "detected", 10)


@_query()
def score_table(t) -> DataFrame:
    own = t("fx_pred")
    both = own.withColumn("model", F.lit("given")).unionByName(own.withColumn("model", F.lit("shrunk")).withColumn("p", 0.25 + F.col("p") / 2))
    return scores.score_table(both, "p", "detected")


@_query()
def pair_model(t) -> DataFrame:
    """Held-out pairs, by models that stop on scenes that are neither fitted nor held out."""
    rows = _stored(pair_set(_feature_table(t)).withColumns({"held_out": pairs.is_held_out(), "__validation": pairs.is_validation()}))
    features = PAIR_FEATURES
    fitted = models.fit_outcomes(rows.where("not held_out"), features, "score", 4, 20, validation="__validation")
    return models.predict_outcomes(fitted, rows.where("held_out and target_id_a < target_id_b"), features).select("scenario_id", "drop_id", "target_id_a", "target_id_b", "score", "p0", "p1", "p2", "p3")


@_query()
def regime_model(t) -> DataFrame:
    rows = _stored(_feature_table(t).where("range_error_m is not null").withColumn("region", ft.regime(F.col("range_error_m"))).select(*KEYS, "region", *FEATURES))
    _, scored = models.cross_fit(rows, FEATURES, "region", 6)
    scored = _stored(scored.select(*KEYS, "region", "raw"))
    bias = models.fit_bias(scored, "raw", "region", 6)
    return scored.select(*KEYS, "region", *[p.alias(f"p{i}") for i, p in enumerate(models.biased("raw", bias))])


@_query()
def slip_model(t) -> DataFrame:
    rows = _stored(_feature_table(t).withColumn("held_out", pairs.is_held_out()).select(*KEYS, "held_out", "log_R", "rss_max", "nn_norm_range_sep", "abs_frac_u", "abs_frac_v", "slip_u", "slip_v"))
    farthest = rows.where("not held_out").agg(F.max("nn_norm_range_sep")).first()[0] or 0.0
    sides = models.slip_features(rows, farthest)
    whether, size = models.fit_slip(sides.where("not held_out"))
    found = models.predict(whether, sides.where("held_out"), ("edge", "close", "rss"), "p_slip")
    return models.predict(size, found, ("log_R", "rss_max"), "p_one_cell").select(*KEYS, "axis", "p_slip", "p_one_cell")


@_query()
def quantile_forest(t) -> DataFrame:
    levels = LEVELS
    rows = _feature_table(t).where("range_error_m is not null").withColumn("size", F.ln(F.abs("range_error_m") + 1e-6)).withColumn("held_out", pairs.is_held_out()).select(*KEYS, "size", "held_out", *FEATURES)
    rows = _stored(rows)
    model, leaves = models.fit_quantiles(rows.where("not held_out"), FEATURES, "size", levels)
    found = models.predict_quantiles(model, leaves, rows.where("held_out"), FEATURES, KEYS, len(levels))
    return found.select(*KEYS, *[F.col("q")[i].alias(f"q{i + 1}") for i in range(len(levels))], draws.quantile_draws(levels, F.col("q"), uniform("quantile", *KEYS)).alias("drawn"))


@_query()
def two_sample_classifier(t) -> DataFrame:
    error = _stored(t("fx_draws").where("draw = 0").join(t("fx_target").select(*KEYS, "bistatic_range_m"), list(KEYS)))
    side = lambda c: error.select(*KEYS, "bistatic_range_m", F.col(c).alias("error"))
    return models.two_sample(side("range_error_m"), side("value"), ("bistatic_range_m", "error"))
