"""Queries of training sets, evaluation and whole draws, beside those of ``queries`` and ``draw_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keyed_random import categorical, normal, uniform
from ..operators import draws, models, pairs, pipelines, scores
from ..operators import features as ft
from ..operators.ranks import ordinal
from ..schemas import CLASSIFIER, INDEP_FEATURES, INDEPENDENT, KEYS, PAIR_FEATURES, PAIR_OWN, PAIRS, POSITION, POSITION_FEATURES, REGIMES, SCENE, SHARED_FEATURES, union
from ..sources import sets
from .draw_queries import _DRAWN, _ORDER, _REGIME, _U, _others
from .queries import _E, _K, _PK, _TAIL10, _TILE, _feature_table, _query, _r, _stored, _targets, _typed

_G = "(select *, count(*) over (partition by scenario_id, drop_id, nn_norm_range_sep) g from {t})"


@_query(f"select {_K}, {_typed(*INDEPENDENT.features, 'detected')} from {_G.format(t='fx_features')} x where g = 1")
def independent_set(t) -> DataFrame:
    return sets.independent_set(_feature_table(t))


_SIDES = ", ".join(f"{s}.{c} {c}_{s}" for c in ("target_id", "detected", *PAIR_OWN) for s in "ab")


@_query(f"""with w as (select * from {_G.format(t='fx_features')} z where g = 2), j as (select a.scenario_id, a.drop_id, {_SIDES}, {', '.join(f'a.{c}' for c in SHARED_FEATURES)}, 2*a.detected+b.detected score
 from w a join w b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id and a.nn_norm_range_sep=b.nn_norm_range_sep where a.target_id <> b.target_id)
 select {_PK}, {_typed(*PAIR_FEATURES, *PAIRS.labels)} from j""")
def pair_set(t) -> DataFrame:
    return sets.pair_set(_feature_table(t))


@_query(f"select {_K}, {_typed(*POSITION.features, *POSITION.labels)} from fx_features where detected = 1")
def position_set(t) -> DataFrame:
    return sets.position_set(_feature_table(t))


@_query(f"select {_K}, {_typed(*CLASSIFIER.features, 'detected')} from fx_features")
def classifier_set(t) -> DataFrame:
    return sets.classifier_set(_feature_table(t))


@_query(f"select {_K}, (e.position_error_x_m is not null)::bigint as_detected, {_r('range_error_m range_error_m')}, n_mpc from fx_target left join fx_error e using ({_ORDER}) left join fx_mp using ({_ORDER})")
def combined(t) -> DataFrame:
    """Targets with errors and multipath features, without detections."""
    joined = t("fx_target").join(t("fx_error"), list(KEYS), "left").join(ft.multipath(t("fx_snr")), list(KEYS), "left")
    return joined.select(*KEYS, F.col("position_error_x_m").isNotNull().cast("int").alias("as_detected"), "range_error_m", "n_mpc")


@_query(f"select {_K}, detected::bigint detected, {_r(*[f'case when detected=1 then {c} end {c}' for c in _E])} from fx_pred left join fx_error using ({_ORDER})")
def baseline_labels(t) -> DataFrame:
    joined = t("fx_pred").select(*KEYS, "detected").join(t("fx_error").select(*KEYS, *_E), list(KEYS), "left")
    return joined.select(*KEYS, "detected", *[F.when(F.col("detected") == 1, F.col(c)).alias(c) for c in _E])


_SLOTS = f"(select a.scenario_id, a.drop_id, a.target_id, b.target_id partner_id, (a.target_id > b.target_id)::int slot from {_G.format(t='fx_pred')} a join fx_pred b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id and a.nn_norm_range_sep=b.nn_norm_range_sep and a.target_id<>b.target_id where g=2)"


@_query(f"select {_K}, partner_id::bigint partner_id, coalesce(slot,-1)::bigint slot from fx_pred left join {_SLOTS} s using ({_ORDER})")
def branch_codes(t) -> DataFrame:
    return t("fx_pred").select(*KEYS).join(pairs.partners(pairs.pairs(t("fx_pred"), [])), list(KEYS), "left").select(*KEYS, "partner_id", F.coalesce("slot", F.lit(-1)).alias("slot"))


_POINTS = f"""(select x.*, coalesce(q.m, x.p) p_point, (q.m is not null)::int mutual from fx_pred x left join (
 select scenario_id, drop_id, target_id_a target_id, p2+p3 m from fx_pair_pred union all select scenario_id, drop_id, target_id_b, p1+p3 from fx_pair_pred) q using ({_ORDER}))"""


def _points(t) -> DataFrame:
    """Points with their marginals: of the pair's joint where they have a partner, else of the model for single targets."""
    return pipelines.points(t("fx_pred"), t("fx_pair_pred"), "p", [f"p{i}" for i in range(4)])


# pairs that share a target with no other pair
_APART = """(select * from (select *, count(*) over (partition by scenario_id, drop_id, target_id_a) + count(*) over (partition by scenario_id, drop_id, target_id_b) c from fx_pair_pred) z where c = 2
 and not exists (select 1 from fx_pair_pred o where o.scenario_id = z.scenario_id and o.drop_id = z.drop_id and (o.target_id_a = z.target_id_b or o.target_id_b = z.target_id_a)))"""


def _null_pairs_sql(n: int) -> str:
    key = "concat_ws('|', scenario_id, drop_id, {t}, sim)"
    u_pair, u_row = (f"{{U({key.format(t=t)};{salt})}}" for t, salt in (("target_id_a, target_id_b", "null pair"), ("target_id", "null")))
    return f"""with q as (select * from {_APART} x),
 m as (select scenario_id, drop_id, target_id_a target_id, p2+p3 m from q union all select scenario_id, drop_id, target_id_b, p1+p3 from q),
 o as (select f.scenario_id, f.drop_id, f.target_id, f.detected, coalesce(m.m, f.p) v, m.m is not null paired from fx_pred f left join m using ({_ORDER})),
 r as (select *, row_number() over (order by v, {_ORDER}) - 1 r0, count(*) over () n from o), g as (select *, floor(r0*15/n) b from r),
 l as (select *, case when r0 < round_even(b*n/15.0,0) then b-1 when r0 >= round_even((b+1)*n/15.0,0) then b+1 else b end bin from g),
 s as (select draw sim from {{SEQ({n})}} z),
 d as (select q.*, sim, {u_pair} u from q, s), k as (select *, (p0<=u)::int+(p0+p1<=u)::int+(p0+p1+p2<=u)::int k from d),
 h as (select scenario_id, drop_id, target_id_a target_id, sim, (k>=2)::int hit from k union all select scenario_id, drop_id, target_id_b, sim, k%2 from k
  union all select scenario_id, drop_id, target_id, sim, ({u_row} < v)::int from l, s where not paired
  union all select scenario_id, drop_id, target_id, -1, detected from l),
 e as (select sim, sum(d)/max(n) ece from (select sim, bin, abs(sum(v)-sum(hit)) d, max(n) n from h join l using ({_ORDER}) group by sim, bin) w group by sim),
 f as (select max(ece) filter (sim = -1) observed from e)
 select {_r('max(observed) observed', 'avg(ece) filter (sim >= 0) null_mean', f'(1+count(*) filter (sim >= 0 and ece >= observed))/({n}+1e0) p_value')} from e, f"""


@_query(_null_pairs_sql(20))
def mc_null_ece_pairs(t) -> DataFrame:
    """Replicates of both rows of a pair come from one draw of the pair's joint."""
    names = [f"p{i}" for i in range(4)]
    ends = t("fx_pair_pred").withColumn("target_id", F.explode(F.array("target_id_a", "target_id_b"))).withColumn("c", F.count("*").over(W.partitionBy(*KEYS)))
    joint = ends.groupBy(*SCENE, "target_id_a", "target_id_b", *names).agg(F.max("c").alias("c")).where("c = 1").drop("c")
    return scores.null_ece(pipelines.points(t("fx_pred"), joint, "p", names), "p_point", "detected", 15, 20, joint=joint, joint_p=names)


@_query(f"select {_K}, {_r('p_point p_point')}, detected::bigint detected, mutual::bigint mutual from {_POINTS} x")
def evaluation_points(t) -> DataFrame:
    return _points(t).select(*KEYS, "p_point", "detected", F.col("mutual").cast("int").alias("mutual"))


_BRANCHED = f"(select *, case when mutual=1 then 'mutual' else 'non_mutual' end branch from {_POINTS} a union all select *, 'pooled' from {_POINTS} b)"
_METRICS = f"""with v as materialized (select branch, p_point p, detected y from {_BRANCHED} w), n as (select branch, count(*) n, avg(y) o from v group by 1),
 r as (select v.*, n, o, rank() over (partition by branch order by p)-1 r0, rank() over (partition by branch order by p)+(count(*) over (partition by branch, p)-1)/2.0 k from v join n using (branch)),
 c as (select *, floor(r0*15/n) b from r), d as (select *, case when r0 < round_even(b*n/15.0,0) then b-1 when r0 >= round_even((b+1)*n/15.0,0) then b+1 else b end bin from c),
 e as (select branch, bin, count(*) m, avg(p) mp, avg(y) my, max(n) n, max(o) o from d group by 1, 2),
 f as (select branch, sum(m*(mp-my)*(mp-my))/max(n) reliability, sum(m*(my-o)*(my-o))/max(n) resolution, max(o*(1-o)) uncertainty from e group by 1),
 h as (select branch, avg((p-y)*(p-y)) brier, (sum(y*k)-sum(y)*(sum(y)+1)/2)/(sum(y)::double*sum(1-y)) auroc from r group by 1)"""


@_query(f"{_METRICS} select branch, {_r(*[f'{c} {c}' for c in ('brier', 'reliability', 'resolution', 'uncertainty', 'auroc')])} from f join h using (branch)")
def branch_metrics(t) -> DataFrame:
    return scores.branch_metrics(_points(t), "p_point", "detected", "mutual", 15)


@_query(f"{_METRICS}, l as (unpivot (select branch, brier, auroc from f join h using (branch)) on brier, auroc into name metric value v) select metric, max(format('{{:.4f}}', v)) filter (branch='non_mutual') non_mutual, max(format('{{:.4f}}', v)) filter (branch='mutual') mutual, max(format('{{:.4f}}', v)) filter (branch='pooled') pooled from l group by metric")
def branch_report(t) -> DataFrame:
    found = scores.branch_metrics(_points(t), "p_point", "detected", "mutual", 15)
    long = found.select("branch", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("brier", "auroc")])))
    return scores.report(long, "metric", "branch", "value", scores.BRANCHES)


@_query(f"""with c as (select *, ntile(8) over (order by bistatic_range_m, {_ORDER})-1 bin from fx_pred), k as (select *, rank() over (partition by bin order by p)+(count(*) over (partition by bin, p)-1)/2.0 k from c)
 select bin::bigint bin, count(*) n, {_r('avg(bistatic_range_m) f_mid', 'avg((p-detected)*(p-detected)) brier', '(sum(detected*k)-sum(detected)*(sum(detected)+1)/2)/(sum(detected)::double*sum(1-detected)) auroc')} from k group by bin""")
def metric_slices(t) -> DataFrame:
    return scores.slice_metrics(t("fx_pred"), "bistatic_range_m", "p", "detected", 8)


@_query(f"""with w as (select * from {_G.format(t='fx_pred')} z), s as (select 2*a.detected+b.detected s from w a join w b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id and a.nn_norm_range_sep=b.nn_norm_range_sep and a.target_id<>b.target_id where a.g=2)
 select {_r('avg(detected) filter (g=1) rate', *[f'(select avg((s={i})::int) from s) f{i}' for i in range(4)])} from w""")
def constant_predictions(t) -> DataFrame:
    return models.constant_predictions(t("fx_pred"))


@_query(f"select bin::bigint bin, count(*) n, {_r('ln(avg(p)/(1-avg(p))) logit_p', 'ln(greatest(least(avg(detected),1-0.5/count(*)),0.5/count(*))/(1-greatest(least(avg(detected),1-0.5/count(*)),0.5/count(*)))) logit_rate')} from {_TILE} group by all")
def reliability_logits(t) -> DataFrame:
    return scores.reliability_logits(t("fx_pred"), "p", "detected", 15)


@_query(f"select {_r('x statistic', f'{_TAIL10} p_value')} from (select sum(z*z) x from (select (sum(detected)-sum(p))/sqrt(sum(p*(1-p))) z from (select *, ntile(10) over (order by nn_norm_range_sep, {_ORDER}) bin from fx_pred where nn_norm_range_sep is not null) a group by bin) b) c")
def chi2_total(t) -> DataFrame:
    return scores.chi2_total(scores.slice_chi2(t("fx_pred"), "nn_norm_range_sep", "p", "detected", 10), 10)


@_query("select " + _r(*[f"quantile_cont(range_error_m, {q}) q{i}" for i, q in enumerate((0.025, 0.5, 0.975))]) + " from fx_error")
def error_quantiles(t) -> DataFrame:
    return t("fx_error").agg(*[F.percentile("range_error_m", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.025, 0.5, 0.975))])


@_query("select scenario_id::bigint scenario_id, drop_id::bigint drop_id, (row_number() over (order by h, scenario_id, drop_id)-1)%5 fold from (select distinct scenario_id, drop_id, ('0x'||substr(md5(concat_ws('|','fold',scenario_id,drop_id)),1,8))::bigint h from fx_geo) x")
def balanced_folds(t) -> DataFrame:
    return pairs.balanced_folds(t("fx_geo"), 5)


_KD = "{U(concat_ws('|',scenario_id,drop_id,target_id,draw);%s)}"
_FOUND = f"(select scenario_id, drop_id, target_id, range_error_m e, row_number() over (order by range_error_m, {_ORDER})-1 k, count(*) over () n from fx_error where range_error_m is not null)"
_CLIMATE = f"(select d.scenario_id, d.drop_id, d.target_id, d.draw, d.e real, f.e picked from (select x.scenario_id, x.drop_id, x.target_id, draw, range_error_m e, floor({_KD % 'climate'}*(select max(n) from {_FOUND} z)) k from fx_error x, {{SEQ(5)}} s where range_error_m is not null) d join {_FOUND} f on d.k=f.k)"


def _climate(t) -> DataFrame:
    known = t("fx_error").where("range_error_m is not null")
    return draws.climatology(known.select(*KEYS, F.col("range_error_m").alias("real")), draws.empirical(known.select(*KEYS, F.col("range_error_m").alias("value")), "value"), 5)


@_query(f"select {_K}, draw::bigint draw, {_r('picked as_drawn')} from {_CLIMATE} x")
def climatology(t) -> DataFrame:
    return _climate(t).select(*KEYS, "draw", F.col("value").alias("as_drawn"))


@_query(f"with m as (select avg(range_error_m) mu, stddev_pop(range_error_m) sd from fx_error) select {_K}, draw::bigint draw, {_r('mu+sd*z as_drawn')} from (select *, sqrt(-2*ln(1-{_KD % 'plain1'}))*cos(2*pi()*{_KD % 'plain2'}) z from fx_error, {{SEQ(5)}} s where range_error_m is not null) x, m")
def gaussian_draws(t) -> DataFrame:
    known = t("fx_error").where("range_error_m is not null")
    fit = known.agg(F.avg("range_error_m").alias("mu"), F.stddev_pop("range_error_m").alias("sd")).first()
    return draws.tiled(known.select(*KEYS), 5).select(*KEYS, "draw", (F.lit(fit["mu"]) + F.lit(fit["sd"]) * normal("plain", *KEYS, "draw")).alias("as_drawn"))


@_query(f"""select {_K}, {_r('az_est-rx_azimuth_deg+180-360*floor((az_est-rx_azimuth_deg+180)/360)-180 az_err', 'el_est-rx_elevation_deg el_err')} from (
 select *, 30+degrees(asin(greatest(-1e0,least(1e0,ku_true/32/greatest(cos(asin(kv_true/32)),1e-9))))) az_est, degrees(asin(kv_true/32)) el_est from fx_features) a""")
def no_slip_angles(t) -> DataFrame:
    return draws.angle_draws(ft.angle_grid(_targets(t)), F.lit(0.0), F.lit(0.0)).select(*KEYS, "az_err", "el_err")


_PICKED = f"(select t.scenario_id, t.drop_id, t.target_id, f.e/2 d from (select *, floor({_U % 'range3d'}*(select max(n) from {_FOUND} z)) k from fx_target) t join {_FOUND} f on t.k=f.k)"


@_query(f"""select {_K}, {_r('sqrt(pow((r+d)*cos(e+b)*cos(a)-r*cos(e),2)+pow((r+d)*cos(e+b)*sin(a),2)+pow((r+d)*sin(e+b)-r*sin(e),2)) err_3d')} from (
 select *, rx_target_distance_m r, radians(rx_elevation_deg) e, radians(az_est-rx_azimuth_deg+180-360*floor((az_est-rx_azimuth_deg+180)/360)-180) a, radians(el_est-rx_elevation_deg) b from (
 select *, 30+degrees(asin(greatest(-1e0,least(1e0,ue/greatest(cos(asin(ve)),1e-9))))) az_est, degrees(asin(ve)) el_est from (
  select *, (32*u_true-frac_u+su)/32 ue, greatest(-1e0,least(1e0,(32*v_true-frac_v+sv)/32)) ve from {_DRAWN}) x) y join {_PICKED} p using ({_ORDER})) z""")
def position_draws(t) -> DataFrame:
    """One-way range errors picked from those seen, angle errors from slips, both into a 3D error."""
    known = t("fx_error").where("range_error_m is not null").select(*KEYS, F.col("range_error_m").alias("value"))
    rows = draws.pick(ft.angle_grid(_targets(t)), draws.empirical(known, "value"), uniform("range3d", *KEYS))
    return pipelines.position_draws(rows, "value", F.lit(0.3), F.lit(0.3)).select(*KEYS, "err_3d")


_SHARES = (0.7, 0.08, 0.07, 0.06, 0.05, 0.04)


@_query(f"""with b as (select e.*, bistatic_range_m x, range_error_m y from fx_error e join fx_target using ({_ORDER}) where range_error_m between -0.52 and 0.82 and not (bistatic_range_m < 110 and abs(range_error_m) < 0.03)),
 f as (select regr_slope(y,x) s, regr_intercept(y,x) i from b), r as (select y-(i+s*x) residual, row_number() over (order by y-(i+s*x), {_ORDER})-1 k, count(*) over () n from b, f),
 o as (select x.scenario_id, x.drop_id, x.target_id, range_error_m error, coalesce(nearest_neighbor_norm_range_sep,1e18) nn, {_REGIME} region from fx_error x join fx_target using ({_ORDER}) where range_error_m is not null),
 g as (select q, max(nn) b from (select nn, ntile(5) over (order by nn, {_ORDER}) q from o where region=3) a where q<5 group by q),
 p as (select stratum, error picked, row_number() over (partition by stratum order by error, {_ORDER})-1 k, count(*) over (partition by stratum) n from (select *, region*10 + case when region=3 then (select count(*) from g where b < o.nn) else 0 end stratum from o where region<>0) a),
 d as (select *, coalesce(nearest_neighbor_norm_range_sep,1e18) nn, ({' + '.join(f'(u >= {sum(_SHARES[:i + 1])!r}e0)::int' for i in range(5))}) region from (select *, {_U % 'regime'} u, {_U % 'bulk'} ub, {_U % 'other'} uo, 2*{_U % 'jitter'}-1 j from fx_target) a),
 s as (select *, region*10 + case when region=3 then (select count(*) from g where b < d.nn) else 0 end stratum from d),
 w as (select s.*, r.residual, picked, picked+j*(case region when 1 then 0.03 when 2 then 0.06 when 4 then 0.15 else 0.03 end) m from s left join r on r.k = floor(ub*(select max(n) from r)) left join (select distinct stratum, n from p) z on s.stratum=z.stratum left join p on p.stratum=s.stratum and p.k=floor(uo*z.n))
 select {_K}, ['bulk','sideband+','sideband-','far+','far-','near'][region+1] region_txt, round((case when region=0 then i+s*bistatic_range_m+residual when region=3 then picked when case region when 1 then m between 1.40 and 1.85 when 2 then m between -2.25 and -1.55 when 4 then m<=-2.25 else case when picked>=0.82 then m<=1.40 else m>=-1.55 end end then m else 2*picked-m end)::double,6)+0e0 sampled_error from w, f""")
def range_draws(t) -> DataFrame:
    """A regime drawn from fixed shares, then an error of that regime."""
    model = pipelines.fit_range(t("fx_error").where("range_error_m is not null").join(t("fx_target").withColumnRenamed("nearest_neighbor_norm_range_sep", "nn_norm_range_sep"), list(KEYS)))
    rows = t("fx_target").withColumnRenamed("nearest_neighbor_norm_range_sep", "nn_norm_range_sep")
    rows = rows.withColumn("region", categorical([F.lit(x) for x in _SHARES], uniform("regime", *KEYS)))
    names = F.array(*[F.lit(x) for x in REGIMES])
    return pipelines.range_draws(rows, model).select(*KEYS, F.element_at(names, F.col("region") + 1).alias("region_txt"), "sampled_error")


_MODELS = f"(select scenario_id, drop_id, target_id, draw, real, picked v, 'climatology' model from {_CLIMATE} a union all select scenario_id, drop_id, target_id, draw, range_error_m, value, 'uniform' from fx_draws where draw < 5)"


def _two_models(t) -> DataFrame:
    given = t("fx_draws").where("draw < 5").select(*KEYS, "draw", F.col("range_error_m").alias("real"), "value", F.lit("uniform").alias("model"))
    return _climate(t).select(*KEYS, "draw", "real", "value", F.lit("climatology").alias("model")).unionByName(given)


@_query(f"""with v as materialized (select * from {_MODELS} x), c as (select model, {_ORDER}, avg(abs(v-real)) - sum((2*i-m-1)*v)/max(m*(m-1)) c from (select *, row_number() over (partition by model, {_ORDER} order by v) i, count(*) over (partition by model, {_ORDER}) m from v) x group by all),
 q as (select model, x, sum(r) r, sum(d) d from (select distinct model, {_ORDER}, real x, 1.0 r, 0.0 d from v union all select model, {_ORDER}, v, 0, 1 from v) y group by 1, 2),
 w as (select model, x, lead(x) over (partition by model order by x) nx, sum(r) over (partition by model order by x)/(sum(r) over (partition by model)) f, sum(d) over (partition by model order by x)/(sum(d) over (partition by model)) g from q),
 a as (select model, sum(abs(f-g)*(nx-x)) w1 from w group by 1), b as (select model, avg(c) crps from c group by 1)
 select model, {_r('w1 w1', 'crps crps', "1-crps/(select crps from b where model='climatology') crpss")} from a join b using (model)""")
def draw_scores(t) -> DataFrame:
    return scores.draw_scores(_two_models(t), "real", reference="climatology")


@_query(f"""with v as (select d.*, bistatic_range_m from fx_draws d join fx_target using ({_ORDER})), c as (select {_ORDER}, max(range_error_m) real, max(bistatic_range_m) x, avg(abs(value-range_error_m)) - sum((2*i-m-1)*value)/max(m*(m-1)) c from (select *, row_number() over (partition by {_ORDER} order by value) i, count(*) over (partition by {_ORDER}) m from v) z group by all),
 k as (select *, ntile(8) over (order by x, {_ORDER})-1 bin from c), q as (select bin, x, sum(r) r, sum(d) d from (select bin, real x, 1.0 r, 0.0 d from k union all select bin, value, 0, 1 from v join k using ({_ORDER})) y group by 1, 2),
 w as (select bin, x, lead(x) over (partition by bin order by x) nx, sum(r) over (partition by bin order by x)/(sum(r) over (partition by bin)) f, sum(d) over (partition by bin order by x)/(sum(d) over (partition by bin)) g from q), a as (select bin, sum(abs(f-g)*(nx-x)) w1 from w group by 1)
 select bin::bigint bin, count(*) n, {_r('avg(x) f_mid', 'avg(c) crps', 'max(w1) w1')} from k join a using (bin) group by bin""")
def draw_slices(t) -> DataFrame:
    drawn = t("fx_draws").join(t("fx_target").select(*KEYS, "bistatic_range_m"), list(KEYS))
    return scores.draw_slices(drawn, "range_error_m", "bistatic_range_m", 8)


@_query()
def detection_pipeline(t) -> DataFrame:
    """Both branches fitted on the training scenes; probabilities, and a draw on every held-out target with a branch."""
    rows = _stored(_feature_table(t).select(*KEYS, "detected", *INDEP_FEATURES).withColumn("held_out", pairs.is_held_out()))
    model = pipelines.fit_branches(rows.where("not held_out"))
    return pipelines.draw_branches(model, rows.where("held_out"))


@_query()
def pair_network(t) -> DataFrame:
    rows = _stored(sets.pair_set(_feature_table(t)).withColumn("held_out", pairs.is_held_out()))
    model = models.fit_pair_network(rows.where("not held_out"), PAIR_FEATURES, "score", 4)
    found = models.predict_classes(model, rows.where("held_out and target_id_a < target_id_b"), PAIR_FEATURES, 4)
    return found.select(*SCENE, "target_id_a", "target_id_b", "score", *[f"p{i}" for i in range(4)])


#: What regimes, range errors, slips and draws read of the table of features.
_POSITION_READS = union(POSITION_FEATURES, ("bistatic_range_m", "nn_norm_range_sep", "range_error_m", "log_R", "rss_max", "rx_target_distance_m", "rx_azimuth_deg", "rx_elevation_deg"), tuple(f"{c}_{a}" for c in ("slip", "abs_frac", "frac") for a in "uv"), ("u_true", "v_true"))


def _regime_rows(t) -> DataFrame:
    """Rows with errors and their regimes, written once: every fit and the draws read them."""
    rows = _feature_table(t).where("range_error_m is not null").select(*KEYS, *_POSITION_READS)
    return _stored(rows.withColumns({"region": ft.regime(F.col("range_error_m")), "held_out": pairs.is_held_out()}))


@_query()
def regime_ensemble(t) -> DataFrame:
    """Held-out rows by the average of the folds' calibrated probabilities."""
    rows = _regime_rows(t)
    fitted = models.fit_regimes(rows.where("not held_out"), POSITION_FEATURES, "region", 6)
    return models.predict_regimes(fitted, rows.where("held_out"), POSITION_FEATURES, 6).select(*KEYS, "region", *[f"p{i}" for i in range(6)])


@_query()
def position_pipeline(t) -> DataFrame:
    """Regimes, range errors, slips and the 3D error as one model, drawn five times for held-out targets."""
    rows = _regime_rows(t)
    model = pipelines.fit_position(rows.where("not held_out"))
    return pipelines.draw_position(model, rows.where("held_out"), 5).select(*KEYS, "draw", "sampled_error", "az_err", "el_err", "err_3d")


@_query()
def feature_importance(t) -> DataFrame:
    """The five features whose dealing anew costs most AUROC."""
    rows = _stored(_feature_table(t).select(*KEYS, "detected", *INDEP_FEATURES).withColumn("held_out", pairs.is_held_out()))
    model = models.fit_detection(rows.where("not held_out"), INDEP_FEATURES)
    return models.permutation_importance(model, rows.where("held_out"), INDEP_FEATURES, "detected").orderBy(F.desc("loss"), "feature").limit(5)


@_query()
def detection_two_sample(t) -> DataFrame:
    """Drawn against true detections, with the partner's outcome as a feature, and the same of draws against draws."""
    given = {"fx_pred": _stored(t("fx_pred")), "fx_pair_pred": _stored(t("fx_pair_pred"))}  # derived once, read by every pass
    features = ("bistatic_range_m", "nn_norm_range_sep")
    points = _points(given.__getitem__).join(pairs.partners(pairs.pairs(given["fx_pred"], [])), list(KEYS), "left")
    return pipelines.detection_two_sample(_stored(points.select(*KEYS, "partner_id", "detected", "p_point", *features)), "p_point", "detected", features, 20)


@_query()
def error_two_sample(t) -> DataFrame:
    """Draw 0 against the real errors, and the other draws against each other, two by two, as the null."""
    rows = _stored(_feature_table(t).where("range_error_m is not null").select(*KEYS, *POSITION_FEATURES))  # draws are of these alone
    drawn = _stored(t("fx_draws").where("draw <= 4").withColumnRenamed("range_error_m", "real"))
    return pipelines.draws_two_sample(drawn, rows, POSITION_FEATURES, 2)
