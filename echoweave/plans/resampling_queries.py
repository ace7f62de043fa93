"""Queries of intervals and permutations; DuckDB makes the same draws from their definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resampling as rs
from ..operators import scores
from ..schemas import KEYS, SCENE
from .evaluation_queries import _MODELS, _POINTS, _points, _two_models
from .queries import _query, _r, _stored


def _mixed(rows: str, size: str) -> str:
    """``rows(base, i, ...)`` with ``slot``: the mixed number below ``size``."""
    out = f"select *, (base + i * 2654435769) & 4294967295 x from {rows}"
    for _ in range(2):
        out = f"select * exclude (x), (xor(x >> 16, x) * 73244475) & 4294967295 x from ({out}) z"
    return f"(select *, (xor(x >> 16, x) * {size}) >> 32 slot from ({out}) z)"


def _weights(table: str, replicates: int, size: int = 512) -> str:
    """Tables up to ``w(scenario_id, drop_id, b, w)``: how often each replicate draws a scene; replicate -1 has all scenes once."""
    base = lambda stage, key: f"('0x'||substr(md5(concat_ws('|', '42', 'resample{stage}', {key})), 1, 8))::bigint"
    return f"""sc as materialized (select scenario_id, drop_id, row_number() over (order by drop_id, scenario_id) - 1 j, count(*) over () g from (select distinct scenario_id, drop_id from {table}) x),
 h1 as materialized (select b, slot // {size} s, count(*) m, max(g) g from {_mixed(f"(select b, {base(1, 'b, 0')} base, unnest(range((select max(g) from sc))) i, (select max(g) from sc) g from range({replicates}) r(b)) y", "g")} v group by 1, 2),
 w as materialized (select scenario_id, drop_id, b, n w from (select b, s * {size} + slot j, count(*) n from {_mixed(f"(select b, s, {base(2, 'b, s')} base, unnest(range(m)) i, least({size}, g - s * {size}) size from h1) y", "size")} v group by 1, 2) u join sc using (j)
  union all select scenario_id, drop_id, -1, 1 from sc)"""


_BOUNDS = "quantile_cont({x}, 0.025) filter (b >= 0) low, quantile_cont({x}, 0.975) filter (b >= 0) high"


@_query(f"with {_weights('fx_pred', 1000)}, m as (select b, sum(w * (p - detected) * (p - detected)) / sum(w) m from fx_pred join w using (scenario_id, drop_id) group by b) select round(quantile_cont(m, 0.025) filter (b >= 0), 6) low, round(quantile_cont(m, 0.975) filter (b >= 0), 6) high from m")
def scene_bootstrap(t) -> DataFrame:
    """The interval of a mean in 1000 replicates."""
    return scores.scene_bootstrap(t("fx_pred").withColumn("loss", (F.col("p") - F.col("detected")) ** 2), "loss", 1000)


@_query(f"""with {_weights('fx_pred', 100)}, pt as materialized (select x.*, k.kind model, case k.kind when 'given' then p_point else 0.25e0 + p_point / 2 end q from {_POINTS} x, (values ('given'), ('shrunk')) k(kind)),
 v as materialized (select *, case when mutual = 1 then 'mutual' else 'non_mutual' end branch from pt union all select *, 'pooled' from pt),
 t as materialized (select model, branch, b, q, sum(w)::double n, sum(w * detected)::double pos, sum(w * (q - detected) * (q - detected)) e from v join w using (scenario_id, drop_id) group by 1, 2, 3, 4),
 c as (select *, sum(n) over o - n r0, sum(n - pos) over o - (n - pos) below, sum(n) over g m, sum(pos) over g k from t window o as (partition by model, branch, b order by q), g as (partition by model, branch, b)),
 d as (select *, floor(r0 * 15 / m) f from c), f as (select *, case when r0 < round_even(f * m / 15.0, 0) then f - 1 when r0 >= round_even((f + 1) * m / 15.0, 0) then f + 1 else f end bin from d),
 h as (select model, branch, b, bin, sum(n) n, sum(n * q) sp, sum(pos) sy, max(m) m, max(k) k, sum(e) e, sum(pos * (below + (n - pos) / 2)) u from f group by 1, 2, 3, 4),
 s as (select model, branch, b, sum(e) / max(m) brier, sum(pow(sp - sy, 2) / n) / max(m) reliability, sum(sy * sy / n) / max(m) - pow(max(k) / max(m), 2) resolution, max(k) / max(m) * (1 - max(k) / max(m)) uncertainty, case when max(k) > 0 and max(k) < max(m) then sum(u) / (max(k) * (max(m) - max(k))) end auroc from h group by 1, 2, 3),
 l as (unpivot s on brier, reliability, resolution, uncertainty, auroc into name metric value x),
 jp as (select y.*, k.kind model, case k.kind when 'given' then 0e0 else 0.125e0 end a, case k.kind when 'given' then 1e0 else 0.5e0 end m from fx_pair_pred y, (values ('given'), ('shrunk')) k(kind)),
 j as (select model, 'mutual' branch, b, 'brier_joint' metric, sum(w * ({' + '.join(f'pow(a + m * p{i} - (score = {i})::int, 2)' for i in range(4))})) / sum(w) x from jp join w using (scenario_id, drop_id) group by 1, 3),
 z as (select model, branch, metric, max(x) filter (b < 0) v, {_BOUNDS.format(x='x')} from (select model, branch, b, metric, x from l union all select model, branch, b, metric, x from j) q group by 1, 2, 3)
 select model, branch, metric, {_r("v value", "low low", "high high")} from z""")
def branch_intervals(t) -> DataFrame:
    """All 16 branch metrics of two models, with intervals from 100 replicates."""
    shrunk = lambda df, columns, a, m: df.withColumn("model", F.lit("given")).unionByName(df.withColumn("model", F.lit("shrunk")).withColumns({c: a + m * F.col(c) for c in columns}))
    outcomes = [f"p{i}" for i in range(4)]
    given = {"fx_pred": _stored(t("fx_pred").select(*KEYS, "p", "detected")), "fx_pair_pred": _stored(t("fx_pair_pred"))}  # derived once, read by every pass
    points = shrunk(_stored(_points(given.__getitem__).select(*SCENE, "p_point", "detected", "mutual")), ["p_point"], 0.25, 0.5)
    joint = shrunk(given["fx_pair_pred"], outcomes, 0.125, 0.5)
    return rs.branch_intervals(points, joint, "p_point", "detected", "mutual", outcomes, "score", 15, rs.Resamples(given["fx_pred"], 100, observed=True), ["model"])


@_query(f"""with {_weights('fx_draws', 50)}, v as materialized (select * from {_MODELS} x),
 c as materialized (select model, scenario_id, drop_id, target_id, max(real) real, avg(abs(v-real)) - sum((2*i-m-1)*v)/max(m*(m-1)) c from (select *, row_number() over (partition by model, scenario_id, drop_id, target_id order by v) i, count(*) over (partition by model, scenario_id, drop_id, target_id) m from v) x group by all),
 e as (select model, b, sum(w * c) / sum(w) crps from c join w using (scenario_id, drop_id) group by 1, 2),
 q as (select model, b, x, sum(r * w)::double r, sum(d * w)::double d from (select model, scenario_id, drop_id, real x, 1 r, 0 d from c union all select model, scenario_id, drop_id, v, 0, 1 from v) y join w using (scenario_id, drop_id) group by 1, 2, 3),
 g as (select model, b, abs(sum(r) over o / sum(r) over p - sum(d) over o / sum(d) over p) * (lead(x) over o - x) a from q window o as (partition by model, b order by x), p as (partition by model, b)),
 s as (select model, b, w1, crps, 1 - crps / base crpss from (select model, b, sum(a) w1 from g group by 1, 2) a join e using (model, b) join (select b, crps base from e where model = 'climatology') k using (b)),
 z as (select model, metric, max(x) filter (b < 0) v, {_BOUNDS.format(x='x')} from (unpivot s on w1, crps, crpss into name metric value x) q group by 1, 2)
 select model, metric, {_r('v value', 'low low', 'high high')} from z""")
def draw_intervals(t) -> DataFrame:
    """W1, CRPS and skill of two models' draws, with intervals from 50 replicates that they share."""
    known = _stored(t("fx_error").where("range_error_m is not null").select(*KEYS, "range_error_m"))  # derived once, read by every pass
    given = {"fx_error": known, "fx_draws": _stored(t("fx_draws").where("draw < 5"))}
    return rs.draw_intervals(_two_models(given.__getitem__), "real", rs.Resamples(given["fx_draws"], 50, observed=True), reference="climatology")


@_query()
def anderson_darling_permuted(t) -> DataFrame:
    """The test with 9999 permutations of the labels."""
    return rs.permuted_anderson_darling(t("fx_pred"), "p", "detected", 9999)
