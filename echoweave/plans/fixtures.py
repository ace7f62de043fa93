"""Tables of the engine's input shapes, derived from the generic star schema.

The SQL runs on Spark and, with its own functions put in, on DuckDB; see FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_geo": """
select *, degrees(atan2(y,x)) az, degrees(asin((z-10)/r_rx)) el, (x*vx+y*vy+(z-10)*vz)/r_rx v_rad from (
 select *, sqrt(x*x+y*y+(z-10)*(z-10)) r_rx, sqrt((x-50)*(x-50)+y*y+(z-10)*(z-10)) r_tx from (
  select o_custkey%5 scenario_id, o_custkey*4+o_orderkey%4 drop_id, o_orderkey target_id,
   20+180*{U(o_orderkey;x)} x, -20+200*{U(o_orderkey;y)} y, 50*{U(o_orderkey;z)} z,
   -20+40*{U(o_orderkey;vx)} vx, -20+40*{U(o_orderkey;vy)} vy, -5+10*{U(o_orderkey;vz)} vz from orders) a) b""",
    "fx_nn": """
select * from (
 select a.scenario_id, a.drop_id, a.target_id,
  sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) dist,
  abs((a.r_rx+a.r_tx)-(b.r_rx+b.r_tx)) range_sep, abs(a.az-b.az) az_sep, abs(a.el-b.el) el_sep,
  row_number() over(partition by a.scenario_id,a.drop_id,a.target_id
   order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.target_id) rn
 from fx_geo a join fx_geo b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id and a.target_id<>b.target_id) q where rn=1""",
    "fx_target": """
select g.scenario_id, g.drop_id, g.target_id, r_rx+r_tx bistatic_range_m, r_rx rx_target_distance_m, r_tx tx_target_distance_m,
 vx target_v_x_ms, vy target_v_y_ms, vz target_v_z_ms, v_rad radial_velocity, -93.4*v_rad bistatic_doppler_hz,
 az rx_azimuth_deg, el rx_elevation_deg, n.dist nearest_neighbor_xyz_distance_m, n.range_sep nearest_neighbor_bistatic_range_sep_m,
 n.az_sep nearest_neighbor_rx_az_sep_deg, n.el_sep nearest_neighbor_rx_el_sep_deg, n.range_sep/1.5 nearest_neighbor_norm_range_sep,
 sqrt(n.az_sep*n.az_sep+n.el_sep*n.el_sep)/3.58 nearest_neighbor_norm_rx_angle_sep,
 count(*) over(partition by g.scenario_id,g.drop_id) num_targets_in_sample
from fx_geo g left join fx_nn n on g.scenario_id=n.scenario_id and g.drop_id=n.drop_id and g.target_id=n.target_id""",
    "fx_detection": """
select scenario_id, drop_id, case when {U(target_id;fp)}<0.01 then null else cast(target_id as double) end associated_target_id,
 r_rx+r_tx+2*err estimated_bistatic_range_m, err,
 30+degrees(asin(greatest(-1e0,least(1e0,ue/greatest(cos(asin(ve)),1e-9))))) estimated_rx_azimuth_deg, degrees(asin(ve)) estimated_rx_elevation_deg
from (select *, ({RINT(32*cos(radians(el))*sin(radians(az-30)))}+su)/32 ue, greatest(-1e0,least(1e0,({RINT(32*sin(radians(el)))}+sv)/32)) ve from (
 select *, case when {U(target_id;su)}<0.015 then 1 else 0 end su, case when {U(target_id;sv)}<0.015 then -1 else 0 end sv,
  case when q<0.90 then -0.52+1.34*w when q<0.94 then 1.40+0.45*w when q<0.97 then -2.25+0.70*w when q<0.985 then 1.86+20*w
       when q<0.995 then -2.26-15*w else 0.83+0.56*w end err
 from (select *, {U(target_id;reg)} q, {U(target_id;err)} w from fx_geo) a) b) c where {U(target_id;det)}<0.7""",
    "fx_error": """
select g.scenario_id, g.drop_id, g.target_id, d.err range_error_m,
 d.estimated_rx_azimuth_deg-g.az rx_azimuth_error_deg, d.estimated_rx_elevation_deg-g.el rx_elevation_error_deg,
 (g.r_rx+d.err)*cos(radians(d.estimated_rx_elevation_deg))*cos(radians(d.estimated_rx_azimuth_deg))-g.x position_error_x_m,
 sqrt(pow((g.r_rx+d.err)*cos(radians(d.estimated_rx_elevation_deg))*cos(radians(d.estimated_rx_azimuth_deg))-g.x,2)
  +pow((g.r_rx+d.err)*cos(radians(d.estimated_rx_elevation_deg))*sin(radians(d.estimated_rx_azimuth_deg))-g.y,2)
  +pow((g.r_rx+d.err)*sin(radians(d.estimated_rx_elevation_deg))-(g.z-10),2)) position_error_3d_m
from fx_geo g left join fx_detection d on g.scenario_id=d.scenario_id and g.drop_id=d.drop_id and g.target_id=d.associated_target_id""",
    "fx_snr": """
select o_custkey%5 scenario_id, o_custkey*4+o_orderkey%4 drop_id, o_orderkey target_id,
 case when l_quantity=50 then null else -60-l_quantity end PathRSS, l_extendedprice*1e-3 PathDelay,
 -180+l_extendedprice%360 PathAOA, 80+200*l_tax PathZOA
from lineitem join orders on l_orderkey=o_orderkey""",
    "fx_pred": """
select *, least(greatest(0.15e0+0.5e0*{U(target_id;p)}+0.3e0*detected,0.01e0),0.99e0) p from (
 select t.scenario_id, t.drop_id, t.target_id, t.bistatic_range_m, t.nearest_neighbor_norm_range_sep nn_norm_range_sep,
  case when e.position_error_x_m is not null then 1 else 0 end detected
 from fx_target t join fx_error e on t.scenario_id=e.scenario_id and t.drop_id=e.drop_id and t.target_id=e.target_id) a""",
    "fx_pair_pred": """
select scenario_id, drop_id, target_id_a, target_id_b, score, e0/s p0, e1/s p1, e2/s p2, e3/s p3 from (
 select *, e0+e1+e2+e3 s from (
  select a.scenario_id, a.drop_id, a.target_id target_id_a, b.target_id target_id_b, 2*a.detected+b.detected score,
   0.1e0+{U(a.target_id;e0)} e0, 0.1e0+{U(a.target_id;e1)} e1, 0.1e0+{U(a.target_id;e2)} e2, 0.1e0+{U(a.target_id;e3)} e3
  from fx_pred a join fx_pred b on a.scenario_id=b.scenario_id and a.drop_id=b.drop_id
   and a.nn_norm_range_sep=b.nn_norm_range_sep where a.target_id<b.target_id) c) d""",
    "fx_draws": """
select e.scenario_id, e.drop_id, e.target_id, s.draw, -0.52e0+1.34e0*{U(e.target_id*100+s.draw;draw)} value, e.range_error_m
from fx_error e cross join {SEQ(10)} s where e.range_error_m is not null""",
}

_LIVE = "filter (PathRSS is not null)"
_CIRCLE = "degrees(sqrt(-2*ln(least(greatest(sqrt(({s})*({s})+({c})*({c})),1e-12),1))))"
_WS, _WC = "sum(sin(radians(PathAOA))*p)/sum(p)", "sum(cos(radians(PathAOA))*p)/sum(p)"
#: Tables of features for DuckDB alone; Spark's come from the operators.
DUCK_VIEWS: dict[str, str] = {
    "fx_mp": f"""
select scenario_id, drop_id, target_id, count(PathRSS) n_mpc, max(PathRSS) rss_max, min(PathRSS) rss_min, avg(PathRSS) rss_mean, case when count(PathRSS)>1 then stddev_samp(PathRSS) else 0 end rss_std, 10*log10(sum(p)) rss_total_db,
 min(PathDelay) {_LIVE} delay_min, max(PathDelay) {_LIVE} delay_max, max(PathDelay) {_LIVE}-min(PathDelay) {_LIVE} delay_spread_raw,
 {_CIRCLE.format(s=f"avg(sin(radians(PathAOA))) {_LIVE}", c=f"avg(cos(radians(PathAOA))) {_LIVE}")} aoa_std, case when count(PathRSS)>1 then stddev_samp(PathZOA) {_LIVE} else 0 end zoa_std,
 (max({{'a':PathRSS,'b':PathDelay,'c':PathAOA,'d':PathZOA}}) {_LIVE}).b dom_delay, (max({{'a':PathRSS,'b':PathDelay,'c':PathAOA,'d':PathZOA}}) {_LIVE}).d dom_zoa, degrees(atan2({_WS},{_WC})) aoa_mean_circ,
 (max({{'a':PathRSS,'b':PathDelay,'c':PathAOA,'d':PathZOA}}) {_LIVE}).c-degrees(atan2({_WS},{_WC})) dom_aoa_offset, sin(radians(max(PathAOA) {_LIVE})) dom_aoa_sin, cos(radians(max(PathAOA) {_LIVE})) dom_aoa_cos,
 max(PathRSS)-(min({{'a':PathDelay,'b':PathRSS}}) {_LIVE}).b dom_excess_delay, (max({{'a':PathRSS,'b':PathDelay,'c':PathAOA,'d':PathZOA}}) {_LIVE}).b-min(PathDelay) {_LIVE} first_rss_minus_dom,
 max(md) mean_delay_w, sqrt(sum((PathDelay-md)*(PathDelay-md)*p)/sum(p)) rms_delay_spread, {_CIRCLE.format(s=_WS, c=_WC)} aoa_spread_w, sqrt(sum((PathZOA-mz)*(PathZOA-mz)*p)/sum(p)) zoa_spread_w,
 least(max(PathRSS)-10*log10(greatest(sum(p)-max(p),1e-30)),60) k_factor_db, count(*)-count(PathRSS) n_mpc_dropped
from (select *, pow(10, PathRSS/10) p, sum(PathDelay*pow(10,PathRSS/10)) over w / sum(pow(10,PathRSS/10)) over w md, sum(PathZOA*pow(10,PathRSS/10)) over w / sum(pow(10,PathRSS/10)) over w mz
 from fx_snr window w as (partition by scenario_id, drop_id, target_id)) q group by all having count(PathRSS) > 0""",
    "fx_features": """
select g.*, case when e.position_error_x_m is not null then 1 else 0 end detected, e.position_error_3d_m, e.range_error_m, e.rx_azimuth_error_deg, e.rx_elevation_error_deg, m.* exclude (scenario_id, drop_id, target_id) from (
 select *, 32*u_true-ku_true frac_u, 32*v_true-kv_true frac_v, abs(32*u_true-ku_true) abs_frac_u, abs(32*v_true-kv_true) abs_frac_v, ku_est-ku_true slip_u, kv_est-kv_true slip_v from (
 select *, round_even(32*u_true,0) ku_true, round_even(32*v_true,0) kv_true, round_even(32*u_coord,0) ku_est, round_even(32*v_coord,0) kv_est from (
 select t.*, d.estimated_bistatic_range_m-bistatic_range_m range_err_bi, ln(rx_target_distance_m) log_R, 2*target_v_x_ms*target_v_x_ms speed, rx_azimuth_deg-30 az_off_boresight, abs(bistatic_doppler_hz) abs_bistatic_doppler_hz,
  nearest_neighbor_norm_range_sep nn_norm_range_sep, nearest_neighbor_norm_rx_angle_sep nn_norm_ang_sep, num_targets_in_sample n_targets,
  cos(radians(rx_elevation_deg))*sin(radians(rx_azimuth_deg-30)) u_true, sin(radians(rx_elevation_deg)) v_true, cos(radians(estimated_rx_elevation_deg))*sin(radians(estimated_rx_azimuth_deg-30)) u_coord, sin(radians(estimated_rx_elevation_deg)) v_coord
 from fx_target t left join fx_detection d on t.scenario_id = d.scenario_id and t.drop_id = d.drop_id and t.target_id = d.associated_target_id) a) b) g
 left join fx_error e using (scenario_id, drop_id, target_id) left join fx_mp m using (scenario_id, drop_id, target_id)""",
}

_ALL = VIEWS | DUCK_VIEWS
_SPARK = {
    "U": lambda k, salt: f"(conv(substr(md5(concat_ws('|','42','{salt}',cast({k} as string))),1,13),16,10)/pow(2,52))",
    "RINT": lambda x: f"rint({x})",
    "SEQ": lambda n: f"(select id draw from range({n}))",
}
_DUCK = {
    "U": lambda k, salt: f"(('0x'||substr(md5(concat_ws('|','42','{salt}',cast({k} as varchar))),1,13))::BIGINT/pow(2,52))",
    "RINT": lambda x: f"round_even({x},0)",
    "SEQ": lambda n: f"(select range draw from range({n}))",
}


def _filled(sql: str, functions: dict) -> str:
    return re.sub(r"\{(U|RINT|SEQ)\(([^{}]*)\)\}", lambda m: functions[m[1]](*m[2].split(";")), sql)


def _needed(sql: str) -> list[str]:
    """The views that a statement uses, directly or through others, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"\bfx_\w+", text)) - found:
            found.add(name)
            todo.append(_ALL[name])
    return [name for name in _ALL if name in found]


def _statement(sql: str, functions: dict, kind: str = "") -> str:
    head = ", ".join(f"{name} as {kind}({_ALL[name]})" for name in _needed(sql))
    if head and sql.startswith("with "):  # the statement's own tables follow the views
        return _filled(f"with {head}, {sql[5:]}", functions)
    return _filled(f"with {head} {sql}" if head else sql, functions)


def oracle(sql: str) -> str:
    """The statement with its views put in, for DuckDB."""
    return _statement(sql, _DUCK, "materialized ")


#: Paths in one task: they are joined, ranged by target and aggregated there, so its sorts hold that many.
TASK_PATHS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables.

    The paths' two tables are dealt by order, which is the target, in as many parts as keep a task at ``TASK_PATHS``:
    the join and all that goes by target stay in these parts, however many there are.
    """
    bases = {base: spark.read.parquet(f"{sf_dir}/{base}.parquet") for base in ("orders", "lineitem")}
    if name == "fx_snr":
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bases["lineitem"].count() // TASK_PATHS))
        bases = {base: df.repartition(parts, f"{base[0]}_orderkey") for base, df in bases.items()}
    for base, df in bases.items():
        df.createOrReplaceTempView(base)
    return spark.sql(_statement(f"select * from {name}", _SPARK))
