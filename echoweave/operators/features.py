"""Row-local features and the multipath aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import KEYS

#: Boresight azimuth in degrees, cells of the direction-cosine grid for each unit.
BORESIGHT, GRID = 30.0, 32.0


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null, which greatest and least alone would skip."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def geometry(df: DataFrame, compat: bool = True) -> DataFrame:
    """Adds the geometry features. ``compat`` keeps ``speed`` as twice the square of the x component; otherwise it is the length of the velocity."""
    v = [F.col(f"target_v_{a}_ms") for a in "xyz"]
    squares = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    return df.withColumns(
        {
            "range_err_bi": F.col("estimated_bistatic_range_m") - F.col("bistatic_range_m"),
            "log_R": F.ln("rx_target_distance_m"),
            "speed": 2 * v[0] * v[0] if compat else F.sqrt(squares),
            "az_off_boresight": F.col("rx_azimuth_deg") - BORESIGHT,
            "abs_bistatic_doppler_hz": F.abs("bistatic_doppler_hz"),
            "log_range_product": F.log10(F.col("tx_target_distance_m") * F.col("rx_target_distance_m")),
            "path_loss_proxy": -20 * (F.log10("tx_target_distance_m") + F.log10("rx_target_distance_m")),
            "tangential_velocity": F.sqrt(clip(squares - F.col("radial_velocity") * F.col("radial_velocity"), 0.0)),
        }
    )


def neighbours(df: DataFrame, fill: bool = False) -> DataFrame:
    """Adds the nearest-neighbour features; with ``fill`` stated constants stand for null."""
    made = {
        "nn_dist": (F.col("nearest_neighbor_xyz_distance_m"), 1e4),
        "nn_range_sep": (F.abs("nearest_neighbor_bistatic_range_sep_m"), 1e4),
        "nn_az_sep": (F.abs("nearest_neighbor_rx_az_sep_deg"), 180.0),
        "nn_el_sep": (F.abs("nearest_neighbor_rx_el_sep_deg"), 180.0),
        "nn_norm_range_sep": (F.col("nearest_neighbor_norm_range_sep"), 1e3),
        "nn_norm_ang_sep": (F.col("nearest_neighbor_norm_rx_angle_sep"), 1e3),
    }
    return df.withColumns({n: F.coalesce(c, F.lit(x)) if fill else c for n, (c, x) in made.items()} | {"n_targets": F.col("num_targets_in_sample")})


def uv(azimuth: Column, elevation: Column) -> tuple[Column, Column]:
    """Direction cosines of degrees."""
    return F.cos(F.radians(elevation)) * F.sin(F.radians(azimuth - BORESIGHT)), F.sin(F.radians(elevation))


def from_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """Azimuth and elevation in degrees."""
    elevation = F.asin(clip(v, -1.0, 1.0))
    return BORESIGHT + F.degrees(F.asin(clip(u / clip(F.cos(elevation), 1e-9), -1.0, 1.0))), F.degrees(elevation)


def angle_grid(df: DataFrame) -> DataFrame:
    """Adds true and estimated direction cosines, their cells, offsets within cells, and slips between cells."""
    u, v = uv(F.col("rx_azimuth_deg"), F.col("rx_elevation_deg"))
    u_est, v_est = uv(F.col("estimated_rx_azimuth_deg"), F.col("estimated_rx_elevation_deg"))
    out = df.withColumns({"u_coord": u_est, "v_coord": v_est, "u_true": u, "v_true": v})
    out = out.withColumns({f"k{a}_{kind}": F.rint(GRID * F.col(f"{a}_{source}")) for a in "uv" for kind, source in (("true", "true"), ("est", "coord"))})
    out = out.withColumns({f"frac_{a}": GRID * F.col(f"{a}_true") - F.col(f"k{a}_true") for a in "uv"} | {f"slip_{a}": F.col(f"k{a}_est") - F.col(f"k{a}_true") for a in "uv"})
    return out.withColumns({f"abs_frac_{a}": F.abs(f"frac_{a}") for a in "uv"})


def regime(error: Column) -> Column:
    """Label 0 to 5 of a range error; null falls to 5."""
    bounds = F.when(error.between(-0.52, 0.82), 0).when(error.between(1.40, 1.85), 1).when(error.between(-2.25, -1.55), 2)
    return bounds.when(error > 1.85, 3).when(error < -2.25, 4).otherwise(5)


def position_error(df: DataFrame, range_error: str, az_error: str, el_error: str, distance: str, elevation: str, unit: str = "deg") -> DataFrame:
    """Adds the parts of the 3D error along and across the line of sight, its exact size and its small-angle size."""
    scale = {"deg": F.pi() / 180, "rad": F.lit(1.0), "mrad": F.lit(1e-3)}[unit]
    r, e, d = F.col(distance), F.radians(F.col(elevation)), F.col(range_error)
    az, el = F.col(az_error) * scale, F.col(el_error) * scale
    far, up = r + d, e + el
    x, y, z = far * F.cos(up) * F.cos(az) - r * F.cos(e), far * F.cos(up) * F.sin(az), far * F.sin(up) - r * F.sin(e)
    out = df.withColumns({"err_along": d, "err_cross_h": r * F.cos(e) * az, "err_cross_v": r * el, "err_3d": F.sqrt(x * x + y * y + z * z)})
    return out.withColumn("err_3d_approx", F.sqrt(sum(F.col(c) * F.col(c) for c in ("err_along", "err_cross_h", "err_cross_v"))))


def multipath(paths: DataFrame) -> DataFrame:
    """One row of features per target from its paths: a window for weighted means, then one aggregate, in one shuffle.

    Targets whose paths all lack a power are left out. Equal powers or delays are told apart by delay, angle and power.
    """
    live = F.col("PathRSS").isNotNull()
    own = paths.withColumn("p", F.pow(F.lit(10.0), F.col("PathRSS") / 10))
    over = W.partitionBy(*KEYS)
    for c in ("PathDelay", "PathZOA"):
        own = own.withColumn(f"mean_{c}", F.sum(F.col(c) * F.col("p")).over(over) / F.sum("p").over(over))
    rss, delay, zoa, aoa, p = (F.when(live, F.col(c)) for c in ("PathRSS", "PathDelay", "PathZOA", "PathAOA", "p"))
    a = F.radians(aoa)
    n = F.count(rss)
    strongest = F.when(live, F.struct(F.col("PathRSS"), F.col("PathDelay"), F.col("PathAOA"), F.col("PathZOA")))
    earliest = F.when(live, F.struct(F.col("PathDelay"), F.col("PathRSS")))
    spread = lambda c: F.sqrt(F.sum((F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}")) * p) / F.sum(p))
    resultant = lambda s, c: F.degrees(F.sqrt(-2 * F.ln(clip(F.sqrt(s * s + c * c), 1e-12, 1.0))))
    sin_w, cos_w = F.sum(F.sin(a) * p) / F.sum(p), F.sum(F.cos(a) * p) / F.sum(p)
    best, first = F.max(strongest), F.min(earliest)
    found = own.groupBy(*KEYS).agg(
        n.alias("n_mpc"), F.max(rss).alias("rss_max"), F.min(rss).alias("rss_min"), F.avg(rss).alias("rss_mean"),
        F.when(n > 1, F.stddev_samp(rss)).otherwise(0.0).alias("rss_std"), (10 * F.log10(F.sum(p))).alias("rss_total_db"),
        F.min(delay).alias("delay_min"), F.max(delay).alias("delay_max"), (F.max(delay) - F.min(delay)).alias("delay_spread_raw"),
        resultant(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("aoa_std"), F.when(n > 1, F.stddev_samp(zoa)).otherwise(0.0).alias("zoa_std"),
        best["PathDelay"].alias("dom_delay"), best["PathZOA"].alias("dom_zoa"), F.degrees(F.atan2(sin_w, cos_w)).alias("aoa_mean_circ"),
        (best["PathAOA"] - F.degrees(F.atan2(sin_w, cos_w))).alias("dom_aoa_offset"), F.sin(F.radians(F.max(aoa))).alias("dom_aoa_sin"), F.cos(F.radians(F.max(aoa))).alias("dom_aoa_cos"),
        (best["PathRSS"] - first["PathRSS"]).alias("dom_excess_delay"), (best["PathDelay"] - first["PathDelay"]).alias("first_rss_minus_dom"),
        F.max("mean_PathDelay").alias("mean_delay_w"), spread("PathDelay").alias("rms_delay_spread"), resultant(sin_w, cos_w).alias("aoa_spread_w"), spread("PathZOA").alias("zoa_spread_w"),
        F.least(F.max(rss) - 10 * F.log10(F.greatest(F.sum(p) - F.max(p), F.lit(1e-30))), F.lit(60.0)).alias("k_factor_db"),
        F.count(F.when(~live, 1)).alias("n_mpc_dropped"),
    )
    return found.where("n_mpc > 0")
