"""Draws of range and angle errors. Every random number is keyed by the row (and a draw number), so retries repeat it."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed_random import categorical, normal, uniform
from ..schemas import KEYS
from .features import GRID, from_uv
from .ranks import ordinal, tile

#: Half-widths of the jitter and bounds of the error of regimes 1 to 5 (regime 5 lies on both sides of the bulk).
JITTER = {1: 0.03, 2: 0.06, 3: 0.1, 4: 0.15, 5: 0.03}
BOUNDS = {1: (1.40, 1.85), 2: (-2.25, -1.55), 3: (1.85, None), 4: (None, -2.25), 5: (-1.55, 1.40)}
#: Chance that a slip goes to the nearer edge; shares of slips of 1 to 4 cells.
TOWARD, MAGNITUDES = 0.935, (0.933, 0.043, 0.015, 0.009)
#: Stands for the separation of a target without neighbour.
FAR = 1e18


def tiled(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, with ``draw`` from 0 to n - 1; no shuffle."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def empirical(df: DataFrame, value: str, by: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """A distribution to pick from: (``by``, ``k`` from 0, ``size``, value), the values of each stratum in order."""
    return ordinal(df.where(F.col(value).isNotNull()), value, keys, by).select(*by, (F.col("row") - 1).alias("k"), F.col("n").alias("size"), value)


def pick(df: DataFrame, table: DataFrame, u: Column, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Adds one value of :func:`empirical` for the number u of each row; null where the row's stratum is empty.

    The values are found by a join on the place; Spark broadcasts the sizes of strata only where they are few, and
    always if the caller says so: else the rows may be shuffled for the sizes alone.
    """
    sizes = table.where("k = 0").select(*by, "size")
    if by:
        placed = df.join(F.broadcast(sizes) if few else sizes, list(by), "left")
    else:
        only = sizes.first()
        placed = df.withColumn("size", F.lit(only["size"] if only else None).cast("long"))
    placed = placed.withColumn("k", F.floor(u * F.col("size"))).drop("size")
    return placed.join(table.drop("size"), [*by, "k"], "left").drop("k")


def climatology(points: DataFrame, table: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``n`` values of :func:`empirical` for every point, whatever its features."""
    return pick(tiled(points, n), table, uniform("climate", *keys, "draw"))


def bulk_draws(df: DataFrame, slope: float, intercept: float, residuals: DataFrame, u: Column, distance: str = "bistatic_range_m", name: str = "sampled_error") -> DataFrame:
    """Trend in range and a residual picked at random (``residuals``: :func:`empirical` of ``residual``)."""
    return pick(df, residuals, u).withColumn(name, F.lit(intercept) + F.lit(slope) * F.col(distance) + F.col("residual")).drop("residual")


def neighbour_breaks(df: DataFrame, regime: str = "region", separation: str = "nn_norm_range_sep", keys: Sequence[str] = KEYS) -> list[float]:
    """Upper ends of the first four fifths of the neighbour separation of regime 3; no neighbour counts as farthest."""
    far = df.where(F.col(regime) == 3).withColumn(separation, F.coalesce(separation, F.lit(FAR)))
    ends = ordinal(far, separation, keys).groupBy(tile(5).alias("fifth")).agg(F.max(separation).alias("end")).where("fifth < 4")
    return sorted(r["end"] for r in ends.collect())


def stratum(regime: Column, separation: Column, breaks: Sequence[float]) -> Column:
    """10 times the regime; in regime 3, plus the number of breaks below the separation."""
    above = sum((((F.coalesce(separation, F.lit(FAR)) > b).cast("int")) for b in breaks), F.lit(0))
    return regime * 10 + F.when(regime == 3, above).otherwise(0)


def jittered(error: Column, regime: Column, u: Column) -> Column:
    """The error moved by up to its regime's half-width, to the other side where the move would leave the regime."""
    out = F.lit(None).cast("double")
    for r, (low, high) in BOUNDS.items():
        moved = error + (2 * u - 1) * JITTER[r]
        above = F.lit(True) if low is None else moved >= low
        below = F.lit(True) if high is None else moved <= high
        inside = F.when(error >= 0.82, below).otherwise(above) if r == 5 else above & below
        out = F.when(regime == r, F.when(inside, moved).otherwise(2 * error - moved)).otherwise(out)
    return F.when(regime == 0, error).otherwise(out)


def other_draws(df: DataFrame, table: DataFrame, breaks: Sequence[float], u: Column, u_jitter: Column, regime: str = "region", separation: str = "nn_norm_range_sep", name: str = "sampled_error") -> DataFrame:
    """Errors outside the bulk: one of the row's stratum (``table``: :func:`empirical` of ``error`` by ``stratum``), jittered but for regime 3."""
    placed = df.withColumn("stratum", stratum(F.col(regime), F.col(separation), breaks))
    moved = F.when(F.col(regime) == 3, F.col("error")).otherwise(jittered(F.col("error"), F.col(regime), u_jitter))
    return pick(placed, table, u, ["stratum"]).withColumn(name, moved).drop("error", "stratum")


def signed_slip(axis: str, p: Column, magnitudes: Sequence[Column] | None = None, keys: Sequence[str] = KEYS) -> Column:
    """Slip in cells along an axis: whether, how far, and whether to the nearer edge; a coin decides where ``frac`` is 0."""
    u = lambda what: uniform(f"slip_{what}_{axis}", *keys)
    frac = F.col(f"frac_{axis}")
    shares = [F.lit(m) for m in MAGNITUDES] if magnitudes is None else list(magnitudes)
    edge = F.when(frac == 0, F.when(u("coin") < 0.5, -1).otherwise(1)).otherwise(F.signum(frac).cast("int"))
    way = F.when(u("toward") < TOWARD, edge).otherwise(-edge)
    return F.when(u("hit") < p, way * (1 + categorical(shares, u("size")))).otherwise(0).cast("long")


def angle_draws(df: DataFrame, p_u: Column, p_v: Column, magnitudes: Sequence[Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds slips, estimated angles and their errors: cell of the grid, slip, back to angles; azimuth errors in [-180, 180)."""
    out = df.withColumns({f"drawn_slip_{a}": signed_slip(a, p, magnitudes, keys) for a, p in (("u", p_u), ("v", p_v))})
    u, v = ((GRID * F.col(f"{a}_true") - F.col(f"frac_{a}") + F.col(f"drawn_slip_{a}")) / GRID for a in "uv")
    azimuth, elevation = from_uv(u, v)
    out = out.withColumns({"az_est": azimuth, "el_est": elevation})
    return out.withColumns({"az_err": F.pmod(F.col("az_est") - F.col("rx_azimuth_deg") + 180, F.lit(360.0)) - 180, "el_err": F.col("el_est") - F.col("rx_elevation_deg")})


def gaussian_draws(df: DataFrame, means: Sequence[float], covariance: Sequence[Sequence[float]], names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds correlated normal errors; a covariance that has no full rank gives zero for the direction it lacks."""
    n = len(means)
    low = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = covariance[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
            low[i][j] = sqrt(max(rest, 0.0)) if i == j else rest / low[j][j] if low[j][j] else 0.0
    z = [normal(f"gauss{i}", *keys) for i in range(n)]
    return df.withColumns({name: F.lit(means[i]) + sum((low[i][j] * z[j] for j in range(i + 1)), F.lit(0.0)) for i, name in enumerate(names)})


def quantile_draws(levels: Sequence[float], quantiles: Column, u: Column) -> Column:
    """The value at level u of a sorted array of quantiles of a logarithm, linear between levels, constant beyond them."""
    at = lambda i: F.get(quantiles, F.lit(i))
    out = at(len(levels) - 1)
    for i in range(len(levels) - 2, -1, -1):
        share = (u - levels[i]) / (levels[i + 1] - levels[i])
        out = F.when(u < levels[i + 1], at(i) + share * (at(i + 1) - at(i))).otherwise(out)
    return F.exp(F.when(u < levels[0], at(0)).otherwise(out))

