"""Calibration, discrimination and distribution scores. ``by`` groups (models, branches, slices) are columns, not loops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import erfc, lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.keyed_random import categorical, uniform
from ..schemas import KEYS, SCENE
from .ranks import PER_RANGE, bisected, edge_bin, hold, ordinal, ranges, tile


def brier(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def brier_joint(df: DataFrame, probabilities: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Summed over the outcomes, averaged over the pairs."""
    each = [(F.col(p) - (F.col(label) == i).cast("int")) ** 2 for i, p in enumerate(probabilities)]
    return df.groupBy(*by).agg(F.avg(sum(each[1:], each[0])).alias("brier"))


def spiegelhalter(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    x, lean = F.col(p), 1 - 2 * F.col(p)
    return df.groupBy(*by).agg((F.sum((F.col(y) - x) * lean) / F.sqrt(F.sum(lean * lean * x * (1 - x)))).alias("z"))


def confusion(df: DataFrame, p: str, y: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts of (threshold, label, p >= threshold)."""
    each = df.select(y, p, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return each.groupBy("threshold", F.col(y).alias("label"), (F.col(p) >= F.col("threshold")).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal-width bins; the last one holds its upper end. Values outside are left out."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    return inside.groupBy(*by, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int, kind: str = "edges", by: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """(bin, n, mean_p, rate) of bins of equal mass: ``edges`` rounded, ``tile`` as ntile, ``ties`` with ties together."""
    ranked = ordinal(df, p, keys, by)
    place = {"edges": edge_bin(bins), "tile": tile(bins), "ties": edge_bin(bins, "rank")}[kind]
    return ranked.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def ece(df: DataFrame, p: str, y: str, bins: int, kind: str = "edges", by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error."""
    return calibration_bins(df, p, y, bins, kind, by).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def chi2_tail(x: Column, freedom: int) -> Column:
    """Share of the chi-square distribution above x: a finite sum, with the normal tail if the degrees of freedom are odd."""
    half, odd = x / 2, freedom % 2
    term, total = (F.lit(1.0), F.lit(0.0)) if not odd else (2 * F.sqrt(half / F.pi()), F.lit(0.0))
    for i in range((freedom - odd) // 2):
        total = total + term
        term = term * half / (i + 1 + odd / 2)
    return F.exp(-half) * total + (_normal_tails(F.sqrt(x)) if odd else 0)


@F.pandas_udf(DoubleType())
def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda v: erfc(v / 2**0.5))


def hosmer_lemeshow(df: DataFrame, p: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """The statistic and its p value (bins less two degrees of freedom)."""
    m = F.col("mean_p")
    found = calibration_bins(df, p, y, bins, "tile", by).groupBy(*by).agg(F.sum(F.col("n") * (F.col("rate") - m) * (F.col("rate") - m) / (m * (1 - m))).alias("statistic"))
    return found.withColumn("p_value", chi2_tail(F.col("statistic"), bins - 2))


def murphy(df: DataFrame, p: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Reliability, resolution and uncertainty; tied predictions share a bin."""
    n, gap = F.col("n"), F.col("mean_p") - F.col("rate")
    sums = calibration_bins(df, p, y, bins, "ties", by).groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * gap * gap).alias("g"), F.sum(n * F.col("rate") * F.col("rate")).alias("r"), (F.sum(n * F.col("rate")) / F.sum(n)).alias("o"))
    o = F.col("o")
    return sums.select(*by, (F.col("g") / n).alias("reliability"), (F.col("r") / n - o * o).alias("resolution"), (o * (1 - o)).alias("uncertainty"), (F.col("g") / n - F.col("r") / n + o).alias("reconstructed"))


def slice_chi2(df: DataFrame, feature: str, p: str, y: str, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """z of every slice of a covariate; null covariates are left out."""
    sliced = ordinal(df.where(F.col(feature).isNotNull()), feature, keys).withColumn("bin", tile(bins))
    return sliced.groupBy("bin").agg(F.count("*").alias("n"), ((F.sum(y) - F.sum(p)) / F.sqrt(F.sum(F.col(p) * (1 - F.col(p))))).alias("z"))


def auroc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact, from counts of distinct scores; null if a class is missing."""
    return auroc_of_counts(df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg")), p, by)


def auroc_of_counts(counts: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUROC from the counts ``pos`` and ``neg`` of each distinct score."""
    running = _running(counts, p, ["pos", "neg"], by)
    below = F.col("cum_neg") - F.col("neg")
    sums = running.groupBy(*by).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return sums.select(*by, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("u") / (F.col("a") * F.col("b"))).alias("auroc"))


def value_ranges(counts: DataFrame, value: str, name: str, buckets: int) -> DataFrame:
    """Adds ``name``, the range of a value among at most ``buckets``, which end at values of a bounded sample. Where they end changes no result."""
    share = min(1.0, PER_RANGE * buckets / max(counts.count(), 1))
    rows = counts.select(value) if share == 1.0 else counts.select(value).sample(share, 1)
    sample = rows.agg(F.sort_array(F.collect_set(value)).alias("x")).first()["x"]
    step = max(1, len(sample) // buckets)
    return bisected(counts, name, [F.lit(x).cast(counts.schema[value].dataType) for x in sample[step::step]], lambda e: F.col(value) >= e)


def _running(counts: DataFrame, value: str, columns: Sequence[str], by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Adds cumulative sums in the order of distinct values, by ranges as :func:`ordinal` does, totals, and the value after (``__next``)."""
    dealt = value_ranges(hold(counts), value, "__b", ranges(counts, buckets))
    sizes = dealt.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__{c}") for c in columns], F.min(value).alias("__least"))
    order = W.partitionBy(*by).orderBy("__b")
    sums = {f"__before_{c}": F.sum(f"__{c}").over(order) - F.col(f"__{c}") for c in columns} | {f"all_{c}": F.sum(f"__{c}").over(W.partitionBy(*by)) for c in columns}
    # the least value of the next range that has one
    sizes = sizes.withColumns(sums | {"__border": F.lead("__least").over(order)}).drop("__least", *[f"__{c}" for c in columns])
    within = W.partitionBy(*by, "__b").orderBy(value)
    inside = within.rowsBetween(W.unboundedPreceding, 0)
    made = {f"cum_{c}": F.sum(c).over(inside) + F.col(f"__before_{c}") for c in columns} | {"__next": F.coalesce(F.lead(value).over(within), "__border")}
    # ranges and groups are few, so their sums go to the rows, not the rows to the sums
    return dealt.join(F.broadcast(sizes), [*by, "__b"]).withColumns(made).drop("__b", "__border", *[f"__before_{c}" for c in columns])


def best_f1(df: DataFrame, p: str, y: str) -> DataFrame:
    """The threshold (p >= it) of the largest F1, the lower one of equals."""
    counts = df.groupBy(p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    run = _running(counts, p, ["pos", "n"])
    hit = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    called = F.col("all_n") - F.col("cum_n") + F.col("n")
    scored = run.select(F.col(p).alias("threshold"), F.round(2 * hit / (called + F.col("all_pos")), 9).alias("f1"))
    return scored.agg(F.max(F.struct("f1", -F.col("threshold"))).alias("x")).select((-F.col("x.col2")).alias("threshold"), "x.f1")


def ks_two_sample(df: DataFrame, p: str, y: str) -> DataFrame:
    counts = df.groupBy(p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    run = _running(counts, p, ["pos", "neg"])
    found = run.agg(F.max(F.abs(F.col("cum_pos") / F.col("all_pos") - F.col("cum_neg") / F.col("all_neg"))).alias("ks"), F.first("all_pos").alias("a"), F.first("all_neg").alias("b"))
    # the asymptotic distribution; its terms vanish soon
    scale = F.col("ks") * F.col("ks") * F.col("a") * F.col("b") / (F.col("a") + F.col("b"))
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * scale))
    return found.select("ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)).alias("p_value"))


def wasserstein(real: DataFrame, draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """W1 of ``real(value)`` and pooled ``draws(value)``: the area between their distribution functions."""
    both = real.select(*by, "value", F.lit(1).alias("r"), F.lit(0).alias("d")).union(draws.select(*by, "value", F.lit(0), F.lit(1)))
    counts = both.groupBy(*by, "value").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
    run = _running(counts, "value", ["r", "d"], by)
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_d") / F.col("all_d"))
    return run.groupBy(*by).agg(F.coalesce(F.sum(gap * (F.col("__next") - F.col("value"))), F.lit(0.0)).alias("w1"))


def ensembles(draws: DataFrame, real: str, value: str, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """A row for each point: its real value ``__real``, its sorted draws ``__x`` (null ones left out), its fair-ensemble ``crps``, and columns that its draws share."""
    return with_crps(draws.groupBy(*keys).agg(F.first(real).alias("__real"), F.collect_list(value).alias("__x"), *[F.first(c).alias(c) for c in columns]))


def with_crps(points: DataFrame) -> DataFrame:
    """Sorts the draws ``__x`` of each point and adds its ``crps`` against ``__real``."""
    rows, m = points.withColumn("__x", F.array_sort("__x")), F.size("__x")
    error = F.aggregate("__x", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__real"))) / m
    weighted = F.transform("__x", lambda x, i: (2 * (i + 1) - m - 1) * x)
    pair = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("crps", F.when(m > 1, error - pair / (m * (m - 1))).otherwise(error))


def crps(draws: DataFrame, real: str, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Fair-ensemble CRPS of every point, from the sorted draws of its row."""
    return ensembles(draws, real, value, keys).select(*keys, "crps")


#: Values of a group and range at most, on average: one task sorts them.
RANGE_VALUES = 1_000_000


def ensemble_wasserstein(points: DataFrame, by: str) -> DataFrame:
    """(by, w1): W1 of the real values ``__real`` and all draws ``__x`` of each group's points; null where one side has none.

    Values travel once, as blocks of numbers by group and range. Counts of the ranges come first, so a range knows how
    many values lie below it, and sums its own part of the area between the distribution functions, gaps at its ends included.
    """
    known = points.where(f"`{by}` is not null").select(F.xxhash64(by).alias("g"), F.col("__real").cast("double").alias("real"), F.col("__x").cast("array<double>").alias("x"))
    total = known.agg(F.count("*").alias("n"), F.sum(F.size("x")).alias("d")).first()
    buckets = max(ranges(points, None), -(-int(total["d"] or 0) // RANGE_VALUES))
    share = min(1.0, PER_RANGE * buckets / max(total["n"], 1))
    sample = known.sample(share, 1).select(F.explode(F.concat(F.array("real"), F.slice("x", 1, 4))).alias("v")).where("v is not null").collect()
    sample = np.unique([r["v"] for r in sample])
    cuts = sample[:: max(1, len(sample) // buckets)][1:]  # where ranges end changes no result

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(group, range, side, its values) of each batch; side 0 is real."""
        for batch in batches:
            g, lists, real = batch.column("g").to_numpy(), batch.column("x"), batch.column("real")
            each = np.repeat(g, np.diff(lists.offsets.to_numpy()))
            there = np.asarray(real.is_valid())
            for side, (group, v) in enumerate(((g[there], real.drop_null().to_numpy()), (each, lists.flatten().to_numpy(zero_copy_only=False)))):
                r = np.searchsorted(cuts, v, side="right")
                order = np.lexsort((r, group))
                group, v, r = group[order], v[order], r[order]
                at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (r[1:] != r[:-1]))) if len(v) else []
                for a, b in zip(at, [*at[1:], len(v)], strict=True):
                    yield int(group[a]), int(r[a]), side, v[a:b]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for g, r, side, v in values(batches):
            found[g, r, side] = found.get((g, r, side), 0) + len(v)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["g", "r", "side", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, r, side, v in values(batches):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([r], pa.int32()), pa.array([side], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["g", "r", "side", "v"])

    sizes: dict[int, np.ndarray] = {}
    for x in known.mapInArrow(counts, "g long, r int, side int, n long").groupBy("g", "r", "side").agg(F.sum("n").alias("n")).collect():
        sizes.setdefault(x["g"], np.zeros((2, len(cuts) + 1), np.int64))[x["side"], x["r"]] = x["n"]
    # the distribution functions where each range begins, and the number of all values of a side
    heads = {g: (np.cumsum(n, axis=1) - n, n.sum(axis=1)) for g, n in sizes.items() if n.any(axis=1).all()}
    empty = [(g, float(abs(np.subtract(*(before[:, r] / all_))) * (cuts[r] - cuts[r - 1]))) for g, (before, all_) in heads.items() for r in range(1, len(cuts)) if not sizes[g][:, r].any()]

    def area(key: tuple, t: pa.Table) -> pa.Table:
        g, r = key[0].as_py(), key[1].as_py()
        if g not in heads:
            return pa.table({"g": pa.array([g], pa.int64()), "area": pa.array([None], pa.float64())})
        before, all_ = heads[g]
        sides = [np.sort(np.frombuffer(b"".join(t.filter(pa.compute.equal(t["side"], side))["v"].to_pylist()))) for side in (0, 1)]
        v = np.concatenate([*([cuts[r - 1 : r]] if r else []), *sides, *([cuts[r : r + 1]] if r < len(cuts) else [])])
        v.sort()
        gap = np.subtract(*((before[s, r] + np.searchsorted(sides[s], v[:-1], side="right")) / all_[s] for s in (0, 1)))
        return pa.table({"g": pa.array([g], pa.int64()), "area": pa.array([float(np.abs(gap) @ np.diff(v))])})

    parts = known.mapInArrow(blocks, "g long, r int, side int, v binary").repartition(buckets, "g", "r").groupBy("g", "r").applyInArrow(area, "g long, area double")
    if empty:
        parts = parts.unionByName(points.sparkSession.createDataFrame(empty, "g long, area double"))
    found = parts.groupBy("g").agg(F.sum("area").alias("w1"))
    return points.where(f"`{by}` is not null").select(by).distinct().withColumn("g", F.xxhash64(by)).join(F.broadcast(found), "g", "left").select(by, "w1")


def scene_bootstrap(df: DataFrame, value: str, replicates: int, alpha: float = 0.05, scene: Sequence[str] = SCENE, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Interval of the mean of ``value`` by resampling whole scenes; all groups of ``by`` share the draws."""
    from .resampling import Resamples, intervals

    sums = Resamples(df, replicates, scene, seed).sums(df, {"s": F.col(value), "n": F.col(value).isNotNull().cast("int")}, by)
    return intervals(sums.withColumn("m", F.try_divide("s", "n")), ["m"], by, alpha).drop("metric")


def null_ece(df: DataFrame, p: str, y: str, bins: int, simulations: int, seed: int = 42, joint: DataFrame | None = None, joint_p: Sequence[str] = ()) -> DataFrame:
    """(observed, null_mean, p_value): the ECE against that of labels drawn from the predictions themselves; bins are fixed once.

    Rows of a pair in ``joint(SCENE, target_id_a, target_id_b, *joint_p)``, with the probabilities of neither, the second,
    the first and both, share one outcome a replicate: both draw by the keys of the pair, so they meet without a join.
    A row has one pair at most. Only hits of a replicate and bin are shuffled.

    Without pairs a row's draws of all replicates are mixed from one hash of its keys, as arrays: rows are not repeated.
    With pairs the draws are those of the keys' md5.
    """
    pair = ("target_id_a", "target_id_b")
    rows = df.select(*KEYS, p, y)
    if joint is not None:
        sides = F.array(*[F.struct(F.col(t).alias("target_id"), F.lit(i).alias("slot")) for i, t in enumerate(pair)])
        rows = rows.join(joint.select(*SCENE, *pair, *joint_p, F.inline(sides)), list(KEYS), "left")
    placed = hold(ordinal(rows, p, KEYS).withColumn("bin", edge_bin(bins)).drop("row", "rank", "n"))
    hit = (uniform("null", *KEYS, "sim", seed=seed) < F.col(p)).cast("int")
    if joint is not None:
        outcome = categorical([F.col(c) for c in joint_p], uniform("null pair", *SCENE, *pair, "sim", seed=seed))
        hit = F.when(F.col("slot").isNull(), hit).when(F.col("slot") == 0, (outcome >= 2).cast("int")).otherwise(outcome % 2)
    if joint is None:
        hits = _null_hits(placed.select("bin", F.col(p).cast("double").alias("p"), F.xxhash64(*KEYS, F.lit(seed)).alias("key")), bins, simulations)
    else:
        drawn = placed.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).select("sim", "bin", hit.alias("hit"))
        hits = drawn.groupBy("sim", "bin").agg(F.sum("hit").alias("h"))
    # as many rows as there are bins; simulation -1 is the observed one
    fixed = placed.groupBy("bin").agg(F.sum(p).alias("sp"), F.count("*").alias("m"), F.sum(y).alias("sy"))
    sums = hits.join(F.broadcast(fixed), "bin")
    sums = sums.select("sim", "sp", "m", "h").unionByName(fixed.select(F.lit(-1).alias("sim"), "sp", "m", F.col("sy").alias("h")))
    each = sums.groupBy("sim").agg((F.sum(F.abs(F.col("sp") - F.col("h"))) / F.sum("m")).alias("ece"))
    whole = each.agg(F.max(F.when(F.col("sim") < 0, F.col("ece"))).alias("observed"), F.collect_list(F.when(F.col("sim") >= 0, F.col("ece"))).alias("null"))
    return whole.select("observed", (F.aggregate("null", F.lit(0.0), lambda s, x: s + x) / F.size("null")).alias("null_mean"), ((1 + F.size(F.filter("null", lambda x: x >= F.col("observed")))) / (1 + F.size("null"))).alias("p_value"))


#: Rows whose draws are made at once: with 1000 replicates some 2 MB, which stay in a core's cache.
_DRAWN_ROWS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: each bit of a key moves about half of the output."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    return x


def _hits_of(bin_: np.ndarray, p: np.ndarray, key: np.ndarray, bins: int, simulations: int) -> np.ndarray:
    """Hits of each bin (row) and replicate (column); two replicates share the 64 bits of one key."""
    steps = np.arange(1, -(-simulations // 2) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found, order = np.zeros((bins, simulations), np.int64), np.argsort(bin_, kind="stable")
    bin_, key = bin_[order], key[order].view(np.uint64)
    limit = np.rint(np.clip(p[order], 0.0, 1.0) * 2.0**32).astype(np.uint64)
    cuts = np.flatnonzero(np.diff(bin_)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bin_)], strict=True):
        for i in range(a, b, _DRAWN_ROWS):
            j = min(b, i + _DRAWN_ROWS)
            with np.errstate(over="ignore"):
                drawn = _mixed(key[i:j, None] + steps[None, :]).view("<u4")[:, :simulations]
            # a limit of 2^32 is always hit
            hit = (drawn < np.minimum(limit[i:j], 0xFFFFFFFF).astype(np.uint32)[:, None]) | (limit[i:j] > 0xFFFFFFFF)[:, None]
            found[bin_[i]] += hit.view(np.uint8).sum(axis=0, dtype=np.uint16)
    return found


def _null_hits(rows: DataFrame, bins: int, simulations: int) -> DataFrame:
    """(sim, bin, h) of ``rows(bin, p, key)``: how many rows of a bin each replicate hits. A task leaves one row for each of them; null p hits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = np.zeros((bins, simulations), np.int64), np.zeros(bins, bool)
        for batch in batches:
            own = batch.column("bin").to_numpy()
            found += _hits_of(own, batch.column("p").fill_null(0.0).to_numpy(), batch.column("key").to_numpy(), bins, simulations)
            seen[own] = True
        for b in np.flatnonzero(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(simulations, dtype=np.int32)), pa.array(np.full(simulations, b, np.int32)), pa.array(found[b])], names=["sim", "bin", "h"])

    return rows.mapInArrow(run, "sim int, bin int, h long").groupBy("sim", "bin").agg(F.sum("h").alias("h"))


def anderson_darling(df: DataFrame, p: str, y: str) -> DataFrame:
    """Statistic of the two-sample Anderson-Darling test with mid-ranks, from counts of distinct scores."""
    counts = df.groupBy(p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg")).withColumn("l", F.col("pos") + F.col("neg"))
    run = _running(counts, p, ["pos", "neg", "l"])
    big, tied = F.col("all_l"), F.col("l")
    below = F.col("cum_l") - tied / 2
    weight = tied / big / (below * (big - below) - big * tied / 4)
    terms = []
    for c in ("pos", "neg"):
        gap = big * (F.col(f"cum_{c}") - F.col(c) / 2) - F.col(f"all_{c}") * below
        terms.append(F.sum(F.when(tied < big, weight * gap * gap / F.col(f"all_{c}"))))
    return run.agg(((F.max(big) - 1) / F.max(big) * (terms[0] + terms[1])).alias("statistic"))


def wasserstein_null(df: DataFrame, value: str, member: str, real: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Is the real sample farther from the draws than they are from each other?

    ``member`` numbers equally large samples, ``real`` is the real one. Samples are sorted apart; values of one rank
    meet in a window of as many rows as there are members, where prefix sums give the distances to all others.
    Returns (observed, p).
    """
    placed = ordinal(df, value, keys, [member]).select(member, "row", value)
    at_rank = W.partitionBy("row").orderBy(value, member)
    before, i, m = F.sum(value).over(at_rank.rowsBetween(W.unboundedPreceding, 0)), F.row_number().over(at_rank), F.count("*").over(W.partitionBy("row"))
    total = F.sum(value).over(W.partitionBy("row"))
    away = placed.select(member, (F.col(value) * (2 * i - m) + total - 2 * before).alias("d"), (m - 1).alias("others"))
    means = away.groupBy(member).agg(F.avg(F.col("d") / F.col("others")).alias("d"))
    split = means.agg(F.max(F.when(F.col(member) == real, F.col("d"))).alias("observed"), F.collect_list(F.when(F.col(member) != real, F.col("d"))).alias("null"))
    return split.select("observed", ((1 + F.size(F.filter("null", lambda x: x >= F.col("observed")))) / (1 + F.size("null"))).alias("p"))


def _beta_share(a: float, b: float, x: float) -> float:
    """Share of a beta distribution below x, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    c, d, value = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return (value - 1) * np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a


def _beta_quantile(a: float, b: float, share: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_share(a, b, mid) < share else (low, mid)
    return (low + high) / 2


def rate_bounds(df: DataFrame, feature: str, p: str, y: str, bins: int, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed rate, its Clopper-Pearson bounds and the mean prediction in bins of equal mass of a covariate.

    Rows without the covariate are left out. Python sees one row for each bin.
    """
    sliced = ordinal(df.where(F.col(feature).isNotNull()), feature, keys).groupBy(tile(bins).alias("bin"))
    sums = sliced.agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("hits"), F.avg(feature).alias("middle"), F.avg(y).alias("rate"), F.avg(p).alias("mean_p"))

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["low"] = [0.0 if not k else _beta_quantile(k, n - k + 1, alpha / 2) for n, k in zip(f.n, f.hits, strict=True)]
            f["high"] = [1.0 if k == n else _beta_quantile(k + 1, n - k, 1 - alpha / 2) for n, k in zip(f.n, f.hits, strict=True)]
            yield f

    return sums.mapInPandas(bound, sums.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", low double, high double")


def score_table(df: DataFrame, p: str, y: str, model: str = "model", bins: int = 15) -> DataFrame:
    """Brier score, ECE, Murphy parts and AUROC of several models at once: one row per model and metric."""
    by = [model]
    parts = brier(df, p, y, by).join(ece(df, p, y, bins, by=by), by).join(murphy(df, p, y, bins, by), by).join(auroc(df, p, y, by), by)
    names = ("brier", "ece", "reliability", "resolution", "uncertainty", "auroc")
    return parts.select(model, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def chi2_total(slices: DataFrame, bins: int) -> DataFrame:
    """Sum of squared z of :func:`slice_chi2` and its p value."""
    return slices.agg(F.sum(F.col("z") * F.col("z")).alias("statistic")).withColumn("p_value", chi2_tail(F.col("statistic"), bins))


def reliability_logits(df: DataFrame, p: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Logits of mean prediction and rate of each bin, rates kept half an observation away from 0 and 1."""
    edge = 0.5 / F.col("n")
    logit = lambda x: F.ln(x / (1 - x))
    kept = F.greatest(F.least(F.col("rate"), 1 - edge), edge)
    return calibration_bins(df, p, y, bins, "tile", by).select(*by, "bin", "n", logit(F.col("mean_p")).alias("logit_p"), logit(kept).alias("logit_rate"))


def sliced(df: DataFrame, feature: str, bins: int, keys: Sequence[str] = KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``bin`` of equal mass of a covariate; rows without it are left out."""
    return ordinal(df.where(F.col(feature).isNotNull()), feature, keys, by).withColumn("bin", tile(bins)).drop("row", "rank", "n")


def slice_metrics(df: DataFrame, feature: str, p: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and AUROC in bins of a covariate."""
    cut, at = sliced(df, feature, bins, by=by), [*by, "bin"]
    return cut.groupBy(*at).agg(F.count("*").alias("n"), F.avg(feature).alias("f_mid")).join(brier(cut, p, y, at), at).join(auroc(cut, p, y, at), at)


BRANCHES = ("non_mutual", "mutual", "pooled")


def branch_metrics(points: DataFrame, p: str, y: str, mutual: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, Murphy parts and AUROC of points outside pairs, in pairs, and of all: each point in two branches."""
    at = [*by, "branch"]
    own = points.select(*by, *KEYS, p, y, F.explode(F.array(F.when(F.col(mutual), "mutual").otherwise("non_mutual"), F.lit("pooled"))).alias("branch"))
    return brier(own, p, y, at).join(murphy(own, p, y, bins, at).drop("reconstructed"), at).join(auroc(own, p, y, at), at)


def report(values: DataFrame, row: str, column: str, value: str, names: Sequence[str], low: str | None = None, high: str | None = None) -> DataFrame:
    """A table to read: one row for each ``row``, one text column for each of ``names``, with its interval if there is one."""
    plain = F.format_string("%.4f", value)
    cell = plain if low is None else F.when(F.col(low).isNull(), plain).otherwise(F.format_string("%.4f [%.4f, %.4f]", value, low, high))
    return values.groupBy(row).pivot(column, list(names)).agg(F.first(cell))


def draw_scores(draws: DataFrame, real: str, value: str = "value", model: str = "model", reference: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """W1 and mean CRPS of the draws of each model, and the CRPS skill against the ``reference`` model. The draws are read once."""
    return ensemble_scores(ensembles(draws, real, value, [model, *keys]), model, reference)


def ensemble_scores(points: DataFrame, model: str = "model", reference: str | None = None) -> DataFrame:
    """The same of points that have their draws as an array (:func:`with_crps`)."""
    points = hold(points.select(model, "__real", "__x", "crps"))
    table = ensemble_wasserstein(points, model).join(points.groupBy(model).agg(F.avg("crps").alias("crps")), model)
    if reference is None:
        return table
    base = F.max(F.when(F.col(model) == reference, F.col("crps"))).over(W.partitionBy(F.lit(1)))  # a row for each model
    return table.withColumn("crpss", 1 - F.col("crps") / base)


def draw_slices(draws: DataFrame, real: str, feature: str, bins: int, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """W1 and CRPS in bins of a covariate of the points. The draws are read once: a point takes them along to its bin."""
    points = ensembles(draws, real, value, keys, [feature])
    cut = hold(sliced(points, feature, bins, keys).select("bin", feature, "__real", "__x", "crps"))
    w = wasserstein(cut.select("bin", F.col("__real").alias("value")), cut.select("bin", F.explode("__x").alias("value")), ["bin"])
    return cut.groupBy("bin").agg(F.count("*").alias("n"), F.avg(feature).alias("f_mid"), F.avg("crps").alias("crps")).join(w, "bin")
