"""Intervals by resampling whole scenes, and permutations of labels.

A replicate draws as many scenes as there are, with replacement. Scenes are numbered and cut into strata; a replicate
first draws how often each stratum is hit (only counts leave the tasks that draw), then each stratum draws among its
own scenes. So a scene's weights in all replicates are made where its rows are, as one array, and no row is ever
repeated for a replicate. All statistics of one :class:`Resamples` share its draws.

* :meth:`Resamples.sums`: weighted sums of any columns. A statistic is any expression of them.
* :meth:`Resamples.ranked`: AUROC, Brier score and Murphy parts. Equal scores are added up first, then ranges of the score are swept
  in order with arrays of running sums, one number for each replicate; nothing is sorted again for a replicate.
* :meth:`Resamples.wasserstein`: the same sweep for the area between two distribution functions.

Draws are integers mixed from keys, equal on every engine and partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS, SCENE
from .ranks import PER_RANGE, hold, ordinal, ranges
from .scores import ensembles, value_ranges

#: Least scenes of a stratum, and most strata.
STRATUM, STRATA = 512, 16384
_MASK, _GOLDEN, _MIX = np.uint64(0xFFFFFFFF), np.uint64(2654435769), np.uint64(0x45D9F3B)


def draw(stage: int, replicate: int, stratum: int, i: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Numbers below ``size``, for each i one: 32 bits of a key, moved on by i, mixed and scaled."""
    base = np.uint64(int(hashlib.md5(f"{seed}|resample{stage}|{replicate}|{stratum}".encode()).hexdigest()[:8], 16))
    x = (base + i.astype(np.uint64) * _GOLDEN) & _MASK
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * _MIX) & _MASK
    x = (x >> np.uint64(16)) ^ x
    return ((x * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def packed(weights: np.ndarray) -> list[bytes]:
    """A row's weights as bytes: two in a byte where all are below 16 (nearly always, as they are counts of about 1), else four bytes each."""
    n, replicates = weights.shape
    small = np.zeros((n, replicates + replicates % 2), np.uint8)
    small[:, :replicates] = np.minimum(weights, 15)
    pairs = small[:, ::2] | (small[:, 1::2] << 4)
    large = weights.max(axis=1, initial=0) > 15
    return [w.astype("<i4").tobytes() if big else own.tobytes() for w, own, big in zip(weights, pairs, large, strict=True)]


def unpacked(rows: Sequence[bytes], replicates: int) -> np.ndarray:
    """What :func:`packed` was given."""
    size = -(-replicates // 2)
    out, small = np.zeros((len(rows), replicates), np.int64), np.array([len(x) == size for x in rows], bool)
    pairs = np.frombuffer(b"".join([x for x in rows if len(x) == size]), np.uint8).reshape(-1, size)
    out[small] = np.stack([pairs & 15, pairs >> 4], axis=2).reshape(len(pairs), 2 * size)[:, :replicates]
    out[~small] = np.frombuffer(b"".join([x for x in rows if len(x) != size]), "<i4").reshape(-1, replicates)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes as binary values, copied once as a whole."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(rows.tobytes())])


def _table(column: pa.Array, replicates: int) -> np.ndarray:
    """A column of :func:`packed` weights, a row each; read in place where all are of two in a byte."""
    n, size = len(column), -(-replicates // 2)
    if n and column.type == pa.binary():
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        if (np.diff(ends) == size).all():
            pairs, out = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, size), np.empty((n, 2 * size), np.uint8)
            np.bitwise_and(pairs, 15, out=out[:, ::2])
            np.right_shift(pairs, 4, out=out[:, 1::2])
            return out[:, :replicates]
    return unpacked(column.to_pylist(), replicates)


#: Strata in a task at most, and numbers that a sweep works on at once, so that its arrays stay in a core's cache.
TASK_STRATA, _CELLS = 32, 262_144


class Resamples:
    """``replicates`` resamples of the scenes of ``df``; with ``observed`` also replicate -1, which has every scene once."""

    def __init__(self, df: DataFrame, replicates: int, scene: Sequence[str] = SCENE, seed: int = 42, observed: bool = False):
        self.replicates, self.scene, self.seed, self.observed = replicates, list(scene), seed, observed
        self.numbers = np.array([*range(replicates), *([-1] if observed else [])], np.int32)
        numbered = ordinal(df.select(*scene).distinct(), scene[-1], scene).select(*scene, (F.col("row") - 1).alias("__j"))
        self.scenes = numbered.agg(F.count("*")).first()[0]
        self.stratum = max(STRATUM, -(-self.scenes // STRATA))
        # every statistic joins the numbers and reads the hits
        self.numbered = hold(numbered.select(*scene, F.floor(F.col("__j") / self.stratum).cast("int").alias("__s"), (F.col("__j") % self.stratum).cast("int").alias("__i")))
        self.hits = hold(self._hits(df))

    def _hits(self, df: DataFrame) -> DataFrame:
        """(__s, __hits): for each stratum how many draws it gets in every replicate, four bytes each."""
        scenes, size, replicates, seed = self.scenes, self.stratum, self.replicates, self.seed
        strata = -(-scenes // size)

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((replicates, strata), np.int32)
            for batch in batches:
                i = batch.column("id").to_numpy()
                for b in range(replicates):
                    found[b] += np.bincount(draw(1, b, 0, i, scenes, seed) // size, minlength=strata).astype(np.int32)
            own = np.flatnonzero(found.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([found[:, s].tobytes() for s in own], pa.binary())], names=["__s", "__hits"])

        def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, hits in zip(batch.column("__s").to_pylist(), batch.column("__hits").to_pylist(), strict=True):
                    sums[s] = sums.get(s, 0) + np.frombuffer(hits, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["__s", "__hits"])

        schema = "__s int, __hits binary"
        return df.sparkSession.range(scenes).mapInArrow(count, schema).repartition("__s").mapInArrow(total, schema)

    def _weighted(self, rows: DataFrame, schema: str, use: Callable, end: Callable | None = None) -> DataFrame:
        """``use(state, batch, weights, at)`` on rows that have ``__s`` and ``__i``; row n of the batch has the weights ``weights[at[n]]``.

        ``state`` is a dict of the task, which ``end(state)`` sees after all its rows.
        """
        scenes, size, replicates, width, seed = self.scenes, self.stratum, self.replicates, len(self.numbers), self.seed
        names = [c for c in rows.columns if c not in ("__s", "__i")]
        head = self.hits.select("__s", F.lit(-1).alias("__i"), "__hits", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in names])
        both = rows.withColumn("__hits", F.lit(None).cast("binary")).unionByName(head)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, weights, state = None, None, {}
            for batch in batches:
                stratum, local = batch.column("__s").to_numpy(), batch.column("__i").to_numpy()
                cuts = [*_runs(stratum).tolist(), len(stratum)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    s = int(stratum[a])
                    if s != now:
                        # the hits of a stratum stand before its rows; one that is never drawn has none
                        now, here = s, min(size, scenes - s * size)
                        weights = np.ones((here, width), np.int32)  # a column beyond the replicates stays as it is: every scene once
                        weights[:, :replicates] = 0
                        if local[a] == -1:
                            hits = np.frombuffer(batch.column("__hits")[a].as_py(), np.int32)
                            for k in range(replicates):
                                weights[:, k] = np.bincount(draw(2, k, s, np.arange(hits[k]), here, seed), minlength=here)
                            a += 1
                    if b > a:
                        yield from use(state, batch.slice(a, b - a), weights, local[a:b])
            if end:
                yield from end(state)

        strata = -(-scenes // size) or 1
        tasks = min(strata, max(ranges(rows, None), -(-strata // TASK_STRATA)))
        return both.repartition(tasks, "__s").sortWithinPartitions("__s", "__i").mapInArrow(run, schema)

    def _groups(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.withColumn("__g", F.xxhash64(*by) if by else F.lit(0).cast("long"))

    def _named(self, found: DataFrame, df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
        if not by:
            return found.select("b", *columns)
        return found.join(F.broadcast(df.select("__g", *by).distinct()), "__g").select(*by, "b", *columns)

    def sums(self, df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
        """(by, b, a column for each of ``values``): their sums over the rows of every replicate; nulls add nothing."""
        names, numbers = list(values), self.numbers
        own = self._groups(df, by)
        each = own.groupBy(*self.scene, "__g").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("double").alias(n) for n, v in values.items()])
        rows = each.join(self.numbered, self.scene).select("__s", "__i", "__g", F.array(*names).alias("x"))

        def use(state: dict, batch: pa.RecordBatch, weights: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, g = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(names)), batch.column("__g").to_numpy()
            for k in np.unique(g):
                state[k] = state.get(k, 0) + weights[at[g == k]].T.astype(float) @ x[g == k]
            return iter(())

        def end(state: dict) -> Iterator[pa.RecordBatch]:
            for k, total in state.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), k)), pa.array(numbers), *[pa.array(total[:, i].copy()) for i in range(len(names))]], names=["__g", "b", *names])

        parts = self._weighted(rows, "__g long, b int, " + ", ".join(f"`{n}` double" for n in names), use, end)
        return self._named(parts.groupBy("__g", "b").agg(*[F.sum(n).alias(n) for n in names]), own, by, names)

    def _swept(self, df: DataFrame, value: str, first: Column, by: Sequence[str], names: Sequence[str], finish: Callable) -> DataFrame:
        """(__g, b, names): sums of what ``finish(v, following, a, c, before_a, before_c, total_a, total_c)`` gives for distinct values in order.

        ``a`` and ``c`` have a row for each replicate and a column for each value: the weights of rows with and without
        ``first``; before: their sums over all lower values. It returns a row for each replicate, a column for each name.
        """
        numbers, width = self.numbers, len(self.numbers)
        buckets = ranges(df, None)
        known = df.where(F.col(value).isNotNull())
        share = min(1.0, PER_RANGE * buckets / max(known.count(), 1))
        sample = sorted(r[0] for r in known.select(F.col(value).cast("double")).sample(share, 1).collect())
        cuts = np.unique(np.array(sample[:: max(1, len(sample) // buckets)][1:], float))  # where ranges end changes no result
        rows = known.join(self.numbered, self.scene).select("__s", "__i", "__g", F.col(value).cast("double").alias("v"), first.cast("boolean").alias("k"))

        def combine(state: dict, batch: pa.RecordBatch, weights: np.ndarray, local: np.ndarray) -> Iterator[pa.RecordBatch]:
            g, v, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__g", "v", "k"))
            order = np.lexsort((k, v, g))
            g, v, k = g[order], v[order], k[order].astype(bool)
            at = _runs(g, v, k)
            if state.get("of") is not weights:  # once for a stratum
                state["of"], state["bytes"] = weights, None if weights.max(initial=0) > 15 else np.frombuffer(b"".join(packed(weights)), np.uint8).reshape(len(weights), -1)
            if len(at) == len(v) and state["bytes"] is not None:
                w = _binary(state["bytes"][local[order]])
            else:
                w = pa.array(packed(np.add.reduceat(weights[local[order]], at, axis=0)), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(v[at]), pa.array(k[at]), w, pa.array(np.searchsorted(cuts, v[at], side="right").astype(np.int32))], names=["__g", "v", "k", "w", "r"])

        one = self._weighted(rows, "__g long, v double, k boolean, w binary, r int", combine)
        # held once, read by both sweeps; the number of tasks is given, as a row stands for all its replicates
        ordered = one.repartition(buckets, "__g", "r").sortWithinPartitions("__g", "r", "v").persist()

        def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            """((g, r), v, k, weights) of pieces of a range, in order."""
            for batch in batches:
                g, r, v, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__g", "r", "v", "k"))
                cut, step, w = [*_runs(g, r).tolist(), len(g)], max(1, _CELLS // width), batch.column("w")
                for a, b in zip(cut, cut[1:], strict=False):
                    for i in range(a, b, step):
                        j = min(b, i + step)
                        yield (int(g[a]), int(r[a])), v[i:j], k[i:j].astype(bool), _table(w.slice(i, j - i), width)

        def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple, list] = {}
            for key, v, k, w in runs(batches):
                old = found.setdefault(key, [v[0], np.zeros(width, np.int64), np.zeros(width, np.int64)])
                old[1] += w[k].sum(axis=0, dtype=np.int64)
                old[2] += w[~k].sum(axis=0, dtype=np.int64)
            for (g, r), (least, a, c) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([r], pa.int32()), pa.array([least], pa.float64()), pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["__g", "r", "least", "a", "c"])

        # one row of sums for each group and range: the sums of all lower ranges go to the tasks by themselves
        parts = {(x["__g"], x["r"]): x for x in ordered.mapInArrow(totals, "__g long, r int, least double, a binary, c binary").collect()}
        whole = {g: [np.zeros(width, np.int64), np.zeros(width, np.int64)] for g, _ in parts}
        heads, last = {}, {}
        for g, r in sorted(parts):
            x = parts[g, r]
            heads[g, r] = [*whole[g], None]
            if g in last:
                heads[last[g]][2] = x["least"]
            whole[g], last[g] = [t + np.frombuffer(bytes(x[c]), np.int64) for t, c in zip(whole[g], "ac", strict=True)], (g, r)
        shared = df.sparkSession.sparkContext.broadcast((heads, whole))

        def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, a0, c0, following, sums, whole_ = None, None, None, None, None, 0, None

            def done(v, after, a, c) -> None:
                nonlocal a0, c0, sums
                sums = sums + finish(v, after, a, c, a0, c0, *whole_)
                a0, c0 = a0 + a.sum(axis=1), c0 + c.sum(axis=1)

            def close() -> Iterator[pa.RecordBatch]:
                if now is not None:
                    v, a, c = held
                    done(np.array([v]), np.array([v if following is None else following]), a[:, None], c[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(width, now[0])), pa.array(numbers), *[pa.array(sums[:, i].copy()) for i in range(len(names))]], names=["__g", "b", *names])

            for key, v, k, w in runs(batches):
                if key != now:
                    yield from close()
                    now, held, sums = key, None, 0
                    (a0, c0, following), whole_ = shared.value[0][key], shared.value[1][key[0]]
                w, at = np.ascontiguousarray(w.T).astype(np.int64), _runs(v)
                a = w * k
                c = w - a
                if len(at) < len(v):
                    v, a, c = v[at], np.add.reduceat(a, at, axis=1), np.add.reduceat(c, at, axis=1)
                if held:
                    old, ha, hc = held
                    if old == v[0]:
                        a[:, 0] += ha
                        c[:, 0] += hc
                    else:
                        v, a, c = np.append(old, v), np.hstack([ha[:, None], a]), np.hstack([hc[:, None], c])
                if len(v) > 1:
                    done(v[:-1], v[1:], a[:, :-1], c[:, :-1])
                held = v[-1], a[:, -1].copy(), c[:, -1].copy()
            yield from close()

        swept = ordered.mapInArrow(sweep, "__g long, b int, " + ", ".join(f"{n} double" for n in names))
        found = hold(swept.groupBy("__g", "b").agg(*[F.sum(n).alias(n) for n in names]))
        found.count()  # made now, so that the rows it came from can go
        ordered.unpersist()
        return found

    def ranked(self, df: DataFrame, p: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
        """(by, b, brier, auroc, reliability, resolution, uncertainty); AUROC is null in replicates that lack a class. ``y`` is 0 or 1."""
        own = self._groups(df, by)

        def finish(v, following, a, c, before_a, before_c, total_a, total_c) -> np.ndarray:
            n, big, sum_a = a + c, total_a + total_c, np.cumsum(a, axis=1)
            sum_n = np.cumsum(n, axis=1)
            below = before_c[:, None] + sum_n - sum_a - c
            place = (before_a + before_c)[:, None] + sum_n - n
            edges = np.rint(np.arange(1, bins) * big[:, None] / bins)
            # places grow along a row, so the rows of a bin lie side by side
            inner = [np.searchsorted(place[i], edges[i]) for i in range(len(n))]
            ends = np.hstack([np.zeros((len(n), 1), np.int64), np.array(inner, np.int64).reshape(len(n), bins - 1), np.full((len(n), 1), n.shape[1])])
            each = [np.diff(np.take_along_axis(np.hstack([np.zeros((len(n), 1)), x]), ends, axis=1), axis=1) for x in (sum_n, np.cumsum(n * v, axis=1), sum_a)]
            u = (a * (below + c / 2)).sum(axis=1)
            return np.column_stack([*each, u, a @ ((1 - v) ** 2) + c @ (v * v)])

        names = [[f"{x}{i}" for i in range(bins)] for x in ("n", "sp", "sy")]
        swept = self._swept(own, p, F.col(y) == 1, by, [*names[0], *names[1], *names[2], "u", "e"], finish)
        total = lambda xs: sum(xs[1:], xs[0])
        n, sp, sy = ([F.col(x) for x in xs] for xs in names)
        in_bins = lambda f: total([F.when(n[i] > 0, f(i)).otherwise(0.0) for i in range(bins)])
        whole = swept.select("__g", "b", "u", "e", total(n).alias("m"), total(sy).alias("pos"), in_bins(lambda i: (sp[i] - sy[i]) * (sp[i] - sy[i]) / n[i]).alias("g2"), in_bins(lambda i: sy[i] * sy[i] / n[i]).alias("r2"))
        o, neg = F.try_divide("pos", "m"), F.col("m") - F.col("pos")
        stats = whole.select("__g", "b", F.try_divide("e", "m").alias("brier"), F.when((F.col("pos") > 0) & (neg > 0), F.col("u") / (F.col("pos") * neg)).alias("auroc"), F.try_divide("g2", "m").alias("reliability"), (F.try_divide("r2", "m") - o * o).alias("resolution"), (o * (1 - o)).alias("uncertainty"))
        return self._named(stats, own, by, ["brier", "auroc", "reliability", "resolution", "uncertainty"])

    def wasserstein(self, values: DataFrame, value: str, real: str, by: Sequence[str] = ()) -> DataFrame:
        """(by, b, w1): W1 between the rows with and without ``real`` of every replicate; null where one is empty."""
        own = self._groups(values, by)

        def finish(v, following, a, c, before_a, before_c, total_a, total_c) -> np.ndarray:
            with np.errstate(invalid="ignore", divide="ignore"):
                gap = np.abs((before_a[:, None] + np.cumsum(a, axis=1)) / total_a[:, None] - (before_c[:, None] + np.cumsum(c, axis=1)) / total_c[:, None])
            return (gap @ (following - v))[:, None]

        swept = self._swept(own, value, F.col(real), by, ["w1"], finish)
        return self._named(swept.withColumn("w1", F.when(~F.isnan("w1"), F.col("w1"))), own, by, ["w1"])


def intervals(stats: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(by, metric, low, high): quantiles of each metric over the replicates that have it."""
    long = stats.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy(*by, "metric").agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))


#: Values whose sums are taken at once, so that their arrays stay in a core's cache.
_SUMMED = 16_384


def subset(rng: np.random.Generator, rows: int, chosen: int) -> np.ndarray:
    """``rows`` labels of which ``chosen`` are 1, all such rows of labels equally likely.

    Each label is drawn from a byte, then as many random ones as are too many are taken back (or added): given their
    number, independent labels are such a subset, and so is what is left.
    """
    drawn = rng.bit_generator.random_raw(-(-rows // 8)).view(np.uint8)[:rows]
    labels = (drawn < round(256 * chosen / max(1, rows))).view(np.uint8)
    ones = int(np.count_nonzero(labels))
    side, left = int(ones > chosen), abs(ones - chosen)
    while left:
        # in the order of the draws, each place once
        at = rng.integers(0, rows, int((left + 8) * rows / max(1, ones if side else rows - ones)) + 1)
        at = at[np.sort(np.unique(at, return_index=True)[1])]
        at = at[labels[at] == side][:left]
        labels[at] = 1 - side
        left -= len(at)
        ones += len(at) * (1 - 2 * side)
    return labels


def permuted_anderson_darling(df: DataFrame, p: str, y: str, permutations: int, seed: int = 42) -> DataFrame:
    """(statistic, p_value): the two-sample Anderson-Darling test with labels dealt anew ``permutations`` times.

    Only distinct scores and their counts are permuted, never rows: the positive labels are first split over ranges of
    the score, then over the values of a range, both hypergeometrically. A range sums its part of the statistic of
    every permutation; permutation -1 is the observed one.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("v")).agg(F.sum(y).cast("long").alias("pos"), F.count("*").alias("l")).persist()
    buckets = ranges(df, None)
    placed = value_ranges(counts, "v", "r", buckets)
    sizes = {r["r"]: (r["l"], r["pos"]) for r in placed.groupBy("r").agg(F.sum("l").alias("l"), F.sum("pos").alias("pos")).collect()}
    order = sorted(sizes)
    large, own = np.array([sizes[r][0] for r in order], np.int64), np.array([sizes[r][1] for r in order], np.int64)
    n, a = int(large.sum()), int(own.sum())

    def part(pos: np.ndarray, before: int, weight: np.ndarray, middle: np.ndarray) -> float:
        """A range's part of the statistic; ``before``: positive labels of all lower ranges, ``middle``: twice those expected at or below a value."""
        total, carry = 0.0, 2 * before
        for i in range(0, len(pos), _SUMMED):
            labels = pos[i : i + _SUMMED]
            gap = np.cumsum(labels, dtype=np.float64)
            ones = int(gap[-1])
            gap += gap
            gap -= labels
            gap += carry
            gap -= middle[i : i + _SUMMED]
            total, carry = total + float(np.dot(weight[i : i + _SUMMED] * gap, gap)), carry + 2 * ones
        return total

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("v")
        at = order.index(key[0].as_py())
        pos, l = t.column("pos").to_numpy(), t.column("l").to_numpy()  # noqa: E741
        below = int(large[:at].sum()) + np.cumsum(l) - l / 2
        # of the other sample the gap is the same with the other sign; a value of all rows counts nothing
        spread = below * (n - below) - n * l / 4
        weight = np.divide(l / n * (1 / a + 1 / (n - a)) * (n / 2) ** 2, spread, out=np.zeros(len(l)), where=l < n)
        middle = 2 * a * below / n
        terms, rows = [part(pos, int(own[:at].sum()), weight, middle)], int(l.sum())
        for b in range(permutations):
            split = np.random.default_rng([seed, b]).multivariate_hypergeometric(large, a, method="marginals")
            own_draws = np.random.default_rng([seed, b, at])
            if rows <= 4 * len(l):  # few ties: rows are drawn
                inner = subset(own_draws, rows, int(split[at]))
                inner = inner if rows == len(l) else np.add.reduceat(inner, np.cumsum(l) - l, dtype=np.int64)
            else:
                inner = own_draws.multivariate_hypergeometric(l, int(split[at]), method="marginals")
            terms.append(part(inner, int(split[:at].sum()), weight, middle))
        return pa.table({"b": pa.array(np.arange(-1, permutations)), "term": pa.array(terms)})

    if not 0 < a < n:
        counts.unpersist()
        return df.sparkSession.createDataFrame([(None, None)], "statistic double, p_value double")
    # each distinct score once: a range holds about as many values as the others
    each = placed.repartition(buckets, "r").groupBy("r").applyInArrow(run, "b long, term double").groupBy("b").agg((F.lit((n - 1) / n) * F.sum("term")).alias("s"))
    found = each.agg(F.max(F.when(F.col("b") == -1, F.col("s"))).alias("statistic"), F.collect_list(F.when(F.col("b") >= 0, F.col("s"))).alias("null")).persist()
    found.count()
    counts.unpersist()
    at_least = F.size(F.filter("null", lambda x: x >= F.col("statistic") - 1e-9 * F.abs("statistic")))
    return found.select("statistic", ((1 + at_least) / (1 + F.size("null"))).alias("p_value"))


def _with_intervals(stats: DataFrame, metrics: Sequence[str], by: Sequence[str], alpha: float) -> DataFrame:
    """(by, metric, value, low, high): the value of replicate -1, which has every scene once, and the interval of the others."""
    long = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return stats.where("b = -1").select(*by, long).join(intervals(stats.where("b >= 0"), metrics, by, alpha), [*by, "metric"], "left").select(*by, "metric", "value", "low", "high")


def branch_intervals(points: DataFrame, joint: DataFrame, p: str, y: str, mutual: str, outcomes: Sequence[str], score: str, bins: int, resamples: Resamples, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(by, branch, metric, value, low, high): the branch metrics of points and the joint Brier score of pairs, with intervals.

    ``resamples`` has the observed replicate, so values and intervals come from one sweep of the points.
    """
    at = [*by, "branch"]
    own = points.withColumn("branch", F.explode(F.array(F.when(F.col(mutual), "mutual").otherwise("non_mutual"), F.lit("pooled"))))
    off = [(F.col(o) - (F.col(score) == i).cast("int")) ** 2 for i, o in enumerate(outcomes)]
    pair = {"n": F.lit(1), "e": sum(off[1:], off[0])}
    paired = resamples.sums(joint, pair, by).withColumn("brier_joint", F.try_divide("e", "n")).withColumn("branch", F.lit("mutual"))
    found = _with_intervals(resamples.ranked(own, p, y, bins, at), ("brier", "reliability", "resolution", "uncertainty", "auroc"), at, alpha)
    return found.unionByName(_with_intervals(paired, ("brier_joint",), at, alpha))


def draw_intervals(draws: DataFrame, real: str, resamples: Resamples, value: str = "value", model: str = "model", reference: str | None = None, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """(model, metric, value, low, high): W1, mean CRPS and CRPS skill of each model's draws, all on the same resamples.

    The draws are read once: a point keeps its own as an array. ``resamples`` has the observed replicate.
    """
    metrics = ["w1", "crps", *(["crpss"] if reference else [])]
    points = hold(ensembles(draws, real, value, [model, *keys]).select(model, *resamples.scene, "__real", "__x", "crps"))
    sums = resamples.sums(points, {"n": F.col("crps").isNotNull().cast("int"), "c": F.col("crps")}, [model]).withColumn("crps", F.try_divide("c", "n"))
    if reference:
        base = sums.where(F.col(model) == reference).select("b", F.col("crps").alias("base"))
        sums = sums.join(F.broadcast(base), "b", "left").withColumn("crpss", 1 - F.try_divide("crps", "base"))
    one = lambda x, own: F.struct(x.alias("x"), F.lit(own).alias("real"))
    both = points.select(model, *resamples.scene, F.inline(F.concat(F.array(one(F.col("__real"), True)), F.transform("__x", lambda x: one(x, False)))))
    return _with_intervals(sums.join(resamples.wasserstein(both, "x", "real", [model]), [model, "b"]), metrics, [model], alpha)
