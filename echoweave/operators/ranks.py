"""Global ranks without a window over the whole table, and bins of equal mass."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sampled rows for each range that is cut; the sample is all that reaches the driver.
PER_RANGE = 64
#: Copies of inputs that stay cached at most: a result is read after :func:`ordinal` returns, so its copy can't go at once.
HELD = 8
_held: deque[DataFrame] = deque()


def hold(df: DataFrame) -> DataFrame:
    """Cached, for an input that is read several times; the oldest of more than ``HELD`` such copies is released.

    A result whose copy is gone is computed from its sources again, so this changes no rows.
    """
    _held.append(df.persist())
    while len(_held) > HELD:
        _held.popleft().unpersist()
    return df


def release() -> None:
    """Releases all copies."""
    while _held:
        _held.popleft().unpersist()


def ranges(df: DataFrame, buckets: int | None) -> int:
    """Ranges of a value: what is asked for, or as many as the session has shuffle partitions, 32 at least."""
    return buckets or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bisected(df: DataFrame, name: str, ends: Sequence[Column], test: Callable[[Column], Column]) -> DataFrame:
    """Adds ``name``: how many of ``ends`` pass ``test``, which those up to some place all pass and the others do not.

    Halving takes a column for each step, so a row looks at as many ends as their number has binary digits.
    """
    table, out = F.array(*ends), df.withColumn(name, F.lit(0))
    for i in reversed(range(len(ends).bit_length())):
        # beyond the last end there is null, which doesn't pass
        out = out.withColumn(name, F.col(name) + F.when(test(F.get(table, F.col(name) + (2**i - 1))), 2**i).otherwise(0))
    return out


def dealt(df: DataFrame, value: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Adds ``__b``, the number of a range in the order of (value, keys), and ``__hot``: the range holds one value alone.

    Ranges end at rows of a sample, between values. Only a value that would fill more than one range gets ranges of its
    own, cut by the keys, so that even a constant column spreads. Where the ranges end changes no result.
    """
    columns = [value, *keys]
    share = min(1.0, PER_RANGE * buckets / max(df.count(), 1))
    rows = df.select(*columns) if share == 1.0 else df.select(*columns).sample(share, 1)
    # sorted by Spark, so that cuts follow its order of nulls, NaN and text
    sample = rows.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("x")).first()["x"]
    step = max(1, len(sample) // buckets)
    cuts = sample[step::step]
    same = lambda a, b: a == b or (a != a and b != b)
    hot = [same(r[0], q[0]) for r, q in zip(cuts, [*cuts[1:], *cuts[:1]], strict=True)]
    hot = [(h and len(cuts) > 1) or (i > 0 and same(r[0], cuts[i - 1][0])) for i, (h, r) in enumerate(zip(hot, cuts, strict=True))]
    literal = lambda x, c: F.lit(x).cast(df.schema[c].dataType)
    at = F.col(value)
    ends = [literal(r[0], value) for i, r in enumerate(cuts) if r[0] is not None and not (i and same(r[0], cuts[i - 1][0]))]
    single = [literal(r[0], value) for i, (r, h) in enumerate(zip(cuts, hot, strict=True)) if h and r[0] is not None and not (i and same(r[0], cuts[i - 1][0]))]
    inner = [F.struct(*[literal(x, c).alias(c) for x, c in zip(r, columns, strict=True)]) for r, h in zip(cuts, hot, strict=True) if h]
    tests = (("__ends", ends, lambda e: at >= e), ("__single", single, lambda e: at > e), ("__inner", inner, lambda e: F.struct(*columns) >= e))
    rows, number = df, at.isNotNull().cast("int")
    for name, some, test in tests:
        if some:
            rows, number = bisected(rows, name, some, test), number + F.col(name)
    alone = F.exists(F.array(*single), lambda e: at == e) if single else F.lit(False)
    return rows.withColumns({"__b": number, "__hot": at.isNull() | alone}).drop("__ends", "__single", "__inner")


def ordinal(df: DataFrame, value: str, keys: Sequence[str], by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Adds ``row`` (1 for the least value; ties by keys), ``rank`` (ties share the least) and ``n``, in each group of ``by``.

    Rows are dealt into ranges of (value, keys); only counts of ranges leave them, and windows run within a range. Null
    values stand first. Ties of one value that fill several ranges have the rank of the first.
    """
    rows = dealt(hold(df), value, keys, ranges(df, buckets))
    # ranges of one hot value are one step of the ranks
    sizes = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    own, order = W.partitionBy(*by), W.partitionBy(*by).orderBy("__b")
    sizes = sizes.withColumns({"__before": F.sum("__c").over(order) - F.col("__c"), "n": F.sum("__c").over(own)})
    sizes = sizes.withColumn("__start", F.min("__before").over(W.partitionBy(*by, "__low", "__high"))).drop("__c", "__low", "__high")
    inside = W.partitionBy(*by, "__b").orderBy(value, *keys)
    ties = W.partitionBy(*by, "__b").orderBy(value)
    joined = rows.join(sizes if by else F.broadcast(sizes), [*by, "__b"])
    rank = F.when(F.col("__hot"), F.col("__start") + 1).otherwise(F.rank().over(ties) + F.col("__before"))
    return joined.withColumns({"row": F.row_number().over(inside) + F.col("__before"), "rank": rank}).drop("__b", "__hot", "__before", "__start")


def tile(k: int, row: Column | str = "row") -> Column:
    """SQL's ntile: the first bins are larger if n is no multiple of k."""
    r, n = F.col(row) if isinstance(row, str) else row, F.col("n")
    small = F.floor(n / k)
    large = n - small * k
    return F.when(r <= large * (small + 1), F.floor((r - 1) / (small + 1))).otherwise(large + F.floor((r - 1 - large * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")


def edge_bin(k: int, row: Column | str = "row") -> Column:
    """The bin of a row if bins end at the rounded (half to even) multiples of n / k."""
    at = (F.col(row) if isinstance(row, str) else row) - 1
    guess = F.floor(at * k / F.col("n"))
    edge = lambda b: F.rint(b * F.col("n") / k)
    return F.when(at < edge(guess), guess - 1).when(at >= edge(guess + 1), guess + 1).otherwise(guess).cast("int")
