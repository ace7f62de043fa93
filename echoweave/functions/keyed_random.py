"""Random columns drawn from keys: independent of partitions and retries, and equal on any engine that has md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str, *key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of seed, salt and key."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hashed(salt: str, *key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from 53 bits of Spark's own hash of seed, salt and whole-numbered keys: far cheaper than :func:`uniform`, for draws that no other engine repeats."""
    mixed = F.xxhash64(F.lit(salt), F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("long") for k in key])
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(2**53))


def normal(salt: str, *key: Column | str, seed: int = 42) -> Column:
    """A standard normal number by Box and Muller."""
    u, v = uniform(salt + "1", *key, seed=seed), uniform(salt + "2", *key, seed=seed)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def categorical(probabilities: Sequence[Column], u: Column) -> Column:
    """The class whose share of the cumulative probabilities holds u; rounding at the end falls into the last class."""
    total, drawn = F.lit(0.0), F.lit(0)
    for p in probabilities[:-1]:
        total = total + p
        drawn = drawn + (total <= u).cast("int")
    return drawn
