"""Independent targets and mutual nearest-neighbour pairs, scene splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import KEYS, MATCH_COLS, SCENE
from .ranks import ordinal


def with_group_size(df: DataFrame, match: Sequence[str] = MATCH_COLS) -> DataFrame:
    return df.withColumn("group_size", F.count("*").over(W.partitionBy(*match)))


def branch(df: DataFrame, match: Sequence[str] = MATCH_COLS) -> DataFrame:
    """Adds ``branch``: mutual (two rows match), independent (one) or ambiguous (more)."""
    sized = with_group_size(df, match)
    return sized.withColumn("branch", F.when(F.col("group_size") == 2, "mutual").when(F.col("group_size") == 1, "independent").otherwise("ambiguous")).drop("group_size")


def pairs(df: DataFrame, columns: Sequence[str], match: Sequence[str] = MATCH_COLS, symmetric: bool = False, only_mutual: bool = True) -> DataFrame:
    """Rows that match, side by side (``_a``, ``_b``); each pair once with the lower target first, or both ways.

    Null never matches null, as in a join by equality. Mutual rows are groups of two, so each meets the next one of its
    group in a window: the rows are read once and shuffled once, or not at all where they lie in buckets of scenes.
    """
    if only_mutual:
        known, own = " and ".join(f"{c} is not null" for c in match), F.struct("target_id", *columns)
        group = W.partitionBy(*match)
        met = df.where(known).select(*match, own.alias("__a"), F.lead(own).over(group.orderBy("target_id")).alias("__b"), F.count("*").over(group).alias("__size"))
        met = met.where("__size = 2 and __a.target_id < __b.target_id")
        if symmetric:
            met = met.select(*match, F.inline(F.array(F.struct("__a", "__b"), F.struct(F.col("__b").alias("__a"), F.col("__a").alias("__b")))))
        return met.select(*match, *[F.col(f"__{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("target_id", *columns)])
    side = lambda s: df.select(*match, *[F.col(c).alias(f"{c}_{s}") for c in ("target_id", *columns)])
    both = side("a").join(side("b"), list(match))
    return both.where("target_id_a <> target_id_b" if symmetric else "target_id_a < target_id_b")


def reassemble(df: DataFrame, independent: DataFrame, paired: DataFrame, value: str) -> DataFrame:
    """Outcomes of independent rows (KEYS, value) and of pairs (``value_a``, ``value_b``) on the rows of ``df``."""
    sides = F.array(*[F.struct(F.col(f"target_id_{s}").alias("target_id"), F.col(f"{value}_{s}").alias(value)) for s in "ab"])
    flat = paired.select(*SCENE, F.explode(sides).alias("x")).select(*SCENE, "x.*")
    return df.join(independent.select(*KEYS, value).unionByName(flat), list(KEYS), "left")


def partners(paired: DataFrame) -> DataFrame:
    """(scene, target_id, partner_id, slot) of both sides of every pair."""
    sides = F.array(*[F.struct(F.col(f"target_id_{s}").alias("target_id"), F.col(f"target_id_{o}").alias("partner_id"), F.lit(i).alias("slot")) for i, (s, o) in enumerate(("ab", "ba"))])
    return paired.select(*SCENE, F.explode(sides).alias("x")).select(*SCENE, "x.*")


def _share(columns: Sequence[str], salt: str = "split") -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns])), 1, 8)


def is_held_out(columns: Sequence[str] = SCENE) -> Column:
    """A fifth of all scenes (or of other keys): the first 32 bits of an md5 are below 0.2 x 2^32."""
    return _share(columns) < "33333333"


def is_validation(columns: Sequence[str] = SCENE) -> Column:
    """A tenth of all scenes, whatever split they are in: rows that tell a fit when to stop."""
    return _share(columns, "validation") < "1999999a"


def fold(n: int, columns: Sequence[str] = SCENE) -> Column:
    """A fold from 0 to n - 1, the same for all rows of a scene."""
    return (F.conv(_share(columns, "fold"), 16, 10).cast("long") % n).cast("int")


def balanced_folds(df: DataFrame, n: int, scene: Sequence[str] = SCENE) -> DataFrame:
    """(scene, fold): scenes in the order of a hash dealt to ``n`` folds in turn, so folds differ by one scene at most."""
    scenes = df.select(*scene).distinct().withColumn("__h", F.conv(_share(scene, "fold"), 16, 10).cast("long"))
    return ordinal(scenes, "__h", scene).select(*scene, ((F.col("row") - 1) % n).cast("int").alias("fold"))
