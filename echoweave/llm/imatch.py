"""I-Match document fingerprints, with DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band (so their inverse document frequency does). A
document keeps its lexicon terms, sorts the distinct ones (by their 64-bit hashes, which stand for them), and hashes the
sorted list of those in each of several randomised subsets of the lexicon: a term is in a subset if random bits of its
hash say so, at the subset's rate. Subsets come at several rates, as a
long document needs thin ones for some to survive an edit and a short one needs thick ones.

The lexicon is bounded whatever the corpus: the frequencies of all terms sum to at most (distinct terms of a document,
on average) x documents, so at most (that average / ``low``) terms have a share of ``low`` or more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partitions_for

#: 1 / rate of the subsets, one scale each, and the subsets of a scale.
RATES: tuple[int, ...] = (2, 8, 32, 128, 512)
SUBSETS = 8
LOW, HIGH = 0.0005, 0.2
#: Most lexicon terms that are sent to every executor; a larger lexicon is joined by shuffle.
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    """Distinct words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), ""))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, min_docs: int = 2) -> DataFrame:
    """``(h)``: 64-bit hashes of the terms in at least max(``min_docs``, low x documents) and at most high x documents."""
    total = docs.count()
    found = docs.select(F.explode(F.transform(terms(F.col(text)), lambda t: F.xxhash64(t))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return found.where((F.col("df") >= max(min_docs, low * total)) & (F.col("df") <= max(min_docs, high * total))).select("h")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many first code points of the following one (or all of it)."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


#: Ranges of keys, one task of a window each. Bounded, as their borders pass through the driver.
MAX_BUCKETS = 1024


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys(k, n)`` with distinct k to (k, next_k, prev_k, prev_n) by ascending k; the last one's next is the first.

    Windows run within ranges of the key; where the ranges end (quantiles) changes no result.
    """
    spark, parts = keys.sparkSession, partitions_for(keys.sparkSession, keys.count(), 200_000)
    parts = min(parts, MAX_BUCKETS)
    splits = sorted(set(keys.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    edges = F.array(*[F.lit(float(x)) for x in splits]) if splits else F.array().cast("array<double>")
    keyed = keys.withColumn("bucket", F.size(F.filter(edges, lambda e: F.col("k") > e)).cast("int"))
    ends = keyed.groupBy("bucket").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("n", "k").alias("last_n")).orderBy("bucket").collect()
    around = [(x["bucket"], ends[(i + 1) % len(ends)]["first"], ends[i - 1]["last"], ends[i - 1]["last_n"]) for i, x in enumerate(ends)]
    kind = dict(keys.dtypes)["k"]
    borders = spark.createDataFrame(around, f"bucket int, after {kind}, before {kind}, before_n int")
    order = W.partitionBy("bucket").orderBy("k")
    near = keyed.select("bucket", "k", F.lead("k").over(order).alias("n_k"), F.lag("k").over(order).alias("p_k"), F.lag("n").over(order).alias("p_n"))
    return near.join(F.broadcast(borders), "bucket", "left").select("k", F.coalesce("n_k", "after").alias("next_k"), F.coalesce("p_k", "before").alias("prev_k"), F.coalesce("p_n", "before_n").alias("prev_n"))


def _drawn(h: Column) -> Column:
    """The subsets that have a term, one bit each, by random bits of it (8 subsets of a scale from one hash)."""
    out = F.lit(0).cast("long")
    for scale, rate in enumerate(RATES):
        bits = rate.bit_length() - 1
        for k in range(SUBSETS):
            mine = F.shiftrightunsigned(F.xxhash64(h, F.lit(scale)), (k * bits) % (64 - bits)).bitwiseAND(F.lit(rate - 1)) == 0
            out = out.bitwiseOR(F.when(mine, F.lit(1 << (scale * SUBSETS + k)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _list(subset: int, drawn: str) -> Column:
    """The terms of a subset; ``drawn`` has its bit if the term is in it and on the side in question."""
    return F.collect_list(F.when(F.col(drawn).bitwiseAND(F.lit(1 << subset).cast("long")) != 0, F.col("h")))


def _hashes(text: str) -> Column:
    return F.transform(terms(F.col(text)), lambda t: F.xxhash64(t))


def _tag(side: int):
    return lambda h: F.struct(h.alias("h"), F.lit(side).alias("side"))


def _digest(lists: Sequence[str]) -> Column:
    """Eight hex digits of the hash of each subset's sorted list, dots for one without terms."""
    digits = lambda c: F.lpad(F.lower(F.hex(F.xxhash64(F.sort_array(c)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.concat(*[F.when(F.size(c) == 0, F.lit("........")).otherwise(digits(c)) for c in lists])


def likeness(a: Column, b: Column, size: int = SUBSETS, rates: int = len(RATES)) -> Column:
    """0 to 1: over the scales, the largest share of equal subsets among those that have terms on either side.

    A scale counts if two subsets or more have terms. Fingerprints without lexicon terms are alike if equal.
    """
    part = lambda text, i: F.substring(text, i * 8 + 1, F.lit(8))

    def share(scale: int) -> Column:
        places = F.sequence(F.lit(scale * size), F.lit((scale + 1) * size - 1))
        full = F.filter(places, lambda i: (part(a, i) != "........") | (part(b, i) != "........"))
        same = F.size(F.filter(full, lambda i: part(a, i) == part(b, i)))
        return F.when(F.size(full) >= 2, same / F.size(full)).otherwise(F.lit(0.0))

    best = [share(scale) for scale in range(rates)]
    plain = F.startswith(a, F.lit("-")) | F.startswith(b, F.lit("-"))
    return F.when(a == b, F.lit(1.0)).when(plain, F.lit(0.0)).otherwise(F.greatest(*best))


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, and how alike neighbours are.

    Null texts count as empty; a text without lexicon terms, as an empty one, has the hash of its whole as
    fingerprint. Rows without a key are left out; of rows that share a key the greatest text stays. Columns: key,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = lexicon(own, "t", low, high)
    words = materialise(words)
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    links = materialise(neighbours(own.groupBy("k").agg(F.max(F.length("t")).alias("n"))))
    spread = own.join(links, "k").groupBy("k", "next_k", "prev_k", "prev_n").agg(F.max("t").alias("t"))
    # what the document before needs of this one: not more than a quarter of its own length
    heads = spread.select(F.col("prev_k").alias("k"), F.substring("t", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"))
    rows = spread.join(heads, "k").select("k", "next_k", "t", edited(F.col("t"), F.col("head")).alias("e"))
    found = rows.select("k", _hashes("t").alias("a"), _hashes("e").alias("b"))
    # a term's side: 1 in the text, 2 in the edited one, 3 in both
    tagged = F.concat(
        *[F.transform(terms_of, tag) for terms_of, tag in ((F.array_except("a", "b"), _tag(1)), (F.array_except("b", "a"), _tag(2)), (F.array_intersect("a", "b"), _tag(3)))]
    )
    hits = found.select("k", F.explode(tagged).alias("x")).select("k", "x.h", "x.side").join(words, "h")
    # the rows stay dealt by k, so the grouping needs no shuffle
    drawn = hits.select("k", "side", "h", _drawn(F.col("h")).alias("d"))
    drawn = drawn.select("k", "side", "h", F.when(F.col("side") != 2, F.col("d")).alias("da"), F.when(F.col("side") != 1, F.col("d")).alias("db"))
    subsets = range(len(RATES) * SUBSETS)
    lists = drawn.groupBy("k").agg(F.count("da").alias("n_a"), F.count("db").alias("n_b"), *[_list(i, d).alias(f"{d}{i}") for d in ("da", "db") for i in subsets])
    marked = lists.select("k", "n_a", "n_b", *[_digest([f"{d}{i}" for i in subsets]).alias(f) for d, f in (("da", "fa"), ("db", "fb"))])
    facts = rows.select(
        "k", "next_k", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), F.xxhash64("t").alias("whole"), F.xxhash64("e").alias("whole_e"),
    )
    plain = lambda h: F.concat(F.lit("-"), F.lower(F.hex(h)))
    done = materialise(
        facts.join(marked, "k", "left").select(
            "k", "next_k", "n_chars", "edited_sha256",
            F.when(F.col("n_a") > 0, F.col("fa")).otherwise(plain("whole")).alias("fingerprint"),
            F.when(F.col("n_b") > 0, F.col("fb")).otherwise(plain("whole_e")).alias("edited_fingerprint"),
        )
    )
    nexts = done.select(F.col("k").alias("next_k"), F.col("fingerprint").alias("next_fingerprint"))
    return done.join(nexts, "next_k").select(
        F.col("k").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
