"""N-gram Jaccard join by PartEnum signatures.

Set sizes fall into bands so narrow that linked sets (``inter / union >= 3/4``) are in one band or in two that follow
each other; a group is such a pair of bands, and linked sets of a group differ in at most ``k`` shingles. The shingle
domain is cut into first-level partitions, each of these into ``n2`` second-level ones; a signature is a set's
projection on ``n2 - k2`` of the second-level partitions of one first-level partition, and all such subsets are
enumerated. With ``k // (k2 + 1) + 1 + spare`` first-level partitions, linked sets differ by at most ``k2`` in at least
``1 + spare`` of them, and share a signature in each.

Completeness. A partition is weak for a set if one of the set's projections there is empty: empty signatures are not
sent. A set with at most ``spare`` weak partitions shares a sent signature with each set it links with, so only pairs
of sets that both have more can be missed. Those sets send signatures of another, independent cut too, and so on; a
set with too many weak partitions in all cuts sends the empty signatures of the last one as well. Two linked sets meet
in the first cut in which one of them has enough, or else in the last one, by the guarantee of PartEnum itself.

Signatures do not travel as rows: a block of documents sends one packed row to each partition of the signature space,
32 bits a signature. Agreement in those bits makes candidates only; they are thinned by a sound bound (the distance of
count sketches never exceeds the symmetric difference) and the rest is verified on whole texts.

Buckets are not expanded into pairs. Each document is verified against the one bucket head it shares most with, and
what this links is contracted. Buckets that many documents share are left by those that can spare them (``_open``).
Then only members of different components meet: documents around one head in one block; of a bucket that they still
share, the largest group around one head meets the others once for all its buckets, and the others meet in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, Words, components, materialise, mix, partitions_for, roots, shingle_set, text_blocks

WORDS = 5
#: Independent cuts of the shingle domain.
WAYS = 4
#: Members of a bucket that are compared as one block.
CHUNK = 1000
#: Texts of a block whose pairs are verified, and their characters, in each of its two chunks.
LINKED_CHUNK, LINKED_CHARS = 500, 8_000_000
#: Most ids (of eight bytes) that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A larger bucket counts as hot.
HOT = 24
#: Signatures in one task of the search, and of one packed row's block.
TASK_SIGNATURES, SENT = 4_000_000, 1_500_000


def _bands(limit: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    low, high = [1], [1]
    while high[-1] < limit:
        low.append(high[-1] + 1)
        high.append(low[-1] * 4 // 3)
    return np.array(low), np.array(high)


_LOW, _HIGH = _bands()


def layout(group: int) -> tuple[int, int, int, int]:
    """(first-level partitions, ``n2``, ``k2``, spare) of a group, for the ``k`` in which its linked sets can differ.

    Linked sets of sizes a <= b differ in at most (a + b) / 7 <= a / 3 shingles.
    """
    k = int(_HIGH[group]) // 3
    if k < 4:
        return 1, (1, 4, 6, 7)[k], k, 0
    if k < 8:
        return 2, k // 2 + 3, k // 2, 0
    k2, n2, share = (2, 5, 0.15) if k < 48 else (1, 3, 0.25)
    least = k // (k2 + 1) + 1
    spare = 1 + int(np.ceil(share * least))
    return least + spare, n2, k2, spare


_LAYOUT = np.array([layout(g) for g in range(len(_HIGH))])


def _enumerate(flat: np.ndarray, owner: np.ndarray, group: np.ndarray, way: int, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (``flat``: shingles, ``owner``: whose) in one cut of their groups, their owners, and each set's weak partitions.

    Empty projections are left out; with ``empty`` they alone are given.
    """
    n1 = _LAYOUT[group, 0]
    first = np.concatenate([[0], np.cumsum(n1)])
    salt = mix((group * WAYS + way).astype(np.uint64) + np.uint64(0xA5A5))
    weak, sigs, owners = np.zeros(len(group), np.int64), [], []
    kinds = _LAYOUT[group, 1] * 64 + _LAYOUT[group, 2]
    with np.errstate(over="ignore"):
        drawn = mix(flat ^ salt[owner])
        part = ((drawn >> np.uint64(32)) * n1[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sub = ((drawn & np.uint64(0xFFFF)) * _LAYOUT[group, 1][owner].astype(np.uint64) >> np.uint64(16)).astype(np.int64)
        value = mix(drawn + np.uint64(0x51ED))
        for kind in np.unique(kinds).tolist():
            n2, k2 = divmod(kind, 64)
            of_kind = kinds == kind
            cells = np.zeros(int(first[-1]) * n2, np.uint64)
            x = of_kind[owner]
            np.add.at(cells, (first[owner[x]] + part[x]) * n2 + sub[x], value[x])
            whose = np.repeat(np.arange(len(group)), n1)
            mine = np.flatnonzero(of_kind[whose])
            whose, cells = whose[mine], cells.reshape(-1, n2)[mine]
            place = (mine - first[whose]).astype(np.uint64)
            lacking = np.zeros(len(mine), bool)
            for number, subset in enumerate(combinations(range(n2), n2 - k2)):
                total = cells[:, subset].sum(1, dtype=np.uint64)
                none = total == 0
                lacking |= none
                take = none if empty else ~none
                sigs.append(mix(total[take] + mix(place[take] * np.uint64(512) + np.uint64(number) + salt[whose[take]])))
                owners.append(whose[take])
            weak += np.bincount(whose[lacking], minlength=len(group))
    return np.concatenate(sigs), np.concatenate(owners), weak


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of some sets of 64-bit shingle hashes, the set of each, and its code: 8 x slack + 4 x band + way.

    Slack is how many signatures of this band and way the set can do without: linked sets share at least one more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    band = np.searchsorted(_HIGH, sizes)
    out = []
    for lower in (0, 1):
        pending = np.flatnonzero((sizes > 0) & (band >= lower))
        for way in range(WAYS):
            if not len(pending):
                break
            place = np.full(len(sets), -1)
            place[pending] = np.arange(len(pending))
            inside = place[owner] >= 0
            group = band[pending] - lower
            args = flat[inside], place[owner[inside]], group, way
            found, whose, weak = _enumerate(*args, empty=False)
            slack = _LAYOUT[group, 3] - weak
            code = np.clip(slack, 0, 8000) * 8 + lower * 4 + way
            out.append((found, pending[whose], code[whose]))
            if way == WAYS - 1:
                found, whose, _ = _enumerate(*args, empty=True)
                rest = slack[whose] < 0
                out.append((found[rest], pending[whose[rest]], code[whose[rest]]))
            pending = pending[slack < 0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _cells(n: int, at_least: int = 64) -> int:
    """Cells of a set's count sketch: the power of two from n / 2 on."""
    return 1 << max(at_least.bit_length() - 1, int(n - 1).bit_length() - 1)


def _sketch(s: np.ndarray) -> bytes:
    """Counts of the set's shingles in cells of equal parts of the hash domain, cut at 15 (which only lessens distances), two in a byte."""
    size = _cells(len(s))
    counts = np.minimum(np.bincount((s >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _counts(sketch: bytes) -> np.ndarray:
    raw = np.frombuffer(sketch, np.uint8)
    out = np.empty(2 * len(raw), np.int16)
    out[::2], out[1::2] = raw & 15, raw >> 4
    return out


def _folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts in fewer cells, cut at 15 again: the same as of a sketch made with so few."""
    return np.minimum(counts.reshape(size, -1).sum(1, dtype=np.int16), 15)


def _middle(sketch: bytes) -> bytes | None:
    """The sketch of a large set in a quarter of the cells (n / 8 or more); None: the sketch itself is short."""
    if len(sketch) < 512:
        return None
    counts = _folded(_counts(sketch), len(sketch) // 2).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


#: Cells of the coarse sketch, a byte each.
COARSE = 128
#: Documents are kin if their sketches, coarse and full, differ by no more than this times what linked sets can differ by.
KIN = 1.5


def _coarse(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=COARSE), 255).astype(np.uint8).tobytes() if len(s) else b""


def _coarse_table(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COARSE).astype(np.int16)


def _may_link(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray, times: float = 1.0) -> bool:
    """False only for sets that sizes or sketches prove apart, or ``times`` as far apart as linked sets can be."""
    if 4 * n_a < 3 * n_b or 4 * n_b < 3 * n_a:
        return False
    size = min(len(a), len(b))
    return 7 * int(np.abs(_folded(a, size) - _folded(b, size)).sum(dtype=np.int64)) <= times * (n_a + n_b)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch, coarse, middle) of every document: set size, 128-bit digest of the set, count sketches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                grams = words.grams(k)
                sets = [shingle_set(words, grams, i, k) for i in range(block.num_rows)]
                with np.errstate(over="ignore"):
                    first = [int(s.sum(dtype=np.uint64)) for s in sets]
                    second = [int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) for s in sets]
                sketches = [_sketch(s) for s in sets]
                coarse = [_coarse(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.array(d, np.uint64).view(np.int64)) for d in (first, second)], pa.array(sketches, pa.binary()), pa.array(coarse, pa.binary()), pa.array(map(_middle, sketches), pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "sketch", "coarse", "middle"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary, coarse binary, middle binary")


def _send(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """One row per block of documents and partition of the signature space: packed signatures and their owners.

    ``ids`` are the owners' distances from ``base`` in four bytes each, or in eight if four do not hold them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # sets that this task has sent; copies link through their digest
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            sigs, docs_, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = ((sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            pairs, owner = _owners(docs_, codes)
            order = np.argsort((part << 32) + owner, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            low = (sigs & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
            owner = owner[order]
            rows = []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[p], bounds[p + 1]
                starts = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                who = owner[a:b][starts]
                ids = pairs[0][who]
                base = int(ids.min())
                wide = int(ids.max()) - base >= 1 << 32
                rows.append((p, base, low[a:b].tobytes(), (ids - base).astype("<i8" if wide else "<u4").tobytes(), np.diff(np.append(starts, b - a)).astype("<u4").tobytes(), pairs[1][who].astype("<u2").tobytes()))
            part_col, base_col, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part_col, pa.int32()), pa.array(base_col, pa.int64()), *[pa.array(c, pa.binary()) for c in rest]], names=["part", "base", "sigs", "ids", "many", "codes"])

        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                grams = words.grams(k)
                sets, own = [], []
                for i, doc in enumerate(block.column("doc_id").to_pylist()):
                    s = shingle_set(words, grams, i, k)
                    if not len(s):
                        continue
                    with np.errstate(over="ignore"):
                        digest = (len(s), int(s.sum(dtype=np.uint64)))
                    if digest in done:
                        continue
                    done.add(digest)
                    if len(done) > 500_000:
                        done.clear()
                    sets.append(s), own.append(doc)
                found, whose, codes = signatures(sets)
                if len(found):
                    held.append((found, np.array(own, np.int64)[whose], codes))
                    total += len(found)
                if total > SENT:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "part int, base long, sigs binary, ids binary, many binary, codes binary")


def _owners(docs: np.ndarray, codes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (document, code) in order, and which one each entry has."""
    order = np.lexsort((codes, docs))
    d, c = docs[order], codes[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
    owner = np.empty(len(docs), np.int64)
    owner[order] = np.cumsum(new) - 1
    return (d[new], c[new]), owner


def _gathered(sent: DataFrame, parts: int) -> DataFrame:
    """(bucket, least, doc_id, size, times, members, code), of two kinds.

    Bucket -1: the least document of a bucket with another one, and in how many buckets of this task they meet
    (``times``). Others: a member of a bucket with three documents or more, as two are told by the first kind.
    Buckets of one group and cut with equal members say the same: a task keeps one for ``times`` of them. ``members``
    names such a set of members.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for p, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "sigs", "ids", "many", "codes")), strict=True):
                held.setdefault(p, []).append(tuple(rest))
        while held:
            p, rows = held.popitem()
            sigs = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
            many = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
            docs = np.repeat(np.concatenate([np.frombuffer(r[2], "<u4" if len(r[2]) == len(r[3]) else "<i8").astype(np.int64) + r[0] for r in rows]), many)
            code = np.repeat(np.concatenate([np.frombuffer(r[4], "<u2") for r in rows]), many)
            del rows
            order = np.argsort(sigs, kind="stable")
            same = sigs[order][1:] == sigs[order][:-1]
            # those that stand alone go before the finer sort
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            order = order[np.lexsort((docs[order], sigs[order]))]
            sigs, docs, code = sigs[order], docs[order], code[order]
            keep = np.ones(len(sigs), bool)
            keep[1:] = (sigs[1:] != sigs[:-1]) | (docs[1:] != docs[:-1])
            sigs, docs, code = sigs[keep], docs[keep], code[keep]
            start = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(sigs)))
            some = size > 1
            if not some.any():
                continue
            stay = np.repeat(some, size)
            docs, code, size = docs[stay], code[stay], size[some]
            begin = np.cumsum(size) - size
            with np.errstate(over="ignore"):
                members = np.add.reduceat(mix(docs.view(np.uint64) + np.uint64(11)), begin)
            alike = mix(members ^ (code[begin] & 7).astype(np.uint64))
            _, last, times = np.unique(alike[::-1], return_index=True, return_counts=True)
            last = len(size) - 1 - last
            stays, of = np.zeros(len(size), bool), np.zeros(len(size), np.int64)
            stays[last], of[last] = True, times
            bucket, least = np.repeat(np.arange(len(size)), size), np.repeat(docs[begin], size)
            met = np.ones(len(docs), bool)
            met[begin] = False
            (head, other), owner = _owners(least[met & stays[bucket]], docs[met & stays[bucket]])
            zero = np.zeros(len(head), np.int64)
            yield from rows_of(zero - 1, head, other, zero, np.bincount(owner, of[bucket][met & stays[bucket]], minlength=len(head)), zero, zero)
            shown = (stays & (size > 2))[bucket]
            bucket = bucket[shown]
            yield from rows_of((np.int64(p) << np.int64(32)) + bucket, least[shown], docs[shown], size[bucket], of[bucket], members.view(np.int64)[bucket], code[shown])

    def rows_of(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 100_000]).astype(np.int64)) for c in columns], names=["bucket", "least", "doc_id", "size", "times", "members", "code"])

    return sent.repartitionById(parts, "part").mapInArrow(run, "bucket long, least long, doc_id long, size long, times long, members long, code long")


def _heads(met: DataFrame) -> DataFrame:
    """(a, b) for each member b of buckets that is not least in all: of their least members the one it meets in most."""
    return met.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, likely, kin): whether set sizes and sketches do not rule the link out (sound: none is lost), and whether the two are kin."""
    side = lambda s: facts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"), F.col("coarse").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").where("n_a > 0").join(side("b"), "b").where("n_b > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (_coarse_table(batch.column(c).to_pylist()) for c in ("t_a", "t_b"))
            close = 7 * np.abs(x - y).sum(1, dtype=np.int64) <= KIN * (n + m)
            pairs = list(zip(close.tolist(), *(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True))
            likely, kin = ([c and _may_link(a, b, _counts(u), _counts(v), times) for c, a, b, u, v in pairs] for times in (1.0, KIN))
            keep = batch.select(["a", "b"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(likely, pa.bool_()), pa.array(kin, pa.bool_())], names=["a", "b", "likely", "kin"])

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b", "t_a", "t_b").mapInArrow(run, "a long, b long, likely boolean, kin boolean").where("likely or kin")


def _texts(ids: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """A written table of the texts of some documents. Ids are broadcast while they are few, so that only these texts are shuffled."""
    return tables.keep(docs.join(_few(tables.keep(ids.distinct())), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _linked(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs with 100 * intersection >= 75 * union, from whole texts."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "x"):
                sets = []
                for c in ("x", "y"):
                    words = Words(block.column(c))
                    grams = words.grams(k)
                    sets.append([shingle_set(words, grams, i, k) for i in range(block.num_rows)])
                good = []
                for x, y in zip(*sets, strict=True):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(len(x) > 0 and 100 * inter >= 75 * (len(x) + len(y) - inter))
                yield block.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _linked_around(pairs: DataFrame, texts: DataFrame, k: int, parts: int) -> DataFrame:
    """As ``_linked`` for pairs (a, b, h) around few heads h: a text is sent once for all pairs of a block, not for each pair."""
    docs = pairs.select("h", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(texts.select("doc_id", F.length("text").alias("chars")), "doc_id")
    chunks = docs.groupBy("h").agg(F.ceil(F.greatest(F.count("*") / LINKED_CHUNK, F.sum("chars") / LINKED_CHARS)).cast("int").alias("chunks"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("chunks")).cast("int")
    pairs = pairs.join(chunks, "h").select("h", F.least(own("a"), own("b")).alias("i"), F.greatest(own("a"), own("b")).alias("j"), "a", "b")
    needed = pairs.select("h", "i", "j", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(texts, "doc_id")
    rows = needed.select("h", "i", "j", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text").unionByName(pairs.withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                grams = words.grams(k)
                found = []
                for at, (h, i, j, a, b) in enumerate(zip(*(block.column(c).to_pylist() for c in "hijab"), strict=True)):
                    if (h, i, j) != key:
                        key, sets = (h, i, j), {}
                    if b is None:
                        sets[a] = shingle_set(words, grams, at, k)
                        continue
                    x, y = sets[a], sets[b]
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    if len(x) and 100 * inter >= 75 * (len(x) + len(y) - inter):
                        found.append((a, b))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def _open(buckets: DataFrame) -> DataFrame:
    """The buckets without the hot ones that their members can spare.

    Linked documents share at least one signature more than each of them can do without (its slack). If each leaves
    its largest buckets, in one order for all, up to its slack of signatures, the smallest that two share stays: it
    has as many larger shared ones before it as fill the slack. So a passage that very many documents hold brings
    only those together that hold little else.
    """
    order = W.partitionBy("doc_id", "code").orderBy(F.desc("size"), "bucket").rowsBetween(W.unboundedPreceding, 0)
    hot = buckets.where(F.col("size") > HOT).withColumn("spent", F.sum("times").over(order)).where(F.col("spent") > F.shiftright("code", 3)).drop("spent")
    return buckets.where(F.col("size") <= HOT).unionByName(hot)


def _placed(rows: DataFrame, where: DataFrame, side: str) -> DataFrame:
    """Adds component and head of the document in column ``side``; those of none are their own."""
    known = where.select(F.col("doc_id").alias(side), F.col("c").alias(f"c_{side}"), F.col("h").alias(f"h_{side}"))
    return rows.join(known, side, "left").withColumns({f"{x}_{side}": F.coalesce(f"{x}_{side}", side) for x in "ch"})


def _apart(buckets: DataFrame, strangers: DataFrame, where: DataFrame, facts: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Two frames (bucket, size, doc_id, c, h) of the buckets whose members are in several components c and around several heads h.

    Of each bucket the host is the head with most members there. The first frame has a bucket for each host, named by
    it: its own members (h = 0) and all others that some bucket brings together with them (h = 1), without those whose
    size fits none of the other kind. The second has the buckets without their hosts' members. So a large group is not
    sent again with each stranger that it meets.

    ``strangers(a, b)``: least and other members apart in both; only their buckets are looked at.
    """
    named = F.when(F.col("size") > HOT, F.col("bucket")).otherwise(F.col("members"))
    mixed = buckets.join(_few(strangers.select(F.col("a").alias("least"), F.col("b").alias("doc_id"))), ["least", "doc_id"], "left_semi")
    mixed = tables.keep(mixed.select("bucket", named.alias("members")).groupBy("members").agg(F.min("bucket").alias("bucket")).select("bucket"))
    member = tables.keep(_open(buckets.join(_few(mixed), "bucket")).select("bucket", "doc_id"))
    member = tables.keep(_placed(member, where, "doc_id").select("bucket", "doc_id", F.col("c_doc_id").alias("c"), F.col("h_doc_id").alias("h")))
    groups = member.groupBy("bucket", "h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"))
    split = groups.groupBy("bucket").agg(F.max_by("h", F.struct("size", -F.col("h"))).alias("host"), F.count("*").alias("heads"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("c0 <> c1 and heads > 1")
    member = tables.keep(member.join(split.select("bucket", "host"), "bucket"))
    hosts = member.select(F.col("host").alias("bucket"), "doc_id", "c", (F.col("h") != F.col("host")).cast("long").alias("h")).distinct()
    hosts = tables.keep(hosts.join(facts.select("doc_id", "n"), "doc_id"))
    ranges = hosts.groupBy("bucket").agg(*[f(F.when(F.col("h") == 1 - side, F.col("n"))).alias(f"{x}{side}") for side in (0, 1) for x, f in (("low", F.min), ("high", F.max))])
    low, high = (F.when(F.col("h") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("low", "high"))
    hosts = hosts.join(ranges, "bucket").where((4 * F.col("n") >= 3 * low) & (3 * F.col("n") <= 4 * high)).select("bucket", "doc_id", "c", "h")
    return _mixed(tables.keep(hosts)), _mixed(member.where("h <> host").drop("host"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The buckets with several components and several heads, with their sizes."""
    split = rows.groupBy("bucket").agg(*[f(x).alias(f"{x}{i}") for x in "ch" for i, f in enumerate((F.min, F.max))], F.count("*").alias("size")).where("c0 <> c1 and h0 <> h1")
    return rows.join(split.select("bucket", "size"), "bucket").select("bucket", "size", "doc_id", "c", "h")


def _kin(pairs: DataFrame, facts: DataFrame, tables: Tables) -> DataFrame:
    """The pairs whose sketches are close; those left out cannot link.

    Coarse sketches sift first; the full ones tell the rest, as large sets of any texts look alike in few cells.
    """
    names, schema = pairs.columns, pairs.schema

    def sifted(pairs: DataFrame, sketch: str, close) -> DataFrame:
        side = lambda s: facts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col(sketch).alias(f"t_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(names).filter(close(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), batch.column("t_a").to_pylist(), batch.column("t_b").to_pylist()))

        return both.select(*names, "n_a", "n_b", "t_a", "t_b").mapInArrow(run, schema)

    coarse = lambda n, m, x, y: pa.array(7 * np.abs(_coarse_table(x) - _coarse_table(y)).sum(1, dtype=np.int64) <= KIN * (n + m))
    full = lambda n, m, x, y: pa.array([_may_link(a, b, _counts(u), _counts(v), KIN) for a, b, u, v in zip(n.tolist(), m.tolist(), x, y, strict=True)], pa.bool_())
    return sifted(tables.keep(sifted(pairs, "coarse", coarse)), "sketch", full)


def _few(df: DataFrame) -> DataFrame:
    """A written table of ids, broadcast while it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _across(rows: DataFrame, facts: DataFrame, sketch: Column, parts: int, same_head: bool) -> DataFrame:
    """Pairs of one ``bucket`` and different components that sizes and sketches do not rule out.

    ``same_head``: the bucket holds what stands around one head; otherwise pairs of one head are left out, as they
    meet there. Buckets are cut into chunks of about ``CHUNK`` members, each pair of chunks is compared as one block,
    and only plausible pairs leave the task.
    """
    rows = rows.join(facts.select("doc_id", "n", sketch.alias("sketch")), "doc_id")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "c", "h", "n", "sketch")

    def block(i: int, j: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        own, docs, c, h, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
        values, many = np.unique(c, return_counts=True)
        odd = np.flatnonzero(c != values[many.argmax()])
        if not len(odd) or (not same_head and (h == h[0]).all()):
            return
        sketches = [x for part in held for x in part[5]]

        def likely(rows: np.ndarray) -> np.ndarray:
            rows = rows[:, None]
            good = (c != c[rows]) & (4 * n >= 3 * n[rows]) & (4 * n[rows] >= 3 * n)
            if i != j:
                good &= own != own[rows]
            return good if same_head else good & (h != h[rows])

        # each size of sketch: the place of a member, and the members that have as many cells or more
        counts = [_counts(x) for x in sketches]
        sizes = np.array([len(x) for x in counts])
        tables = {s: (np.cumsum(sizes >= s) - 1, np.stack([_folded(x, s) for x in counts if len(x) >= s])) for s in np.unique(sizes).tolist()}
        found = []
        step = max(1, 60_000 // len(docs))
        for at in range(0, len(odd), step):
            rows = odd[at : at + step]
            x, y = np.nonzero(likely(rows))
            x = rows[x]
            for s, (row, table) in tables.items():
                these = np.flatnonzero(np.minimum(sizes[x], sizes[y]) == s)
                for lot in np.array_split(these, 1 + len(these) * s // 2_000_000):
                    u, v = x[lot], y[lot]
                    near = 7 * np.abs(table[row[u]] - table[row[v]]).sum(1, dtype=np.int64) <= n[u] + n[v]
                    found.append(np.column_stack([docs[u[near]], docs[v[near]]]))
        if sum(map(len, found)):
            pairs = np.concatenate(found)
            a, b = _owners(pairs.min(1), pairs.max(1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j, own, docs, c, h, n = (batch.column(x).to_numpy() for x in ("bucket", "i", "j", "own", "doc_id", "c", "h", "n"))
            sketches = batch.column("sketch").to_pylist()
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(bucket)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                name = (bucket[x], i[x], j[x])
                if name != key:
                    if held:
                        yield from block(key[1], key[2], held)
                    key, held = name, []
                held.append((own[x:y], docs[x:y], c[x:y], h[x:y], n[x:y], sketches[x:y]))
        if held:
            yield from block(key[1], key[2], held)

    return rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Links: Jaccard similarity of the sets of distinct ``k``-word shingles of 0.75 or more. A text with fewer words is
    one shingle, a null text or one without words is empty and linked with nothing. Rows that repeat a key count as
    one document, with the greatest text. Rows without a key come back one by one, linked with nothing and with a
    null component. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spare = partitions_for(spark, 0, 1)
    with Tables(spark) as tables:
        described = tables.keep(_describe(own, k))
        own, facts = own.where("doc_id is not null"), described.where("doc_id is not null")
        if not facts.groupBy("doc_id").count().where("count > 1").isEmpty():
            # rows that repeat a key: the fuller description stands, as the links of all of them count for one vertex
            facts = tables.keep(facts.groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2", "sketch", "coarse", "middle")).alias("x")).select("doc_id", "x.*"))
        copies = tables.keep(facts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c"))
        same = tables.keep(facts.select("doc_id", "n", "d1", "d2").join(copies, ["n", "d1", "d2"]).select("a", F.col("doc_id").alias("b")).where("a <> b"))
        total = facts.agg(F.sum("n")).first()[0] or 0
        parts = max(8, -(-int(total) * 5 // (4 * TASK_SIGNATURES)))
        gathered = tables.keep(_gathered(_send(own, k, parts), parts))
        buckets = gathered.where("bucket >= 0")
        met = tables.keep(gathered.where("bucket < 0").groupBy(F.col("least").alias("a"), F.col("doc_id").alias("b")).agg(F.sum("times").alias("c")))
        close = tables.keep(_plausible(_heads(met), facts))
        near = close.where("likely").select("a", "b")
        links = tables.keep(_linked(near, _texts(_ends(near), own, tables), k).unionByName(same))
        found = components(links)
        # a forest of likely heads: a copy stands under its first one, whatever else it meets
        around = roots(close.where("kin").join(same.select("b"), "b", "left_anti").select("a", "b").unionByName(same))
        where = tables.keep(around.join(found.withColumnRenamed("component_id", "c"), "id", "full").select(F.col("id").alias("doc_id"), F.coalesce("c", "id").alias("c"), F.coalesce("root", "id").alias("h")))
        # heads whose documents are kin count as one
        strangers = tables.keep(_placed(_placed(met.select("a", "b"), where, "a"), where, "b").where("c_a <> c_b and h_a <> h_b").select("a", "b", "h_a", "h_b"))
        merged = components(tables.keep(_kin(strangers, facts, tables).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))))
        lone = merged.join(where, F.col("id") == F.col("doc_id"), "left_anti").select(F.col("id").alias("doc_id"), F.col("id").alias("c"), F.col("component_id").alias("h"))
        where = tables.keep(where.join(merged, F.col("h") == F.col("id"), "left").select("doc_id", "c", F.coalesce("component_id", "h").alias("h")).unionByName(lone))
        # documents around one head
        sizes = where.groupBy("h").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h", "size")
        blocks = where.join(sizes, "h").select(F.col("h").alias("bucket"), "size", "doc_id", "c", "h")
        late = _across(blocks, facts, F.col("sketch"), spare, True).join(near, ["a", "b"], "left_anti")
        late = tables.keep(late.join(where.select(F.col("doc_id").alias("a"), "h"), "a").select("a", "b", "h"))
        # and around different heads: the pairs of least members and others were told apart above
        strangers = tables.keep(_placed(_placed(strangers.select("a", "b"), where, "a"), where, "b").where("h_a <> h_b").select("a", "b"))
        hosts, others = _apart(buckets, strangers, where, facts, tables)
        apart = reduce(DataFrame.unionByName, [_across(x, facts, F.coalesce("middle", "sketch"), spare, False) for x in (hosts, others)])
        far = tables.keep(_plausible(apart.distinct(), facts).where("likely").select("a", "b"))
        final, rest = found, late.select("a", "b").unionByName(far)
        if not rest.isEmpty():
            texts = _texts(_ends(rest), own, tables)
            more = tables.keep(_linked_around(late, texts, k, spare).unionByName(_linked(far, texts, k)))
            final = components(links.unionByName(more))
        rows = facts.select("doc_id", "n").unionByName(described.where("doc_id is null").select("doc_id", "n"))
        return materialise(rows.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
