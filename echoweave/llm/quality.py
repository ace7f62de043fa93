"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken block by block with numpy inside Spark tasks. The trees are fitted on a bounded sample of labelled
rows (``sample_rows``) and flattened into arrays, so that all rows of a batch walk down a tree together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _INVERSE, Tables, Words, _power, materialise, mix, text_blocks

#: Classes of bytes that are counted: letters, capitals, digits, white space, line ends, non-ASCII bytes, sentence
#: ends, commas and dashes, quotes and brackets, and the rest of the signs, each of them alone.
_SIGNS = b"#$%&*|!@<>=+_~^\\/{}[]"
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 5
_CLASS[[46, 63]], _CLASS[[44, 45, 59, 58]], _CLASS[[34, 39, 40, 41]] = 6, 7, 8
for _i, _sign in enumerate(_SIGNS):
    _CLASS[_sign] = 10 + _i
_CLASSES = 10 + len(_SIGNS)
FEATURES = _CLASSES + 14


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; a null or empty text has zeros. Nothing depends on other texts."""
    words = Words(texts)
    n = len(texts)
    raw, at = words.raw, words.at
    size = np.diff(at)
    doc_of_byte = np.repeat(np.arange(n), size)
    counts = np.bincount(doc_of_byte * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    share = counts / np.maximum(size, 1)[:, None]
    many = np.diff(words.first)
    doc_of_word = np.repeat(np.arange(n), many)
    length = words.end - words.start

    def repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and how often its commonest occurs."""
        with np.errstate(over="ignore"):
            mixed = values ^ mix(owner.astype(np.uint64) + np.uint64(77))
        _, where, times = np.unique(mixed, return_index=True, return_counts=True)
        top = np.zeros(n)
        np.maximum.at(top, owner[where], times)
        return np.bincount(owner[where], minlength=n), top

    def mean(values: np.ndarray, owner: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, minlength=n) / np.maximum(of, 1)

    distinct, top = repeats(words.hash, doc_of_word)
    grams = words.grams(3)
    inside = doc_of_word[: len(grams)] == doc_of_word[2:] if len(grams) else np.zeros(0, bool)
    triple_of = doc_of_word[: len(grams)][inside]
    triples, top_triple = repeats(grams[inside], triple_of)
    triple_many = np.bincount(triple_of, minlength=n)
    ends = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([at[:-1][size > 0], ends + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.append(line_start[1:], len(raw)) if len(line_start) else line_start
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=sums[1:])
        line_hash = mix((sums[line_end] - sums[line_start]) * _power(_INVERSE, len(raw) + 1)[line_start])
    line_of = np.searchsorted(at, line_start, side="right") - 1
    line_of = np.minimum(line_of, n - 1)
    lines, top_line = repeats(line_hash, line_of)
    line_many = np.bincount(line_of, minlength=n)
    first, last = raw[words.start], raw[np.maximum(words.end - 1, 0)]
    more = [
        np.log1p(size), np.log1p(many), mean(length, doc_of_word, many), np.sqrt(mean(length.astype(float) ** 2, doc_of_word, many)),
        distinct / np.maximum(many, 1), top / np.maximum(many, 1), triples / np.maximum(triple_many, 1), top_triple / np.maximum(triple_many, 1),
        lines / np.maximum(line_many, 1), top_line / np.maximum(line_many, 1), many / np.maximum(line_many, 1),
        mean(((first >= 65) & (first <= 90)).astype(float), doc_of_word, many), mean((_CLASS[last] >= 9).astype(float), doc_of_word, many), mean((length <= 3).astype(float), doc_of_word, many),
    ]
    return np.column_stack([share, *more]).astype(np.float32)


@dataclass
class Trees:
    """All trees one after another: a node's feature, threshold and left child (right: left + 1), or its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[node]
                inner = left >= 0
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(inner, left + right, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.12, bins: int = 64, min_rows: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for log-loss. Without rows every score is 1/2; with one class alone it is that class's."""
    if not len(y):
        return Trees(*(np.zeros(1, t) for t in (np.int64, float)), np.full(1, -1), np.zeros(1), np.zeros(0, np.int64), depth, 0.0)
    cuts = [np.unique(np.quantile(x[:, j].astype(float), np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, j].astype(float)) for j, c in enumerate(cuts)])
    width = bins + 1
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(len(y), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add() -> int:
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        root = add()
        roots.append(root)
        nodes, place = [root], np.zeros(len(y), np.int64)  # rows' place in nodes; -1: in a leaf
        at_node = np.full(len(y), root)
        for level in range(depth + 1):
            live = place >= 0
            k, slots = len(nodes), place[live]
            g_all, h_all = np.bincount(slots, gradient[live], minlength=k), np.bincount(slots, hessian[live], minlength=k)
            for i, node in enumerate(nodes):
                value[node] = rate * g_all[i] / (h_all[i] + ridge)
            if level == depth:
                break
            best = np.zeros(k)
            choice = [(0, 0)] * k
            for j in range(x.shape[1]):
                key = slots * width + code[live, j]
                g, h, c = (np.bincount(key, w, minlength=k * width).reshape(k, width).cumsum(1) for w in (gradient[live], hessian[live], None))
                gain = g**2 / (h + ridge) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                gain[(c < min_rows) | (c[:, -1:] - c < min_rows)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(k), top] > best + 1e-9):
                    best[i], choice[i] = gain[i, top[i]], (j, int(top[i]))
            following, moved = [], np.full(len(y), -1)
            for i, node in enumerate(nodes):
                if best[i] <= 1e-9:
                    continue
                j, cut = choice[i]
                feature[node], threshold[node] = j, float(cuts[j][cut])
                left[node] = add()
                add()
                rows = np.flatnonzero(place == i)
                right = code[rows, j] > cut
                moved[rows] = len(following) + right
                at_node[rows] = left[node] + right
                following += [left[node], left[node] + 1]
            nodes, place = following, moved
            if not nodes:
                break
        margin += np.array(value)[at_node]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, base)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, features)`` of every row, from its whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "t"):
                x = statistics(block.column("t"))
                flat = pa.array(x.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), flat)
                yield pa.RecordBatch.from_arrays([block.column("k"), lists], names=[key, "features"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, features array<float>")


def train(found: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", held_out: int = 2, folds: int = 4, sample_rows: int = 20_000, **params) -> Trees:
    """Trees from at most ``sample_rows`` labelled rows, those with the least hashes of their keys.

    Rows whose crc32(key as text) mod ``folds`` is ``held_out`` are never used, nor rows without key or label. Where
    there are more, a bound on the hash, set by their number, is applied on the executors: about ``sample_rows`` rows
    come to the driver from all partitions together. Equal rows of a key count once.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string")) % folds != held_out))
    usable = usable.groupBy(key).agg(F.max(label).alias("y"))
    known = found.join(usable, key).withColumn("h", F.xxhash64(key, "features"))
    total = known.agg(F.count_distinct("h")).first()[0]
    # the least hashes: a share of all 2^64, a little more than asked for so that the limit is met
    share = (sample_rows + 5 * math.sqrt(sample_rows)) / max(1, total)
    known = (known.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else known).dropDuplicates(["h"])
    rows = known.orderBy("h").limit(sample_rows).select("features", "y").collect()
    if not rows:
        return fit(np.zeros((0, FEATURES), np.float32), np.zeros(0))
    return fit(np.array([r[0] for r in rows], np.float32), np.array([r[1] for r in rows], float), **params)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **params) -> DataFrame:
    """(key, held_out, score, predicted) for every row; only the text is an input of a score.

    Null texts count as empty; without usable labels every score is 1/2. Repeated rows stay, with equal scores.
    """
    found = materialise(features(docs, key, text))
    trees = docs.sparkSession.sparkContext.broadcast(train(found, labels, key, label, **params))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            scores = trees.value.score(flat.reshape(-1, FEATURES)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores)], names=[key, "score"])

    scored = found.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, score double")
    remainder = F.coalesce(F.crc32(F.col(key).cast("string")) % 4, F.lit(-1))
    return scored.select(key, (remainder == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **params) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores ``threshold`` or more; no join and no shuffle of texts.

    Without usable labels no document is rejected, as nothing is known against any.
    """
    with Tables(docs.sparkSession) as tables:
        fitted = train(tables.keep(features(docs, key, text)), labels, key, label, **params)
    if not len(fitted.roots):
        return docs
    trees = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, text):
                yield block.filter(pa.array(trees.value.score(statistics(block.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
