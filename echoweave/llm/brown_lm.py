"""Brown class-based language model: exchange clustering, class transitions and word emissions.

Every word of the training texts has a class. Words with at least ``share`` of all training tokens (at most 1 / share
by count, so their number has a proven bound) are clustered one by one by exchange, on a matrix of bounded size in which
the other words stand as pools by their last two bytes. From there sweeps over the whole vocabulary go on: each task
holds a part of the words with the classes before and after all their training tokens, and moves each word to the class
that gains most likelihood of the class bigrams. Sweeps end when the likelihood of the whole corpus, counted anew after
each, grows by less than ``TOLERANCE`` of itself; a sweep that lowers it is taken back. Only words that no training text
holds keep the class of their pool. A word's probability is P(class | class before) x P(word | class).

Texts are packed once into blocks: words as places in the block's own word list. Blocks send one packed row to each
part of the word space (distinct words, their counts or contexts) and get one back (classes and counts of those words),
so what is shuffled are words of blocks and never tokens, a frequent word costs no more than any other, and nothing but
the bounded matrices meets at the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, Words, mix, text_blocks

SHARE = 1e-3
POOLS = 256
CLASSES = 48
ADD = 0.1
ADD_CLASS = 0.5
#: Least growth of the likelihood, as a share of it, for which another sweep is made.
TOLERANCE = 1e-3
#: Tokens of a block of texts (a longer text stands alone).
BLOCK_TOKENS = 500_000
#: Characters of text for each part of the word space.
PART_CHARS = 20_000_000
#: Context entries whose gains are computed at once.
GAIN_ROWS = 20_000
_END = np.uint64(0xE0D0E0D0E0D0E000)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _keys(words: Words) -> np.ndarray:
    """56 bits of the word's hash, then its pool in 8."""
    low = _LOWER[words.raw]
    last = low[words.end - 1]
    before = np.where(words.end - words.start > 1, low[np.maximum(words.end - 2, 0)], 0)
    pool = mix((last * 256 + before).astype(np.uint64)) & np.uint64(0xFF)
    return (words.hash & ~np.uint64(0xFF)) | pool


def _binary(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_BLOCK = "block long, ids binary, known binary, train binary, at binary, seq binary, words binary"


def _pack(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of texts: keys (and which are not null), training flags, where texts begin, tokens as places in ``words``.

    ``words`` are the block's distinct words by (part of the word space, key); the end of a text is one of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, known, train, many, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            distinct, seq = np.unique(keys, return_inverse=True)
            order = np.argsort(_part(distinct, parts), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = np.concatenate([[0], np.cumsum(many)])
            return _batch([(number, _binary(ids, "<i8"), _binary(known, "u1"), _binary(train, "u1"), _binary(at, "<i8"), _binary(place[seq], "<u4"), _binary(distinct[order], "<u8"))], _BLOCK)

        tokens = 0
        for batch in batches:
            for block in text_blocks(batch, "t"):
                words = Words(block.column("t"))
                keys = np.insert(_keys(words), words.first[1:], _END)
                ids = block.column("k")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), block.column("train").to_numpy(zero_copy_only=False), np.diff(words.first) + 1, keys))
                tokens += len(keys)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    tokens, number = 0, number + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, _BLOCK)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys) % np.uint64(parts)).astype(np.int64)


@dataclass
class Block:
    """One block, unpacked. ``train`` has an entry per text, ``words`` the keys that ``seq`` points to."""

    number: int
    ids: np.ndarray
    known: np.ndarray
    train: np.ndarray
    at: np.ndarray
    seq: np.ndarray
    words: np.ndarray

    @property
    def trained(self) -> np.ndarray:
        """Whether each token stands in a training text."""
        return np.repeat(self.train.astype(bool), np.diff(self.at))

    def cuts(self, parts: int) -> np.ndarray:
        return np.searchsorted(_part(self.words, parts), np.arange(parts + 1))


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    kinds = ("<i8", "u1", "u1", "<i8", "<u4", "<u8")
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    for i in range(batch.num_rows):
        number, *rest = (batch.column(n)[i].as_py() for n in names)
        yield Block(number, *(np.frombuffer(x, t) for x, t in zip(rest, kinds, strict=True)))


def _by_part(rows: DataFrame, parts: int, schema: str, work: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work(part, rows of the part)`` for each part of the word space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append(tuple(rest))
        while held:
            yield from work(*held.popitem())

    return rows.repartitionById(parts, "part").mapInArrow(run, schema)


_LEXICON = "part int, words binary, counts binary, classes binary"


def _count(blocks: DataFrame, parts: int) -> DataFrame:
    """The lexicon: for each part of the word space its sorted words and their training tokens (classes: still none)."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                times = np.bincount(b.seq, b.trained, minlength=len(b.words))
                cut = b.cuts(parts)
                rows = [(p, _binary(b.words[cut[p] : cut[p + 1]], "<u8"), _binary(times[cut[p] : cut[p + 1]], "<u4")) for p in np.flatnonzero(np.diff(cut)).tolist()]
                yield _batch(rows, "part int, words binary, times binary")

    def add(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        words, index = np.unique(np.concatenate([np.frombuffer(w, "<u8") for w, _ in rows]), return_inverse=True)
        counts = np.bincount(index, np.concatenate([np.frombuffer(n, "<u4") for _, n in rows]))
        yield _batch([(part, _binary(words, "<u8"), _binary(counts, "<i8"), b"")], _LEXICON)

    return _by_part(blocks.mapInArrow(send, "part int, words binary, times binary"), parts, _LEXICON, add)


@dataclass
class Units:
    """Sorted keys of the words that stand alone; unit numbers: those words, then the pools, then the end."""

    lexicon: np.ndarray

    @property
    def size(self) -> int:
        return len(self.lexicon) + POOLS + 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        unit = len(self.lexicon) + (keys & np.uint64(0xFF)).astype(np.int64)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
            unit = np.where(self.lexicon[at] == keys, at, unit)
        return np.where(keys == _END, self.size - 1, unit)


def _before(seq: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; a text begins after an end."""
    before = np.concatenate([[end], seq[:-1]])
    before[at[:-1]] = end
    return before


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """Adds up rows (a, b, n) into a size x size matrix, all that reaches the driver."""
    table = np.zeros((size, size))
    for a, b, n in rows.groupBy("a", "b").agg(F.sum("n")).collect():
        table[a, b] = n
    return table


def _cells(table: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[a, b].astype(np.int64))], names=["a", "b", "n"])


def _bigrams(blocks: DataFrame, units: Units) -> np.ndarray:
    """Counts of (unit, following unit) over all training texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(units)
    size = units.size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for b in _blocks(batch):
                seq = shared.value.of(b.words)[b.seq]
                total += np.bincount((_before(seq, b.at, size - 1) * size + seq)[b.trained], minlength=size * size)
        yield _cells(total.reshape(size, size))

    return _table(blocks.mapInArrow(run, "a int, b int, n long"), size)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class for every unit: each in turn moves to the class that gains most likelihood, until a sweep moves none.

    The last unit (the end) keeps class 0 to itself. Deterministic; ties go to the lower class.
    """
    n = len(bigrams)
    counts = bigrams.sum(1) + bigrams.sum(0)
    order = np.argsort(-counts[:-1], kind="stable")
    own = np.zeros(n, np.int64)
    own[order] = 1 + np.arange(n - 1) % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    least = 1e-12 * float(_plogp(bigrams.sum(dtype=float))) + 1e-9  # more than rounding can make of no gain
    moves = 1
    while moves:
        moves = 0
        for w in order:
            if not counts[w]:
                continue
            out = np.bincount(own, bigrams[w], minlength=classes)
            into = np.bincount(own, bigrams[:, w], minlength=classes)
            itself = float(bigrams[w, w])
            old = own[w]
            out[old] -= itself
            into[old] -= itself
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= itself
            f = _plogp(table)
            gain = (_plogp(table + out[None, :]) - f).sum(1) + (_plogp(table + into[:, None]) - f).sum(0)
            d = np.diag(table)
            gain += _plogp(d + out + into + itself) - _plogp(d + out) - _plogp(d + into) + _plogp(d)
            rows, columns = table.sum(1) + into, table.sum(0) + out
            a, b = out.sum() + itself, into.sum() + itself
            gain -= _plogp(rows + a) - _plogp(rows) + _plogp(columns + b) - _plogp(columns)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least:
                new = old
            moves += new != old
            own[w] = new
            table[new] += out
            table[:, new] += into
            table[new, new] += itself
    return own


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for the share of single words, which no clustering changes."""
    return float(_plogp(table).sum() - _plogp(table.sum(0)).sum() - _plogp(table.sum(1)).sum())


def reassign(table: np.ndarray, own: np.ndarray, word: np.ndarray, code: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The class of most gain for each word against a table of class bigrams that holds all words in their ``own`` classes.

    Entries are sorted by ``word``: ``times`` tokens of it stand before class ``code``, or after class ``code - classes``.
    A word is taken out of its own class first (not out of the other classes' entries beside it, a term that is small as a
    word without its own unit is rare, so a gain is close but not exact); ties stay or go to the lower class; class 0 is the end's alone.
    """
    classes = len(table)
    both = np.concatenate([table.T, table])
    rows, columns = table.sum(1), table.sum(0)
    out = own.copy()
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    stops = np.append(heads[1:], len(word))
    i = 0
    while i < len(heads):
        j = max(i + 1, int(np.searchsorted(stops, heads[i] + GAIN_ROWS, "right")))
        a, b = heads[i], stops[j - 1]
        w, n, at = word[heads[i:j]], times[a:b].astype(float), heads[i:j] - a
        met = both[code[a:b]]
        line, home = np.arange(b - a), own[word[a:b]]
        met[line, home] = np.maximum(met[line, home] - n, 0)
        gain = np.add.reduceat(_plogp(met + n[:, None]) - _plogp(met), at)
        line = np.arange(j - i)
        for side, total in ((code[a:b] < classes, rows), (code[a:b] >= classes, columns)):
            mine = np.add.reduceat(n * side, at)
            rest = np.repeat(total[None], j - i, 0)
            rest[line, own[w]] = np.maximum(rest[line, own[w]] - mine, 0)
            gain -= _plogp(rest + mine[:, None]) - _plogp(rest)
        gain[:, 0] = -np.inf
        new = gain.argmax(1)
        out[w] = np.where(gain[line, new] > gain[line, own[w]] + 1e-9, new, own[w])
        i = j
    return out


_REPLY = "part int, block long, classes binary, counts binary"
_CONTEXT = "kind int, part int, block long, words binary, many binary, codes binary, times binary"


def _with_classes(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with the classes and counts of their words, part by part."""
    lists = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "classes", "counts"))).alias("replies"))
    return blocks.join(lists, "block").select(*[x.split()[0] for x in _BLOCK.split(", ")], "replies")


def _replied(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for found in batch.column("replies"):
        rows = found.as_py()
        yield np.frombuffer(b"".join(r["classes"] for r in rows), "u1").astype(np.int64), np.frombuffer(b"".join(r["counts"] for r in rows), "<i8")


def _contexts(blocks: DataFrame, parts: int, classes: int, units: Units, unit_class: np.ndarray) -> DataFrame:
    """Rows of kind 0: the words of a block in one part and their contexts; kind 1: (part, block) is a pair of classes, ``times`` its tokens.

    Without replies the words have the classes of their units.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((units, unit_class))
    first = "replies" not in blocks.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, unit_class = shared.value
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            found = ((unit_class[units.of(b.words)] for b in _blocks(batch)) if first else (c for c, _ in _replied(batch)))
            for b, of in zip(_blocks(batch), found, strict=True):
                c, trained = of[b.seq], b.trained
                before = _before(c, b.at, 0)
                total += np.bincount((before * classes + c)[trained], minlength=classes * classes)
                inner = trained.copy()
                inner[b.at[:-1]] = False
                seq = b.seq.astype(np.int64)
                after = np.flatnonzero(inner)
                entry, times = np.unique(np.concatenate([seq[after - 1] * 2 * classes + c[after], (seq * 2 * classes + classes + before)[trained]]), return_counts=True)
                word, code = entry // (2 * classes), entry % (2 * classes)
                many = np.bincount(word, minlength=len(b.words))
                cut = b.cuts(parts)
                at = np.searchsorted(word, cut)
                yield _batch([(0, p, b.number, *(_binary(x[lo:hi], t) for x, t, lo, hi in ((b.words, "<u8", cut[p], cut[p + 1]), (many, "<u2", cut[p], cut[p + 1]), (code, "u1", at[p], at[p + 1]), (times, "<u4", at[p], at[p + 1])))) for p in np.flatnonzero(np.diff(cut)).tolist()], _CONTEXT)
        a, b = np.divmod(np.flatnonzero(total), classes)
        yield _batch([(1, x, y, b"", b"", b"", _binary(total[x * classes + y], "<i8")) for x, y in zip(a.tolist(), b.tolist(), strict=True)], _CONTEXT)

    return blocks.mapInArrow(run, _CONTEXT)


def _transitions(contexts: DataFrame, classes: int) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = [int.from_bytes(x, "little") for x in batch.column("times").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block").cast(pa.int32()), pa.array(times, pa.int64())], names=["a", "b", "n"])

    return _table(contexts.where("kind = 1").select("part", "block", "times").mapInArrow(run, "a int, b int, n long"), classes)


def _sweep(contexts: DataFrame, lexicon: DataFrame, parts: int, table: np.ndarray, units: Units, unit_class: np.ndarray) -> DataFrame:
    """One sweep over all words: rows with a block are replies, those without hold the lexicon with its new classes."""
    shared = contexts.sparkSession.sparkContext.broadcast((table, units, unit_class))
    sent = contexts.where("kind = 0").select("part", "block", "words", "many", "codes", "times")
    held = lexicon.select("part", F.lit(None).cast("long").alias("block"), "words", F.col("classes").alias("many"), F.lit(b"").alias("codes"), F.col("counts").alias("times"))

    def work(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        table, units, unit_class = shared.value
        _, words, own, _, counts = next(r for r in rows if r[0] is None)
        rows = [r for r in rows if r[0] is not None]
        words, counts = np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8")
        unit = units.of(words)
        alone = (unit < len(units.lexicon)) | (unit == units.size - 1)
        own = np.frombuffer(own, "u1").astype(np.int64) if own else unit_class[unit]
        where = [np.searchsorted(words, np.frombuffer(r[1], "<u8")) for r in rows]
        word = np.concatenate([np.repeat(w, np.frombuffer(r[2], "<u2")) for w, r in zip(where, rows, strict=True)])
        entry = word * 2 * len(table) + np.concatenate([np.frombuffer(r[3], "u1") for r in rows])
        times = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
        free = ~alone[word]
        entry, index = np.unique(entry[free], return_inverse=True)
        times = np.bincount(index, times[free], minlength=len(entry))
        new = reassign(table, own, entry // (2 * len(table)), entry % (2 * len(table)), times)
        yield _batch([(part, None, _binary(new, "u1"), _binary(counts, "<i8"), _binary(words, "<u8"))], _REPLY + ", words binary")
        for w, r in zip(where, rows, strict=True):
            yield _batch([(part, r[0], _binary(new[w], "u1"), _binary(counts[w], "<i8"), None)], _REPLY + ", words binary")

    return _by_part(sent.unionByName(held), parts, _REPLY + ", words binary", work)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each job that ends here: every sweep writes its tables, and nothing reads its shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Model:
    """``blocks`` and ``replies`` are written tables, as is ``lexicon`` (part, words, counts, classes: packed, part by part)."""

    blocks: DataFrame
    replies: DataFrame
    lexicon: DataFrame
    table: np.ndarray
    likelihoods: list[float]


def fit(own: DataFrame, tables: Tables, classes: int = CLASSES, share: float = SHARE) -> Model:
    """Clusters all words of the training texts of ``own(k, t, train)``."""
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(8, -(-chars // PART_CHARS))
    blocks = tables.keep(_pack(own, parts))
    counted = tables.keep(_count(blocks, parts))
    tokens = _totals(counted, 1)[0][0]

    def often(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*(batch.column(c).to_pylist() for c in ("words", "counts")), strict=True):
                found = np.frombuffer(words, "<u8")[np.frombuffer(counts, "<i8") >= max(1, share * tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["word"])

    lexicon = np.sort(np.array([r.word for r in counted.mapInArrow(often, "word long").collect()], np.int64).view(np.uint64))
    units = Units(lexicon[lexicon != _END])
    unit_class = exchange(_bigrams(blocks, units), classes)
    contexts = tables.keep(_contexts(blocks, parts, classes, units, unit_class))
    table, known, reached = _transitions(contexts, classes), counted, []
    before = found = None
    while True:
        reached.append(likelihood(table))
        if found is not None and reached[-1] - reached[-2] <= TOLERANCE * abs(reached[-2]):
            worse = before and before[0]
            if before is not None and reached[-1] < reached[-2]:
                worse = found
                found, known, table = before
            tables.free(contexts, *([] if worse is None else [worse]))
            return Model(blocks, found.where("block is not null"), known, table, reached)
        if before is not None:
            tables.free(before[0])
        used = [contexts, counted] if found is None else [contexts]
        before = None if found is None else (found, known, table)
        found = tables.keep(_sweep(contexts, known, parts, table, units, unit_class))
        tables.free(*used)
        known = found.where("block is null").select("part", "words", "counts", "classes")
        contexts = tables.keep(_contexts(_with_classes(blocks, found.where("block is not null")), parts, classes, units, unit_class))
        table = _transitions(contexts, classes)


def _totals(lexicon: DataFrame, classes: int) -> list[tuple[float, float]]:
    """Training tokens and distinct training words of each class (all of one class where words have none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, own in zip(*(batch.column(c).to_pylist() for c in ("counts", "classes")), strict=True):
                counts = np.frombuffer(counts, "<i8")
                own = np.frombuffer(own, "u1") if own else np.zeros(len(counts), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.array(np.bincount(own, counts, minlength=classes).astype(np.int64)), pa.array(np.bincount(own, counts > 0, minlength=classes).astype(np.int64))], names=["c", "v", "n"])

    sums = {r.c: (r.v, r.n) for r in lexicon.mapInArrow(run, "c int, v long, n long").groupBy("c").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    return [sums.get(c, (0, 0)) for c in range(classes)]


def training_rows(docs: DataFrame, key: str, text: str, folds: int, held_out: int) -> DataFrame:
    remainder = F.crc32(F.col(key).cast("string")) % folds
    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(remainder != held_out, F.lit(False)).alias("train"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, held_out: int = 0, classes: int = CLASSES, share: float = SHARE) -> DataFrame:
    """The contract's row for every row of ``docs``; training texts are those whose crc32(key as text) mod ``folds`` is not ``held_out``.

    A null or empty text has its end alone as token. Rows with a null key are scored and never trained on. Equal rows
    stay, each with its score; each counts in training. Without training texts all counts are 0.
    """
    if classes > 127:
        raise ValueError("a class and its side are one byte: at most 127")
    # packed counts and contexts are mostly zero bytes, which the default codec leaves large
    tables = Tables(docs.sparkSession, "zstd")
    with _shuffles_removed(docs.sparkSession):
        model = fit(training_rows(docs, key, text, folds, held_out), tables, classes, share)
    sums = np.array(_totals(model.lexicon, classes), float)
    tokens, distinct = int(sums[:, 0].sum()), int(sums[:, 1].sum())
    step = np.log10((model.table + ADD_CLASS) / (model.table.sum(1, keepdims=True) + ADD_CLASS * classes)) - np.log10(sums[:, 0] + ADD * (sums[:, 1] + 1))[None, :]
    constant = np.log10(tokens + ADD * (distinct + 1))
    schema = f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [key, *(x.split()[0] for x in schema.split(", ")[1:])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, (own, counts) in zip(_blocks(batch), _replied(batch), strict=True):
                c, at = own[b.seq], b.at[:-1]
                logs = np.add.reduceat(np.log10(counts + ADD)[b.seq], at)
                many = np.diff(b.at)
                moves = np.add.reduceat(step[_before(c, b.at, 0), c], at)
                columns = (pa.array(b.ids, mask=b.known == 0), pa.array((b.train == 0) & (b.known == 1)), pa.array(many), pa.array(np.add.reduceat((counts > 0)[b.seq].astype(np.int64), at)), pa.array(np.full(len(many), tokens)), pa.array(logs - many * constant), pa.array(logs + moves))
                yield pa.RecordBatch.from_arrays(list(columns), names=names)

    return _with_classes(model.blocks, model.replies).mapInArrow(run, schema)
