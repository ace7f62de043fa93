"""Best-fit packing of documents into sequences by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There the
plan is made: for the longest length with pieces left, the hash of sums is asked for a single, a pair or a triple that
fills the gap exactly, and all such sequences that the counts allow are taken at once; what is left goes by best fit.
A plan has few distinct sequence patterns, each with a count. Pieces of one length are interchangeable, so a piece
finds its place from its rank among those of its length: a salted count, no sort of the corpus.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _INVERSE, _power, materialise, mix, scramble, text_blocks, text_bytes

CAPACITY = 4096
END_ID = 1
#: Runs of text whose ids a Python worker remembers; beyond it, it forgets all and starts anew.
REMEMBERED = 600_000
#: Words of letters that are encoded as one line.
WORDS_A_LINE = 1000
SALTS = 256
#: Ids of runs, and of each run its first place and its number of ids.
Laid = tuple[np.ndarray, np.ndarray, np.ndarray]
_BYTE_EXACT = scramble(256, 3)
_KIND = np.full(256, 3, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


class RunTokenizer:
    """Token ids of whole texts, equal to the tokenizer's own, with each distinct run of bytes encoded once.

    The tokenizer cuts at white space, and between ASCII letters, digits and other signs unless an apostrophe opens
    a contraction; so runs between such places can be encoded apart. Bytes from 0x80 on never open a cut.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = RunMemory(self.encode_runs, _BYTE)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_runs(self, runs: list[bytes]) -> Laid:
        """Runs of letters are one word each: they are encoded in lines, which the ids that close a word cut again.

        A line with more closing ids than words holds a word that the tokenizer splits; its words are encoded apart.
        """
        texts = [r.decode() for r in runs]
        word = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        words = np.flatnonzero(word)
        lines = [words[i : i + WORDS_A_LINE] for i in range(0, len(words), WORDS_A_LINE)]
        found = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in line]) for line in lines], add_special_tokens=False)
        at, size, parts, used = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64), [], 0
        for line, x in zip(lines, found, strict=True):
            ids = np.array(x.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(line):
                size[line] = np.diff(ends, prepend=0)
                at[line] = used + ends - size[line]
                parts.append(ids)
                used += len(ids)
            else:
                word[line] = False
        rest = np.flatnonzero(~word)
        ids, begin, size[rest] = laid([x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)])
        at[rest] = used + begin
        return np.concatenate([*parts, ids]), at, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the n + 1 places where texts begin."""
        raw, starts = text_bytes(texts)
        n = len(raw)
        kind = _KIND[raw]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            edge = np.zeros(n + 1, bool)
            edge[starts] = True
            before, x = kind[:-1], kind[1:]
            first[0] = kind[0] > 0
            first[1:] = (x > 0) & ((before == 0) | edge[1:-1] | ((before != x) & (before < 4) & (x < 4) & (raw[:-1] != 39)))
            last[-1] = kind[-1] > 0
            last[:-1] = (before > 0) & ((x == 0) | first[1:])
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        ids, places = self.memory.encode(raw, a, b, np.searchsorted(a, starts))
        data = raw.tobytes()
        if any(s.encode() in data for s in self.special):
            parts = [ids[x:y] for x, y in zip(places, places[1:], strict=False)]
            for i, t in enumerate(texts.to_pylist()):
                if t and any(s in t for s in self.special):  # a special token's string is one token, wherever it stands
                    parts[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            ids, places = joined(parts)
        return ids, places


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def laid(ids: list[Sequence[int]]) -> Laid:
    """Lists of ids one after another, and where each begins and how many it has."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes


class RunMemory:
    """Ids of runs of bytes that were seen before, by 64-bit hash; bounded, as it forgets all when full."""

    def __init__(self, encode: Callable[[list[bytes]], Laid], table: np.ndarray = _BYTE_EXACT):
        """``table``: a number for each byte; bytes that the tokenizer treats alike may share one."""
        self.encode_runs, self.table = encode, table
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, keys: list[int], runs: list[bytes]) -> None:
        flat, begin, sizes = self.encode_runs(runs)
        n, m = len(self.known), self.used + len(flat)
        while m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(keys) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : m] = flat
        self.at[n : n + len(keys)] = self.used + begin
        self.size[n : n + len(keys)] = sizes
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used = m

    def encode(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs ``raw[a:b]``, and where each text begins whose first run is ``first``.

        Runs marked in ``opens`` are told apart from others: ``encode_runs`` gets them with a zero byte before.
        """
        n = len(raw)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[raw] * _power(_BASE, n), out=sums[1:])
            hashes = mix((sums[b] - sums[a]) * _power(_INVERSE, n + 1)[a])
        if opens is not None:
            hashes = np.where(opens, mix(hashes), hashes)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > REMEMBERED:
            self._forget()
        names = keys.tolist()
        new = [i for i, k in enumerate(names) if k not in self.known]
        if new:
            data = raw.tobytes()
            mark = [b"\0" if opens is not None and opens[where[i]] else b"" for i in new]
            self._add([names[i] for i in new], [m + data[a[where[i]] : b[where[i]]] for m, i in zip(mark, new, strict=True)])
        entry = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[inverse]
        sizes = self.size[entry]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.at[entry] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[first]


_tokenizers: dict[str, RunTokenizer] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` tokens (the last may be shorter).

    A null or empty text has the end id alone. Rows stay apart even if they repeat a key; a null key stays null.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, RunTokenizer(tokenizer_path))
        for batch in batches:
            rows: list[tuple] = []
            for block in text_blocks(batch, "t", 1 << 20):
                ids, at = coder.encode(block.column("t"))
                ids = ids.astype("<u4", copy=False)
                for k, a, b in zip(block.column("k").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for p, start in enumerate(range(0, b - a + 1, capacity)):
                        size = min(capacity, b - a + 1 - start)
                        crc = zlib.crc32(ids[a + start : min(b, a + start + size)])
                        if start + size > b - a:
                            crc = zlib.crc32(end_id.to_bytes(4, "little"), crc)
                        rows.append((k, p, start, size, crc))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """``count`` sequences of each pattern; a pattern lists (length, how many)."""

    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)

    def add(self, count: int, lengths: Iterable[int]) -> None:
        sizes, many = np.unique(np.fromiter(lengths, np.int64), return_counts=True)
        self.patterns.append((count, tuple(zip(sizes[::-1].tolist(), many[::-1].tolist(), strict=True))))


def _complement(left: np.ndarray, gap: int, used: int) -> tuple[int, ...] | None:
    """One, two or three lengths that fill the gap exactly; ``used`` is the length that leads, of which one is taken."""
    left = left.copy()
    left[used] -= 1
    if gap < len(left) and left[gap] > 0:
        return (gap,)
    have = left[: gap + 1] > 0
    both = have & have[::-1]  # a and gap - a
    if gap % 2 == 0 and left[gap // 2] < 2:
        both[gap // 2] = False
    if (pair := np.flatnonzero(both[: gap // 2 + 1])).size:
        a = int(pair[np.argmax(np.minimum(left[pair], left[gap - pair]))])
        return (gap - a, a)
    lengths = np.flatnonzero(have)
    if not lengths.size or 3 * lengths[0] > gap:
        return None
    # c is the largest of the three
    for c in lengths[(lengths <= gap - 2 * lengths[0]) & (3 * lengths >= gap)][::-1].tolist():
        rest = gap - c
        have_rest = left[: rest + 1] > 0
        both = have_rest & have_rest[::-1]
        for a in np.flatnonzero(both[: rest // 2 + 1]).tolist():
            need = np.bincount([a, rest - a, c], minlength=len(left))
            if (left >= need).all():
                return (c, rest - a, a)
    return None


def make_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[n]: pieces of length n."""
    left, plan = np.array(counts, np.int64), Plan()
    if left[capacity]:
        plan.add(int(left[capacity]), [capacity])
        left[capacity] = 0
    for lead in range(capacity - 1, 0, -1):
        while left[lead] > 0:
            found = _complement(left, capacity - lead, lead)
            if found is None:
                break
            need = np.bincount([lead, *found], minlength=capacity + 1)
            times = int((left[need > 0] // need[need > 0]).min())
            plan.add(times, [lead, *found])
            left -= times * need
    # best fit of the rest, longest first: sequences that are alike move together
    room: dict[int, list[list]] = {}
    for n in np.flatnonzero(left)[::-1].tolist():
        many = int(left[n])
        while many:
            gap = min((g for g in room if g >= n), default=None)
            if gap is None:
                per = min(capacity // n, many)
                bins, many = divmod(many, per)
                room.setdefault(capacity - per * n, []).append([bins, [n] * per])
                continue
            bins, held = room[gap].pop()
            if not room[gap]:
                del room[gap]
            per = min(gap // n, many)
            take = min(bins, many // per)
            if take < bins:
                room.setdefault(gap, []).append([bins - take, held])
            room.setdefault(gap - per * n, []).append([take, held + [n] * per])
            many -= take * per
    for groups in room.values():
        for bins, held in groups:
            plan.add(bins, held)
    return plan


def _slots(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence id, pieces a sequence, offset of the first, of each pattern in turn."""
    seen = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for count, pattern in plan.patterns:
        offset = 0
        for n, many in pattern:
            rows.setdefault(n, []).append((int(seen[n]), sequence, many, offset))
            seen[n] += count * many
            offset += n * many
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; see :func:`pieces` for the cases of input.

    An empty table gives an empty result.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, key, text))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sized = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # capacity x SALTS rows at most
    first = sized.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in sized.groupBy("length").agg(F.sum("n")).collect():
        counts[n] = many
    slots = _slots(make_plan(counts, capacity), capacity)
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("rank", rank.cast("long") - 1).join(first, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                start, seq, many, off = shared.value[n]
                i = np.searchsorted(start, rank[own], side="right") - 1
                nth = rank[own] - start[i]
                sequence[own] = seq[i] + nth // many[i]
                offset[own] = off[i] + nth % many[i] * n
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
