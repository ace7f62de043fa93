"""SentencePiece encoding and decoding by weighted finite-state transducers.

Machines compiled from the model's file, in this order of composition:

* :class:`Normaliser` reads characters and writes them, white space as its sign, after the sign of the text's beginning.
* :class:`PieceMachine` reads what it wrote: a trie whose leaves write pieces at a weight of minus their score, and an
  arc over each character that is no piece, which writes the character (spelled in byte pieces by the last machine).
* For merge-based models, a filter that lets two pieces stand side by side only if the model's merges would leave them
  so; a state remembers the last piece. Models of single pieces (unigram) need no filter and no memory.

A text is composed with them lazily, chunk by chunk, and its ids are the path of least weight in the tropical semiring:
weights add along a path, the least of the paths into a state stays. Chunks are maximal runs of space and what follows;
no piece crosses their borders (checked when compiling), so each distinct chunk is solved once. Models with a table of
character replacements, white space removal, pieces of the user or no byte pieces are refused when compiling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_bytes
from .packing import RunMemory, joined, laid

SIGN = "▁"
#: Pairs of pieces whose verdict a worker remembers.
PAIRS = 1_000_000
#: Numbers of the model file's format: kinds of models, and kinds of pieces.
UNIGRAM, MERGES = 1, 2
NORMAL, BYTE = 1, 6
USER_DEFINED, UNUSED = 4, 5
#: Fixed value: what a unigram model adds to its largest weight for a character that is no piece.
UNKNOWN_EXTRA = 10.0


class Normaliser:
    """Two states, before the first character and behind it; the arc out of the first writes the opening sign."""

    def __init__(self, opening: bool = True):
        self.opening = SIGN if opening else ""
        self.arcs = str.maketrans({" ": SIGN})

    def __call__(self, text: str, opens: bool) -> str:
        return (self.opening if opens else "") + text.translate(self.arcs)


class PieceMachine:
    """The weighted machine of ``weight`` (piece to weight); with ``merges``, composed with the filter of merges."""

    def __init__(self, weight: Mapping[str, float], merges: bool):
        self.weight, self.merges = dict(weight), merges
        self.unknown = max(self.weight.values(), default=0.0) + UNKNOWN_EXTRA
        self.trie: dict = {}
        for p in self.weight:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.verdicts: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a string: the best-scored pair first, the leftmost of equals."""
        parts, weight = list(text), self.weight
        none = float("inf")
        costs = [weight.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = weight.get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = weight.get(parts[i] + parts[i + 1], none)
        return parts

    def adjoin(self, a: str, b: str) -> bool:
        """The filter: pieces a and b stay side by side under the merges of their characters."""
        known = self.verdicts.get((a, b))
        if known is None:
            if len(self.verdicts) > PAIRS:
                self.verdicts.clear()
            known = self.verdicts[(a, b)] = self.merged(a + b) == [a, b]
        return known

    def shortest(self, text: str) -> list[str]:
        """The path of least weight through the composition, as strings; of equal ones that whose last piece is longest.

        A state is a place of the text and the last piece. With the filter, one path alone leads to each place (what
        merges make of the text up to there), so a place has one state and, once reached, is not relaxed again; without
        it the last piece decides nothing and a place has one state as well. ``least`` holds the states' weights.
        """
        n, merges, weight, trie, adjoin = len(text), self.merges, self.weight, self.trie, self.adjoin
        none = float("inf")
        least = [none] * (n + 1)
        last: list[str] = [""] * (n + 1)
        least[0] = 0.0
        for i in range(n):
            here, before = least[i], last[i]
            if here == none:
                continue
            node, j = trie, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is None:
                    continue
                there = here + weight[piece]
                if there < least[j] if not merges else least[j] == none and (not before or adjoin(before, piece)):
                    least[j], last[j] = there, piece
            there = here + self.unknown
            if text[i] not in weight and (there < least[i + 1] if not merges else least[i + 1] == none and (not before or adjoin(before, text[i]))):
                least[i + 1], last[i + 1] = there, text[i]
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(path[-1])
        return path[::-1]


class Transducer:
    """The composition of the machines of a model's file, and its inverse."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules, kind = model.normalizer_spec, model.trainer_spec.model_type
        types = [p.type for p in model.pieces]
        refused = {
            "a kind other than unigram or merges": kind not in (UNIGRAM, MERGES),
            "a table of character replacements": bool(rules.precompiled_charsmap),
            "removal of white space": rules.remove_extra_whitespaces,
            "white space kept as it is, or behind words": not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix,
            "no 256 byte pieces": types.count(BYTE) != 256,
            "pieces of the user, or unused ones": USER_DEFINED in types or UNUSED in types,
            "a piece with white space behind other characters: chunks do not stand alone": any(SIGN in p.piece.lstrip(SIGN) for p in model.pieces if p.type == NORMAL),
        }
        if found := [what for what, is_so in refused.items() if is_so]:
            raise ValueError("the model has " + "; ".join(found))
        self.bytes_first = types.index(BYTE)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.normalise = Normaliser(rules.add_dummy_prefix)
        self.machine = PieceMachine({p: -model.pieces[i].score for p, i in self.id.items()}, kind == MERGES)
        self.memory = RunMemory(lambda runs: laid([self.chunk(r[1:].decode(), True) if r[:1] == b"\0" else self.chunk(r.decode(), False) for r in runs]))
        spelled = [b"" for _ in types]
        for p, i in self.id.items():
            spelled[i] = p.replace(SIGN, " ").encode()
        for x in range(256):
            spelled[self.bytes_first + x] = bytes([x])
        self.spell_size = np.array([len(x) for x in spelled], np.int64)
        self.spell_at = np.cumsum(self.spell_size) - self.spell_size
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def chunk(self, text: str, opens: bool) -> list[int]:
        """Ids of a chunk of normalised or raw text; ``opens``: it begins the text."""
        out = []
        for piece in self.machine.shortest(self.normalise(text, opens)):
            if piece in self.id:
                out.append(self.id[piece])
            else:
                out += [self.bytes_first + x for x in piece.encode()]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each begins. Null and empty texts have none."""
        raw, at = text_bytes(texts)
        n = len(raw)
        space = raw == 32
        start = np.zeros(n, bool)
        if n:
            start[1:] = space[1:] & ~space[:-1]
            start[at[:-1][np.diff(at) > 0]] = True
        a = np.flatnonzero(start)
        b = np.append(a[1:], n) if len(a) else a
        opens = np.isin(a, at[:-1])
        ids, places = self.memory.encode(raw, a, b, np.searchsorted(a, at), opens)
        if SIGN.encode() in raw.tobytes():
            parts = [ids[x:y] for x, y in zip(places, places[1:], strict=False)]
            for i, t in enumerate(texts.to_pylist()):
                if t and SIGN in t:  # the sign itself is white space to the model: chunks begin elsewhere
                    whole = self.normalise(t, True)
                    cuts = [0, *(k for k in range(1, len(whole)) if whole[k] == SIGN != whole[k - 1]), len(whole)]
                    parts[i] = np.array([x for p, q in zip(cuts, cuts[1:], strict=False) for x in self.chunk(whole[p:q], False)], np.uint32)
            ids, places = joined(parts)
        return ids, places

    def decode(self, ids: np.ndarray, places: np.ndarray) -> list[str]:
        """The texts of id sequences: spellings one after another, without the opening sign. Bytes that are no UTF-8 become U+FFFD."""
        sizes = self.spell_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.spelled[np.repeat(self.spell_at[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[places].tolist()
        return [raw[a + (bool(self.normalise.opening) and raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


_machines: dict[str, Transducer] = {}


def _machine(path: str) -> Transducer:
    return _machines.setdefault(path, Transducer(path)) if path not in _machines else _machines[path]


def _over(df: DataFrame, column: str, added: str, make) -> DataFrame:
    """Each batch in blocks; ``make(block)`` gives the arrays of the added columns, which replace others of their names."""
    names = [x.split()[0] for x in added.split(", ")]
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "__in") if pa.types.is_string(batch.column("__in").type) else [batch]:
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), *make(block.column("__in"))], names=[*kept, *names])

    source = df.select(*kept, F.col(column).alias("__in"))
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes if c != "__in"), added]))


def _lists(ids: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, the model's encoding of the whole text; a null text has null ids, an empty one none."""

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, places = _machine(model_path).encode(texts)
        found = _lists(ids, places)
        return [pa.array([x if ok else None for x, ok in zip(found, texts.is_valid().to_pylist(), strict=True)], found.type) if texts.null_count else found]

    return _over(docs, text, "ids array<int>", make)


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``text`` of the ids; null ids give null."""

    def make(column: pa.Array) -> list[pa.Array]:
        sizes = np.array([0 if x is None else len(x) for x in column.to_pylist()], np.int64)
        texts = _machine(model_path).decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
        return [pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())]

    return _over(docs, ids, "text string", make)


def round_trips(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_byte_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip: decoding gives the text again.

    Null texts count as empty. White-space signs (U+2581) in a text come back as spaces, so those texts alone differ.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        machine = _machine(model_path)
        ids, places = machine.encode(texts)
        low = np.concatenate([[0], np.cumsum((ids >= machine.bytes_first) & (ids < machine.bytes_first + 256))])
        flat = ids.astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(places, places[1:], strict=False)]
        back = machine.decode(ids, places)
        same = [(t or "") == s for t, s in zip(texts.to_pylist(), back, strict=True)]
        return [pa.array(np.diff(places)), pa.array(low[places[1:]] - low[places[:-1]]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]

    return _over(docs, text, "n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean", make).drop(text)
