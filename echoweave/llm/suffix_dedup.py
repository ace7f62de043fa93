"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those at minimiser places are sorted at first: in every window of ``WINDOW`` consecutive
``GRAM``-word grams the least hash marks its place, so equal passages mark equal places. As
``WINDOW - 1 + PREFIX <= MIN_WORDS``, every repeated passage of ``MIN_WORDS`` words holds a marked suffix whose first
``PREFIX`` words lie in it, and sorting by their hash finds the marks that occur again. Around these, the suffixes at
all places are sorted by the hash of their first ``MIN_WORDS`` words (then document and place), so neighbours share a
whole passage and no shorter fragment can stand between two copies. Consecutive places with the same partner form
runs. Where the partner changes from one place to the next, the words beside the run are fetched for both documents,
in growing windows, and the match is extended to the left and to the right until words differ.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, Words, materialise, partitions_for, text_blocks

MIN_WORDS, PREFIX, GRAM, WINDOW = 50, 32, 8, 18
#: Words fetched beside an open end of a run at first, and how many times more if all of them agree.
BESIDE, GROWTH = 64, 16
SUFFIX = "h long, doc_id long, pos int"


def _minimisers(words: Words, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where a window of grams lies in one text, and the place that each such window marks."""
    grams = words.grams(GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(len(grams) - WINDOW + 1)
    starts = starts[owner[starts] == owner[starts + WINDOW + GRAM - 2]]
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = [part + views[part].argmin(1) for part in (starts[at : at + (1 << 16)] for at in range(0, len(starts), 1 << 16))]
    return starts, np.concatenate(least) if least else starts


def _suffix_batch(words: Words, owner: np.ndarray, ids: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    own = owner[place]
    return pa.RecordBatch.from_arrays([pa.array(hashes[place].view(np.int64)), pa.array(ids[own]), pa.array((place - words.first[own]).astype(np.int32))], names=["h", "doc_id", "pos"])


def _suffixes(docs: DataFrame) -> DataFrame:
    """(h, doc_id, pos) of the marked suffixes of ``PREFIX`` words or more, in texts of ``MIN_WORDS`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                many = np.diff(words.first)
                owner = np.repeat(np.arange(block.num_rows), many)
                long_ = words.grams(PREFIX)
                place = np.unique(_minimisers(words, owner)[1])
                place = place[place < len(long_)]
                place = place[(owner[place + PREFIX - 1] == owner[place]) & (many[owner[place]] >= MIN_WORDS)]
                if len(place):
                    yield _suffix_batch(words, owner, block.column("doc_id").to_numpy(), long_, place)

    return docs.mapInArrow(run, SUFFIX)


def _passages(marked: DataFrame) -> DataFrame:
    """(h, doc_id, pos) of the suffixes of ``MIN_WORDS`` words or more whose window marks one of the text's ``marks``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                owner = np.repeat(np.arange(block.num_rows), np.diff(words.first))
                long_ = words.grams(MIN_WORDS)
                starts, least = _minimisers(words, owner)
                marks = block.column("marks")
                at = marks.flatten().to_numpy() + np.repeat(words.first[:-1], marks.value_lengths().to_numpy())
                known = np.zeros(len(owner), bool)
                known[at] = True
                place = starts[known[least]]
                place = place[place < len(long_)]
                place = place[owner[place + MIN_WORDS - 1] == owner[place]]
                if len(place):
                    yield _suffix_batch(words, owner, block.column("doc_id").to_numpy(), long_, place)

    return marked.select("doc_id", "text", "marks").mapInArrow(run, SUFFIX)


def _neighbours(sorted_: DataFrame) -> DataFrame:
    """Suffixes that agree with a neighbour in sorted order, with that neighbour; ``later``: it stands before.

    The first and the last suffix of every partition come too (``edge`` 1 and 2), for the comparison across borders.
    """
    schema = SUFFIX + ", other long, other_pos int, later boolean, edge int, part int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["h", "doc_id", "pos", "other", "other_pos", "later", "edge", "part"]

        def out(h, doc, pos, other, other_pos, later, edge) -> pa.RecordBatch:
            none = other_pos < 0
            columns = [pa.array(h), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(other, mask=none), pa.array(other_pos.astype(np.int32), mask=none), pa.array(later), pa.array(edge.astype(np.int32)), pa.array(np.full(len(h), part, np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        before = None  # the last row seen, still without its right neighbour
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc, pos = (batch.column(c).to_numpy() for c in ("h", "doc_id", "pos"))
            if before is not None:
                h, doc, pos = (np.concatenate([[x], y]) for x, y in zip(before[:3], (h, doc, pos), strict=True))
            n = len(h)
            same = h[1:] == h[:-1]
            prev = np.concatenate([[False], same])
            if before is not None and before[3] is not None:
                prev[0] = True
            following = np.concatenate([same, [False]])
            other = np.where(prev, np.roll(doc, 1), np.roll(doc, -1))
            other_pos = np.where(prev, np.roll(pos, 1), np.roll(pos, -1)).astype(np.int64)
            if before is not None and before[3] is not None:
                other[0], other_pos[0] = before[3]
            edge = np.zeros(n, np.int64)
            if not seen:
                edge[0] = 1
            seen_edge_first = not seen
            seen = True
            hit = prev | following
            other_pos[~hit] = -1
            show = hit.copy()
            if seen_edge_first:
                show[0] = True
            show[-1] = False  # it waits for its right neighbour
            if n == 1 and seen_edge_first:
                show[0] = False
            carried_edge = 1 if n == 1 and seen_edge_first else 0
            before = (h[-1], doc[-1], pos[-1], (other[-1], other_pos[-1]) if prev[-1] else None, carried_edge or (before[4] if before is not None and n == 1 else 0))
            if show.any():
                yield out(*(x[show] for x in (h, doc, pos, other, other_pos, prev, edge)))
        if before is not None:
            h, doc, pos, left, first = before
            one = lambda x, t=np.int64: np.array([x], t)
            yield out(one(h), one(doc), one(pos), one(left[0] if left else 0), one(left[1] if left else -1), one(left is not None, bool), one(2 + first))

    return sorted_.mapInArrow(run, schema)


def _across(found: DataFrame) -> DataFrame:
    """Settles the rows at partition borders; at most two rows of each partition come to the driver."""
    edges = found.where("edge > 0").orderBy("part", "edge").collect()
    ends: dict[int, list] = {}
    for r in edges:
        ends.setdefault(r["part"], []).append(r)
    order = sorted(ends)
    fixed: dict[tuple[int, int, int], tuple] = {}
    for a, b in zip(order, order[1:], strict=False):
        last, first = ends[a][-1], ends[b][0]
        if last["h"] != first["h"]:
            continue
        fixed[(first["h"], first["doc_id"], first["pos"])] = (last["doc_id"], last["pos"], True)
        if not last["later"] and (last["h"], last["doc_id"], last["pos"]) not in fixed:
            fixed.setdefault((last["h"], last["doc_id"], last["pos"]), (first["doc_id"], first["pos"], False))
    kept = found.where("edge = 0 or other is not null").select("doc_id", "pos", "other", "other_pos", "later", "h")
    if not fixed:
        return kept.drop("h")
    rows = [(*k, *v) for k, v in fixed.items()]
    mended = found.sparkSession.createDataFrame(rows, "h long, doc_id long, pos int, other long, other_pos int, later boolean")
    kept = kept.join(F.broadcast(mended.select("h", "doc_id", "pos")), ["h", "doc_id", "pos"], "left_anti")
    return kept.select("doc_id", "pos", "other", "other_pos", "later").union(mended.select("doc_id", "pos", "other", "other_pos", "later"))


def _beside(suffixes: DataFrame, parts: int) -> DataFrame:
    """The suffixes whose hash occurs again, each with the place before it of that hash (``later``), or else after it.

    Rows at borders of partitions are left for :func:`_across`, which reads the written table.
    """
    ordered = suffixes.repartitionByRange(parts, "h", "doc_id", "pos").sortWithinPartitions("h", "doc_id", "pos")
    return _neighbours(ordered)


def _runs(pairs: DataFrame, parts: int) -> DataFrame:
    """Consecutive places of a document with the same shift against the same partner, as one stretch of words each.

    An end is open where the next place belongs to a repeated passage too, but with another partner: this partner's
    words can agree farther. Beside any other end the next passage occurs nowhere else. Ends at a batch's border count
    as open.
    """
    schema = "doc_id long, start int, stop int, other long, shift int, later boolean, open_left boolean, open_right boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, other, other_pos = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos", "other", "other_pos"))
            later = batch.column("later").to_numpy(zero_copy_only=False)
            shift = other_pos - pos
            beside = (doc[1:] == doc[:-1]) & (pos[1:] - pos[:-1] == 1)
            new = np.ones(len(doc), bool)
            new[1:] = ~beside | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1]) | (later[1:] != later[:-1])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(doc)) - 1
            left, right = np.concatenate([[True], beside])[at], np.concatenate([beside, [True]])[end]
            columns = [doc[at], pos[at].astype(np.int32), (pos[end] + MIN_WORDS).astype(np.int32), other[at], shift[at].astype(np.int32), later[at], left, right]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "start", "stop", "other", "shift", "later", "open_left", "open_right"])

    ordered = pairs.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "pos")
    return ordered.select("doc_id", "pos", "other", "other_pos", "later").mapInArrow(run, schema)


def _contexts(runs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(run, side, left, right): ``width`` hashed words around both sides of every run's open ends, nearest first."""
    sides = runs.select("run", "open_left", "open_right", F.explode(F.array(F.struct(F.col("doc_id").alias("doc_id"), F.lit(0).alias("side"), F.col("start").alias("a"), F.col("stop").alias("b")), F.struct(F.col("other").alias("doc_id"), F.lit(1).alias("side"), (F.col("start") + F.col("shift")).alias("a"), (F.col("stop") + F.col("shift")).alias("b")))).alias("x"))
    # a document can have very many runs with one other: its text meets some of them at a time
    asked = sides.select("run", "open_left", "open_right", "x.*").groupBy("doc_id", (F.col("run") % 64).alias("some")).agg(F.collect_list(F.struct("run", "side", "a", "b", "open_left", "open_right")).alias("asks"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                short = (words.hash >> np.uint64(32)).astype("<u4")
                rows, size = [], 0
                for i, asks in enumerate(block.column("asks").to_pylist()):
                    low, high = words.first[i], words.first[i + 1]
                    for x in asks:
                        a, b = low + x["a"], low + x["b"]
                        left = short[max(low, a - width) : a][::-1].tobytes() if x["open_left"] else b""
                        right = short[b : min(high, b + width)].tobytes() if x["open_right"] else b""
                        rows.append((x["run"], x["side"], left, right))
                        size += len(left) + len(right)
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["run", "side", "left", "right"])
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["run", "side", "left", "right"])

    return asked.join(docs, "doc_id").select("text", "asks").mapInArrow(run, "run long, side int, left binary, right binary")


def _agree(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y)) // 4
    differ = np.flatnonzero(np.frombuffer(x, "<u4", n) != np.frombuffer(y, "<u4", n))
    return int(differ[0]) if len(differ) else n


def _extended(runs: DataFrame, around: DataFrame, width: int) -> DataFrame:
    """The runs with their open ends moved by up to ``width`` words that agree; an end stays open if all of them do."""
    side = lambda s: around.where(F.col("side") == s).select("run", F.col("left").alias(f"l{s}"), F.col("right").alias(f"r{s}"))
    both = runs.join(side(0), "run").join(side(1), "run")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.fromiter((_agree(x, y) for x, y in zip(batch.column("l0").to_pylist(), batch.column("l1").to_pylist(), strict=True)), np.int64, batch.num_rows)
            right = np.fromiter((_agree(x, y) for x, y in zip(batch.column("r0").to_pylist(), batch.column("r1").to_pylist(), strict=True)), np.int64, batch.num_rows)
            start, stop = batch.column("start").to_numpy() - left, batch.column("stop").to_numpy() + right
            columns = {"start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "open_left": pa.array(left == width), "open_right": pa.array(right == width)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in runs_columns], names=runs_columns)

    runs_columns = runs.columns
    return both.mapInArrow(extend, runs.schema)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, other_id, other_start_word, later) of repeated stretches of 50 words or more.

    A word lies in a stretch with ``later`` if and only if it lies in 50 words that also stand before them in
    (document, place) order, and in some stretch if and only if its 50 words stand anywhere else. Every 50 words are
    linked with their nearest copy before them, the first copy with the next one; each stretch is that link extended
    until words differ. ``later``: the partner comes before it. The first copy of a passage never has it; another
    copy may also have rows without it, extended from places whose first copy it is. Words are those of
    :class:`Words` (A-Z lower-cased). Stretches may overlap. Null texts and texts of fewer than 50 words have none;
    rows without a key are left out; rows that repeat a key count once, with the greatest text.
    """
    spark = docs.sparkSession
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = partitions_for(spark, own.agg(F.sum(F.length("text"))).first()[0], 32 << 20)
    texts = own.groupBy("doc_id").agg(F.max("text").alias("text"))
    with Tables(spark) as tables:
        # a repeated key's suffixes can meet themselves here: a mark too many only costs time
        near = tables.keep(_beside(_suffixes(own), parts))
        marks = _across(near).groupBy("doc_id").agg(F.collect_set("pos").alias("marks"))
        # the documents with a mark that occurs again; those of every run and of its partner are among them
        marked = tables.keep(texts.join(marks, "doc_id"))
        tables.free(near)
        near = tables.keep(_beside(_passages(marked), parts))
        # the row's number only names the run; the table is written, so it is drawn once
        runs = tables.keep(_runs(_across(near), parts).withColumn("run", F.monotonically_increasing_id()))
        tables.free(near)
        found, width = [], BESIDE
        while True:
            found.append(runs.where("not (open_left or open_right)"))
            runs = runs.where("open_left or open_right")
            if runs.isEmpty():
                break
            around = tables.keep(_contexts(runs, marked.select("doc_id", "text"), width))
            runs = tables.keep(_extended(runs, around, width))
            tables.free(around)
            width *= GROWTH
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return materialise(whole.select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("other_id"), (F.col("start") + F.col("shift")).alias("other_start_word"), "later").distinct())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "n_chars") -> DataFrame:
    """The documents without their later copies of repeated passages; ``count`` follows if it is a column.

    Every other byte of a text stays. A document of which nothing but white space is left goes, as all of it stands
    elsewhere; documents without later copies, empty ones among them, stay as they are. Of rows that repeat a key only
    those with the text that was searched (the greatest) are cut; the others stay.
    """
    spans = repeated_passages(docs, key, text).where("later").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cut"))
    cut = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # which of a key's texts was searched: its hash, so that no text is shuffled for it; equal hashes are compared by length too
    digest = lambda t: F.struct(F.length(t).alias("n"), F.sha2(t, 256).alias("h"))
    repeated = cut.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id")
    searched = cut.join(repeated, "__id", "left_semi").groupBy("__id").agg(F.max("__text").alias("t")).select("__id", digest(F.col("t")).alias("__searched"))
    spans = spans.withColumnRenamed("doc_id", "__id").join(searched, "__id", "left")
    marked = docs.join(spans, F.col(key) == F.col("__id"), "left")
    own = F.col("__searched").isNull() | (F.col("__searched") == digest(F.coalesce(F.col(text), F.lit(""))))
    marked = marked.select(*docs.columns, F.when(own, F.col("__cut")).alias("__cut"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, text):
                cuts = block.column("__cut").to_pylist()
                texts = block.column(text).to_pylist()
                gone = np.zeros(len(cuts), bool)
                words = Words(block.column(text)) if any(cuts) else None
                for i, cut in enumerate(cuts):
                    if not cut:
                        continue
                    low, high = words.first[i], words.first[i + 1]
                    drop = np.zeros(high - low + 1, np.int64)
                    for x in cut:
                        drop[x["start_word"]] += 1
                        drop[min(x["start_word"] + x["n_words"], high - low)] -= 1
                    keep = np.flatnonzero(np.concatenate([[False], drop[:-1].cumsum() == 0, [False]])[1:] != np.concatenate([[False], drop[:-1].cumsum() == 0, [False]])[:-1])
                    at = words.at[i + 1]
                    edges = np.append(words.start[low:high], at)
                    edges[0] = words.at[i]
                    raw = words.raw
                    parts = [raw[edges[a] : edges[b]].tobytes().decode() for a, b in zip(keep[::2], keep[1::2], strict=True)]
                    texts[i] = "".join(parts)
                    gone[i] = not texts[i].strip()
                columns = [pa.array(texts, pa.string()) if n == text else block.column(n) for n in block.schema.names if n != "__cut"]
                out = pa.RecordBatch.from_arrays(columns, names=[n for n in block.schema.names if n != "__cut"])
                yield out.filter(pa.array(~gone))

    kept = marked.mapInArrow(run, docs.schema)
    if count in docs.columns:
        kept = kept.withColumn(count, F.length(text).cast(dict(docs.dtypes)[count]))
    return kept
