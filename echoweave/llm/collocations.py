"""Phrase collocations by set-oriented (SETM) mining: relations of occurrences, merge-joined, counted and semi-joined.

The relation R_k holds the occurrences of frequent phrases of k words. It is persisted in order of (piece, position),
nested: a row for each document, ``groups[position]`` the number of the phrase that begins there, -1 for none. Positions
run through the document; one without a word ends each piece, so no phrase crosses a border.

One step: R_k is merge-joined with itself at adjacent positions (two phrases that share all but their outer words make
one of k + 1), the pairs are counted by group, groups with enough occurrences are numbered, and the pairs are
semi-joined with them, which makes R_(k+1). The first step does the same with words.

The frequent groups are looked up from a sorted array on every executor where a count has shown that they are few, and
by a shuffle join on the group otherwise, where Spark splits the partition of a group with very many occurrences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, materialise, text_blocks, text_bytes

MAX_WORDS, MIN_COUNT, COVER, TOP = 3, 10, 50, 2000
#: Words or groups that a task joins at once, and groups that it counts at once.
SLICE, COUNTED = 250_000, 1_000_000
#: Most frequent groups (words: strings; longer phrases: 8 bytes each) that every executor holds.
BROADCAST_GROUPS = 1 << 21
#: Shares of a language that are ranked apart before their best meet.
SALTS = 64

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each text its words in order, and an empty string after each piece that has any: (ends of texts, tokens)."""
    raw, at = text_bytes(texts)
    n = len(raw)
    cut = _CUT[raw]
    solid = ~cut & ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    if not n:
        return np.zeros(len(at), np.int64), pa.array([], pa.string())
    before, after = np.append(False, solid[:-1]), np.append(solid[1:], False)
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    stop = np.flatnonzero(solid & (~after | edge[1:])) + 1
    # the piece of a word: cuts and ends of texts before it
    piece = (np.cumsum(np.append(0, cut[:-1])) + np.cumsum(edge[:-1]))[start]
    last = np.append(piece[1:] != piece[:-1], True)[: len(start)]
    words = _LOWER[raw[solid]]
    count = 1 + last.astype(np.int64)
    place = np.cumsum(count) - count
    sizes = np.zeros(count.sum(), np.int64)
    sizes[place] = stop - start
    offsets = np.append(0, np.cumsum(sizes))
    tokens = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(words)).cast(pa.string())
    ends = np.append(place, len(sizes))[np.searchsorted(start, at)]
    return ends, tokens


def _nested(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), values)


def _occurrences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, words): the relation of all words, not yet numbered."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                ends, tokens = _tokens(block.column("text"))
                yield pa.RecordBatch.from_arrays([block.column("lang"), _nested(ends, tokens)], names=["lang", "words"])

    return source.mapInArrow(run, "lang string, words array<string>").withColumn("doc", F.monotonically_increasing_id())


def _numbered(groups: DataFrame, by: list[str], tables: Tables) -> DataFrame:
    """The groups in order of ``by`` with ``id`` from 0: only the sizes of the parts leave them."""
    kept = tables.keep(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("mono", F.monotonically_increasing_id()))
    part = F.shiftright("mono", 33)
    sizes = sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = F.broadcast(kept.sparkSession.createDataFrame(starts, "part long, begin long"))
    out = tables.keep(kept.withColumn("part", part).join(begin, "part").withColumn("id", F.col("begin") + F.col("mono") - F.shiftleft("part", 33)).drop("part", "begin", "mono"))
    tables.free(kept)
    return out


def _slices(batches: Iterable[pa.RecordBatch], nested: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with at most ``most`` entries of a nested column (a longer row stands alone): arrays of a slice are all that a task holds."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(nested)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a nested column and, for each, the row that it is in."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))


def adjacent(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a nested relation with itself at the next position: (places in the flat relation, left, right)."""
    groups, row = _flat(column)
    at = np.flatnonzero((groups[:-1] >= 0) & (groups[1:] >= 0) & (row[:-1] == row[1:])) if len(groups) > 1 else np.zeros(0, np.int64)
    return at, groups[at], groups[at + 1]


def pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, f) of each slice of a nested relation."""
    for batch in _slices(batches, "groups", COUNTED):
        _, left, right = adjacent(batch.column("groups"))
        order = np.lexsort((right, left)) if len(left) and max(left.max(), right.max()) >> 31 else np.argsort((left << 32) | right, kind="stable")
        left, right = left[order], right[order]
        first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[: len(left)])
        many = np.diff(np.append(first, len(left)))
        yield pa.RecordBatch.from_arrays([pa.array(left[first]), pa.array(right[first]), pa.array(many.astype(np.int64))], names=["left", "right", "f"])


def _counted(relation: DataFrame) -> DataFrame:
    """(left, right, f): occurrences of each pair of phrases at adjacent positions, added up in the tasks first."""
    return relation.select("groups").mapInArrow(pair_counts, "left long, right long, f long").groupBy("left", "right").agg(F.sum("f").alias("f"))


def _scattered(length: np.ndarray, found: pa.Array) -> pa.Array:
    """Nested groups of the given lengths, -1 but for the (position, group) in ``found``."""
    ends = np.append(0, np.cumsum(length))
    out = np.full(ends[-1], -1, np.int64)
    own = found.fill_null([]) if found.null_count else found
    pairs = own.flatten()
    if len(pairs):
        row = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
        out[ends[:-1][row] + pairs.field("pos").to_numpy()] = pairs.field("id").to_numpy()
    return _nested(ends, pa.array(out))


def _from_join(rows: DataFrame, nested: str, occurrences: DataFrame, frequent: DataFrame, by: list[str]) -> DataFrame:
    """The semi-join by shuffle: ``occurrences(doc, pos, *by)`` of ``frequent(*by, id)``, nested again beside their documents."""
    found = occurrences.join(frequent.select(*by, "id"), by).groupBy("doc").agg(F.collect_list(F.struct("pos", "id")).alias("found"))
    both = rows.select("lang", "doc", F.size(nested).alias("length")).join(found, "doc", "left").select("lang", "doc", "length", "found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc"), _scattered(batch.column("length").to_numpy(), batch.column("found"))], names=["lang", "doc", "groups"])

    return both.mapInArrow(run, "lang string, doc long, groups array<long>")


def _words_joined(rows: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """R_1: the occurrences of frequent words, semi-joined with ``frequent(lang, word, id)``."""
    if frequent.count() > most:
        occurrences = rows.select("lang", "doc", F.posexplode("words").alias("pos", "word")).where("word <> ''")
        return _from_join(rows, "words", occurrences, frequent, ["lang", "word"])
    # ids follow (lang, word), so those of one language lie together
    table = frequent.select("lang", "word", "id").toArrow().sort_by("id")
    own = {name: table.filter(pc.equal(table.column("lang"), name)) for name in table.column("lang").unique().to_pylist()}
    held = rows.sparkSession.sparkContext.broadcast({name: (t.column("word").combine_chunks(), t.column("id").to_numpy()) for name, t in own.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "words"):
            words, names = batch.column("words"), batch.column("lang").to_pylist()
            flat, row = words.flatten(), np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            out = np.full(len(flat), -1, np.int64)
            which = np.array([names.index(x) for x in names], np.int64) if names else np.zeros(0, np.int64)
            for name in dict.fromkeys(names):
                if name in held.value:
                    known, ids = held.value[name]
                    at = np.flatnonzero((which == names.index(name))[row])
                    hit = pc.index_in(flat.take(pa.array(at)), value_set=known)
                    valid = hit.is_valid().to_numpy(zero_copy_only=False)
                    out[at[valid]] = ids[hit.drop_null().to_numpy()]
            ends = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc"), _nested(ends, pa.array(out))], names=["lang", "doc", "groups"])

    return rows.select("lang", "doc", "words").mapInArrow(run, "lang string, doc long, groups array<long>")


def _pairs_joined(relation: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """R_(k+1): the pairs at adjacent positions of R_k, semi-joined with ``frequent(left, right, id)``."""
    few = frequent.agg(F.count("*"), F.max(F.greatest("left", "right"))).first()
    if few[0] > most or (few[1] or 0) >> 31:

        def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = batch.column("groups")
                at, left, right = adjacent(groups)
                size = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(groups)), size)[at]
                pos = at - (np.cumsum(size) - size)[row]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(left), pa.array(right)], names=["doc", "pos", "left", "right"])

        return _from_join(relation, "groups", relation.select("doc", "groups").mapInArrow(pairs, "doc long, pos int, left long, right long"), frequent, ["left", "right"])
    table = frequent.select("left", "right", "id").toArrow().sort_by("id")
    # ids follow (left, right), so an id is the place in the sorted keys
    held = relation.sparkSession.sparkContext.broadcast((table.column("left").to_numpy() << 32) | table.column("right").to_numpy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        for batch in _slices(batches, "groups"):
            groups = batch.column("groups")
            at, left, right = adjacent(groups)
            size = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
            out = np.full(size.sum(), -1, np.int64)
            if len(keys):
                key = (left << 32) | right
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                out[at[hit]] = place[hit]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc"), _nested(np.append(0, np.cumsum(size)), pa.array(out))], names=["lang", "doc", "groups"])

    return relation.mapInArrow(run, "lang string, doc long, groups array<long>")


def _levels(docs: DataFrame, text: str, lang: str, longest: int, least: int, most: int, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """For each length the frequent groups (lang, id, phrase, last, left, right, pre, suf), and (lang, n) of all words.

    ``pre`` counts the first 1, 2, ... words of a phrase and ``suf`` its last k, k - 1, ... words.
    """
    rows = tables.keep(_occurrences(docs, text, lang))
    words = tables.keep(rows.select("lang", F.explode("words").alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f")))
    n = tables.keep(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = _numbered(words.where(F.col("f") >= least), ["lang", "word"], tables)
    tables.free(words)
    relation = tables.keep(_words_joined(rows, frequent, most))
    tables.free(rows)
    levels = [frequent.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.array("f").alias("pre"), F.array("f").alias("suf"))]
    for k in range(2, longest + 1):
        groups = _numbered(_counted(relation).where(F.col("f") >= least), ["left", "right"], tables)
        head = levels[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("begin"), "pre")
        tail = levels[-1].select(F.col("id").alias("right"), "last", "suf")
        level = groups.join(head, "left").join(tail, "right").select("lang", "id", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "left", "right", F.concat("pre", F.array("f")).alias("pre"), F.concat(F.array("f"), "suf").alias("suf"))
        levels.append(tables.keep(level))
        if k < longest:
            before, relation = relation, tables.keep(_pairs_joined(relation, groups, most))
            tables.free(before)
        tables.free(groups)
    tables.free(relation)
    return levels, n


def _wide(column: str) -> str:
    return f"cast({column} as decimal(18, 0))"


#: The lowest-scoring cut (k, l, r) of a phrase with counts pre and suf. Counts below 10^15 keep every product within 38 digits.
_CUTS = f"array_min(transform(sequence(1, size(pre) - 1), k -> struct((1000000BD * ({_wide('pre[size(pre) - 1]')} * {_wide('pre[size(pre) - 1]')})) div ({_wide('pre[k - 1]')} * {_wide('suf[k]')}) as score, k as k, pre[k - 1] as l, suf[k] as r)))"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``max_words`` words of each language.

    A candidate occurs ``min_count`` times or more in its language (null: ``und``). It is dropped if a longer candidate
    that holds its words has ``cover`` percent of its occurrences or more; one longer by one word decides, as any longer
    candidate around it holds such a one with as many occurrences or more. Ranks run by score and occurrences
    descending, then by the phrase's UTF-8 bytes. Null and empty texts have no words; repeated rows count each; other
    columns, keys among them, are not read. A table without candidates gives no rows.
    """
    with Tables(docs.sparkSession) as tables:
        levels, n = _levels(docs, text, lang, max_words, min_count, broadcast_groups, tables)
        found = None
        for k in range(1, max_words):
            level = levels[k].withColumn("a", F.element_at("pre", -1))
            if k + 1 < max_words:
                longer = levels[k + 1].withColumn("f", F.element_at("pre", -1))
                around = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
                level = level.join(around, "id", "left").where((F.coalesce("around", F.lit(0)) * 100 < F.col("a") * cover) | F.col("around").isNull())
            level = level.select("lang", "phrase", "a", F.expr(_CUTS).alias("cut"))
            found = level if found is None else found.unionByName(level)
        scored = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        order = (F.desc("score"), F.desc("a"), "phrase")
        apart = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        apart = apart.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
        best = apart.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        return materialise(best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
