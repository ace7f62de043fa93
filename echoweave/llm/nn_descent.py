"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its nearest neighbours found so far: the ``K`` best, and while all of those reach the
threshold it is enlarged, up to ``WIDE``. Lists start from random hyperplane trees: vectors sorted by (label, signs,
projection) are compared within consecutive blocks of bounded size. Rounds of the local join follow: a vector's
neighbours are compared with each other, as a neighbour of a neighbour is likely a neighbour.

Entries at the threshold are links, and links make components. A full list may hide links, but only from one full list
to another. So the vectors with full lists are searched again, now for neighbours outside their own component; what is
found joins components, and those whose lists are full once more are searched once more, until no list is full. A full
list joins its component with another one, so the components of such vectors at least halve each time.

Within each component all pairs are compared in blocks, and only the number of links leaves a block: ``n_links`` misses
a link only where the component does. Recall is audited on that result, uncut, against brute force; while it is too low,
another forest and another round refine the lists, and if the last one does not do, an exact search in blocks takes
their place. Of it only a spanning forest of each block's links leaves the block.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, components, materialise, partitions_for

K, WIDE, TREES, BLOCK, JOINED, ROUNDS = 10, 48, 4, 1024, 16, 2
#: Most queries of the audit (rows whose id is divisible by 50, before others; then those with the least hashes), and the mean share of a query's links that must be found.
AUDIT, RECALL = 1000, 0.97
PAIR = "a long, b long, sim double"
log = logging.getLogger(__name__)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(sim.astype(float))], names=["a", "b", "sim"])


def _best(sims: np.ndarray, ids: np.ndarray, comps: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Of a block's similarities to other components each row's K best, and those at the threshold up to WIDE."""
    sims[comps[:, None] == comps[None, :]] = -2
    ordered = -np.partition(-sims, [min(K, len(ids) - 1) - 1, min(WIDE, len(ids) - 1) - 1], axis=1)
    kth, wide = ordered[:, min(K, len(ids) - 1) - 1], ordered[:, min(WIDE, len(ids) - 1) - 1]
    a, b = np.nonzero((sims >= np.maximum(np.minimum(kth, threshold), wide)[:, None]) & (sims > -2))
    return _pairs(ids[a], ids[b], sims[a, b])


def _forest(vectors: DataFrame, dim: int, first: int, threshold: float) -> DataFrame:
    """Neighbours of another component within blocks of ``TREES`` sorted orders of ``vectors(id, label, comp, vec)``; tree numbers start at ``first``."""
    spark = vectors.sparkSession
    n = vectors.count()
    bits = max(1, math.ceil(math.log2(max(2, n / BLOCK / 4))))
    planes = np.random.default_rng(1234 + first).standard_normal((TREES, bits + 1, dim))

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            for tree in range(TREES):
                y = x @ planes[tree].T
                sign = ((y[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), batch.column("label"), pa.array(sign), pa.array(y[:, bits]), batch.column("id"), batch.column("comp"), batch.column("vec")], names=["tree", "label", "sign", "proj", "id", "comp", "vec"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            ids, comps, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            if len(ids) > 1:
                yield _best(x @ x.T, ids, comps, threshold)

        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, comps = _matrix(batch.column("vec"), dim), batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "sign")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and keys[a] != name:
                    yield from block()
                    size = 0
                name = keys[a]
                while a < b:
                    take = min(b - a, BLOCK - size)
                    held.append((ids[a : a + take], comps[a : a + take], x[a : a + take]))
                    size, a = size + take, a + take
                    if size == BLOCK:
                        yield from block()
                        size = 0
        if held:
            yield from block()

    # tasks of some blocks each, so that few blocks end early at a border
    parts = partitions_for(spark, n * TREES, 16 * BLOCK)
    planted = vectors.select("id", "label", "comp", "vec").mapInArrow(plant, "tree int, label int, sign long, proj double, id long, comp long, vec array<double>")
    ordered = planted.repartitionByRange(parts, "tree", "label", "sign", "proj").sortWithinPartitions("tree", "label", "sign", "proj", "id")
    return ordered.mapInArrow(compare, PAIR)


def _merge(lists: DataFrame | None, found: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """Lists (id, near: sorted (sim, b)) of the K best, and of those at the threshold up to WIDE, among old entries and new pairs."""
    flat = found.select(F.col("a").alias("id"), F.struct("sim", "b").alias("x"))
    if lists is not None:
        flat = flat.union(lists.select("id", F.explode("near").alias("x")))
    near = flat.groupBy("id").agg(F.sort_array(F.collect_set("x"), asc=False).alias("near"))
    out = tables.keep(near.select("id", F.filter("near", lambda x, i: (i < K) | ((x["sim"] >= threshold) & (i < WIDE))).alias("near")))
    if lists is not None:
        tables.free(lists)
    return out


def _local_join(lists: DataFrame, inner: DataFrame | None, vectors: DataFrame, dim: int, turn: int, threshold: float) -> DataFrame:
    """Compares the neighbours of each vector with each other, if their components differ: ``JOINED`` of its list, others in every round.

    ``inner``: lists from before components were joined; as many neighbours of theirs take part.
    """
    drawn = F.slice(F.array_sort(F.transform("near", lambda x: F.struct(F.xxhash64(x["b"], F.col("id"), F.lit(turn)).alias("h"), x["b"].alias("b")))), 1, JOINED)
    pick = lambda of: of.select(F.col("id").alias("center"), F.explode(drawn).alias("x")).select("center", F.col("x.b").alias("id"))
    asked = pick(lists) if inner is None else pick(lists).union(pick(inner)).union(inner.select(F.col("id").alias("center"), "id")).distinct()
    last = F.element_at("near", -1)["sim"]
    worst = lists.select("id", F.when(F.size("near") >= WIDE, last).when(F.size("near") >= K, F.least(last, F.lit(threshold))).otherwise(-1.5).alias("floor"))
    members = asked.join(vectors.join(worst, "id", "left").select("id", "comp", "vec", F.coalesce("floor", F.lit(-1.5)).alias("floor")), "id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for center in zip(*(batch.column(c).to_pylist() for c in ("ids", "comps", "floors", "vecs")), strict=True):
                ids, comps, floor, x = (np.array(c) for c in center)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sims = x @ x.T
                sims[comps[:, None] == comps[None, :]] = -2
                a, b = np.nonzero((sims > floor[:, None]) & (sims > -2))
                out.append((ids[a], ids[b], sims[a, b]))
            if out:
                yield _pairs(*(np.concatenate(c) for c in zip(*out, strict=True)))

    around = members.groupBy("center").agg(F.collect_list(F.struct("id", "comp", "floor", "vec")).alias("m")).where(F.size("m") > 1)
    around = around.select(F.col("m.id").alias("ids"), F.col("m.comp").alias("comps"), F.col("m.floor").alias("floors"), F.col("m.vec").alias("vecs"))
    return around.mapInArrow(compare, PAIR).distinct()


def _recall(counts: DataFrame, copies: DataFrame, dim: int, threshold: float) -> float:
    """The mean, over at most ``AUDIT`` queries that have links, of the share of them in ``counts(id, others)``; brute force over all vectors, uncut."""
    queries = copies.orderBy(F.when(F.col("id") % 50 == 0, 0).otherwise(1), F.xxhash64("id")).limit(AUDIT).select("id", "label", "vec").collect()
    if not queries:
        return 1.0
    ids, labels = np.array([q["id"] for q in queries]), np.array([q["label"] for q in queries])
    x = np.array([q["vec"] for q in queries], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
                sims = x @ _matrix(batch.column("vec"), dim).T
                near = (sims >= threshold) & (labels[:, None] == label[None, :]) & (ids[:, None] != own[None, :])
                many = near @ batch.column("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[many > 0]), pa.array(many[many > 0])], names=["id", "n"])

    true = copies.mapInArrow(search, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    share = true.join(counts, "id", "left").agg(F.avg(F.coalesce("others", F.lit(0)) / F.col("n"))).first()[0]
    return 1.0 if share is None else share


def _in_blocks(rows: DataFrame, sizes: DataFrame, dim: int, schema: str, compare) -> DataFrame:
    """``compare`` of every two chunks of each group of ``rows(g, size, id, weight, vec)``; chunks hold about BLOCK rows.

    ``sizes`` holds the ``size`` of each group. A row is copied once for each chunk of its group. ``compare(ids, weights, x, left)``: ``left`` marks the rows of
    the first of two chunks; all are left ones where a chunk meets itself.
    """
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "vec")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> Iterator[pa.RecordBatch]:
            own, ids, weights, x = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from compare(ids, weights, x, np.ones(len(own), bool) if key[1] == key[2] else own == key[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, i, j, own, ids, weights = (batch.column(c).to_numpy() for c in ("g", "i", "j", "own", "id", "weight"))
            x = _matrix(batch.column("vec"), dim)
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = (g[a], i[a], j[a])
                if name != key:
                    if held:
                        yield from block()
                    key, held = name, []
                held.append((own[a:b], ids[a:b], weights[a:b], x[a:b]))
        if held:
            yield from block()

    parts = partitions_for(rows.sparkSession, sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0], 16 * BLOCK)
    return dealt.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, schema)


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it reaches) by the links ``near`` between two blocks of ids."""
    rows, columns, none = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        least_c = np.minimum(columns, np.where(near, rows[:, None], none).min(axis=0, initial=none))
        least_r = np.minimum(rows, np.where(near, least_c[None, :], none).min(axis=1, initial=none))
        if (least_c == columns).all() and (least_r == rows).all():
            ids, roots = np.concatenate([left, right]), np.concatenate([rows, columns])
            return ids[ids != roots], roots[ids != roots]
        rows, columns = least_r, least_c


def _exact(vectors: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links (a, b) that join all vectors of a label as all its links do; for vectors whose lists stay below the recall."""

    def links(ids, weights, x, left) -> Iterator[pa.RecordBatch]:
        right = np.ones(len(left), bool) if left.all() else ~left
        a, b = _spanning(x[left] @ x[right].T >= threshold, ids[left], ids[right])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sizes = vectors.groupBy("label").agg(F.count("*").alias("size"))
    rows = vectors.join(sizes, "label").select(F.col("label").cast("long").alias("g"), "size", "id", F.lit(1).cast("long").alias("weight"), "vec")
    return _in_blocks(rows, sizes, dim, "a long, b long", links)


def _link_counts(members: DataFrame, sizes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, others): for each of ``members(g, size, id, weight, vec)`` the weights of the others of its group that it links with."""

    def count(ids, weights, x, left) -> Iterator[pa.RecordBatch]:
        right = np.ones(len(left), bool) if left.all() else ~left
        near = x[left] @ x[right].T >= threshold
        near &= ids[left][:, None] != ids[right][None, :]
        yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array((near @ weights[right]).astype(np.int64))], names=["id", "others"])
        if not left.all():
            yield pa.RecordBatch.from_arrays([pa.array(ids[right]), pa.array((weights[left] @ near).astype(np.int64))], names=["id", "others"])

    return _in_blocks(members, sizes, dim, "id long, others long", count).groupBy("id").agg(F.sum("others").alias("others"))


def _links(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.select(F.col("id").alias("a"), F.explode("near").alias("x")).where(F.col("x.sim") >= threshold).select("a", F.col("x.b").alias("b"))


def _join_components(lists: DataFrame, vectors: DataFrame, dim: int, seed: int, threshold: float, tables: Tables) -> DataFrame:
    """Components (id, component_id) of the links in the lists, and of those that full lists hide."""
    full = lambda of: of.where((F.size("near") >= WIDE) & (F.element_at("near", -1)["sim"] >= threshold))
    links = tables.keep(_links(lists, threshold))
    found = components(links)
    inner = tables.keep(full(lists))
    while not inner.isEmpty():
        hidden = tables.keep(vectors.drop("comp").join(inner.select("id"), "id", "left_semi").join(found, "id").withColumnRenamed("component_id", "comp"))
        outer = _merge(None, _forest(hidden, dim, seed * TREES, threshold), threshold, tables)
        for turn in range(ROUNDS):
            outer = _merge(outer, _local_join(outer, inner, hidden, dim, seed * ROUNDS + turn, threshold), threshold, tables)
        across = _links(outer, threshold)
        if across.isEmpty():
            return found
        # a component stands for its members
        of = found.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
        pairs = across.join(found.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), "a").join(of, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        wider = components(tables.keep(pairs.distinct())).select(F.col("id").alias("component_id"), F.col("component_id").alias("wider"))
        found = tables.keep(found.join(wider, "component_id", "left").select("id", F.coalesce("wider", "component_id").alias("component_id")))
        inner, seed = tables.keep(full(outer)), seed + 1
    return found


def _of_dimension(good: DataFrame, dim: int, threshold: float, max_forests: int, tables: Tables) -> DataFrame:
    """(id, n_links, component_id) of usable rows (id, label, vec) of one dimension."""
    copies = tables.keep(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    vectors = copies.select("id", "label", F.col("id").alias("comp"), "vec")

    def counted(found: DataFrame) -> DataFrame:
        sizes = tables.keep(found.groupBy("component_id").agg(F.count("*").alias("size")))
        members = found.join(sizes, "component_id").join(copies, "id").select(F.col("component_id").alias("g"), "size", "id", F.col("copies").alias("weight"), "vec")
        return tables.keep(_link_counts(members, sizes, dim, threshold))

    lists = counts = None
    for forest in range(max_forests):
        lists = _merge(lists, _forest(vectors, dim, forest * TREES, threshold), threshold, tables)
        for turn in range(ROUNDS):
            lists = _merge(lists, _local_join(lists, None, vectors, dim, forest * ROUNDS + turn, threshold), threshold, tables)
        found = _join_components(lists, vectors, dim, max_forests + forest, threshold, tables)
        counts = counted(found)
        recall = _recall(counts, copies, dim, threshold)
        log.info("dimension %d, forest %d: recall %.4f", dim, forest, recall)
        if recall >= RECALL:
            break
    else:
        found = components(tables.keep(_exact(vectors, dim, threshold)))
        counts = counted(found)
    whole = copies.join(counts, "id", "left").join(found, "id", "left").select("label", "vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return tables.keep(good.join(whole, ["label", "vec"]).select("id", "n_links", "component_id"))


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, max_forests: int = 5) -> DataFrame:
    """(key, n_links, component_id, kept) of every row whose key is not null.

    Only vectors of one label and one dimension are compared; each dimension is searched apart. Vectors without label,
    and those that are null, empty, zero or have null or non-finite components, link with nothing. Vectors are scaled
    by their largest component first, so neither large nor tiny numbers spoil their length. Equal vectors of a label
    are searched once and each copy counts as a link of the others. Rows that repeat a key give one row, with the
    least (label, vector). Other columns are not read.
    """
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "vec"), F.struct("label", "vec")).alias("x")).select("id", "x.*")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    with Tables(table.sparkSession) as tables:
        rows = tables.keep(rows.withColumn("usable", usable).withColumn("vec", F.when(F.col("usable"), F.transform("vec", lambda x: x / largest))))
        good = rows.where("usable").select("id", "label", "vec")
        dims = sorted(r[0] for r in good.select(F.size("vec")).distinct().collect())
        done = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        for dim in dims:
            done = done.unionByName(_of_dimension(good.where(F.size("vec") == dim), dim, threshold, max_forests, tables))
        return materialise(done.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")))
