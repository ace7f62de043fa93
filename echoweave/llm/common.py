"""Helpers shared by the operators: scratch tables, blocks of Arrow text, vectorised word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; it bounds the working arrays whatever the Arrow batch holds.
BLOCK_BYTES = 1 << 19
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one operator. Those still there at the end of a ``with`` block are deleted then."""

    def __init__(self, spark: SparkSession, compression: str | None = None):
        self.spark, self.options = spark, {"compression": compression} if compression else {}
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.free(*[frame for frame, _ in self.paths.values()])

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        df.write.options(**self.options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def free(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        context = self.spark.sparkContext
        for frame in frames:
            name = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame))[1])
            name.getFileSystem(context._jsc.hadoopConfiguration()).delete(name, True)


def partitions_for(spark: SparkSession, units: int, per_task: int) -> int:
    """As many partitions as keep a task at ``per_task`` units, and at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(units or 0) // per_task))


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, room = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and room + size > limit:
            yield batch.slice(at, i - at)
            at, room = i, 0
        room += size
    if at < batch.num_rows:
        yield batch.slice(at)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 places where they begin."""
    big = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = big.buffers()
    at = np.frombuffer(offsets, np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves about half of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def scramble(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _MIX[2])


_BYTE = scramble(256, 1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(steps)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = known
    return known[:n]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts, A-Z lower-cased, as 64-bit hashes.

    ``hash``, ``start``, ``end`` (byte places in ``raw``) have one entry per word; the words of text i are
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: pa.Array):
        self.raw, self.at = text_bytes(texts)
        n = len(self.raw)
        solid = ~_SPACE[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.raw] * _power(_BASE, n), out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * _power(_INVERSE, n + 1)[self.start])
        self.first = np.searchsorted(self.start, self.at)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on (the last k - 1 places have none)."""
        odd = scramble(k, 7) | np.uint64(1)
        m = max(0, len(self.hash) - k + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(m, np.uint64)
            for j in range(k):
                out += self.hash[j : j + m] * odd[j]
        return mix(out)


def shingle_set(words: Words, grams: np.ndarray, i: int, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of text i; all its words as one if they are fewer."""
    a, b = words.first[i], words.first[i + 1]
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((words.hash[a:b] * (scramble(k, 9)[: b - a] | np.uint64(1))).sum(keepdims=True, dtype=np.uint64))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: a written table (id, component_id), one row per vertex that has an edge to another.

    Alternates large-star and small-star rounds. The least neighbours are written before they meet the edges, so both
    sides of that join are plain shuffles, of which Spark splits the large partition of a vertex with very many edges.
    Only the tables of the last round are kept.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with Tables(spark) as tables:
        edges = tables.keep(both(edges.where("a <> b")).distinct())
        before = None
        for _ in range(max_rounds):
            least = tables.keep(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
            large = edges.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            lowest = low.groupBy("a").agg(F.min("b").alias("m"))
            small = low.join(lowest, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b")
            previous, edges = edges, tables.keep(both(small).distinct())
            tables.free(previous, least)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"no convergence in {max_rounds} rounds")
        return materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component_id")).withColumnRenamed("a", "id"))


def roots(parents: DataFrame) -> DataFrame:
    """The written table (id, root) of a forest ``parents(b, a)`` with one parent a < b for each b; roots come too."""
    with Tables(parents.sparkSession) as tables:
        own = parents.select(F.col("b").alias("id"), F.col("a").alias("up"))
        own = tables.keep(own.unionByName(own.join(own.select(F.col("id").alias("up")), "up", "left_anti").select(F.col("up").alias("id"), "up").distinct()))
        while True:
            above = own.select(F.col("id").alias("up"), F.col("up").alias("higher"))
            following = tables.keep(own.join(above, "up").select("id", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")))
            moved = not following.where("moved").isEmpty()
            tables.free(own)
            own = following.drop("moved")
            if not moved:
                return materialise(own.withColumnRenamed("up", "root"))
            own = tables.keep(own)
            tables.free(following)
