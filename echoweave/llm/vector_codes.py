"""Vectors as short codes: one codebook for each of their parts, found by Lloyd's rounds over resident members.

A member is one part of one vector. Members are dealt to owners (position, entry, salt), and an owner's members lie
together in files. A round reads the resident members with the codebooks and writes them again where they are, without
a shuffle, but for those whose nearest entry changed: these migrate to their new owners. Owners then sum their
members, and the sums of all owners of an entry make it anew. The salt spreads an entry that holds most of the members.

Only the codebooks pass through the driver: as many numbers as ``entries`` vectors have, whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, materialise, partitions_for

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Members of a task, and integers that one step of the search for the nearest entry holds.
MEMBERS, STEP = 500_000, 1 << 21
#: Most labels whose sums are sent to every executor; more are joined by shuffle.
BROADCAST_LABELS = 100_000

MEMBER = "position int, entry int, salt int, part array<int>"


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _list_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).astype(np.int32)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry (ties: the lower) and the squared distance to it, exactly, for each row of x."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, STEP // max(1, book.size))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = np.square(part[:, None, :] - book[None, :, :]).sum(axis=2)
        at[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d.min(axis=1)
    return at, far


@dataclass(frozen=True)
class Codebooks:
    """Fitted codebooks: ``books[position, entry]`` is an entry of ``width`` integers. Vectors of ``dim`` components are padded with zeros."""

    dim: int
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, label, code, error) of ``rows(id, label, x)``."""
        books, dim, width, padded = self.books, self.dim, self.width, len(self.books) * self.width
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.pad(_lists(batch.column("x"), dim), ((0, 0), (0, padded - dim))).reshape(batch.num_rows, len(books), width)
                found = [nearest(x[:, p], books[p]) for p in range(len(books))]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                names = [row.tobytes().hex() for row in code]
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

        return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _members(rows: DataFrame, first: Codebooks, salts: int) -> DataFrame:
    """The parts of all vectors with their nearest entries; a row's salt comes from its own components and place."""
    books, dim, width, padded = first.books, first.dim, first.width, len(first.books) * first.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.pad(_lists(batch.column("x"), dim), ((0, 0), (0, padded - dim))).reshape(batch.num_rows, len(books), width)
            salt = batch.column("salt")
            for p in range(len(books)):
                entry = nearest(x[:, p], books[p])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), salt, _list_array(x[:, p])], names=["position", "entry", "salt", "part"])

    return rows.select("x", F.pmod(F.xxhash64("id", "x"), F.lit(salts)).cast("int").alias("salt")).mapInArrow(run, MEMBER)


def _assigned(members: DataFrame, now: Codebooks) -> DataFrame:
    """The members with their entries under new codebooks, and whether the entry changed."""
    books, width = now.books, now.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, position, was = _lists(batch.column("part"), width), batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            entry = np.zeros(len(x), np.int32)
            for p in np.unique(position):
                own = position == p
                entry[own] = nearest(x[own], books[p])[0]
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(entry), batch.column("salt"), batch.column("part"), pa.array(entry != was)], names=["position", "entry", "salt", "part", "moved"])

    return members.mapInArrow(run, MEMBER + ", moved boolean")


def _updated(members: DataFrame, now: Codebooks) -> Codebooks:
    """Each entry as the floored mean of its members, summed where they reside; entries without members stay."""
    width, entries = now.width, now.books.shape[1]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((len(now.books) * entries, width), np.int64), np.zeros(len(now.books) * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                owner = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
                order = np.argsort(owner, kind="stable")
                own, begin = np.unique(owner[order], return_index=True)
                many[own] += np.diff(np.append(begin, len(owner)))
                if width:
                    total[own] += np.add.reduceat(_lists(batch.column("part"), width)[order], begin, axis=0)
        held = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(many[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["owner", "n", "total"])

    parts = members.mapInArrow(sums, "owner long, n long, total array<long>")
    # entries x width rows at most, whatever the table; width 0 keeps one row of its own
    rows = parts.select("owner", "n", F.posexplode_outer("total").alias("j", "v")).groupBy("owner", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    books = now.books.reshape(len(now.books) * entries, width).copy()
    for r in rows:
        if r["j"] is not None:
            books[r["owner"], r["j"]] = r["v"] // r["n"]
    return Codebooks(now.dim, books.reshape(now.books.shape))


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of ``rows(id, label, x array<int>)``, all with ``dim`` components.

    They start as the parts of the rows with the least ids (nulls last, ties by components); fewer rows make fewer entries.
    A round that changes no entry ends the work, as all later ones would change none.
    """
    width = -(-dim // parts)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.zeros((len(seeds), parts * width), np.int64)
    books[:, :dim] = np.array([s["x"] for s in seeds], np.int64).reshape(len(seeds), dim)
    now = Codebooks(dim, np.ascontiguousarray(books.reshape(len(seeds), parts, width).transpose(1, 0, 2)))
    spark, owner = rows.sparkSession, ("position", "entry", "salt")
    tasks = partitions_for(spark, rows.count() * parts, MEMBERS)
    with Tables(spark) as tables:
        held = [tables.keep(_members(rows, now, tasks).repartition(tasks, *owner))]
        resident = held[0]
        for turn in range(rounds):
            if turn:
                before = tables.keep(_assigned(resident, now))
                arrived = tables.keep(before.where("moved").drop("moved").repartition(tasks, *owner))
                tables.free(*held)
                held = [before, arrived]
                resident = before.where("not moved").drop("moved").union(arrived)
            after = _updated(resident, now)
            if (after.books == now.books).all():
                break
            now = after
    return now


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.union(more)
    return whole


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row whose vector has finite components only.

    Rows whose vector is null or holds null, NaN or infinite components are dropped. A component x counts as
    floor(4096 x), and as at most isqrt(2^60 / width of a part) in size, so that squares fit 64 bits. Vectors of
    different lengths have codebooks of their own; a length that ``parts`` does not divide is padded with zeros.
    Repeated and null keys are rows as any other. ``label_error`` sums the error over all lengths of a label, nulls
    together. Other columns are not read. At most 256 entries, as a code has two hex digits for each part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = table.select(F.col(key).alias("id"), F.col(label).alias("label"), x.alias("x")).where(F.col("x").isNotNull()).where(finite)
    with Tables(table.sparkSession) as tables:
        sized = usable.withColumn("dim", F.size("x"))
        largest = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.lit(1), F.ceil(F.col("dim") / parts)))))
        most = F.least(largest, F.lit(float((1 << 31) - 1)))
        kept = tables.keep(sized.withColumn("most", most).select("id", "label", "dim", F.transform("x", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.col("most")), -F.col("most"))).cast("int")).alias("x")))
        coded = []
        for (dim,) in sorted(kept.select("dim").distinct().collect()):
            rows = kept.where(F.col("dim") == dim).select("id", "label", "x")
            books = fit(rows, dim, parts, entries, rounds)
            coded.append(tables.keep(books.encode(rows).withColumn("codebooks_sha256", F.lit(books.sha256()))))
        if not coded:
            return usable.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        whole = _union(coded)
        sums = tables.keep(whole.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
        sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
        return materialise(whole.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256"))
