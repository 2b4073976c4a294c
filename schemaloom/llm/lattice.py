"""Near duplicates among embeddings by E8 lattice hashing.

A vector's direction is projected to blocks of eight dimensions and each block is decoded to the nearest point
of the E8 lattice; the points of a table's blocks name its cell. Besides its own cell a vector probes the
cells where one block moves to the best point of the lattice's other coset. The number of blocks follows the
number of vectors, so cells stay small, and the number of tables follows from the target recall. Vectors in a cell of more than
``hot`` are hashed once more with one block more, and the tables that this needs, up to ``splits`` times.

What shares a cell is compared by sketches of ``sketch_bits`` sign bits first, so cells carry some bytes for a vector and
not the vector. A large cell is cut in blocks, and pairs of blocks are dealt over the tasks. Pairs are verified by cosine in double precision before any
group is formed: first each vector of a cell with the smallest one of a near sketch, which joins copies of one text by few pairs; then, cell by cell, all vectors
whose near sketches those links leave unexplained. The components of verified links are the groups; within a group all pairs are compared, in
blocks, to count each vector's links.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
equal vectors are one class and link with each other; vectors of different lengths never link; null and
repeated ids count row by row; an empty table gives no rows; columns other than these two are not read. A group of n different
vectors that links join costs n^2 / block rows, and so does a cell of n vectors with near sketches and no links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import Scratch, connected_components
from schemaloom.llm.text import odd_numbers


@dataclass(frozen=True)
class LatticeParams:
    """``same`` and ``near``: chance that a block of a pair at the threshold decodes to one point, or to one with
    a probe; ``alike``: the same for random pairs, as measured for ``scale``. A Gaussian projection of a unit vector
    has the same spread in every dimension, so the first two hold for vectors of any length; ``alike`` is greater for
    short vectors, whose cells are larger. ``block``: vectors of a task's block. ``sketch_sigma``: how many standard deviations
    more bits than expected two sketches at the threshold may differ in."""

    threshold: float = 0.95
    scale: float = 2.0
    recall: float = 0.99
    same: float = 0.44
    near: float = 0.64
    alike: float = 0.008
    per_cell: int = 16
    block: int = 512
    hot: int = 2048
    splits: int = 2
    sketch_bits: int = 128
    sketch_sigma: float = 4.5

    def blocks(self, n: int) -> int:
        return max(1, math.ceil(math.log(max(2, n) / self.per_cell) / -math.log(self.alike)))

    def tables(self, n: int, more: int = 0) -> int:
        m = self.blocks(n) + more
        found = self.same**m + m * self.same ** (m - 1) * (self.near - self.same)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - found))

    @property
    def sketch_limit(self) -> int:
        """The greatest number of different bits of sketches that count as near."""
        share = math.acos(self.threshold) / math.pi
        return math.floor(self.sketch_bits * share + self.sketch_sigma * math.sqrt(self.sketch_bits * share * (1 - share)))


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: if the sum is odd, the worst coordinate is rounded the other way."""
    r = np.rint(x)
    gap = x - r
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest lattice point of each row, and twice the nearest one of the other coset."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    first = (((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None]
    return (2 * np.where(first, whole, half)).astype(np.int64), (2 * np.where(first, half, whole)).astype(np.int64)


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each vector's own cells (rows x tables) and of the cells it probes (rows x tables*blocks)."""
    n, dim = unit.shape
    rng = np.random.default_rng(8 + dim)
    odd = odd_numbers(9, seed=88).astype(np.uint64)
    own, probes = [], []
    with np.errstate(over="ignore"):

        def key(points: np.ndarray) -> np.ndarray:
            k = (points.astype(np.uint64) * odd[:8]).sum(axis=1)
            return (k ^ (k >> np.uint64(30))) * odd[8]

        for t in range(tables):
            near, other = [], []
            for _ in range(blocks):
                w = rng.normal(size=(dim, 8)) / scale
                a, b = decode_e8(unit @ w)
                near.append(key(a))
                other.append(key(b))
            base = np.full(n, np.uint64(t * 1_000_003 + dim))
            total = base + sum((k * odd[i % 8] for i, k in enumerate(near)), np.zeros(n, np.uint64))
            mix = lambda k: (k ^ (k >> np.uint64(29))) * odd[7]
            own.append(mix(total))
            probes += [mix(total + (other[i] - near[i]) * odd[i % 8]) for i in range(blocks)]
    return np.stack(own, axis=1).astype(np.int64), np.stack(probes, axis=1).astype(np.int64)


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, None if it has no direction."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate([[0], np.cumsum(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))])
    out: list[np.ndarray | None] = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        v = flat[a:b]
        out.append(v if b > a and np.isfinite(v).all() and v.any() else None)
    return out


def sketches(unit: np.ndarray, bits: int) -> np.ndarray:
    """Signs of random projections, as rows of 64-bit integers."""
    planes = np.random.default_rng(9 + unit.shape[1]).normal(size=(unit.shape[1], bits))
    return np.packbits(unit @ planes > 0, axis=1).view("<u8")


def units_of(raw: list[bytes]) -> dict[int, tuple[list[int], np.ndarray]]:
    """By length: row numbers and directions of vectors that are given as doubles."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(raw):
        by_size.setdefault(len(v), []).append(i)
    return {n: (rows, _directions(np.stack([np.frombuffer(raw[i], "<f8") for i in rows]))) for n, rows in by_size.items()}


def _directions(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, and digest and doubles of the vector; these two null where it has no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in _rows(batch.column("embedding"))]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "vec"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, digest binary, vec binary")


def _with_cells(classes: DataFrame, tables: int, blocks: int, p: LatticeParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = batch.column("num").to_numpy()
            for rows, unit in units_of(batch.column("vec").to_pylist()).values():
                own, probes = cells(unit, tables, blocks, p.scale)
                sketch = [x.tobytes() for x in sketches(unit, p.sketch_bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(num[rows]), pa.array(sketch, pa.binary()), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probes), pa.list_(pa.int64()))],
                    ["num", "sketch", "own", "probes"],
                )

    return classes.select("num", "vec").mapInArrow(run, "num long, sketch binary, own array<long>, probes array<long>")


def _reach(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest rank that each row reaches over the links a-b."""
    rank = rank.copy()
    while len(a):
        before = rank.copy()
        np.minimum.at(rank, a, rank[b])
        np.minimum.at(rank, b, rank[a])
        if (before == rank).all():
            break
    return rank


def _in_units(units: DataFrame, schema: str, work: Callable[[dict], pa.RecordBatch | None]) -> DataFrame:
    """Rows sorted by (key, i, j) in each partition: calls ``work`` with some whole units at a time."""
    names = units.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            change = np.ones(table.num_rows, bool)
            change[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            starts = np.flatnonzero(change)
            end = table.num_rows if last else starts[-1]
            if end:
                part = table.slice(0, end)
                out = work({c: part.column(c) for c in names} | {"bounds": np.append(starts[starts < end], end)})
                if out is not None:
                    yield out
            held = table.slice(end).to_batches()

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                held.append(batch.slice(k, 4096))
                if sum(x.num_rows for x in held) >= 4096:
                    yield from flush(False)
        if sum(x.num_rows for x in held):
            yield from flush(True)

    return units.mapInArrow(run, schema)


def _near_pairs(c: dict, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each unit the rows of pairs with near sketches, one of them in its own cell."""
    owner = np.array(c["owner"].to_pylist(), bool)
    block, i, j, num = (c[k].to_numpy() for k in ("block", "i", "j", "num"))
    sketch = np.frombuffer(b"".join(c["sketch"].to_pylist()), "<u8").reshape(len(num), -1)
    for a, b in zip(c["bounds"], c["bounds"][1:]):
        mine = a + np.flatnonzero(owner[a:b])
        if b - a < 2 or not len(mine):
            continue
        differ = sum(np.bitwise_count(sketch[mine, k, None] ^ sketch[None, a:b, k]).astype(np.int16) for k in range(sketch.shape[1]))
        x, y = np.nonzero(differ <= limit)
        x, y = mine[x], y + a
        ok = num[x] != num[y]
        if i[a] != j[a]:
            ok &= block[x] != block[y]
        yield x[ok], y[ok]


def _likely(p: LatticeParams) -> Callable[[dict], pa.RecordBatch | None]:
    """For each row of a unit the smallest one with a near sketch: (a, b)."""

    def work(c: dict) -> pa.RecordBatch | None:
        num = c["num"].to_numpy()
        low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x, y in _near_pairs(c, p.sketch_limit):
            a, b = np.minimum(num[x], num[y]), np.maximum(num[x], num[y])
            order = np.lexsort((a, b))
            first = np.flatnonzero(np.diff(b[order], prepend=-1))
            low.append(a[order][first])
            high.append(b[order][first])
        pairs = np.unique(np.stack([np.concatenate(high), np.concatenate(low)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]) if len(pairs) else None

    return work


def _unproved(p: LatticeParams) -> Callable[[dict], pa.RecordBatch | None]:
    """The rows of a unit, once each, that have a near sketch of another label."""

    def work(c: dict) -> pa.RecordBatch | None:
        num, label = c["num"].to_numpy(), c["label"].to_numpy()
        rows = [np.empty(0, np.int64)]
        for x, y in _near_pairs(c, p.sketch_limit):
            other = label[x] != label[y]
            found = np.unique(np.concatenate([x[other], y[other]]))
            rows.append(found[np.unique(num[found], return_index=True)[1]])
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([c[k].take(at).combine_chunks() if isinstance(c[k], pa.ChunkedArray) else c[k].take(at) for k in ("key", "i", "j", "num")], ["key", "i", "j", "num"]) if len(at) else None

    return work


def _proved(p: LatticeParams) -> Callable[[dict], pa.RecordBatch | None]:
    """Links of a unit's vectors by cosine: (a, b), b the smallest one that a reaches in the unit."""

    def work(c: dict) -> pa.RecordBatch | None:
        num = c["num"].to_numpy()
        reach = num.copy()
        for a, b in zip(c["bounds"], c["bounds"][1:]):
            for rows, v in units_of(c["vec"].slice(a, b - a).to_pylist()).values():
                rows = np.array(rows) + a
                x, y = np.nonzero(np.triu(v @ v.T >= p.threshold, 1))
                order = np.argsort(num[rows])
                rank = np.empty(len(rows), np.int64)
                rank[order] = np.arange(len(rows))
                reach[rows] = num[rows][order][_reach(rank, x, y)]
        moved = reach != num
        return pa.RecordBatch.from_arrays([pa.array(num[moved]), pa.array(reach[moved])], ["a", "b"]) if moved.any() else None

    return work


def _cosines(pairs: DataFrame, classes: DataFrame, p: LatticeParams) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ok = np.zeros(part.num_rows, bool)
                left, right = part.column("v").to_pylist(), part.column("w").to_pylist()
                same = [k for k in range(len(left)) if len(left[k]) == len(right[k])]
                for size in {len(left[k]) for k in same}:
                    rows = [k for k in same if len(left[k]) == size]
                    v, w = (_directions(np.stack([np.frombuffer(x[k], "<f8") for k in rows])) for x in (left, right))
                    ok[rows] = (v * w).sum(axis=1) >= p.threshold
                yield part.select(["a", "b"]).filter(pa.array(ok))

    vec = lambda n, v: classes.select(F.col("num").alias(n), F.col("vec").alias(v))
    return pairs.join(vec("a", "v"), "a").join(vec("b", "w"), "b").select("a", "b", "v", "w").mapInArrow(run, "a long, b long")


def _counted(p: LatticeParams) -> Callable[[dict], pa.RecordBatch | None]:
    """The links of each of a unit's vectors, copies of its partners included."""

    def work(c: dict) -> pa.RecordBatch | None:
        copies, block, i, j, num = (c[k].to_numpy() for k in ("copies", "block", "i", "j", "num"))
        links = np.zeros(len(copies), np.int64)
        for a, b in zip(c["bounds"], c["bounds"][1:]):
            for rows, v in units_of(c["vec"].slice(a, b - a).to_pylist()).values():
                rows = np.array(rows) + a
                link = v @ v.T >= p.threshold
                np.fill_diagonal(link, False)
                if i[a] != j[a]:
                    link &= block[rows, None] != block[None, rows]
                links[rows] = link @ copies[rows]
        return pa.RecordBatch.from_arrays([pa.array(num), pa.array(links)], ["num", "links"])

    return work


def _dealt(rows: DataFrame, *extra: str) -> DataFrame:
    """Rows with key and blocks, once for each pair of blocks they take part in."""
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "num", *extra)
    )


def _by_unit(units: DataFrame) -> DataFrame:
    return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _levels(classes: DataFrame, n: int, scratch: Scratch, p: LatticeParams) -> list[tuple[DataFrame, DataFrame, Column]]:
    """(keys of the vectors, sizes of large cells, which of those are left to the next level), the vectors of left cells hashed again."""
    out, todo = [], classes.select("num", "vec")
    for more in range(p.splits + 1):
        keys = scratch.table(_with_cells(todo, p.tables(n, more), p.blocks(n) + more, p), "cells")
        # only cells that must be cut are told apart: the others go to one unit each, whatever is in them
        large = scratch.table(_entries(keys).groupBy("key").agg(F.count("*").alias("n"), F.count_if("owner").alias("own")).filter((F.col("own") > 0) & (F.col("n") > p.block)).select("key", "n"), "sizes")
        split = F.coalesce(F.col("n") > (p.hot if more < p.splits else 1 << 62), F.lit(False))
        out.append((keys, large, split))
        hot = scratch.table(_entries(keys).join(large.filter(split), "key").select("num").distinct(), "hot")
        if hot.isEmpty():
            break
        todo = todo.join(hot, "num", "left_semi")
    return out


def _entries(keys: DataFrame, *extra: str) -> DataFrame:
    own = keys.select("num", "sketch", *extra, F.explode("own").alias("key"), F.lit(True).alias("owner"))
    return own.union(keys.select("num", "sketch", *extra, F.explode("probes"), F.lit(False)))


def _units(level: tuple[DataFrame, DataFrame, Column], p: LatticeParams, labels: DataFrame | None = None) -> DataFrame:
    """What shares a cell, sorted by unit; with the labels of the vectors where there are any."""
    keys, large, split = level
    extra = [] if labels is None else ["label"]
    if labels is not None:
        keys = keys.join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    marked = _entries(keys, *extra).join(large, "key", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / p.block).cast("int"))
    return _by_unit(_dealt(marked.filter(~split), "owner", "sketch", *extra))


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(connected_components(links, scratch).select(F.col("node").alias("num"), F.col("root").alias("label")), "labels")


def _linked(classes: DataFrame, scratch: Scratch, p: LatticeParams) -> DataFrame:
    """num and label: the components of pairs that share a cell and whose cosine reaches the threshold."""
    levels = _levels(classes, classes.count(), scratch, p)
    pairs = None
    for level in levels:
        likely = _in_units(_units(level, p), "a long, b long", _likely(p))
        pairs = likely if pairs is None else pairs.union(likely)
    links = scratch.table(_cosines(pairs.distinct(), classes, p), "links")
    labels = _components(links, scratch)
    # near sketches that no link explains yet: the vectors of those rows are fetched for each unit, and all pairs there compared
    more = None
    for level in levels:
        rows = _in_units(_units(level, p, labels), "key long, i int, j int, num long", _unproved(p)).join(classes.select("num", "vec"), "num").select("key", "i", "j", "num", "vec")
        found = _in_units(_by_unit(rows), "a long, b long", _proved(p))
        more = found if more is None else more.union(found)
    more = scratch.table(more.distinct(), "links")
    return labels if more.isEmpty() else _components(links.union(more), scratch)


def near_vectors(embeddings: DataFrame, p: LatticeParams = LatticeParams()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept. A table in the shared folder."""
    with Scratch(embeddings.sparkSession) as scratch:
        rows = scratch.table(prepared(embeddings), "vectors")
        classes = scratch.table(
            rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
            .withColumn("num", F.monotonically_increasing_id()), "classes"
        )
        roots = _linked(classes, scratch, p).withColumnRenamed("label", "key")
        sizes = scratch.table(roots.groupBy("key").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks")), "sizes")
        members = _dealt(roots.join(sizes, "key")).join(classes.select("num", "vec", "copies"), "num")
        links = _in_units(_by_unit(members), "num long, links long", _counted(p)).groupBy("num").agg(F.sum("links").alias("links"))
        real = roots.withColumnRenamed("key", "root")
        every = scratch.table(
            classes.select("digest", "num", "vec_id", "copies").join(links, "num", "left").join(real, "num", "left")
            .select("digest", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "num").alias("root")), "linked"
        )
        lowest = scratch.table(every.groupBy("root").agg(F.min("vec_id").alias("component_id")), "lowest")
        found = scratch.table(every.join(lowest, "root").select("digest", "n_links", "component_id"), "found")
        none = F.col("digest").isNull()
        out = rows.select("vec_id", "digest").join(found, "digest", "left").select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(none, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(none, F.lit(True)).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        )
        return scratch.result(out, "near-vectors")


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
