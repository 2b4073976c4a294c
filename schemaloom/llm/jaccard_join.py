"""Near duplicates by Jaccard similarity of word five-grams: a MinHash LSH forest and exact verification.

Each document's shingle set gets a 128-bit digest and a label of ``label`` minhashes in each of ``trees`` trees. Sets that are
equal are one class. A label is one integer whose leading bits are the leading minhashes, so a tree is the sorted column of
its labels and a shorter prefix is the same column shifted right. The trees are descended from the longest prefix on: at each
depth the classes that share a prefix and shared none before are verified by their exact sets. Then the recall is estimated
from what this depth has added, and prefixes are shortened further until it reaches ``recall``, or the depth is reached
at which even a pair right at the threshold shares a prefix with that chance.

No pair is written. Classes are dealt to cells of about ``block`` classes or ``block_shingles`` shingles: by the largest
bucket they are in, and such homes go together with the largest one that some bucket joins them to. A task verifies one cell, or
two cells that some bucket joins; in it only classes that share a prefix are compared, so what is compared follows the
buckets and not the components they make. It returns for each class how many documents it links to and the smallest class it
reaches, and whether all pairs have been verified, so that shorter prefixes need not come back to it.

Edge cases: null and empty texts have no shingles and link with nothing; a text of one to four words is
one shingle; equal texts link whatever their ids; repeated rows and repeated or null ids count as
documents of their own; an empty table gives no rows; ``join`` reads doc_id and text only, ``keep_one`` passes all
columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import Scratch, connected_components
from schemaloom.llm.text import hash_words, odd_numbers, owners, slices, split_words, texts_of, windows

#: Bits of a label for each minhash below the shortest prefix; all those above share the others.
_LEVEL_BITS = 4


@dataclass(frozen=True)
class ForestParams:
    """``stride``: minhashes that a prefix is shortened by at a time."""

    width: int = 5
    threshold: float = 0.8
    trees: int = 40
    label: int = 12
    stride: int = 3
    recall: float = 0.9999
    block: int = 256
    block_shingles: int = 1 << 19

    def missed(self, depth: int, similarity: float) -> float:
        """The chance that a pair shares no prefix of this depth."""
        return (1 - similarity**depth) ** self.trees

    @property
    def floor(self) -> int:
        """The longest prefix whose recall at the threshold reaches the target."""
        return next((d for d in range(self.label, 1, -1) if 1 - self.missed(d, self.threshold) >= self.recall), 1)

    @property
    def depths(self) -> list[int]:
        """Prefix lengths in the order of descent."""
        return [*range(self.label, self.floor, -self.stride), self.floor]

    def shift(self, depth: int) -> int:
        return _LEVEL_BITS * (self.label - depth)

    def recall_after(self, depth: int, before: int, new: int, total: int) -> float:
        """The least recall that the links found so far speak for. Of links first found at this depth and not at the one
        before, ``new``, those right at the threshold leave the most behind; three more stand for what chance may hide."""
        left, was = self.missed(depth, self.threshold), self.missed(before, self.threshold)
        behind = left / (was - left) * (new + 3)
        return max(1 - left, total / (total + behind))


_ODD = odd_numbers(16, seed=4)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text, flat, and the offsets by text."""
    codes, offsets, words = split_words(texts)
    hashes = hash_words(words)[codes] if len(words) else np.empty(0, np.uint64)
    shingle, first = windows(hashes, offsets, width, _ODD)
    own = owners(offsets)[first]
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        with np.errstate(over="ignore"):
            one = np.array([np.bitwise_xor.reduce((hashes[offsets[i] : offsets[i + 1]] * _ODD[8 : 8 + n[i]]) >> np.uint64(7)) * _ODD[n[i]] for i in short], np.uint64)
        shingle, own = np.concatenate([shingle, one]), np.concatenate([own, short])
    order = np.argsort(shingle)
    order = order[np.argsort(own[order].astype(np.uint16), kind="stable")] if len(texts) < 1 << 16 else np.lexsort((shingle, own))
    shingle, own = shingle[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])
    shingle, own = shingle[new], own[new]
    return shingle, np.searchsorted(own, np.arange(len(texts) + 1))


def digests(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; none of an empty set."""
    raw = shingles.astype("<u8").tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def labels(shingles: np.ndarray, offsets: np.ndarray, p: ForestParams) -> np.ndarray:
    """For each set its label in each tree: texts x trees. The first ``floor`` minhashes are mixed to the leading bits, a few
    bits of each further one follow."""
    floor, bits = p.floor, np.uint64(_LEVEL_BITS)
    factors = odd_numbers(p.trees * p.label, seed=44).reshape(p.trees, p.label)
    out = np.zeros((len(offsets) - 1, p.trees), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    part = np.unique(np.searchsorted(offsets[some], np.arange(0, len(shingles) + 1, 1 << 15)))
    mix = odd_numbers(p.label + 1, seed=45)
    for a, b in zip(part, [*part[1:], len(some)]):
        if a == b:
            continue
        rows = some[a:b]
        low = offsets[rows[0]]
        values, starts = shingles[low : offsets[rows[-1] + 1]], offsets[rows] - low
        with np.errstate(over="ignore"):
            for t in range(p.trees):
                key = np.full(len(rows), mix[p.label] * np.uint64(t + 1), np.uint64)
                for k in range(floor):
                    key = (key ^ np.minimum.reduceat(values * factors[t, k], starts)) * mix[k]
                    key ^= key >> np.uint64(31)
                key >>= bits * np.uint64(p.label - floor)
                for k in range(floor, p.label):
                    key = (key << bits) | (np.minimum.reduceat(values * factors[t, k], starts) * mix[k]) >> (np.uint64(64) - bits)
                out[rows, t] = key
    return out


def sign(documents: DataFrame, p: ForestParams) -> DataFrame:
    """id, at (a hash of the text), doc_id, digest, size and labels of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingles, offsets = shingle_sets(texts_of(batch, "text"), p.width)
            keys = labels(shingles, offsets, p).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.trees, dtype=np.int32), keys.ravel())
            size = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "at", "doc_id")), pa.array(digests(shingles, offsets), pa.binary()), size, lists], ["id", "at", "doc_id", "digest", "n", "labels"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(*_place(), "doc_id", "text").mapInArrow(run, f"id string, at long, doc_id {kind}, digest binary, n long, labels array<long>")


def _place() -> tuple[Column, Column]:
    """What finds a text again: its id, where null counts as an id of its own, and a hash of it."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("at")


def _with_sets(documents: DataFrame, members: DataFrame, p: ForestParams) -> DataFrame:
    """The members' shingle sets, from the text of one document of each class. Spark broadcasts the places only if
    their table is under its threshold; copies of a text are one before they are shuffled."""
    texts = documents.select(*_place(), "text").join(members.select("id", "at", "num"), ["id", "at"]).groupBy("num").agg(F.first("text").alias("text"))
    rows = texts.join(members.select("num", "cell", "copies", "labels"), "num")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingles, offsets = shingle_sets(texts_of(batch, "text"), p.width)
            raw = shingles.astype("<u8").tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "num", "copies", "labels")), sets], ["cell", "num", "copies", "labels", "shingles"])

    return rows.mapInArrow(run, "cell long, num long, copies long, labels array<long>, shingles binary")


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices some columns at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    renumber = np.cumsum(often) - 1
    keep = often[code]
    row, code = row[keep], renumber[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((n, n))
    for low in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(code, [low, low + columns])
        m = np.zeros((n, columns), np.float32)
        m[row[a:b], code[a:b] - low] = 1
        total += m @ m.T
    return total


def candidates(label: np.ndarray, cell: np.ndarray, cross: bool, shift: int, before: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs x < y that share a prefix at ``shift`` in some tree and shared none at ``before``; of two cells if ``cross``.
    And whether all pairs share one at ``shift``, so that none is left."""

    def shared(bits: int) -> np.ndarray:
        key = label >> bits
        if label.size * len(label) <= 1 << 20:
            return (key[:, None, :] == key[None, :, :]).any(axis=2)
        found = np.zeros((len(key), len(key)), bool)
        for t in range(key.shape[1]):
            found |= key[:, t, None] == key[None, :, t]
        return found

    near = shared(shift)
    others = cell[:, None] != cell[None, :] if cross else True
    whole = bool((near | ~others).all()) if cross else bool(near.all())
    if before is not None:
        near &= ~shared(before)
    return *np.nonzero(np.triu(near & others, 1)), whole


def verify_unit(num: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class of a unit: documents of other classes that it links to, those classes, and the smallest class it
    reaches. ``x`` and ``y`` are the pairs to verify."""
    size = np.array([len(s) for s in sets], np.int64)
    possible = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
    x, y = x[possible], y[possible]
    used = np.unique(np.concatenate([x, y]))
    if len(x) > 4 * len(used):
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        both = shared_counts([sets[i] for i in used])[place[x], place[y]]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())])
    link = both * (1 + threshold) >= threshold * (size[x] + size[y]) - 1e-9
    x, y = x[link], y[link]
    reach = num.copy()
    while len(x):
        low = reach.copy()
        np.minimum.at(low, x, reach[y])
        np.minimum.at(low, y, reach[x])
        if (low == reach).all():
            break
        reach = low
    n = len(num)
    links = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
    return links.astype(np.int64), np.bincount(x, minlength=n) + np.bincount(y, minlength=n), reach


def _verify(units: DataFrame, p: ForestParams, shift: int, before: int | None) -> DataFrame:
    """Rows sorted by unit in each partition: verifies unit by unit. Classes with a link are returned, and the units
    of which no pair is left, as rows without a class."""
    names = ["num", "links", "pairs", "reach", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def verified() -> Iterator[pa.RecordBatch]:
            num, cell, copies, label, sets = zip(*rows)
            num = np.array(num)
            x, y, whole = candidates(np.array(label), np.array(cell), key[0] != key[1], shift, before)
            if len(x):
                links, pairs, reach = verify_unit(num, np.array(copies), [np.frombuffer(r, "<u8") for r in sets], x, y, p.threshold)
                some = np.flatnonzero(pairs)
                if len(some):
                    none = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(num[some]), pa.array(links[some]), pa.array(pairs[some]), pa.array(reach[some]), none, none], names)
            if whole:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([key[0]]), pa.array([key[1]])], names)

        for batch in batches:
            for i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "num", "cell", "copies", "labels", "shingles"))):
                if (i, j) != key:
                    if len(rows) > 1:
                        yield from verified()
                    key, rows = (i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield from verified()

    return units.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _prefixes(classes: DataFrame, shift: int, *columns: str) -> DataFrame:
    """One row for each class and tree: tree, the label's prefix, and other columns."""
    return classes.select(*columns, F.posexplode("labels").alias("tree", "label")).withColumn("key", F.shiftright("label", shift))


def _cells(classes: DataFrame, p: ForestParams, scratch: Scratch) -> DataFrame:
    """The classes that share some shortest prefix, each with its cell."""
    entries = _prefixes(classes, p.shift(p.floor), "num").drop("label")
    buckets = scratch.table(entries.groupBy("tree", "key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    mates = scratch.table(entries.join(buckets, ["tree", "key"]), "mates")
    home = F.max(F.struct("size", F.xxhash64("tree", "key").alias("home")))
    homes = scratch.table(mates.groupBy("num").agg(home.alias("h")).select("num", "h.size", "h.home"), "homes")
    seen = scratch.table(mates.drop("size").join(homes, "num").groupBy("tree", "key", "home", "size").agg(F.count("*").alias("n")).drop("n"), "seen")
    tops = scratch.table(seen.groupBy("tree", "key").agg(F.max(F.struct("size", "home")).alias("top"), F.count("*").alias("homes")).filter("homes > 1").drop("homes"), "tops")
    leaders = scratch.table(seen.join(tops, ["tree", "key"]).groupBy("home").agg(F.max("top").alias("top")).select("home", F.col("top.home").alias("leader")), "leaders")
    settled = homes.join(leaders, "home", "left").select("num", F.coalesce("leader", "home").alias("home")).join(classes, "num")
    settled = scratch.table(settled.select("num", "home", "id", "at", "n", "copies", "labels"), "settled")
    parts = F.ceil(F.greatest(F.count("*") / p.block, F.sum("n") / p.block_shingles)).cast("int")
    sizes = scratch.table(settled.groupBy("home").agg(parts.alias("parts")), "sizes")
    cell = F.xxhash64("home", F.pmod(F.xxhash64("num"), F.col("parts")))
    return scratch.table(settled.join(sizes, "home").select("num", "id", "at", "copies", "labels", cell.alias("cell")), "members")


def _units(members: DataFrame, shift: int, before: int | None) -> DataFrame:
    """(i, j), i <= j: cells that some bucket joins, with itself if the bucket has two classes of it. Buckets whose
    classes all shared the longer prefix too have nothing new."""
    entries = _prefixes(members, shift, "cell").withColumn("child", F.shiftright("label", before or 0))
    new = F.lit(True) if before is None else F.col("low") != F.col("high")
    at = entries.groupBy("tree", "key", "cell").agg(F.count("*").alias("n"), F.min("child").alias("low"), F.max("child").alias("high"))
    whole = at.groupBy("tree", "key").agg(F.count("*").alias("cells"), F.min("low").alias("low"), F.max("high").alias("high")).filter((F.col("cells") > 1) & new)
    alone = at.filter((F.col("n") > 1) & new).select(F.col("cell").alias("i"), F.col("cell").alias("j"))
    shared = at.select("tree", "key", "cell").join(whole.select("tree", "key"), ["tree", "key"])
    pairs = shared.withColumnRenamed("cell", "i").join(shared.withColumnRenamed("cell", "j"), ["tree", "key"]).filter("i < j").select("i", "j")
    return alone.union(pairs).distinct()


def near_duplicates(documents: DataFrame, scratch: Scratch, p: ForestParams = ForestParams()) -> tuple[DataFrame, DataFrame]:
    """(id, at, doc_id, digest) of every row; and of every class: digest, its first document, number of its documents,
    documents that it links to, and root, the smallest class that links reach. Both are tables of ``scratch``."""
    signed = scratch.table(sign(documents, p), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id", "at")).alias("m")  # null ids last
    classes = scratch.table(
        signed.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")).select("digest", "m.doc_id", "m.id", "m.at", "copies", "n", "labels").withColumn("num", F.monotonically_increasing_id()), "classes"
    )
    members = _cells(classes, p, scratch)
    sets = scratch.table(_with_sets(documents, members, p), "sets")
    found, total, before = [], 0, None
    for depth in p.depths:
        shift, longer = p.shift(depth), None if before is None else p.shift(before)
        units = _units(members, shift, longer)
        for earlier in found:
            units = units.join(earlier.filter("num IS NULL").select("i", "j"), ["i", "j"], "left_anti")
        units = scratch.table(units, "units")
        rows = units.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell")).join(sets, "cell")
        verified = scratch.table(_verify(rows.repartition("i", "j").sortWithinPartitions("i", "j"), p, shift, longer), "verified")
        found.append(verified)
        new = (verified.agg(F.sum("pairs")).first()[0] or 0) // 2
        total += new
        if before is not None and total and p.recall_after(depth, before, new, total) >= p.recall:
            break
        before = depth
    verified = found[0]
    for more in found[1:]:
        verified = verified.union(more)
    verified = verified.filter("num IS NOT NULL")
    links = verified.groupBy("num").agg(F.sum("links").alias("links"))
    roots = connected_components(verified.select(F.col("num").alias("a"), F.col("reach").alias("b")), scratch).withColumnRenamed("node", "num")
    every = scratch.table(
        classes.drop("labels", "n").join(links, "num", "left").join(roots, "num", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("root", F.coalesce("root", "num")), "linked"
    )
    return signed.select("id", "at", "doc_id", "digest"), every


def join(documents: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id that links reach), n_links (documents with a
    similarity at the threshold or above, equal ones included) and kept. A table in the shared folder."""
    with Scratch(documents.sparkSession) as scratch:
        rows, classes = near_duplicates(documents, scratch, p)
        lowest = scratch.table(classes.groupBy("root").agg(F.min("doc_id").alias("class_id")), "lowest")
        found = scratch.table(classes.join(lowest, "root").select("digest", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "found")
        none = F.col("digest").isNull()
        out = rows.join(found, "digest", "left").select(
            "doc_id",
            F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(none, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        )
        return scratch.result(out, "near-duplicates")


def keep_one(documents: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """The rows and columns of one document of each group, that with the smallest id; documents without any
    word all stay. A row is told by its id and a hash of its text; what must go is a table in the shared folder."""
    with Scratch(documents.sparkSession) as scratch:
        rows, classes = near_duplicates(documents, scratch, p)
        stay = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id", "at")).alias("m")).select("m.id", "m.at")
        counted = rows.filter(F.col("digest").isNotNull()).groupBy("id", "at").agg(F.count("*").alias("n"))
        gone = scratch.result(counted.join(stay, ["id", "at"], "left_anti").select("id", "at"), "gone")
        twice = scratch.result(counted.filter("n > 1").join(gone, ["id", "at"], "left_anti").select("id", "at"), "repeated")
    place = ["id", "at"]
    kept = documents.select(F.struct("*").alias("row"), *_place()).join(gone, place, "left_anti")
    if not twice.isEmpty():  # rows that are equal in id and text
        repeated = kept.join(twice, place, "left_semi").groupBy(*place).agg(F.first("row").alias("row"))
        kept = kept.join(twice, place, "left_anti").select("row").union(repeated.select("row"))
    return kept.select("row.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
