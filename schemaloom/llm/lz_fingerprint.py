"""Lempel-Ziv fingerprints of documents.

A text's UTF-8 bytes are parsed into phrases: each is the shortest string at its place that isn't one yet, as in LZ78. The set of
phrases is what a compressor would have learnt, so texts that help to compress each other share phrases. The ``size`` smallest hashes
of the set are the fingerprint; the likeness of two is the share of the smallest hashes of their union that both have, an
estimate of the Jaccard similarity of the phrase sets, exact for sets of up to ``size`` phrases.

``edited_fingerprints`` also takes the end of each text from the next document in descending order of doc_id. Documents are dealt to ranges
of that order in one shuffle and stream by in order, so each meets its next one; a range's end gets a copy of the first
document of the range behind it. The ranges begin at keys picked by a hash, some for each shuffle partition. The unchanged start of a
text is parsed once for both versions.

Edge cases: null texts are empty; an empty text has an empty fingerprint, which is like itself (1) and nothing else (0); texts of any length are
parsed whole; null ids come last; of equal ids the order is by a hash of the text; repeated rows are documents of their own that
follow each other; a lone document is its own next one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.text import slices


@dataclass(frozen=True)
class FingerprintParams:
    """``ranges``: how many ranges of the order there are for each shuffle partition, about."""

    size: int = 128
    ranges: int = 16


class Parse:
    """Phrases of a text, read piece by piece. ``base``: a parse that this one goes on from, which stays as it is."""

    def __init__(self, base: Parse | None = None):
        self.base, self.own, self.open, self._hashes = base, set(), base.open if base else b"", None

    def read(self, data: bytes) -> Parse:
        data, start = self.open + data, 0
        own, add, ends = self.own, self.own.add, range(len(self.open) + 1, len(data) + 1)
        if self.base is None:
            for end in ends:
                phrase = data[start:end]
                if phrase not in own:
                    add(phrase)
                    start = end
        else:
            known = self.base.own
            for end in ends:
                phrase = data[start:end]
                if phrase not in known and phrase not in own:
                    add(phrase)
                    start = end
        self.open, self._hashes = data[start:], None
        return self

    def hashes(self, size: int) -> np.ndarray:
        """The ``size`` smallest of the phrases' hashes, in order."""
        if self._hashes is None:
            h = np.fromiter(map(zlib.crc32, self.own), np.uint32, len(self.own))
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)  # a checksum is linear in the bytes; this is not
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            if self.base is not None:
                h = np.concatenate([h, self.base.hashes(size)])
            self._hashes = np.unique(h)[:size]
        return self._hashes


def fingerprint(text: str, size: int = 128) -> np.ndarray:
    return Parse().read(text.encode()).hashes(size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = 128) -> float:
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, a).dot(np.isin(union, b).astype(np.int64)) / len(union))


def as_text(fingerprint: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash."""
    return fingerprint.astype(">u4").tobytes().hex()


class _Document:
    """A text, cut where the edited version leaves it, and its fingerprint."""

    def __init__(self, doc_id, text: str, size: int):
        self.id, self.text, self.size = doc_id, text, size
        self.cut = len(text) - len(text) // 3
        self.start = Parse().read(text[: self.cut].encode())
        self.print = Parse(self.start).read(text[self.cut :].encode()).hashes(size)

    def beside(self, after: _Document) -> tuple:
        end = after.text[: len(self.text) - self.cut]
        edited = Parse(self.start).read(end.encode()).hashes(self.size)
        sha = hashlib.sha256((self.text[: self.cut] + end).encode()).hexdigest()
        return self.id, len(self.text), sha, as_text(self.print), as_text(edited), likeness(self.print, edited, self.size), likeness(self.print, after.print, self.size)


def _place(doc_id, tie) -> tuple:
    """Sorts as the rows do: ids descending, nulls last, then the hash of the text. Ids are wrapped, so strings sort as well."""
    return (doc_id is None, _Down(doc_id), tie)


class _Down:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other: _Down) -> bool:
        return self.v is not None and other.v is not None and self.v > other.v

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.v == other.v


def in_ranges(documents: DataFrame, p: FingerprintParams = FingerprintParams()) -> DataFrame:
    """doc_id, text, range and guard: sorted by range and order in the partitions, each range closed by a guard, the first document
    of the next range; the last range's is the first document of all."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    keys = rows.select("doc_id", "tie")
    first = keys.orderBy(*order).limit(1).collect()
    wanted = p.ranges * int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = F.pmod(F.xxhash64("doc_id", "tie", F.lit(12)), F.lit(max(1, keys.count() // wanted))) == 0
    if first:
        picked |= F.col("doc_id").eqNullSafe(F.lit(first[0].doc_id).cast(documents.schema["doc_id"].dataType)) & (F.col("tie") == first[0].tie)
    starts = [_place(r.doc_id, r.tie) for r in keys.filter(picked).distinct().orderBy(*order).collect()]  # some for each shuffle partition

    @F.arrow_udf("int")
    def number(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array([bisect_right(starts, _place(*k)) - 1 for k in zip(doc_id.to_pylist(), tie.to_pylist())], pa.int32())

    rows = rows.withColumn("range", number("doc_id", "tie"))
    guards = rows.filter(picked).withColumn("range", F.pmod(F.col("range") - 1, F.lit(max(1, len(starts)))))
    both = rows.withColumn("guard", F.lit(False)).union(guards.withColumn("guard", F.lit(True)))
    return both.repartition("range").sortWithinPartitions("range", "guard", *order).select("doc_id", "text", "range", "guard")


def edited_fingerprints(documents: DataFrame, p: FingerprintParams = FingerprintParams()) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Document | None = None
        closed = None  # the range whose guard has come; a repeated guard says nothing more
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text, place, guard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guard"))):
                if guard and place == closed:
                    continue
                now = _Document(doc_id, text, p.size)
                if before is not None:
                    out.append(before.beside(now))
                before = None if guard else now
                closed = place if guard else closed
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column("doc_id").type, *kinds))], names)

    return in_ranges(documents, p).mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
