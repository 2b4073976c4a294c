"""Importance resampling towards a target distribution.

Word n-grams fall into buckets by their CRC-32. What a bucket's share in the target corpus is above its share in the documents is
its gain; a document's weight is the mean gain of its n-grams, and the documents with the highest weights plus Gumbel noise
are drawn, which is sampling without replacement in proportion to exp(weight).

No n-gram is ever written out: each distinct word of a slice has its checksum computed once, and those of n-grams are composed by
the length-shift matrices of ``crc``. Both distributions are counted over all texts, in each task first, so the shuffle and the driver see
``buckets`` rows at most. The ranks come from a sort by ranges and the row counts of its partitions.

Edge cases: null and empty texts have no features and weight 0; a null id counts as the empty text in the noise; repeated rows and equal ids
are drawn each for itself, in any order between equal rows; without documents there are no rows, and an empty target is one of no
features; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import crc
from schemaloom.llm.shared import Scratch
from schemaloom.llm.text import only, owners, slices, split_words, texts_of


@dataclass(frozen=True)
class ResampleParams:
    """``percent`` of the documents with at least ``least_words`` words are drawn."""

    buckets: int = 10_000
    longest: int = 2
    seed: int = 7
    percent: int = 25
    least_words: int = 20


def _word_bytes(b: np.ndarray) -> np.ndarray:
    """Digits, letters a-z and all bytes of characters beyond ASCII."""
    return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122))


def features(texts: pa.Array, p: ResampleParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's number, number of words of each text)."""
    codes, offsets, words = split_words(only(texts, _word_bytes))
    own = owners(offsets)
    word, size = crc.of_strings(words)
    spaced = crc.joined(np.full(len(word), crc.of_strings(pa.array([" "]))[0]), word, size)[codes]  # of " word"
    word, size = word[codes], size[codes]
    found, gram = [(word, own)], word
    for n in range(2, p.longest + 1):
        same = own[: len(own) - n + 1] == own[n - 1 :]
        # gram[i] is the checksum of the n - 1 words that begin at i; where a text ends before, it means nothing
        gram = crc.joined(gram[: len(own) - n + 1], spaced[n - 1 :], size[n - 1 :] + 1)
        found.append((gram[same], own[n - 1 :][same]))
    return np.concatenate([g for g, _ in found]).astype(np.int64) % p.buckets, np.concatenate([o for _, o in found]), np.diff(offsets)


def bucket_counts(corpus: DataFrame, p: ResampleParams) -> np.ndarray:
    """The number of features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(p.buckets, np.int64)
        for batch in slices(batches, "text"):
            n += np.bincount(features(texts_of(batch, "text"), p)[0], minlength=p.buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    counts = np.zeros(p.buckets, np.int64)
    for r in corpus.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        counts[r.bucket] = r.n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over document share, by bucket; one is added to each count."""
    size = len(documents)
    s_all, t_all = float(documents.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def noise(key: str) -> int:
    """Gumbel noise in thousandths, from a hash of the key."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, p: ResampleParams) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bucket, own, n_words = features(texts_of(batch, "text"), p)
            n = np.bincount(own, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, own, gain[bucket])
            weight = total // np.maximum(n, 1)
            ids = batch.column("doc_id")
            drawn = np.array([noise(f"{p.seed}:{'' if i is None else i}") for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n, weight, weight + drawn))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def resample(documents: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank, which is null where it is not drawn. A table in the
    shared folder."""
    spark = documents.sparkSession
    with Scratch(spark) as scratch:
        gain = gains(bucket_counts(documents, p), bucket_counts(target, p))
        rows = scratch.table(scored(documents, gain, p), "scores")
        fit = F.col("n_words") >= p.least_words
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        placed = scratch.table(rows.filter(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places")
        # the upper bits of a place are its partition; one row for each partition comes to the driver
        sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        before, seen = [], 0
        for r in sizes:
            before.append((r.part, seen))
            seen += r.n
        offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
        rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
        names = ["doc_id", "n_words", "n_features", "weight", "score"]
        ranked = placed.withColumn("part", F.shiftright("place", 33)).join(offsets, "part").select(*names, F.when(rank <= p.percent * seen // 100, rank).alias("rank"))
        return scratch.result(ranked.union(rows.filter(~fit).select(*names, F.lit(None).cast("long"))), "resampled")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
