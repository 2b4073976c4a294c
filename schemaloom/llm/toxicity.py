"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded sample of labelled documents (``sample_rows`` and ``sample_bytes``, documented parameters) and runs
FTRL-proximal with per-coordinate rates in one task, or in some shards whose weights are averaged by a
Spark aggregation. L1 leaves only some thousands of weights, which are broadcast.
Scoring is one pass over the documents without any shuffle.

Edge cases: a null or empty text gets the score of the bias alone; a null doc_id counts as the empty
string for the fold; several label rows of one doc_id count as toxic if any is; of several
texts of one labelled doc_id the least is learned from; no labels at all
give the score 0 for each row; other columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from schemaloom.llm.text import hash_words, odd_numbers, owners, slices, split_words, texts_of

_ODD = odd_numbers(4, seed=2)
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>…-"
_BIAS = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class FtrlParams:
    """``sample_rows`` bounds the labelled documents used to fit, all ``shards`` together; their weights
    are averaged. Texts over ``text_bytes`` are not learned from, nor those of a shard past its ``sample_bytes``; scored are all. A
    feature is learned if ``min_documents`` of a shard's sample have it."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    epochs: int = 6
    shards: int = 1
    sample_rows: int = 12288
    sample_bytes: int = 128 << 20
    text_bytes: int = 1 << 20
    min_documents: int = 3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 32-bit feature hash) of every word, word pair and pair around one skipped word."""
    codes, offsets, words = split_words(texts)
    h = hash_words(pc.utf8_lower(pc.utf8_trim(words, _EDGE)))[codes] if len(words) else np.empty(0, np.uint64)
    own = owners(offsets)
    doc, out = [own], [(h * _ODD[0] >> np.uint64(32)).astype(np.uint32)]
    for gap in (1, 2):
        same = own[:-gap] == own[gap:]
        pair = h[:-gap] * _ODD[gap] + (h[gap:] ^ (h[gap:] >> np.uint64(31))) * _ODD[3]
        pair ^= pair >> np.uint64(33)
        doc.append(own[:-gap][same])
        out.append((pair[same] * _ODD[0] >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(doc), np.concatenate(out)


def _seen(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct features of each text, some texts at a time."""
    for i in range(0, len(texts), 256):
        doc, feature = features(pa.array(texts[i : i + 256], pa.large_string()))
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | feature)
        bounds = np.searchsorted(key >> np.uint64(32), np.arange(len(texts[i : i + 256]) + 1, dtype=np.uint64))
        feature = key.astype(np.uint32)
        yield from (feature[a:b] for a, b in zip(bounds, bounds[1:]))


def _fit_shard(texts: list[str], labels: np.ndarray, p: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint32((1 << 24) - 1)
    count = np.zeros(1 << 24, np.uint8 if p.min_documents < 256 else np.uint32)
    most = np.iinfo(count.dtype).max  # counts stay there
    for x in _seen(texts):
        at = x & low
        count[at] += count[at] < most
    rows = [x[count[x & low] >= p.min_documents] for x in _seen(texts)]
    del count
    # a few rows at a time, so that no second copy of all is held
    index = np.unique(np.concatenate([*(np.unique(np.concatenate(rows[i : i + 1024])) for i in range(0, len(rows), 1024)), np.empty(0, np.uint32)]))
    for i, x in enumerate(rows):
        rows[i] = np.searchsorted(index, x).astype(np.int32)
    bias = len(index)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= p.l1, 0.0, (np.sign(zs) * p.l1 - zs) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in range(len(texts)):
            at = np.append(rows[i], bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    keep = np.flatnonzero(w)
    return np.append(index, _BIAS)[keep], w[keep]


def train(documents: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and their weights. Only rows outside fold 0 are learned from."""
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id").limit(params.sample_rows)
    )
    rows = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.octet_length("text") <= params.text_bytes)
        .join(F.broadcast(sample), "doc_id")  # sample_rows rows at most
        .groupBy("doc_id", "at", "y").agg(F.min("text").alias("text"))  # an id may be repeated very often
        .withColumn("shard", F.pmod("at", F.lit(params.shards)).cast("int"))
        .repartition(params.shards, "shard").sortWithinPartitions("shard", "at", "doc_id", "text")
        .select("shard", "text", "y")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for part in slices([batch], "text"):
                for s, t, y in zip(*(c.to_pylist() for c in part.columns)):
                    size[s] = size.get(s, 0) + len(t.encode())
                    if size[s] <= params.sample_bytes:
                        shards.setdefault(s, ([], []))[0].append(t)
                        shards[s][1].append(y)
        for texts, ys in shards.values():
            index, w = _fit_shard(texts, np.array(ys, dtype=float), params)
            yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(w)], ["feature", "w"])

    fitted = rows.mapInArrow(fit, "feature long, w double").groupBy("feature").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    shards = max([r["n"] for r in fitted if r["feature"] == int(_BIAS)], default=1)
    fitted = sorted((r["feature"], r["w"] / shards) for r in fitted)
    return np.array([f for f, _ in fitted], dtype=np.uint32), np.array([w for _, w in fitted])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds ``score`` to each row, in place of any column of that name; one pass, no shuffle."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    documents = documents.drop("score")
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        bias = weight[index == _BIAS].sum()
        low = np.uint32((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[index[index != _BIAS] & low] = True
        for batch in slices(batches, "text"):
            total = np.full(batch.num_rows, bias)
            if len(index):
                doc, feature = features(texts_of(batch, "text"))
                hit = np.flatnonzero(maybe[feature & low])
                doc, feature = doc[hit], feature[hit]
                at = np.searchsorted(index, feature)
                real = (at < len(index)) & (index[np.minimum(at, len(index) - 1)] == feature) & (feature != _BIAS)
                once = np.unique(doc[real] * np.int64(len(index)) + at[real])
                np.add.at(total, once // len(index), weight[once % len(index)])
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30))) if len(index) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*columns, "score"])

    schema = StructType([*documents.schema.fields, StructField("score", DoubleType())])
    return documents.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
