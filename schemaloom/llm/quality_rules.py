"""Quality rules with compression bands.

The base figures count words, symbols, repeated lines and repeated eight-word windows. The method then
compresses each whole document and each of its fixed chunks with zstandard: a ratio above the band of
its length means repetitive text, one below it means noise. One pass over the documents, no shuffle.

Edge cases: null and empty texts have no words, fail the base rule and compress to nothing; texts under
``min_bytes`` get no verdict by compression; lone surrogates cannot occur in Arrow strings; repeated
rows are judged one by one; other columns are passed through by ``judge`` and dropped by the query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from schemaloom.llm.text import ASCII_SPACE, hash_words, odd_numbers, owners, slices, split_words, texts_of, windows

_ODD = odd_numbers(9, seed=6)


@dataclass(frozen=True)
class Bands:
    """``whole``: (below so many UTF-8 bytes, least ratio, greatest ratio), the last one for all longer texts; the least is
    just below the lowest of clean text of that length. ``chunk``: the same for a whole chunk; a last partial chunk has the
    least ratio of its own length. ``chunk_share``: the greatest share of a text's bytes in chunks outside."""

    whole: tuple[tuple[float, float, float], ...] = (
        (100, 0.4, 1.7), (200, 1.0, 2.1), (300, 1.15, 2.1), (500, 1.25, 2.2), (700, 1.36, 2.2), (1_000, 1.47, 2.2),
        (1_500, 1.58, 2.3), (2_000, 1.72, 2.3), (2_500, 1.78, 2.3), (3_000, 1.86, 2.3), (3_500, 1.9, 2.45),
        (5_000, 1.91, 2.45), (6_500, 2.02, 2.45), (10_000, 2.08, 2.45), (14_000, 2.16, 2.7), (20_000, 2.2, 2.7), (40_000, 2.27, 2.7), (float("inf"), 2.3, 3.0),
    )
    chunk: tuple[float, float] = (1.76, 2.6)
    chunk_bytes: int = 2048
    chunk_share: float = 0.2
    min_bytes: int = 32
    level: int = 3


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(ASCII_SPACE))


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    codes, offsets, words = split_words(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = hash_words(words)[codes] if len(words) else np.empty(0, np.uint64)
    window, first = windows(hashes, offsets, 8, _ODD)
    own = owners(offsets)
    window = window ^ (own[first].astype(np.uint64) * _ODD[8])  # equal only within one text
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 8, -1)
    return {
        "n_words": np.diff(offsets),
        "word_chars": _sum_by(chars[codes], offsets) if len(words) else np.zeros(len(texts), np.int64),
        "n_symbols": _sum_by(symbols[codes], offsets) if len(words) else np.zeros(len(texts), np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts.to_pylist()], dtype=np.int64),
        "n_repeat_words": _sum_by((np.cumsum(cover[:-1]) > 0).astype(np.int64), offsets),
    }


def within_bands(text: str, bands: Bands, compress) -> bool:
    """The verdict of the compression bands on one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) < bands.min_bytes:
        return True

    def band(n: int) -> tuple[float, float]:
        return next((a, b) for below, a, b in bands.whole if n < below)

    least, greatest = band(len(raw))
    if not least <= len(raw) / len(compress(raw)) <= greatest:
        return False
    size = bands.chunk_bytes
    outside = 0
    for i in range(0, len(raw), size) if len(raw) > size else ():
        c = raw[i : i + size]
        if len(c) < bands.min_bytes:
            continue
        least, greatest = bands.chunk if len(c) == size else (band(len(c))[0], bands.chunk[1])
        if not least <= len(c) / len(compress(c)) <= greatest:
            outside += len(c)
    return outside <= bands.chunk_share * len(raw)


def judge(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Adds the base figures, ``base_failed`` and ``kept`` to the rows, in place of columns of those names."""
    documents = documents.drop(*FIGURES, "base_failed", "kept")
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            f = figures(texts)
            failed = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
            kept = [not bad and within_bands(t, bands, compress) for bad, t in zip(failed, texts.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(f[k], pa.int64()) for k in FIGURES), pa.array(failed), pa.array(kept, pa.bool_())],
                [*columns, *FIGURES, "base_failed", "kept"],
            )

    added = [StructField(k, LongType()) for k in FIGURES] + [StructField(k, BooleanType()) for k in ("base_failed", "kept")]
    return documents.mapInArrow(run, StructType([*documents.schema.fields, *added]))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
