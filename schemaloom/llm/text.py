"""Vectorised text helpers shared by the corpus operators.

They run inside Arrow tasks: Spark deals the rows out, these functions turn one bounded slice of a
batch into flat numpy arrays, so no Python loop touches single words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the word definition used by every operator here: blank and \x09 to \x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def _trim() -> None:
    """Gives free memory of the C heap back, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``budget`` bytes of text, one row at least. Workers are used again by later tasks: what a task
    freed goes back to the system at its end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = (np.cumsum(size) - size) // budget
        edges = np.flatnonzero(np.diff(chunk, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
    del batches
    pa.default_memory_pool().release_unused()
    _trim()


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts of a batch, null as the empty string, in buffers of their own: some kernels (ascii_lower)
    misread a slice whose first offset isn't 0."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts: (code of each word, offsets by text, distinct words)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        flat = flat.filter(pa.array(real))
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, dtype=np.int64), offsets, coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if not len(words):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text in the slice."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window that lies in one text, and the window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = hashes[:n] * odd[0]
        for i in range(1, width):
            h = h + hashes[i : n + i] * odd[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    own = owners(offsets)
    first = np.flatnonzero(own[:n] == own[width - 1 :])
    return h[first], first


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def only(texts: pa.Array, keep: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The texts of ``texts_of`` with A-Z lower-cased and each byte that ``keep`` says false of as a blank. ``keep`` sees all
    bytes, lower-cased, and must keep or drop the bytes of a character together."""
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(np.where(keep(low), low, np.uint8(32))))
