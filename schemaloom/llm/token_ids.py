"""Token ids of whole texts from the ids of their distinct units (words, or marked pieces of text).

A tokenizer whose tokens never cross unit borders gives the same ids for a text as for its units one by
one; distinct units are few, so each is encoded once per worker and the rest is a numpy gather.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class UnitEncoder:
    """Keeps the ids of at most about ``limit`` units; ``encode`` gives little-endian 32-bit ids for a list of units.

    The ids of all kept units lie in one array, and Arrow looks all units of a call up at once; only new ones become Python strings. Beyond the
    limit the half that was met last stays, so frequent units stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000):
        self.encode, self.limit, self.calls = encode, limit, 0
        self.units, self.flat = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.start = self.size = self.met = np.empty(0, np.int64)  # of each kept unit: its place in ``flat``, how many ids, the last call that had it

    def _forget(self) -> None:
        half = len(self.met) - self.limit // 2
        keep = np.flatnonzero(self.met >= np.partition(self.met, half)[half])
        n = self.size[keep]
        ends = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - n), n) + np.arange(n.sum())]
        self.units, self.start, self.size, self.met = self.units.take(pa.array(keep)), ends - n, n, self.met[keep]

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where each unit is kept, once those that are new are encoded."""
        self.calls += 1
        if len(self.units) > self.limit:
            self._forget()
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            coded = units.take(pa.array(missing)).dictionary_encode()
            at[missing] = len(self.units) + np.asarray(coded.indices, np.int64)
            blobs = self.encode(coded.dictionary.to_pylist())
            n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            self.units = pa.concat_arrays([self.units, coded.dictionary])
            self.start, self.size = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n]), np.concatenate([self.size, n])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(blobs), "<u4")])
            self.met = np.concatenate([self.met, np.zeros(len(n), np.int64)])
        self.met[at] = self.calls
        return at

    def ids(self, codes: np.ndarray, offsets: np.ndarray, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text) for texts given as unit codes."""
        if not len(codes):
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        unit = self._places(units.cast(pa.large_string()))
        n = self.size[unit][codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(ends[-1], len(self.flat)) < 1 << 31 else np.int64
        at = np.repeat((self.start[unit][codes] - ends[:-1]).astype(kind), n)
        at += np.arange(ends[-1], dtype=kind)
        return self.flat[at], ends[offsets]
