"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; from it come the normaliser, the metaspace marker, the unigram scores
or BPE merges, and byte fallback. Texts are cut before each run of markers, where no piece of the model can
cross (checked at load), so each distinct part is encoded once per worker, in multithreaded batches. Every
row's ids are compared with those of the sentencepiece library, and decoded again. Nothing is shuffled.

Edge cases: null and empty texts have no tokens and decode to the empty string; a marker character in the
text decodes to a blank, as in sentencepiece, which shows as ``round_trip`` false; rows are treated one by
one and other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm.text import slices, texts_of
from schemaloom.llm.token_ids import UnitEncoder

MARK = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(key & 7) or _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def _after_mark(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(MARK, texts.type), texts, pa.scalar("", texts.type))


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SpModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                model.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                model.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                model.charsmap, model.dummy_prefix, model.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        return model

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def byte_fallback(self) -> bool:
        return any(p[2] == BYTE for p in self.pieces)

    @property
    def separable(self) -> bool:
        """No piece holds a marker after another character, so parts can be encoded one by one."""
        return all(MARK not in p[0].lstrip(MARK) for p in self.pieces if p[2] in (NORMAL, USER))


def build(model: SpModel):
    """The tokenizers object; texts come with blanks as markers and with the dummy prefix."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    unk = model.pieces[model.unk][0]
    if model.kind == BPE:
        merges = [(i, a, b) for p, i in usable.items() for a, b in ((p[:k], p[k:]) for k in range(1, len(p))) if a in usable and b in usable]
        merges.sort(key=lambda m: (-model.pieces[m[0]][1], m[0], usable[m[1]], usable[m[2]]))
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=[(a, b) for _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    if model.charsmap:
        tokenizer.normalizer = normalizers.Precompiled(model.charsmap)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


class SpCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = SpModel.parse(f.read())
        self.tokenizer = build(self.model)
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.units = UnitEncoder(lambda parts: [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)], 600_000)

    def _marked(self, texts: pa.Array) -> pa.Array:
        if self.model.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        texts = pc.replace_substring(texts, " ", MARK)
        some = pc.not_equal(texts, "")
        return pc.if_else(some, _after_mark(texts), texts) if self.model.dummy_prefix else texts

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text."""
        marked = self._marked(texts)
        lists = [[t] if t else [] for t in marked.to_pylist()] if not self.model.separable else None
        if lists is None:
            odd = pc.or_(pc.match_substring(marked, MARK + MARK), pc.or_(pc.ends_with(marked, MARK), pc.invert(pc.starts_with(marked, MARK))))
            if not pc.any(odd).as_py():
                parts = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), MARK)
                flat = _after_mark(parts.flatten()).dictionary_encode()
                ids, ends = self.units.ids(np.asarray(flat.indices, np.int64), np.asarray(parts.offsets, np.int64), flat.dictionary)
                return [ids[a:b] for a, b in zip(ends, ends[1:])]
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            even = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
            out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
            if len(even):
                for i, x in zip(even, self.encode(texts.take(pa.array(even)))):
                    out[i] = x
            for i, x in zip(at, self._encode_lists([self._parts(t) for t in marked.take(pa.array(at)).to_pylist()])):
                out[i] = x
            return out
        return self._encode_lists(lists)

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Cuts before each run of markers."""
        parts, begin = [], 0
        at = text.find(MARK, 1)
        while at > 0:
            if text[at - 1] != MARK:
                parts.append(text[begin:at])
                begin = at
            at = text.find(MARK, at + 1)
        return [*parts, text[begin:]] if text else []

    def _encode_lists(self, lists: list[list[str]]) -> list[np.ndarray]:
        flat = pa.array([x for part in lists for x in part], pa.large_string()).dictionary_encode()
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids, ends = self.units.ids(np.asarray(flat.indices, np.int64), offsets, flat.dictionary)
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n) + np.arange(n.sum())
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@dataclass(frozen=True)
class SpParams:
    """``path``: the model file, "" for the box's BPE pieces; ``threads`` of the batch encoder in a task."""

    path: str = ""
    threads: int = 2


_CODECS: dict[str, SpCodec] = {}


def codec(params: SpParams) -> tuple[SpCodec, str]:
    """One codec for each Python worker and file, and the file."""
    import os

    os.environ.setdefault("RAYON_NUM_THREADS", str(params.threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    path = params.path
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _CODECS:
        _CODECS[path] = SpCodec(path)
    return _CODECS[path], path


def encode(documents: DataFrame, params: SpParams = SpParams()) -> DataFrame:
    """doc_id and the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = codec(params)
        for batch in slices(batches, "text", 4 << 20):
            ids = [x.astype(np.int32) for x in sp.encode(texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, params: SpParams = SpParams()) -> DataFrame:
    """doc_id and text of each list of ids; null ids give the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = codec(params)
        for batch in batches:
            texts = [sp.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def verify(documents: DataFrame, params: SpParams = SpParams()) -> DataFrame:
    """Per document the number and digest of its ids, the bytes among them, whether the sentencepiece library
    gives the same ids, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp, path = codec(params)
        other = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in slices(batches, "text", 4 << 20):
            texts = texts_of(batch, "text")
            plain = texts.to_pylist()
            found = sp.encode(texts)
            same = [np.array_equal(a, np.array(b, "<u4")) for a, b in zip(found, other.encode(plain, num_threads=1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, found), pa.int64()),
                    pa.array([zlib.crc32(np.ascontiguousarray(x).tobytes()) for x in found], pa.int64()),
                    pa.array([int(sp.is_byte[x].sum()) for x in found], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.array([sp.decode(x) == t for x, t in zip(found, plain)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "parity", "round_trip"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_crc32 long, n_bytes long, parity boolean, round_trip boolean"
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
