"""Lexical retrieval packing: documents become full training windows with their lexical neighbours.

Documents are dealt to partitions by a lexical key, a minhash of their rarer words, and sorted by it and a second one, so that texts with many words in
common, copies above all, lie side by side whatever rows they came from. Each text keeps a sketch, its words of smallest hashes; a word in the sketches of many
documents makes no key, and a key that many documents have is dealt by the second minhash too. Both are counted over all documents. A partition that is still too large is cut by adaptive execution. Each shard of ``block_bytes`` has its own BM25 inverted index; the document that opens a window is the query, and
its unused neighbours fill the window in order of their scores. A document that runs over the window's end is cut there and
opens the next window, as its seed. So every window is full; the last tokens of a task go to windows whose lengths are powers
of two, which need no padding. The texts are written once, with their sketches, and shuffled once, by their key.

Edge cases: null and empty texts are the closing id alone; documents of any length are cut as often as
needed; equal documents and repeated rows are packed each for itself; an empty table gives no rows; extra
columns are not read. sequence_id is the task's number times 2**40 plus a counter.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import written
from schemaloom.llm.text import hash_words, owners, slices, split_words, texts_of
from schemaloom.llm.token_ids import UnitEncoder


@dataclass(frozen=True)
class PackParams:
    """``tokenizer``: path of a tokenizers file whose tokens never cross white space; "" for the box's word BPE. Words in the sketches, of ``sketch`` words,
    of more than ``frequent_share`` of all documents are no key; keys of more than ``hot_share`` of all documents are dealt by the second one as well."""

    tokenizer: str = ""
    window: int = 2048
    end_id: int = 1
    k1: float = 1.2
    b: float = 0.75
    block_bytes: int = 4 << 20
    sketch: int = 8
    frequent_share: float = 0.03
    hot_share: float = 0.002


_ENCODERS: dict[str, UnitEncoder] = {}
#: Letters that every normaliser leaves as they are: lower case, one code point, no mark to combine.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """How byte-level tokenizers write bytes as characters: printable ones as themselves, the others from 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


def letters_by_model(tokenizer) -> Callable[[str], bytes] | None:
    """Ids of a word of letters straight from the model, without normaliser and pre-tokenizer, which leave such a word whole; None if this tokenizer gives
    other ids for a sample of words."""
    model, table = tokenizer.model, byte_letters()

    def ids(word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(table)
        return array("I", [t.id for t in model.tokenize(word)]).tobytes()

    rng = np.random.default_rng(49)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzeaoißàäéöøþÿ"))
    sample = ["".join(rng.choice(letters, n)) for n in (*range(1, 20), 60, 300) for _ in range(4)] + ["the", "straße", "x" * 50, "don", "ll", "re", "ving"]
    same = all(np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() == ids(w) for w in sample)
    return ids if same and array("I").itemsize == 4 and sys.byteorder == "little" else None


def encoder(path: str) -> UnitEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        if path:
            file = path
        else:
            import public_tokenizers

            file = public_tokenizers.path("word_bpe_49k.json")
        tokenizer = Tokenizer.from_file(file)
        mark, mark_id = next((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)

        direct = letters_by_model(tokenizer)

        def plain(words: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        def encode(words: list[str]) -> list[bytes]:
            """Words of lower-case letters by the model alone; of the others many at once, told apart by a special token between them."""
            found = {w: direct(w) for w in words if _LETTERS.fullmatch(w)} if direct else {}
            odd = [w for w in words if "<|" in w or not w]
            found.update(zip(odd, plain(odd)))
            rest = [w for w in words if w not in found]
            for i in range(0, len(rest), 1000):
                part = rest[i : i + 1000]
                ids = np.array(tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
                cut = np.flatnonzero(ids == mark_id)
                if len(cut) == len(part) - 1:
                    edges = [-1, *cut.tolist(), len(ids)]
                    found.update((w, ids[a + 1 : b].tobytes()) for w, a, b in zip(part, edges, edges[1:]))
                else:
                    found.update(zip(part, plain(part)))
            return [found[w] for w in words]

        _ENCODERS[path] = UnitEncoder(encode)
    return _ENCODERS[path]


#: Closing marks that the tokenizer's pattern cuts from a letter or digit before them.
_CLOSING = ".,;:!?#*$%&"


def halves(codes: np.ndarray, offsets: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word as two units, its lower-case stem and its closing marks, so that there are fewer units to
    encode. Only marks after a Latin letter or digit are cut off: there the tokenizer cuts as well."""
    words = pc.ascii_lower(words)
    stem = pc.utf8_rtrim(words, _CLOSING)
    at = np.flatnonzero(pc.not_equal(stem, words).to_numpy(zero_copy_only=False))
    at = at[pc.match_substring_regex(stem.take(pa.array(at)), "[a-z0-9À-ÖØ-öø-ÿ]$").to_numpy(zero_copy_only=False)]
    cut = np.zeros(len(words), bool)
    cut[at] = True
    stem = pc.if_else(pa.array(cut), stem, words)
    marks = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(stem).to_numpy(zero_copy_only=False))[at]  # a byte each
    order = np.argsort(marks, kind="stable")
    at, marks = at[order], marks[order]
    edges = np.flatnonzero(np.diff(marks, prepend=0)).tolist()
    parts = [pc.utf8_slice_codeunits(words.take(pa.array(at[a:b])), -int(marks[a])) for a, b in zip(edges, [*edges[1:], len(at)])]
    tails = pa.concat_arrays([pa.array([], words.type), *parts]).dictionary_encode()
    tail_of = np.zeros(len(words), np.int64)
    tail_of[at] = np.asarray(tails.indices, np.int64) + 1
    stems = stem.dictionary_encode()
    both = np.stack([np.asarray(stems.indices, np.int64)[codes], (tail_of + len(stems.dictionary))[codes]], axis=1).ravel()
    return both, 2 * offsets, pa.concat_arrays([stems.dictionary, pa.array([""], words.type), tails.dictionary])


class Bm25Block:
    """Inverted index of one block: postings of the terms that two or more documents have."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, n_terms: int, p: PackParams):
        self.n = len(offsets) - 1
        key, tf = np.unique(codes * np.int64(self.n) + owners(offsets), return_counts=True)
        term, doc = np.divmod(key, self.n) if self.n else (key, key)
        df = np.bincount(term, minlength=n_terms)
        keep = df[term] > 1
        term, self.doc, tf = term[keep], doc[keep], tf[keep]
        length = np.diff(offsets)
        norm = p.k1 * (1 - p.b + p.b * length / max(1.0, length.mean())) if self.n else length
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (p.k1 + 1) / (tf + norm[self.doc])
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        order = np.argsort(self.doc, kind="stable")
        self.terms_of, self.doc_start = term[order], np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the block for all terms of the seed."""
        terms = self.terms_of[self.doc_start[seed] : self.doc_start[seed + 1]]
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Packer:
    """The open window of one task; ``pieces`` gathers (document, start, length, window, offset)."""

    def __init__(self, first_id: int, window: int):
        self.id, self.window, self.used, self.pieces = first_id, window, 0, []

    def place(self, doc: int, length: int) -> bool:
        """Puts a whole document; true if it ended in another window than it began in, or filled one."""
        start, crossed = 0, False
        while start < length:
            n = min(length - start, self.window - self.used)
            self.pieces.append((doc, start, n, self.id, self.used))
            start, self.used = start + n, self.used + n
            if self.used == self.window:
                self.id, self.used, crossed = self.id + 1, 0, True
        return crossed

    def take(self) -> list[tuple[int, int, int, int, int]]:
        out, self.pieces = self.pieces, []
        return out


def by_score(score: np.ndarray, first: int = 32) -> Iterator[int]:
    """The documents with a score, best first, equal ones by their number. A window takes few, so about ``first`` are sorted, and the others only when asked for."""
    near = np.flatnonzero(score)
    top = np.ones(len(near), bool)
    if len(near) > first:
        found = score[near]
        top = found >= np.partition(found, -first)[-first]
    for some in (near[top], near[~top]):
        yield from some[np.argsort(-score[some], kind="stable")].tolist()


def pack_block(index: Bm25Block, lengths: np.ndarray, packer: Packer) -> None:
    unused = np.ones(index.n, bool)
    first = 0
    while first < index.n:
        if not unused[first]:
            first += 1
            continue
        seed = first
        while seed >= 0:
            if unused[seed]:
                unused[seed] = False
                packer.place(seed, int(lengths[seed]))
            score = index.scores(seed) * unused
            seed = -1
            for x in by_score(score):
                unused[x] = False
                if packer.place(x, int(lengths[x])):
                    seed = x  # it opens the next window
                    break


def tail_windows(pieces: list, first_id: int, used: int) -> list:
    """Deals the pieces of the last, part-filled window out to windows of power-of-two lengths."""
    sizes = [1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1]
    out, at, room, wid, offset = [], 0, sizes[0] if sizes else 0, first_id, 0
    for doc, start, n, _, _ in pieces:
        while n:
            k = min(n, room)
            out.append((doc, start, k, wid, offset))
            start, n, room, offset = start + k, n - k, room - k, offset + k
            if not room and at + 1 < len(sizes):
                at, room, wid, offset = at + 1, sizes[at + 1], wid + 1, 0
    return out


_NEVER = np.uint64(2**64 - 1)


def sketches(texts: pa.Array, size: int) -> np.ndarray:
    """The ``size`` smallest hashes of each text's words, in order, a row for each text; the greatest number where it has fewer words."""
    codes, offsets, words = split_words(texts)
    out = np.full((len(texts), size), _NEVER)
    if not len(codes):
        return out
    hashes, n_words = hash_words(words), np.int64(len(words))
    order = np.argsort(hashes)
    rank = np.empty(n_words, np.int64)
    rank[order] = np.arange(n_words)
    rank, doc = rank[codes], owners(offsets)

    def distinct(some: np.ndarray) -> np.ndarray:
        key = np.sort(doc[some] * n_words + rank[some])
        return key[np.diff(key, prepend=-1) != 0]

    # a text of n words most likely has enough of them in this share of the hashes; where it has not, all are looked at
    key = distinct(rank * np.diff(offsets)[doc] < 4 * size * n_words)
    short = np.bincount(key // n_words, minlength=len(texts)) < size
    key = np.sort(np.concatenate([key[~short[key // n_words]], distinct(short[doc])]))
    of, rank = np.divmod(key, n_words)
    place = np.arange(len(of)) - np.searchsorted(of, of)
    held = place < size
    out[of[held], place[held]] = hashes[order][rank[held]]
    return out


def keys_of(sketch: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two minhashes of each sketch's rarer words, those whose hashes are not in ``frequent``; of all where none is rarer. Texts that share a share s of
    their words agree in each with a chance of about s."""
    rare = np.where(np.isin(sketch, frequent), _NEVER, sketch)
    first = rare.min(axis=1)
    first = np.where(first == _NEVER, sketch[:, 0], first)
    mixed = np.where(rare == _NEVER, _NEVER, (rare ^ rare >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15))
    return first, mixed.min(axis=1)


def lexical_keys(texts: pa.Array, frequent: np.ndarray, size: int = PackParams.sketch) -> tuple[np.ndarray, np.ndarray]:
    return keys_of(sketches(texts, size), frequent)


def sketched(documents: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, text, copy (a hash of the text) and sketch."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = sketches(texts_of(batch, "text"), p.sketch).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, p.sketch), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "sketch"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sketch array<long>")


def frequent_words(documents: DataFrame, p: PackParams) -> tuple[np.ndarray, int]:
    """Hashes of the words in the sketches of more than ``frequent_share`` of all documents, and how many documents there are."""
    rows = documents if "sketch" in documents.columns else sketched(documents, p)
    size = rows.count()
    counts = rows.select(F.explode("sketch").alias("word")).filter("word <> -1").groupBy("word").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > max(4, p.frequent_share * size)).select("word").collect()  # sketch / frequent_share at most
    return np.array(sorted(r.word for r in found), np.int64).view(np.uint64), size


def side_by_side(documents: DataFrame, p: PackParams) -> DataFrame:
    """doc_id and text, lexical neighbours next to each other in the partitions, copies first. Which words are frequent and which keys are
    hot is counted over all documents; a hot key is dealt by its second minhash as well. Spark cuts a partition that is still too large, and
    joins small ones. The texts with their sketches are a table in the shared folder, which stays for the reader of the result."""

    def keyed(rows: DataFrame, frequent: np.ndarray, hot: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sketch = np.asarray(batch.column("sketch").flatten()).view(np.uint64).reshape(-1, p.sketch)
                first, second = keys_of(sketch, frequent)
                dealt = np.where(np.isin(first, hot), first ^ second * np.uint64(0x9E3779B97F4A7C15), first)
                rest = [c for c in batch.schema.names if c != "sketch"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(k.view(np.int64)) for k in (first, second, dealt))], [*rest, "key", "key2", "dealt"])

        fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "sketch"]
        return rows.mapInArrow(run, ", ".join([*fields, "key long, key2 long, dealt long"]))

    rows, _ = written(sketched(documents, p), "packing-sketches")
    frequent, size = frequent_words(rows, p)
    none = np.empty(0, np.uint64)
    counts = keyed(rows.select("sketch"), frequent, none).groupBy("key").agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") > max(8, p.hot_share * size)).select("key").collect()  # 1 / hot_share keys at most
    out = keyed(rows, frequent, np.array(sorted(r.key for r in hot), np.int64).view(np.uint64) if hot else none)
    return out.hint("rebalance", "dealt").sortWithinPartitions("key", "key2", "copy").select("doc_id", "text")


def pack(documents: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece of a document, with its place in a window."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(params.tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, params.window)
        held: list = []  # pieces of the open window, with what they need to be written

        def rows(pieces: list) -> pa.RecordBatch:
            columns = zip(*((p[5], p[1], p[2], zlib.crc32(p[6][p[1] : p[1] + p[2]].tobytes()), len(p[6]), p[3], p[4]) for p in pieces))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [arrow_id, *[pa.int64()] * 6])], names)

        arrow_id = pa.int64()
        for batch in slices(batches, "text", params.block_bytes):
            arrow_id = batch.column("doc_id").type
            codes, offsets, words = split_words(texts_of(batch, "text"))
            ids, bounds = encode.ids(*halves(codes, offsets, words))
            lengths = np.diff(bounds) + 1
            pack_block(Bm25Block(codes, offsets, len(words), params), lengths, packer)
            keys = batch.column("doc_id").to_pylist()
            tokens: dict[int, np.ndarray] = {}
            done = []
            for piece in packer.take():
                d = piece[0]
                if d not in tokens:
                    tokens[d] = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(params.end_id)).astype("<u4")
                (held if piece[3] == packer.id else done).append((*piece, keys[d], tokens[d]))
            if done:
                last = {p[3] for p in done}
                done = [p for p in held if p[3] in last] + done
                held = [p for p in held if p[3] not in last]
                yield rows(done)
        if held:
            plain = {(p[0], id(p[6])): p for p in held}
            where = list(plain)
            cut = tail_windows([(where.index((p[0], id(p[6]))), *p[1:5]) for p in held], packer.id, packer.used)
            yield rows([(*c, *plain[where[c[0]]][5:]) for c in cut])

    return side_by_side(documents, params).mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
