"""Spelling variants: words that one inserted, deleted or replaced character tells apart, and the form each stands for.

Words are counted over all texts, in each slice first. A word is cut in half: an error in its second half leaves the first one
as it is, so forward automata find the word's neighbours from there; an error in the first half leaves the second one, and backward
automata, those of the reversed words, find them. Words and queries meet by (direction, exact half, length of the query), so Spark deals
the work out. A task builds minimal acyclic automata over some thousand words at a time; what a walk skips adds up to the
word's number in sorted order (a perfect hash), by which its count is looked up. What the forward walk finds the backward one
leaves out, so no pair is counted twice. A half that very many words share is cut in blocks of ``block`` words, each with all
the queries of that half, which are streamed past it.

A word's form is the near word of the largest count if that is ``ratio`` times its own; roots follow by pointer jumping, and since
counts grow by that ratio the chains are short.

Edge cases: null and empty texts have no words; a null id counts as the empty text in the checksum; repeated rows and equal ids count
row by row; words of any length are taken whole; without words there are no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import crc
from schemaloom.llm.shared import Scratch
from schemaloom.llm.text import only, owners, slices, split_words, texts_of


@dataclass(frozen=True)
class SpellingParams:
    """``slip``: a run of letters loses a character in documents where the checksum of id and run is a multiple of it; 0 for no run.
    ``block``: words of an automaton at most."""

    least_chars: int = 6
    least_count: int = 5
    ratio: int = 5
    slip: int = 199
    block: int = 20_000


def _letter_bytes(b: np.ndarray) -> np.ndarray:
    """a-z and U+00C0 to U+00FF, which are the characters whose first byte is C3."""
    lead = b == 0xC3
    follows = np.zeros(len(b), bool)
    follows[1:] = lead[:-1]
    return ((b >= 97) & (b <= 122)) | lead | follows


def _slice_counts(texts: pa.Array, ids: list, p: SpellingParams) -> tuple[pa.Array, np.ndarray]:
    """Words long enough, and how often each occurs in the slice."""
    codes, offsets, words = split_words(only(texts, _letter_bytes))
    if not len(words):
        return words, np.empty(0, np.int64)
    pair, times = np.unique(owners(offsets) * np.int64(len(words)) + codes, return_counts=True)
    row, word = np.divmod(pair, len(words))
    slipped: Counter[str] = Counter()
    if p.slip:
        head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        check, size = crc.of_strings(words)
        h = crc.joined(head[row], check[word], size[word])
        for k in np.flatnonzero(h % np.uint32(p.slip) == 0).tolist():
            w = words[int(word[k])].as_py()
            at = int(h[k]) % len(w)
            slipped[w[:at] + w[at + 1 :]] += int(times[k])
            times[k] = 0
    n = np.zeros(len(words), np.int64)
    np.add.at(n, word, times)
    keep = (n > 0) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= p.least_chars)
    more = {w: k for w, k in slipped.items() if len(w) >= p.least_chars}
    return pa.concat_arrays([words.filter(pa.array(keep)), pa.array(list(more), words.type)]), np.concatenate([n[keep], np.fromiter(more.values(), np.int64, len(more))])


def word_counts(documents: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word and n, its occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, n = _slice_counts(texts_of(batch, "text"), batch.column("doc_id").to_pylist(), p)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least_count)


class Automaton:
    """Minimal acyclic automaton of different words in sorted order. ``moves`` has for each state the next one by character, with the
    number of words that sort before those behind the move."""

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.final: list[bool] = [False]
        count, known, last = [0], {}, ""
        path, nexts = [0], [{}]  # the states of the last word, and where they lead

        def close(depth: int) -> None:
            """Gives the states of the last word beyond ``depth`` their final shape, each that of an equal one if there is any."""
            while len(path) > depth + 1:
                state, out = path.pop(), nexts.pop()
                shape = (self.final[state], *out.items())
                same = known.setdefault(shape, state)
                if same == state:
                    self._number(state, out, count)
                nexts[-1][last[len(path) - 1]] = same

        for word in words:
            depth, most = 0, min(len(last), len(word))
            while depth < most and last[depth] == word[depth]:
                depth += 1
            close(depth)
            for _ in word[depth:]:
                path.append(len(self.moves))
                nexts.append({})
                self.moves.append({})
                self.final.append(False)
                count.append(0)
            self.final[path[-1]] = True
            last = word
        close(0)
        self._number(0, nexts[0], count)

    def _number(self, state: int, out: dict[str, int], count: list[int]) -> None:
        seen = int(self.final[state])
        for c, target in out.items():
            self.moves[state][c] = (target, seen)
            seen += count[target]
        count[state] = seen

    def _walk(self, state: int, number: int, rest: str) -> int:
        """The number of the word that the rest leads to, -1 if none."""
        moves = self.moves
        for c in rest:
            step = moves[state].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first ``half`` characters and then differ by exactly one error. In a run of
        one character only its last one is deleted and only the place behind it is filled with another: the others give the same."""
        found, state, number = set(), 0, 0
        for i in range(len(word) + 1):
            c = word[i] if i < len(word) else ""
            if i >= half:
                if c and word[i + 1 : i + 2] != c:
                    found.add(self._walk(state, number, word[i + 1 :]))
                for d, (target, before) in self.moves[state].items():
                    if d != c:
                        found.add(self._walk(target, number + before, word[i:]))
                        if c:
                            found.add(self._walk(target, number + before, word[i + 1 :]))
            step = self.moves[state].get(c)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def _first_half(word: Column, length: Column) -> Column:
    return F.substring(word, F.lit(1), F.floor(length / 2).cast("int"))


def _second_half(word: Column, length: Column) -> Column:
    """As many characters from the word's end as the second half of a word of that length has."""
    n = (length - F.floor(length / 2)).cast("int")
    return F.substring(word, F.char_length(word) - n + 1, n)


def _key(backward: bool, word: Column, length: Column) -> Column:
    return F.xxhash64(F.lit(backward), length, _second_half(word, length) if backward else _first_half(word, length))


def _units(words: DataFrame, scratch: Scratch, p: SpellingParams) -> DataFrame:
    """key, cell, cells, backward, query, word and n: what meets in a cell. A query is in every cell of its key, a word in one."""
    word, length = F.col("word"), F.char_length("word")
    either = (False, True)
    keys = lambda lengths: F.array(*(F.struct(F.lit(b).alias("backward"), _key(b, word, n.cast("int")).alias("key")) for b in either for n in lengths))
    offered = words.select("word", "n", F.explode(keys((length - 1, length, length + 1))).alias("k")).select("k.*", "word", "n")
    asked = words.select("word", "n", F.explode(keys((length,))).alias("k")).select("k.*", "word", "n")
    large = scratch.table(offered.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > p.block).select("key", F.ceil(F.col("size") / p.block).cast("int").alias("cells")), "halves")
    cells = F.coalesce("cells", F.lit(1))
    offered = offered.join(large, "key", "left").select("key", F.pmod(F.xxhash64("word"), cells).cast("int").alias("cell"), cells.alias("cells"), "backward", F.lit(False).alias("query"), "word", "n")
    asked = asked.join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), cells.alias("cells"), "backward", F.lit(True).alias("query"), "word", "n")
    return offered.union(asked).repartition("key", "cell").sortWithinPartitions("key", "cell", "query")


class _Side:
    """The words of one direction: their automaton and their counts by word number."""

    def __init__(self, rows: list[tuple[str, int]], backward: bool):
        self.backward = backward
        rows = sorted({(w[::-1] if backward else w, n) for w, n in rows})
        self.words, self.counts = [w for w, _ in rows], [n for _, n in rows]
        self.automaton = Automaton(self.words)

    def near(self, word: str) -> list[tuple[int, str]]:
        """(count, word) of all near words that this direction finds, and only it."""
        first = word[: len(word) // 2]
        if not self.backward:
            return [(self.counts[k], self.words[k]) for k in self.automaton.near(word, len(first))]
        found = ((self.counts[k], self.words[k][::-1]) for k in self.automaton.near(word[::-1], len(word) - len(first)))
        return [x for x in found if not x[1].startswith(first)]


def near_words(words: DataFrame, scratch: Scratch, p: SpellingParams = SpellingParams()) -> DataFrame:
    """For each of the words (word, n) that has near ones: word, n_near, and best, the near word of the largest count, with best_n."""

    def answers(rows: list[dict]) -> pa.RecordBatch:
        sides = {b: _Side([(r["word"], r["n"]) for r in rows if not r["query"] and r["backward"] == b], b) for b in (False, True)}
        out = []
        for r in rows:
            if r["query"] and (near := sides[r["backward"]].near(r["word"])):
                best_n, best = min((-n, w) for n, w in near)
                out.append((r["word"], len(near), -best_n, best))
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cells, many small ones at a time. A cell of a cut half is looked up alone, since a word may be in it for another half's
        sake; if its queries are many they come in parts, and only its words are held."""
        held: list[dict] = []
        place = lambda r: (r["key"], r["cell"])

        def answered(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            alone: dict[tuple, list[dict]] = {}
            for r in rows:
                if r["cells"] > 1:
                    alone.setdefault(place(r), []).append(r)
            for part in (*alone.values(), [r for r in rows if r["cells"] == 1]):
                if part:
                    yield answers(part)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held += batch.slice(at, 4096).to_pylist()
                if len(held) < 2 * p.block:
                    continue
                last = place(held[-1])
                end = next((k for k in range(len(held) - 1, -1, -1) if place(held[k]) != last), -1) + 1
                if end:
                    yield from answered(held[:end])
                    held = held[end:]
                elif held[-1]["query"]:
                    yield from answered(held)
                    held = [r for r in held if not r["query"]]
        yield from answered(held)

    found = _units(words, scratch, p).mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of the words that have a form: each round doubles the steps that a word has gone."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        then = scratch.table(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(documents: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n. A table in the shared folder."""
    with Scratch(documents.sparkSession) as scratch:
        words = scratch.table(word_counts(documents, p), "words")
        near = near_words(words, scratch, p)
        clear = F.col("best_n") >= p.ratio * F.col("n")
        told = scratch.table(
            words.join(near, "word", "left").select(
                "word", F.when(clear, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("best_n")).alias("form_n")
            ), "forms"
        )
        roots = _roots(told.filter(F.col("form").isNotNull()), scratch)
        return scratch.result(told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
