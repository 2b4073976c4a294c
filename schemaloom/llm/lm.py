"""Language-model scores: unigram counts over the whole corpus and a log-bilinear model above them.

Spark counts the words of all training documents; the most frequent ones, up to ``vocabulary``, are the model's. Sorted by
count they fall in classes of ``class_size`` words, and a token's probability is that of its class times that of the word
in its class, so each normaliser is exact and a product with some hundred rows. The log-bilinear model (context embeddings, a
matrix for each of two positions, target embeddings and biases) is trained in numpy with noise-contrastive estimation, for
classes and words alike: in each round every task walks over a share of all training tokens, and Spark averages
the parameters by the tokens seen, in two levels. The other words are dealt to ``tails`` groups by how they end; each group is a word of the model, learnt
in context like any other, and its words share its probability by their smoothed counts, with one word that was never met. So every
word of the corpus has a probability that depends on its context.

Frequent words (a share of ``frequent`` of all tokens at least, so at most 1/``frequent`` words, each of at most
``word_bytes`` bytes) are broadcast; the counts of the others come by a join on the word.

Edge cases: null and empty texts are the closing token alone; a null doc_id counts as the empty string for
the fold; equal texts and repeated rows get equal scores; no training documents give the scores of
an empty table of counts; a word of any length is counted; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import crc
from schemaloom.llm.shared import Scratch
from schemaloom.llm.text import slices, split_words, texts_of

END = "\n"  # no word holds white space
END_ID = 0


@dataclass(frozen=True)
class LmParams:
    """``vocabulary``: words with vectors of their own at most, the closing token among them, each met ``min_count`` times; ``tails``: groups of all others.
    ``rounds`` share all training tokens among them; a task of a round takes about ``shard_tokens`` or, if tasks are fewer, its share, and goes over
    them more than once if they are fewer than ``least_steps`` batches."""

    vocabulary: int = 12_544
    tails: int = 448
    class_size: int = 112
    min_count: int = 5
    size: int = 32
    class_noise: int = 48
    word_noise: int = 16
    rounds: int = 3
    batch: int = 16_384
    rate: float = 0.35
    least_steps: int = 40
    shard_tokens: int = 2_000_000
    frequent: float = 1e-6
    word_bytes: int = 64


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the closing token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        held: list[tuple[pa.Array, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            table = pa.table({"word": pa.concat_arrays([w for w, _ in held]), "n": np.concatenate([n for _, n in held])})
            table = table.group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return counted(table["word"].combine_chunks(), table["n_sum"].to_numpy())

        for batch in slices(batches, "text", 4 << 20):
            codes, _, words = split_words(pc.ascii_lower(texts_of(batch, "text")))
            held.append((pa.concat_arrays([words, pa.array([END], words.type)]), np.append(np.bincount(codes, minlength=len(words)), batch.num_rows)))
            size += len(words)
            if size > 400_000:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def tail_groups(words: pa.Array, tails: int) -> np.ndarray:
    """A group for each word by its last two characters."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    return crc.of_strings(ends.dictionary)[0].astype(np.int64)[np.asarray(ends.indices, np.int64)] % tails if len(words) else np.empty(0, np.int64)


def class_ids(texts: pa.Array, vocabulary: pa.Array, tails: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(numbers of all tokens with the closing ones, offsets by text; word codes, their offsets, words). A word's number follows from its place in the
    vocabulary, that of a word outside from its group."""
    codes, offsets, words = split_words(pc.ascii_lower(texts))
    at = pc.fill_null(pc.index_in(words, value_set=vocabulary.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    of_word = np.where(at < 0, len(vocabulary) + 1 + tail_groups(words, tails), at + 1)
    ends = offsets[1:] + np.arange(1, len(offsets))  # where each closing token goes, plus one
    ids = np.full(len(codes) + len(texts), END_ID, np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = of_word[codes]
    return ids, np.concatenate([[0], ends]), codes, offsets, words


def contexts(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens back; before a text stands its closing token."""
    one, two = np.full(len(ids), END_ID), np.full(len(ids), END_ID)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    starts = offsets[:-1]
    one[starts] = two[starts] = END_ID
    second = starts + 1
    second = second[second < offsets[1:]]
    two[second] = END_ID
    return one, two


Weights = dict[str, np.ndarray]
_ROWS = 1024  # whose scores over all classes stay in a core's cache


def start(unigram: np.ndarray, p: LmParams) -> Weights:
    """Weights before training: a word's bias is its share of its class, a class's bias its own share."""
    rng = np.random.default_rng(7)
    v, d = len(unigram), p.size
    group = np.arange(v) // p.class_size
    share = np.bincount(group, unigram)
    draw = lambda scale, *s: rng.normal(0, scale, s).astype(np.float32)
    eye = np.eye(d, dtype=np.float32)
    return {
        "context": draw(0.3, v, d), "first": eye.copy(), "second": 0.5 * eye, "target": draw(0.05, v, d), "class": draw(0.05, len(share), d),
        "bias": np.log(np.maximum(unigram / share[group], 1e-9)).astype(np.float32), "class_bias": np.log(np.maximum(share, 1e-9)).astype(np.float32),
    }


def _sorted(ids: np.ndarray, n: int) -> np.ndarray:
    """The order of numbers below n; numbers of two bytes are sorted by radix."""
    return np.argsort(ids.astype(np.min_scalar_type(n)), kind="stable")


def _row_sums(at: np.ndarray, rows: np.ndarray, n: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of indexes below n and, for each, the sum of its rows; they are sorted in ``room``."""
    order = _sorted(at, n)
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    room = room[: len(at)]
    np.take(rows, order, axis=0, out=room, mode="clip")  # by the other modes a copy more
    return at[first], np.add.reduceat(room, first, axis=0)


def _beside(table: np.ndarray, column: np.ndarray | float) -> np.ndarray:
    """A table with one more column."""
    out = np.empty((len(table), table.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = table, column
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad over batches of tokens: the word is told from ``word_noise`` draws of its class's
    unigram, its class from ``class_noise`` draws of all classes. What the draws add is taken in expectation, over all words of
    the class and all classes, so no draw is made and none disturbs the gradient."""

    def __init__(self, weights: Weights, unigram: np.ndarray, p: LmParams, seed: int):
        self.w = {k: x.copy() for k, x in weights.items()}
        self.grown = {k: np.ones_like(x) for k, x in self.w.items()}
        self.p, self.rng = p, np.random.default_rng(seed)
        group = np.arange(len(unigram)) // p.class_size
        share = np.bincount(group, unigram)
        self.class_noise = (p.class_noise * np.maximum(share, 1e-12)).astype(np.float32)
        self.word_noise = (p.word_noise * np.maximum(unigram / share[group], 1e-12)).astype(np.float32)
        self.log_class_noise, self.log_word_noise = np.log(self.class_noise), np.log(self.word_noise)
        # memory of a batch, used again by the next one, since fresh pages cost about as much as what is written to them
        zeros = lambda *shape: np.zeros(shape, np.float32)
        self._class_scores, self._word_scores, self._hidden = zeros(_ROWS, len(share)), zeros(_ROWS, p.class_size), np.ones((_ROWS, p.size + 1), np.float32)
        self._mixed = {k: zeros(len(unigram), p.size) for k in ("first", "second")}
        self._g_hidden, self._room, self._of_words = zeros(p.batch, p.size), zeros(p.batch, p.size), zeros(len(unigram), p.size + 1)

    def _move(self, name: str, g: np.ndarray, rate: float) -> None:
        w, grown, g = self.w[name].reshape(-1), self.grown[name].reshape(-1), g.reshape(-1)
        for a in range(0, len(g), 32 * _ROWS):  # pieces that stay in a core's cache
            at = slice(a, a + 32 * _ROWS)
            x = g[at] * g[at]
            grown[at] += x
            np.sqrt(grown[at], out=x)
            np.divide(g[at], x, out=x)
            x *= np.float32(rate)
            w[at] -= x

    @staticmethod
    def _told_apart(s: np.ndarray, own: np.ndarray, noise: np.ndarray) -> None:
        """From the logarithm of noise to score, in place: the chance to be taken for data, less what the true one lacks of it. Times the noise it is the
        gradient by the score; ``noise`` is that of the true ones."""
        np.exp(s, out=s)  # may be infinite, which is a chance of 0
        s += 1
        np.reciprocal(s, out=s)
        s, at = s.reshape(-1), np.arange(len(own)) * s.shape[1] + own
        true = s[at]
        s[at] = true + (true - 1) / noise

    def step(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, rate: float) -> None:
        """One batch; its tokens are sorted by id, so those of a class lie together. Biases are a further column of the tables and of the gradients by
        them, the noise a factor of whole tables, so a block of scores is passed over for the chances alone."""
        w, p, v, d = self.w, self.p, len(self.word_noise), self.p.size
        group = ids // p.class_size
        place = ids - group * p.class_size
        for name, mixed in self._mixed.items():
            np.matmul(w["context"], w[name], out=mixed)
        classes, words = _beside(-w["class"], self.log_class_noise - w["class_bias"]), _beside(-w["target"], self.log_word_noise - w["bias"])
        noisy_classes, noisy_words = self.class_noise[:, None] * w["class"], self.word_noise[:, None] * w["target"]
        of_classes, of_words, g_hidden = np.zeros_like(classes), self._of_words, self._g_hidden[: len(ids)]
        of_words.fill(0)
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        with np.errstate(over="ignore"):
            for a in range(0, len(ids), _ROWS):
                b = min(a + _ROWS, len(ids))
                h, g, s = self._hidden[: b - a], g_hidden[a:b], self._class_scores[: b - a]
                np.add(self._mixed["first"].take(one[a:b], axis=0), self._mixed["second"].take(two[a:b], axis=0), out=h[:, :d])
                np.matmul(h, classes.T, out=s)
                self._told_apart(s, group[a:b], self.class_noise[group[a:b]])
                np.matmul(s, noisy_classes, out=g)
                of_classes += s.T @ h
                s = self._word_scores[: b - a]
                starts = [a, *edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b)].tolist()]
                parts = [(slice(i - a, j - a), slice(c * p.class_size, min((c + 1) * p.class_size, v))) for c, i, j in zip(group[starts].tolist(), starts, [*starts[1:], b])]
                for at, own in parts:
                    np.matmul(h[at], words[own].T, out=s[at, : own.stop - own.start])
                self._told_apart(s, place[a:b], self.word_noise[ids[a:b]])
                for at, own in parts:
                    chances = s[at, : own.stop - own.start]
                    g[at] += chances @ noisy_words[own]
                    of_words[own] += chances.T @ h[at]
        of_classes *= self.class_noise[:, None]
        of_words *= self.word_noise[:, None]
        of_context, of_mix = self._mixed["first"], []  # which is used no more
        of_context.fill(0)
        for name, back in (("first", one), ("second", two)):
            at, sums = _row_sums(back, g_hidden, v, self._room)
            of_context[at] += sums @ w[name].T
            of_mix.append(w["context"][at].T @ sums)
        for name, g, pace in (
            ("class", of_classes[:, :d], 1), ("class_bias", of_classes[:, d], 1), ("target", of_words[:, :d], 1), ("bias", of_words[:, d], 1),
            ("first", of_mix[0], 0.2), ("second", of_mix[1], 0.2), ("context", of_context, 1),
        ):
            self._move(name, g, rate * pace)

    def walk(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, rate: float) -> None:
        """All tokens once, in a random order."""
        order = self.rng.permutation(len(ids))
        for i in range(0, len(ids), self.p.batch):
            at = order[i : i + self.p.batch]
            at = at[_sorted(ids[at], len(self.word_noise))]
            self.step(ids[at], one[at], two[at], rate)


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in weights.values()])


def shaped(vector: np.ndarray, like: Weights) -> Weights:
    edges = np.cumsum([0, *(x.size for x in like.values())])
    return {k: vector[a:b].reshape(x.shape).astype(np.float32) for (k, x), a, b in zip(like.items(), edges, edges[1:])}


_PARTS = 32


def train(texts: DataFrame, vocabulary: pa.Array, unigram: np.ndarray, n_tokens: int, p: LmParams) -> Weights:
    """Rounds of side-by-side walks over shares of all texts; after each round the parameters are averaged by tokens."""
    weights = start(unigram, p)
    if not n_tokens:
        return weights
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast(vocabulary.to_pylist())
    shards = min(math.ceil(n_tokens / p.rounds / p.shard_tokens), spark.sparkContext.defaultParallelism)
    share = max(p.shard_tokens, n_tokens / p.rounds / shards)
    teams = math.ceil(math.sqrt(shards))
    for r in range(p.rounds):
        shared = spark.sparkContext.broadcast(weights)

        def fit(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            known = pa.array(words.value, pa.string())
            trainer = Trainer(shared.value, unigram, p, seed=1 + r * 1_000_003 + TaskContext.get().partitionId())
            seen, held = 0, []
            for batch in slices(batches, "text"):
                ids, offsets, *_ = class_ids(texts_of(batch, "text"), known, p.tails)
                one, two = contexts(ids, offsets)
                seen += len(ids)
                rate = p.rate * (1 - 0.7 * (r + min(1.0, seen / share)) / p.rounds)
                if held is not None:
                    held.append((ids, one, two))
                    if seen >= p.least_steps * p.batch:
                        held = None
                trainer.walk(ids, one, two, rate)
            if not seen:
                return
            for again in range(math.ceil(p.least_steps * p.batch / seen) - 1 if held else 0):
                for part in held:
                    trainer.walk(*part, p.rate * (1 - 0.7 * (r + (1 + again) * seen / (p.least_steps * p.batch)) / p.rounds))
            parts = np.array_split(flat(trainer.w).astype("<f4"), _PARTS)
            team = pa.array([TaskContext.get().partitionId() % teams] * _PARTS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), team, pa.array([float(seen)] * _PARTS), pa.array([x.tobytes() for x in parts], pa.binary())], names)

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], list] = {}
            for batch in batches:
                for part, team, tokens, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    sums = total.setdefault((part, team), [0.0, 0.0])
                    sums[0] += tokens
                    sums[1] = sums[1] + tokens * np.frombuffer(raw, "<f4").astype(np.float64)
            for (part, team), (tokens, sums) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([team], pa.int32()), pa.array([tokens]), pa.array([(sums / tokens).astype("<f4").tobytes()], pa.binary())], names)

        own = texts.filter(F.pmod(F.xxhash64("text"), F.lit(p.rounds)) == r).select("text").coalesce(shards)
        names, schema = ["part", "team", "tokens", "weights"], "part int, team int, tokens double, weights binary"
        found = own.mapInArrow(fit, schema)
        if teams > 1:  # each team's average first, so no task gets the weights of all shards
            found = found.repartition(teams * _PARTS, "part", "team").mapInArrow(average, schema)
        found = found.withColumn("team", F.lit(0)).repartition(_PARTS, "part").mapInArrow(average, schema).collect()  # one set of weights, whatever the input
        if found:
            weights = shaped(np.concatenate([np.frombuffer(x["weights"], "<f4") for x in sorted(found, key=lambda x: x["part"])]), weights)
    return weights


_WIDE = 40.0
_HELD = 8


class Scorer:
    """Log probabilities of a model whose weights no longer change. A score is a sum of what either context word gives, so its exponential is a
    product: that of each of them to all classes is computed once, and likewise to the words of up to ``_HELD`` classes that a slice meets more often than the model has
    words. Rows of scores further apart than ``_WIDE``, whose products might leave the range, and other classes are computed by token."""

    def __init__(self, weights: Weights, p: LmParams):
        self.w, self.p = weights, p
        self.first, self.second = weights["context"] @ weights["first"], weights["context"] @ weights["second"]
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        self.classes = self._products(weights["class"], weights["class_bias"])

    def _products(self, table: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
        """(exponentials by the first context word, by the second one with the biases, which rows of either are too wide)."""
        found = []
        for side, more in ((self.first, np.zeros_like(bias)), (self.second, bias)):
            s = side @ table.T
            s += more
            s -= s.max(axis=1, keepdims=True)
            found.append((np.exp(s), s.min(axis=1) < -_WIDE))
        return found[0][0], found[1][0], found[0][1], found[1][1]

    @staticmethod
    def _by_products(products: tuple[np.ndarray, ...], one: np.ndarray, two: np.ndarray, own: np.ndarray) -> np.ndarray:
        s = products[0].take(one, axis=0)
        s *= products[1].take(two, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):  # those of wide rows are computed again
            return np.log(s[np.arange(len(own)), own] / (s @ np.ones(s.shape[1], np.float32)), dtype=np.float64)

    def _by_token(self, table: np.ndarray, bias: np.ndarray, one: np.ndarray, two: np.ndarray, own: np.ndarray) -> np.ndarray:
        s = (self.first.take(one, axis=0) + self.second.take(two, axis=0)) @ table.T
        s += bias
        s -= s.max(axis=1, keepdims=True)  # so that no exponential leaves the range and none is lost by another row's scores
        said = s[np.arange(len(own)), own]
        np.exp(s, out=s)
        return said - np.log(s @ np.ones(s.shape[1], np.float32), dtype=np.float64)

    def _normalised(self, table: np.ndarray, bias: np.ndarray, products: tuple[np.ndarray, ...] | None, one: np.ndarray, two: np.ndarray, own: np.ndarray) -> np.ndarray:
        if products is None:
            return self._by_token(table, bias, one, two, own)
        found = self._by_products(products, one, two, own)
        wide = np.flatnonzero(products[2][one] | products[3][two])
        if len(wide):
            found[wide] = self._by_token(table, bias, one[wide], two[wide], own[wide])
        return found

    def log_probabilities(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, most: int = _ROWS) -> np.ndarray:
        w, p = self.w, self.p
        group = ids // p.class_size
        order = _sorted(group, len(w["class"]))  # so that the tokens of a class lie together
        ids, one, two, group = ids[order], one[order], two[order], group[order]
        found = np.empty(len(ids))
        for i in range(0, len(ids), most):
            at = slice(i, i + most)
            found[at] = self._normalised(w["class"], w["class_bias"], self.classes, one[at], two[at], group[at])
        edges = np.searchsorted(group, np.arange(len(w["class"]) + 1))
        for g, (low, high) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            words = slice(g * p.class_size, (g + 1) * p.class_size)
            table, bias = w["target"][words], w["bias"][words]
            if high - low > len(w["bias"]) and g not in self.held and len(self.held) < _HELD:
                self.held[g] = self._products(table, bias)
            for i in range(low, high, most):
                at = slice(i, min(i + most, high))
                found[at] += self._normalised(table, bias, self.held.get(g), one[at], two[at], ids[at] - g * p.class_size)
        out = np.empty(len(ids))
        out[order] = found
        return out


def log_probabilities(weights: Weights, ids: np.ndarray, one: np.ndarray, two: np.ndarray, p: LmParams, most: int = _ROWS) -> np.ndarray:
    """Natural log probability of each token in its context, normalised over all classes and the words of its class."""
    return Scorer(weights, p).log_probabilities(ids, one, two, most)


def score(documents: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """One row per document: fold, token counts, unigram score and model score, in log10. A table in the shared folder."""
    with Scratch(documents.sparkSession) as scratch:
        return scratch.result(_scored(documents, params, scratch), "scores")


def _scored(documents: DataFrame, p: LmParams, scratch: Scratch) -> DataFrame:
    spark = documents.sparkSession
    learned = documents.filter(fold(F.col("doc_id")) != 1)
    counts = scratch.table(count_words(learned), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = total["n"], total["v"]
    all_mass = n_tokens + 0.5 * (n_words + 1)
    small = F.octet_length("word") <= p.word_bytes
    top = counts.filter(small & (F.col("word") != END) & (F.col("c") >= p.min_count)).orderBy(F.desc("c"), "word").limit(p.vocabulary - 1)
    top = scratch.table(top, "vocabulary")
    rest = counts.filter(F.col("word") != END).join(top.select("word"), "word", "left_anti")
    group = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(p.tails))
    sums = {x["g"]: x["m"] for x in rest.groupBy(group.alias("g")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()}  # ``tails`` rows at most
    top = top.orderBy(F.desc("c"), "word").collect()
    vocabulary = pa.array([x["word"] for x in top], pa.string())
    ends = counts.filter(F.col("word") == END).first()
    tail_mass = np.array([sums.get(g, 0.0) + 0.5 for g in range(p.tails)])  # and a word that was never met
    mass = np.array([ends["c"] + 0.5 if ends else 0.5, *(x["c"] + 0.5 for x in top), *tail_mass])
    weights = train(learned, vocabulary, mass / mass.sum(), n_tokens, p)
    frequent = counts.filter(small & (F.col("c") >= math.ceil(max(1, n_tokens * p.frequent)))).select("word", "c").toArrow()
    known = dict(zip(frequent["word"].to_pylist(), frequent["c"].to_pylist())) | {x["word"]: x["c"] for x in top}  # the model's words are never joined
    shared = spark.sparkContext.broadcast((vocabulary.to_pylist(), pa.array(known, pa.string()), np.array([*known.values()], np.int64), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_model, known, c, weights = shared.value
        words_of_model = pa.array(words_of_model, pa.string())
        log_c = np.append(np.log10(c + 0.5), 0.0)  # the last for words that are not frequent
        log_end, log_tails = math.log10(mass[END_ID]), np.log10(tail_mass)
        scorer = Scorer(weights, p)
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            ids, offsets, codes, word_offsets, words = class_ids(texts, words_of_model, p.tails)
            one, two = contexts(ids, offsets)
            logp = scorer.log_probabilities(ids, one, two)
            at = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), len(c)).to_numpy(zero_copy_only=False)
            inner = np.ones(len(ids), bool)
            inner[offsets[1:] - 1] = False
            word_at = at[codes]
            frequent_part = log_c[word_at]
            tail = ids[inner] - len(words_of_model) - 1
            in_group = np.where(tail >= 0, frequent_part - log_tails[np.maximum(tail, 0)], 0.0)
            rare = word_at == len(c)

            def by_text(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
                s = np.concatenate([[0], np.cumsum(x)])
                return s[ends[1:]] - s[ends[:-1]]

            own = np.repeat(np.arange(len(texts)), np.diff(word_offsets))[rare]
            pair, n = np.unique(own * np.int64(max(1, len(words))) + codes[rare], return_counts=True)
            rare_words = words.take(pa.array(pair % max(1, len(words)))).cast(pa.string())
            lists = np.searchsorted(pair // max(1, len(words)), np.arange(len(texts) + 1)).astype(np.int32)
            key = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(np.diff(offsets)), pa.array(by_text(rare, word_offsets).astype(np.int64)),
                    pa.array(by_text(frequent_part, word_offsets) + log_end), pa.array(by_text(logp, offsets) / math.log(10)),
                    pa.array(by_text(in_group, word_offsets)),
                    pa.ListArray.from_arrays(pa.array(lists), rare_words), pa.ListArray.from_arrays(pa.array(lists), pa.array(n.astype(np.int64))),
                ],
                ["doc_id", "key", "n_tokens", "n_rare", "base_part", "class_part", "tail_part", "words", "times"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = scratch.table(
        documents.select("doc_id", "text").mapInArrow(
            run, f"doc_id {kind}, key binary, n_tokens long, n_rare long, base_part double, class_part double, tail_part double, words array<string>, times array<long>"
        ), "scored"
    )
    rare = parts.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").select("key", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"))
    sums = found.groupBy("key").agg(F.sum("s").alias("s"), F.sum("known").alias("known"))
    copies = parts.groupBy("key").agg(F.count("*").alias("copies"))  # equal texts have given their words more than once
    per_text = scratch.table(copies.join(sums, "key", "left").select("key", (F.coalesce("s", F.lit(0.0)) / F.col("copies")).alias("s"), F.floor(F.coalesce("known", F.lit(0)) / F.col("copies")).alias("known")), "sums")
    docs = parts.drop("words", "times").join(per_text, "key")
    return docs.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") - F.lit(0 if ends else 1) + F.col("known")).cast("long").alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.col("s") - F.col("n_tokens") * F.lit(math.log10(all_mass))).alias("base_score"),
        (F.col("class_part") + F.col("tail_part") + F.col("s")).alias("score"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
