"""Which documents packing brings side by side, and in what order it fills windows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from schemaloom.llm import packing, text


def plain_keys(t, frequent):
    words = {w: int(text.hash_words(pa.array([w], pa.large_string()))[0]) for w in t.split()}
    rare = {h for h in words.values() if h not in frequent} or set(words.values())
    mixed = {(h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64 for h in words.values() if h not in frequent}
    never = 2**64 - 1
    return min(rare, default=never), min(mixed, default=never)


def test_keys_are_minhashes_of_rarer_words():
    texts = ["the cat sat", "", "the the", "a dog", " x ", "the dog sat on the cat", "the a"]
    frequent = text.hash_words(pa.array(["the", "a"], pa.large_string()))
    first, second = packing.lexical_keys(pa.array(texts, pa.large_string()), frequent)
    assert list(zip(first.tolist(), second.tolist())) == [plain_keys(t, set(frequent.tolist())) for t in texts]
    for some in ([], [""]):
        first, second = packing.lexical_keys(pa.array(some, pa.large_string()), frequent)
        assert len(first) == len(second) == len(some)


def corpus(rng, n):
    common = [f"c{i}" for i in range(60)]
    rare = [f"r{i}" for i in range(20_000)]
    texts = [" ".join([*rng.choice(common, 60), *rng.choice(rare, 40)]) for _ in range(n)]
    for i in range(0, n // 4):  # the last quarter are near copies of the first, a tenth of their words changed
        words = texts[i].split()
        for k in rng.integers(0, len(words), 10):
            words[k] = rng.choice(rare)
        texts[n - 1 - i] = " ".join(words)
    return texts


def test_near_copies_lie_side_by_side_whatever_rows_they_came_from(spark):
    texts = corpus(np.random.default_rng(4), 1200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = packing.side_by_side(docs, packing.PackParams(hot_share=0.0)).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1200))
    place = {r.doc_id: k for k, r in enumerate(sorted(rows, key=lambda r: r.at))}
    near = np.mean([abs(place[i] - place[1199 - i]) <= 12 for i in range(300)])  # a hundredth of the rows
    assert near >= 0.62  # they share 36 of 50 rarer words


def test_a_word_in_all_documents_makes_no_key(spark):
    texts = [f"are {'are ' * (i % 5)}w{i} v{i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequent, size = packing.frequent_words(docs, packing.PackParams())
    assert size == 600 and frequent.tolist() == text.hash_words(pa.array(["are"], pa.large_string())).tolist()
    first, _ = packing.lexical_keys(pa.array(texts, pa.large_string()), frequent)
    assert len(set(first.tolist())) == 600


def plain_fill(scores, lengths, window):
    """Documents in the order in which the method takes them."""
    unused, order, used = set(range(len(lengths))), [], 0

    def place(d):
        nonlocal used
        unused.discard(d)
        order.append(d)
        crossed = used + lengths[d] >= window
        used = (used + lengths[d]) % window
        return crossed

    while unused:
        seed = min(unused)
        place(seed)
        while seed is not None:
            ranked = sorted((x for x in unused if scores[seed][x] > 0), key=lambda x: (-scores[seed][x], x))
            seed = next((x for x in ranked if place(x)), None)
    return order


def test_windows_are_filled_by_score(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], int(n))) for n in rng.integers(1, 60, 40)]
    codes, offsets, words = text.split_words(pa.array(texts, pa.large_string()))
    index = packing.Bm25Block(codes, offsets, len(words), packing.PackParams())
    docs = [t.split() for t in texts]
    df = {w: sum(w in d for d in docs) for w in set(sum(docs, []))}
    mean = np.mean([len(d) for d in docs])

    def bm25(q, d):
        total = 0.0
        for w in set(docs[q]):
            tf = docs[d].count(w)
            if tf and df[w] > 1:
                total += np.log1p((40 - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return total

    want = [[bm25(q, d) for d in range(40)] for q in range(40)]
    got = [index.scores(q) for q in range(40)]
    assert np.allclose(want, got)
    lengths = [len(d) for d in docs]
    packer = packing.Packer(0, 64)
    packing.pack_block(index, np.array(lengths), packer)
    taken = list(dict.fromkeys(p[0] for p in packer.take()))
    assert taken == plain_fill([s.tolist() for s in got], lengths, 64)


def test_a_key_larger_than_a_partition_and_equal_keys_lose_nothing(spark):
    texts = ["same words in all of these documents " * 40] * 300 + [None, "", "one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        rows = packing.pack(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by_doc) == set(range(303))
    for pieces in by_doc.values():
        at = 0
        for start, n, total in sorted(pieces):
            assert start == at
            at += n
        assert at == total
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_words_of_letters_get_the_same_ids_from_the_model_alone():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    direct = packing.letters_by_model(tokenizer)
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz" * 3 + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")
    words = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 30, 3000)] + ["reading", "international", "größe", "ss", "ve", "a" * 3000]
    for w in words:
        assert packing._LETTERS.fullmatch(w)
        assert direct(w) == np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w
    assert not any(packing._LETTERS.fullmatch(w) for w in ("É", "a1", "it's", "a÷b", "×", "", "é", "ſ", "a b"))
    blobs = packing.encoder("").encode([*words, "It's", "x<|y", "é1", ""])
    assert [len(b) % 4 for b in blobs] == [0] * len(blobs) and blobs[: len(words)] == [direct(w) for w in words]


def test_units_are_looked_up_without_python_strings():
    """Known units cost no Python string each, units stay the same when old ones are forgotten, and closing marks of any length are cut off."""
    from schemaloom.llm import token_ids

    asked = []
    plain = packing.encoder("").encode
    units = token_ids.UnitEncoder(lambda names: asked.extend(names) or plain(names), limit=6)
    whole = token_ids.UnitEncoder(plain)
    for t in (["the cat sat on a mat", "", "the dog! é.?"], ["the cat sat"], ["x y z!!!! w, v u"], ["the dog ??? a.b.", " "], [""], ["the cat sat on a mat"]):
        given = packing.halves(*text.split_words(pa.array(t, pa.large_string())))
        (ids, ends), (ids2, ends2) = units.ids(*given), whole.ids(*given)
        assert ids.tolist() == ids2.tolist() and ends.tolist() == ends2.tolist()
        tokens = [np.frombuffer(b"".join(plain([w for w in x.split()])), "<u4").tolist() for x in t]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == tokens
    assert len(units.met) < 20 and len(set(asked)) < len(asked)  # some were forgotten and asked for again
    before = len(asked)
    units.ids(*given)
    assert len(asked) == before


def test_best_scores_come_in_order_of_a_full_sort():
    rng = np.random.default_rng(3)
    for n, high in ((0, 5), (20, 3), (500, 4), (500, 10**6)):
        score = rng.integers(0, high, n).astype(float)
        near = np.flatnonzero(score)
        assert list(packing.by_score(score)) == near[np.argsort(-score[near], kind="stable")].tolist()
