"""Spelling variants, Lempel-Ziv fingerprints and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import crc, lz_fingerprint, resample, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " \n\t ", "word", "two words", "x" * 30_000, "ab" * 9_000, "no-break space é ｆｕｌｌ", "ÀÉÿ× straße", "a b c d e " * 40]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", ".", ",", "1"]) for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def rows():
    texts = AWKWARD + [prose(i % 90, 5 + 9 * (i % 30)) for i in range(130)] + ["Receive receive recieve. colour-color colour " * 9]
    out = [(7 * i - 20, t) for i, t in enumerate(texts)]
    return out + [(None, texts[20]), (None, None), (None, texts[21]), (50, "same id"), (50, texts[30]), (85, texts[15]), (85, texts[15]), (2**60 + 1, prose(1, 40))]


@pytest.fixture(scope="module")
def documents(spark, rows):
    clash = {c: F.lit("clash") for c in ("score", "rank", "n", "word", "range", "guard", "tie", "bucket", "weight")}
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumns(clash).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# CRC algebra


def test_checksums_of_joined_strings():
    rng = np.random.default_rng(3)
    parts = [rng.bytes(int(n)) for n in [0, 1, 2, 3, 255, 256, 70_000, *rng.integers(0, 40, 60)]]
    a = np.array([zlib.crc32(x) for x in parts], np.uint32)
    for shift in (1, 5, 11):
        b = parts[shift:] + parts[:shift]
        got = crc.joined(a, np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
        assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(parts, b)]


# importance resampling


def grams(t, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_equals_a_plain_version(spark, rows, documents, longest):
    p = resample.ResampleParams(buckets=97, longest=longest, percent=40)
    target = [prose(5, 80), None, "x" * 100, prose(6, 50)]
    bucket = lambda g: zlib.crc32(g.encode()) % p.buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, longest)[1]) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(p.buckets)]
    want = []
    for i, x in rows:
        words, g = grams(x, longest)
        weight = sum(gain[bucket(y)] for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(words), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: 40 * len(fit) // 100], 1):
        r[5] = k
    got = resample.resample(documents, spark.createDataFrame([(x,) for x in target], "text string"), p)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_resampling_prefers_texts_like_the_target(spark):
    rng = random.Random(9)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(60))
    docs = spark.createDataFrame([(i, make("abc" if i % 4 else "xyz")) for i in range(2000)], "doc_id long, text string")
    drawn = [r.doc_id for r in resample.resample(docs, spark.createDataFrame([(make("xyz"),) for _ in range(20)], "text string")).filter("rank is not null").collect()]
    assert len(drawn) == 500 and sum(i % 4 == 0 for i in drawn) > 400


def test_resampling_of_nothing(spark, empty, documents):
    assert resample.resample(empty, documents).collect() == []
    rows = resample.resample(documents, empty).collect()
    assert len(rows) == documents.count() and max(r.rank or 0 for r in rows) == sum(r.n_words >= 20 for r in rows) // 4


# spelling variants


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, p):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if p.slip and h % p.slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= p.least_chars
    n = {w: k for w, k in n.items() if k >= p.least_count}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and is_near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= p.ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found_variants(documents, p):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents, p).collect()}


@pytest.mark.parametrize(
    "p", [spelling.SpellingParams(least_count=1, slip=5), spelling.SpellingParams(least_chars=3, least_count=2, ratio=2, slip=3), spelling.SpellingParams(least_chars=2, least_count=1, ratio=2, slip=0, block=7)]
)
def test_variants_equal_brute_force(rows, documents, p):
    want = plain_variants(rows, p)
    assert found_variants(documents, p) == want and len(want) > 100


def test_roots_follow_chains(spark):
    text = "Letters " * 3125 + "letter " * 625 + "leter " * 5 + "lettter " * 125 + "lettterr " * 25 + "letttérr " * 5
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = plain_variants([(1, text)], spelling.SpellingParams(slip=0, least_chars=5))
    got = found_variants(docs, spelling.SpellingParams(slip=0, least_chars=5))
    assert got == want and got["letttérr"] == ("lettterr", "letters", 5, 1, 25)


def test_variants_of_nothing(empty):
    assert spelling.variants(empty).collect() == []


def test_a_half_that_all_words_share_is_cut(spark):
    rng = random.Random(2)
    words = {"beginning" + "".join(rng.choice("abc") for _ in range(9)) for _ in range(700)}
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words))], "doc_id long, text string")
    p = spelling.SpellingParams(least_count=1, slip=0, block=50)
    assert {w: v[3] for w, v in found_variants(docs, p).items()} == {w: sum(v != w and is_near(w, v) for v in words) for w in words}


def test_an_automaton_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("re", "un", "") for b in ("do", "tie", "pack") for c in ("ing", "ed", "s", "")})
    made = spelling.Automaton(words)
    assert [made._walk(0, 0, w) for w in words] == list(range(len(words))) and made._walk(0, 0, "packe") == -1
    reached, todo = {0}, [0]
    while todo:
        for target, _ in made.moves[todo.pop()].values():
            if target not in reached:
                reached.add(target)
                todo.append(target)

    def right(state):  # the endings that a state accepts
        return frozenset(({""} if made.final[state] else set()) | {c + rest for c, (t, _) in made.moves[state].items() for rest in right(t)})

    assert len({right(s) for s in reached}) == len(reached)


# Lempel-Ziv fingerprints


def plain_phrases(t):
    data, seen, start = t.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def plain_print(t, size=128):
    out = set()
    for x in plain_phrases(t):
        h = zlib.crc32(x)
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
        out.add(h ^ h >> 16)
    return sorted(out)[:size]


def plain_likeness(a, b, size=128):
    union = sorted(set(a) | set(b))[:size]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_prints_equal_a_plain_version(spark, rows, documents):
    ties = {(r.doc_id, r.text): r.tie for r in documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = plain_print(t), plain_print(edited), plain_print(after)
        text = lambda f: "".join(f"{x:08x}" for x in f)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), plain_likeness(a, b), plain_likeness(a, c)))
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    for p in (lz_fingerprint.FingerprintParams(), lz_fingerprint.FingerprintParams(ranges=2), lz_fingerprint.FingerprintParams(ranges=1000)):
        got = lz_fingerprint.edited_fingerprints(documents, p)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_prints_of_one_and_of_no_document(spark, empty):
    assert lz_fingerprint.edited_fingerprints(empty).collect() == []
    (row,) = lz_fingerprint.edited_fingerprints(spark.createDataFrame([("k", "abcdefghi" * 20)], "doc_id string, text string")).collect()
    assert row.near_next == 1.0 and 0 < row.near_edited <= 1 and row.n_chars == 180
    (row,) = lz_fingerprint.edited_fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (row.n_chars, row.fingerprint, row.near_edited, row.near_next) == (0, "", 1.0, 1.0)


def test_likeness_estimates_the_share_of_phrases():
    base = prose(1, 4000)
    for share in (0.2, 0.5, 0.9):
        other = base[: int(len(base) * share)] + prose(2, 4000)[: int(len(base) * (1 - share))]
        a, b = plain_phrases(base), plain_phrases(other)
        assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(base), lz_fingerprint.fingerprint(other)) - len(a & b) / len(a | b)) < 0.13
