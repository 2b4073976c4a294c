"""Each operator against brute force, on small tables that hold the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaloom.llm import html_text, jaccard_join, lattice, lm, packing, pii, quality_rules, sp_codec, text, toxicity, url_rules

WORDS = [f"{a}{b}{c}" for a in ("re", "th", "on", "la") for b in ("ing", "er", "ou", "est") for c in ("a", "nd", "s", "t.", "ly,")]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)).capitalize()


AWKWARD = [None, "", " \n\t ", "word", "two words", "x" * 50_000, "no-break\u00a0space é ｆｕｌｌ", "a b c d e a b c d e " * 40]


@pytest.fixture(scope="module")
def rows():
    base = [prose(i, 30 + 7 * (i % 40)) for i in range(120)]
    near = [t.replace(t.split()[10], "changed", 1) for t in base[:15]]
    texts = AWKWARD + base + near + base[:10] + [base[0]] * 20 + [prose(500, 9_000)]
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + [(None, base[1], "en", "s", 1), (5, AWKWARD[5], "en", "s", 1), (5, "another text with this id", "en", "s", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("kept", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_of_slices_equal_a_regular_expression(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], ["text"])
    at = 0
    for part in text.slices([batch], "text", 4096):
        codes, offsets, words = text.split_words(text.texts_of(part, "text"))
        names = words.to_pylist()
        for i in range(part.num_rows):
            assert [names[c] for c in codes[offsets[i] : offsets[i + 1]]] == words_of(rows[at + i][1])
        at += part.num_rows
    assert at == len(rows)


# URL filters


def test_urls_listed_rules_and_mined_rules(spark):
    urls = [None, "no scheme", "http://", "HTTPS://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://x.example.net/de/8", "http://net/de/1", "http://y.org/es/?a=1", "http://xcom/en/", "a://b://c/d"]
    mined = [f"http://h{i % 9}.good.example/news/{i}" for i in range(60)] + [f"http://h{i % 9}.good.example/casino/win/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls + mined)] + [(3, urls[3], None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int("casino" not in u), 0) for i, u in enumerate(urls + mined) if u], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host, r.path): r for r in url_rules.judge(pages, labels).collect()}
    assert len(got) == len(urls + mined)

    def want(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = max((r for r in url_rules.UrlParams().listed if (host == (h := r[1].split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[1][len(h) :])), key=lambda r: len(r[1]), default=None)
        return host, path, best

    for i, u in enumerate(urls + mined):
        host, path, best = want(u)
        r = got[i, host, path]
        assert r.rule == (best and best[1])
        assert r.verdict == (best[0] if best else "block" if u and "casino" in u else "allow"), u


def planted_pages():
    """Urls in which two or three tokens together are bad and each alone is not, tokens that always go together, and one that all have."""
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(900):
        path = [x + "xyz"[rng.integers(3)] for x in ("alpha", "beta", "gamma")]
        keys = ["utm"] + (["win", "prize"] if rng.random() < 0.4 else []) + ([f"k{j}" for j in range(14)] if rng.random() < 0.2 else [])
        bad = "alphax" in path and "betaz" in path and rng.random() < 0.95 or "win" in keys and "gammay" in path and rng.random() < 0.9
        rows.append((i, f"http://h{rng.integers(5)}.site.example/{'/'.join(path)}?{'&'.join(f'{k}=1' for k in keys)}", ""))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_mined_rules_equal_enumeration(spark):
    rows, labels = planted_pages()
    p = url_rules.UrlParams()
    mined = url_rules.mine(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), p).collect()
    items = {r.page_id: set(r.t) for r in spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, q, _ in labels if not q}
    least = max(p.min_count, math.ceil(p.min_support * len(rows)))
    where = collections.defaultdict(set)
    for i, ts in items.items():
        for t in ts:
            where[t].add(i)
    where = {t: w for t, w in where.items() if least <= len(w) < len(rows)}
    closed = collections.defaultdict(list)
    for t, w in where.items():
        closed[frozenset(w)].append(t)
    want = {}

    def grow(at, tokens, held):
        if len(held & bad) < least:
            return
        sure = len(held & bad) / len(held)
        if tokens and sure >= p.min_confidence and sure / (len(bad) / len(rows)) >= p.min_lift:
            want[tuple(sorted(tokens))] = sure
        for k in range(at, len(groups)):
            grow(k + 1, tokens + groups[k][1], held & groups[k][0])

    groups = [(set(w), ts) for w, ts in closed.items()]
    grow(0, [], set(items))
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in mined} == {k: round(v, 9) for k, v in want.items()}
    assert len(mined) == len(want) > 10 and max(map(len, want)) >= 4
    assert all(len(where[r.token]) == min(len(where[t]) for t in r.antecedent) for r in mined)


def test_no_labels_no_mined_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in url_rules.judge(pages, labels).collect()] == ["allow"]
    assert url_rules.judge(pages.limit(0), labels).count() == 0


# Toxicity


def test_toxicity_finds_held_out_documents(spark):
    data = [(i, prose(i, 60) + (" utter scumbag, really" if i % 4 == 0 else ""), i) for i in range(600)] + [(900, None, 0), (901, "", 0), (None, "x", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.fold(F.col("doc_id")) == 0).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 600]
    assert held and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).filter("score > 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_weights_equal_plain_ftrl():
    p = toxicity.FtrlParams(epochs=2, l1=0.4, min_documents=2)
    texts = [prose(i, 12) + (" vile scum" if i % 3 == 0 else "") for i in range(60)]
    labels = np.array([float(i % 3 == 0) for i in range(60)])
    seen = [set(x.tolist()) for x in toxicity._seen(texts)]
    n_with = collections.Counter(f for s in seen for f in s)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= p.l1 else (math.copysign(p.l1, z[f]) - z[f]) / ((p.beta + math.sqrt(n[f])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for s, y in zip(seen, labels):
            used = sorted(f for f in s if n_with[f] >= p.min_documents) + ["bias"]
            w = {f: weight(f) for f in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in used:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha * w[f]
                n[f] += g * g
    want = {f: weight(f) for f in z if weight(f)}
    index, w = toxicity._fit_shard(texts, labels, p)
    got = {("bias" if f == int(toxicity._BIAS) else f): v for f, v in zip(index.tolist(), w.tolist())}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_toxicity_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(i, prose(i, 40) + (" vile scum" if i % 2 else "")) for i in range(200)] + [(300, "word " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(300, 1, 1)], "doc_id long, quality int, toxic int")
    index, _ = toxicity.train(docs.limit(0), labels)
    assert not len(index)
    few = toxicity.train(docs, labels, toxicity.FtrlParams(sample_bytes=4_000))
    assert toxicity.score(docs, few).count() == 201 and len(few[0]) < len(toxicity.train(docs, labels)[0])


def test_toxicity_fold_is_crc32(spark):
    got = spark.range(20).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# Packing


def check_packing(pieces, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] += len(ids)
    assert collections.Counter({k: v for k, v in want.items()}) == collections.Counter({k: sum(p.length for p in pieces if p.doc_id == k) for k in want})
    if len({i for i, _ in docs}) == len(docs):
        by_id = dict(docs)
        for p in pieces:
            ids = np.array([*tokenizer.encode(by_id[p.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for w in windows.values():
        w.sort(key=lambda p: p.offset)
        assert [p.offset for p in w] == [sum(q.length for q in w[:i]) for i in range(len(w))]
        total = sum(p.length for p in w)
        assert total <= 2048 and total & (total - 1) == 0


def test_packing_holds_every_token_once(documents, rows, empty):
    check_packing(packing.pack(documents).collect(), [r[:2] for r in rows])
    once = {r[0]: r[1] for r in rows}
    check_packing(packing.pack(documents.dropDuplicates(["doc_id"]).filter("doc_id <> 5")).collect(), [(k, v) for k, v in once.items() if k not in (None, 5)])
    assert packing.pack(empty).count() == 0


def test_units_give_the_ids_of_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's, \"so\". Don't!! ###x### a).b É., İ. ſ, ß; <|endoftext|>, 1.5, 99% '… «x». don't's' ﬁ. é́. x\u3000y z\u00a0.", "日本語。テキスト, 한국어. a<|b|>c"]
    codes, offsets, words = text.split_words(pa.array(odd, pa.large_string()))
    ids, ends = packing.encoder("").ids(*packing.halves(codes, offsets, words))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_bm25_prefers_the_lexical_neighbour():
    docs = ["apple pear plum fig", "iron zinc lead tin", "apple pear plum date", "iron zinc lead gold"]
    codes, offsets, words = text.split_words(pa.array(docs, pa.large_string()))
    index = packing.Bm25Block(codes, offsets, len(words), packing.PackParams())
    s = index.scores(0)
    s[0] = 0
    assert s.argmax() == 2 and s[1] == s[3] == 0


# Near duplicates


def shingles(t, width=5):
    w = words_of(t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_links(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    links = [[j for j in range(len(sets)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(sets))]
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            changed |= low != root[i]
            root[i] = low
    return [len(x) for x in links], root


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_equal_brute_force(documents, rows, block):
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(documents, jaccard_join.ForestParams(block=block)).collect())
    counts, root = brute_links(rows)
    lowest = {}
    for r, x in zip(rows, root):
        if r[0] is not None:
            lowest[x] = min(r[0], lowest.get(x, r[0]))
    want = collections.Counter((r[0], lowest.get(x) if shingles(r[1]) else r[0], n) for r, x, n in zip(rows, root, counts))
    assert got == want


def test_one_of_each_group_stays(documents, rows, empty):
    got = jaccard_join.keep_one(documents).select("doc_id", "text").collect()
    _, root = brute_links(rows)
    groups = len({x for r, x in zip(rows, root) if shingles(r[1])})
    assert sum(bool(words_of(r.text)) for r in got) == groups
    assert sum(not words_of(r.text) for r in got) == sum(not words_of(r[1]) for r in rows)
    assert jaccard_join.join(empty).count() == jaccard_join.keep_one(empty).count() == 0


def test_prefixes_are_shortened_until_the_recall():
    p = jaccard_join.ForestParams()
    recall = lambda d: 1 - (1 - p.threshold**d) ** p.trees
    assert recall(p.floor) >= p.recall > recall(p.floor + 1)
    assert p.depths[0] == p.label and p.depths[-1] == p.floor and p.depths == sorted({*p.depths}, reverse=True)
    a, b = p.depths[:2]
    assert p.recall_after(b, a, 0, 10**6) > p.recall > p.recall_after(b, a, 10**5, 10**6)  # nothing new: near enough; much new: on
    for s in np.arange(p.threshold, 1, 0.01):  # what a similarity leaves behind for each new link is most at the threshold
        left, was = p.missed(b, s), p.missed(a, s)
        assert left / (was - left) <= p.missed(b, p.threshold) / (p.missed(a, p.threshold) - p.missed(b, p.threshold)) + 1e-12


def test_isolated_pairs_at_the_threshold_share_a_prefix():
    p, n = jaccard_join.ForestParams(), 10_000
    x = np.random.default_rng(4).integers(0, 1 << 63, (n, 100), dtype=np.uint64)  # 90 shingles each, 80 of them in both
    offsets = np.arange(n + 1) * 90
    a, b = (jaccard_join.labels(np.ascontiguousarray(s).ravel(), offsets, p) for s in (x[:, :90], np.hstack([x[:, :80], x[:, 90:]])))
    for depth in p.depths:
        shift = np.uint64(p.shift(depth))
        missed = float((~((a >> shift) == (b >> shift)).any(axis=1)).mean())
        assert missed <= 1.3 * p.missed(depth, 80 / 100) + 5e-4, (depth, missed)


def chain(n, step=60, length=240, seed=9):
    """Sets of which each shares length - step shingles with the next one: a similarity of 0.6 at these values."""
    x = np.random.default_rng(seed).integers(0, 1 << 63, n * step + length, dtype=np.uint64)
    return [np.sort(x[i * step : i * step + length]) for i in range(n)]


def test_what_is_compared_in_a_chain_grows_with_its_length():
    p = jaccard_join.ForestParams()

    def compared(n):
        sets = chain(n)
        label = jaccard_join.labels(np.concatenate(sets), np.arange(n + 1) * 240, p).astype(np.int64)
        x, y, whole = jaccard_join.candidates(label, np.zeros(n, int), False, p.shift(p.floor), None)
        links, *_ = jaccard_join.verify_unit(np.arange(n), np.ones(n), sets, x, y, p.threshold)
        assert not links.any() and not whole
        return len(x)

    few, many = compared(100), compared(400)
    assert 50 < few and many < 4.6 * few < 4.6 * 300


def test_chained_texts_that_are_no_duplicates_are_all_kept(spark):
    words = prose(77, 60 * 121).split()
    words = [f"{w}{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(words[60 * i : 60 * i + 244])) for i in range(118)], "doc_id long, text string")
    got = jaccard_join.join(docs, jaccard_join.ForestParams(block=8)).collect()
    assert len(got) == 118 and all(r.kept and not r.n_links for r in got)


def test_links_first_met_at_a_shorter_prefix_are_found(spark):
    words = [f"{w}{i}" for i, w in enumerate(prose(78, 90_000).split())]
    pairs = []
    for i in range(150):  # 100 shingles or so, 11 of each lost on both sides: similarities about 0.8
        text = words[600 * i : 600 * i + 104]
        pairs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[11 + i % 3 :], *words[600 * i + 300 : 600 * i + 300 + i % 12]]))]
    got = jaccard_join.join(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    want, _ = brute_links(pairs)
    assert sum(want) > 100 and {r.doc_id: r.n_links for r in got} == dict(enumerate(want))


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, None, 3), (None, "x y", 4), (None, "x y", 4)], "doc_id long, text string, at int")
    docs = docs.withColumn("id", F.lit("i")).withColumn("digest", F.lit("d")).withColumn("row", F.lit("r"))
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.at for r in got.collect()) == [1, 3, 4]


# Personal data


def brute_spans(t):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


PRIVATE = [
    "a.b+c@x-y.example.com, then 1.2.3.4 and 1.2.3.4.5.6.7.8 or 256.1.1.1; x@y z@@w.com a@b.c@d.e",
    "card 4465 7583 8288 9437 or 4465-7583-8288-9437 4465758382889437 4465758382889437; +1 (743) 555-3824. +12 +1--2",
    "999999999999999999999.1.1.1 0.0.0.0 00001.1.1.1 +4 44 44 44 4( 4465758382889437",
    "9" * 3000 + " " + "1." * 500 + "@" * 50 + "a" * 500,
]


def test_base_spans_equal_the_patterns(rows):
    for t in [*PRIVATE, *(r[1] or "" for r in rows)]:
        assert pii.base_spans(t) == brute_spans(t)


@pytest.mark.parametrize(
    ("source", "kind", "span"),
    [
        ("mail joe (at) example [dot] com now", "email", "joe (at) example [dot] com"),
        ("joe at example dot com", "email", "joe at example dot com"),
        ("j\u043ee@ex\u0430mple.com", "email", "j\u043ee@ex\u0430mple.com"),
        ("plus one seven four three five five five three eight two four.", "phone", "plus one seven four three five five five three eight two four"),
        ("ip one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
        ("card \uff14\uff14\uff16\uff15 7583 8288 9437!", "card", "\uff14\uff14\uff16\uff15 7583 8288 9437"),
        ("joe\u200b@example.com x", "email", "joe\u200b@example.com"),
        ("x joe[@]example[.]com y", "email", "joe[@]example[.]com"),
        ("x joe_AT_example_DOT_com", "email", "joe_AT_example_DOT_com"),
        ("joe&#64;example.com", "email", "joe&#64;example.com"),
        ("host 192[.]168[.]1[.]7", "ip", "192[.]168[.]1[.]7"),
        ("pay 4465 7583 8288 9437 or 4465758382B894 4465-7583-8288-9437", "card", "4465 7583 8288 9437"),
        ("4465758382889437 4465758382889437", "card", "4465758382889437"),
        ("call +1 (743) 555-3824 4465758382889437 now", "phone", "+1 (743) 555-3824"),
        ("call +1 (743) 555-3824 4465758382889437 now", "card", "4465758382889437"),
        ("pay 1O00-0000-0000-00O8 x", "card", "1O00-0000-0000-00O8"),
    ],
)
def test_disguises_map_back_to_the_source(source, kind, span):
    (_, _, every), = pii.spans_by_text(pa.array([source], pa.large_string()))
    assert any(k == kind and source[a:b] == span for k, a, b in every), every


@pytest.mark.parametrize(
    ("source", "kind", "span"),
    [
        ("see joe_at_example.com now", "email", "joe_at_example.com"),
        ("mail: joe at example.com", "email", "joe at example.com"),
        ("Joe <joe at example.com>", "email", "joe at example.com"),
        ("card 4465 7583 8288 94 three seven", "card", "4465 7583 8288 94 three seven"),
        ("card 4465 7583 8288 943 seven", "card", "4465 7583 8288 943 seven"),
        ("card 4465 7583 8288 94  three\nseven x", "card", "4465 7583 8288 94  three\nseven"),
        ("four four six five, 7583 8288 9437", "card", "four four six five, 7583 8288 9437"),
        ("pay 1OO0-0000-0000-0008 x", "card", "1OO0-0000-0000-0008"),
        ("pay 1000 OOOO 0000 0008 x", "card", "1000 OOOO 0000 0008"),
        ("host 192.168.0.I here", "ip", "192.168.0.I"),
        ("host I92.l68.0.1 here", "ip", "I92.l68.0.1"),
        ("ip one  nine\ntwo dot one six eight dot one dot seven", "ip", "one  nine\ntwo dot one six eight dot one dot seven"),
        ("plus one, seven, four, three, five, five, five, three, eight, two, four.", "phone", "plus one, seven, four, three, five, five, five, three, eight, two, four"),
        ("\uff14465 7583 8288 9437 I said", "card", "\uff14465 7583 8288 9437"),
    ],
)
def test_disguises_that_pass_the_trigger_are_rewritten(source, kind, span):
    (_, _, every), = pii.spans_by_text(pa.array([source], pa.large_string()))
    assert [source[a:b] for k, a, b in every if k == kind] == [span], every


def test_words_beside_digits_and_a_plain_at_are_left_alone():
    texts = ["look at example.com, it is 20 I think", "in 2019 I saw 3 or 4, one of 12", "we mail it at example.com", "\u017fix one two", "1 I " * 50, "one two " * 6]
    assert all(not every for _, _, every in pii.spans_by_text(pa.array(texts, pa.large_string())))


def test_plain_words_are_left_alone():
    texts = ["look at example.com", "we met at noon", "one two three, and a dot here", "à 5 % — «voilà»", prose(3, 400)]
    assert all(not every for _, _, every in pii.spans_by_text(pa.array(texts, pa.large_string())))


SPELLED = [
    "zero one two three four five six seven eight nine".split(), "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "zéro un deux trois quatre cinq six sept huit neuf".split(),
]
LOOKS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х"}


def disguised(rng):
    """(kind, text): one identifier in a random disguise. What it disguises is known, so no second finder is needed."""
    digit = lambda: str(rng.integers(10))
    kind = ("email", "ip", "card", "phone")[rng.integers(4)]
    if kind == "email":
        local, host, top = (prose(int(rng.integers(1 << 30)), 1).strip(".,").lower() for _ in range(3))
        at = [" [at] ", " (arroba) ", "_at_", "&#64;", "﹫", "(arobase)", "@"][rng.integers(7)]
        dot = [" [dot] ", " (punkt) ", "[.]", "&#46;", " {punto} ", "."][rng.integers(6)]
        if (at, dot) == ("@", "."):
            local = "a" + local
            return kind, "".join(LOOKS.get(c, c) for c in local) + at + host + dot + top
        return kind, local + at + host + dot + top
    words = SPELLED[rng.integers(4)]
    spell = lambda text, gap: gap.join(words[int(c)] for c in text)
    wide = lambda text: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in text)
    if kind == "ip":
        parts = [str(rng.integers(256)) for _ in range(4)]
        joint = [" [dot] ", "․", "[.]", "(punto)"][rng.integers(4)]
        return kind, [joint.join(parts), wide(".".join(parts)), " dot ".join(spell(x, " ") for x in parts)][rng.integers(3)]
    if kind == "card":
        while not pii.luhn(number := "".join(digit() for _ in range(16))):
            pass
        gap = [" ", ", ", "-", "\n", "  "][rng.integers(5)]
        return kind, [spell(number, gap), wide(number), "\u200b".join(number), number[:8] + " " + spell(number[8:], gap)][rng.integers(4)]
    number = str(rng.integers(1, 10)) + "".join(digit() for _ in range(int(rng.integers(8, 13))))
    return kind, ["plus " + spell(number, " "), "＋" + wide(number), "+" + "\u2011".join(number), "+" + "\u200d".join(number)][rng.integers(4)]


def test_added_spans_are_those_that_were_disguised():
    rng = np.random.default_rng(55)
    missed = []
    for i in range(600):
        text, want, base = "", [], 0
        for _ in range(int(rng.integers(1, 4))):
            text += ("" if not text else "; ") + prose(int(rng.integers(1 << 30)), int(rng.integers(3, 9))).strip(".,") + ": "
            kind, hidden = disguised(rng)
            want.append((kind, len(text), len(text) + len(hidden)))
            text += hidden
        text += "; the end"
        triggered = next(pii.spans_by_text(pa.array([text], pa.large_string())))
        if not {*want} <= {*triggered[2]} or len(triggered[2]) != len(want):
            missed.append((text, want, triggered[2]))
    assert len(missed) <= 6, (len(missed), missed[:3])


def test_many_spans_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        pii.all_spans("joe [at] mail.example.com, " * n, True)
        return time.perf_counter() - began

    took(100)
    assert took(8_000) < 8 * (took(2_000) + 0.02)


def test_pii_rows_and_masks(spark, documents, rows, empty):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string"))
    got = pii.find(docs).collect()
    assert len(got) == len(rows) + len(PRIVATE)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 1000:
            want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(PRIVATE[r.doc_id - 1000]))
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r.spans.split(","))
    masks = {r.doc_id: r for r in pii.mask(docs.withColumn("extra", F.lit(7))).collect()}
    assert masks[0].text is None and masks[1000].extra == 7 and "<EMAIL>" in masks[1000].text and "@x-y" not in masks[1000].text
    assert pii.find(empty).count() == pii.mask(empty).count() == 0


# Quality rules


def brute_figures(t):
    t = t or ""
    w = words_of(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def plain_verdict(t):
    """The bands read anew: a ratio for the whole, one for each piece of 2048 bytes, and a fifth of the bytes may lie outside."""
    import zstandard

    b = quality_rules.Bands()

    def ratio(x):
        return len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))

    raw = t.encode()
    whole = [(least, most) for below, least, most in b.whole if len(raw) < below][0]
    if len(raw) >= 32 and not whole[0] <= ratio(raw) <= whole[1]:
        return False
    bad = 0
    for i in range(0, len(raw), 2048):
        piece = raw[i : i + 2048]
        least = b.chunk[0] if len(piece) == 2048 else [x for below, x, _ in b.whole if len(piece) < below][0]
        if len(piece) >= 32 and not least <= ratio(piece) <= b.chunk[1]:
            bad += len(piece)
    return len(raw) <= 2048 or bad * 5 <= len(raw)


def test_quality_figures_equal_brute_force(documents, rows, empty):
    got = collections.Counter(tuple(r)[:8] for r in quality_rules.judge(documents.select("doc_id", "text")).drop("text", "x").select("doc_id", *quality_rules.FIGURES, "base_failed", "kept").collect())
    want = collections.Counter()
    for r in rows:
        f = brute_figures(r[1])
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        want[r[0], *f, failed, not failed and plain_verdict(r[1])] += 1
    assert got == want
    clash = documents.select("doc_id", "text", "kept", F.lit("x").alias("n_words"), F.lit("y").alias("base_failed"))
    assert {r.kept for r in quality_rules.judge(clash).collect()} == {True, False} == {k[7] for k in want}
    assert quality_rules.judge(empty).count() == 0


def test_bands_reject_repetition_and_noise_only():
    import base64
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    ok = lambda t: quality_rules.within_bands(t, quality_rules.Bands(), compress)
    noise = base64.b64encode(random.Random(1).randbytes(3000)).decode()
    english = "The committee met on Tuesday to discuss plans for the new library. Several residents spoke about parking, opening hours and cost. A final vote is expected in the spring, once the architects have answered the questions raised. "
    assert ok(english) and ok(prose(1, 25)) and not ok(noise) and not ok("buy now cheap pills " * 200)


CLEAN = {
    "en": "The committee met on Tuesday to discuss plans for the new library. Several residents spoke about parking, opening hours and cost, and one of them asked why the old building could not be repaired instead. A final vote is expected in the spring, once the architects have answered the questions raised. Until then the reading room stays open on weekdays, and volunteers will sort the books that were damaged when the roof leaked last winter.",
    "de": "Der Ausschuss traf sich am Dienstag, um über die Pläne für die neue Bibliothek zu sprechen. Mehrere Anwohner äußerten sich zu Parkplätzen, Öffnungszeiten und Kosten, und eine von ihnen fragte, weshalb das alte Gebäude nicht einfach repariert werden könne. Eine endgültige Abstimmung wird im Frühjahr erwartet. Bis dahin bleibt der Lesesaal werktags geöffnet, und Freiwillige sortieren die Bücher, die im letzten Winter beschädigt wurden.",
    "fr": "La commission s'est réunie mardi pour examiner les plans de la nouvelle bibliothèque. Plusieurs habitants ont parlé du stationnement, des horaires et du coût, et l'un d'eux a demandé pourquoi l'ancien bâtiment ne pouvait pas être réparé. Un vote définitif est attendu au printemps. D'ici là, la salle de lecture reste ouverte en semaine, et des bénévoles trieront les livres abîmés lorsque le toit a fui l'hiver dernier.",
    "es": "La comisión se reunió el martes para tratar los planes de la nueva biblioteca. Varios vecinos hablaron del aparcamiento, los horarios y el coste, y uno de ellos preguntó por qué no se podía reparar el edificio antiguo. Se espera una votación definitiva en primavera. Hasta entonces la sala de lectura sigue abierta entre semana, y los voluntarios ordenarán los libros que se dañaron cuando el tejado goteó el invierno pasado.",
}


def noise_of(kind, n):
    import base64
    import random

    r = random.Random(n)
    if kind == "hex":
        return r.randbytes(n).hex()[:n]
    if kind == "base64":
        return base64.b64encode(r.randbytes(n)).decode()[:n]
    if kind == "cut base64":
        return " ".join(base64.b64encode(r.randbytes(9)).decode() for _ in range(n // 13))
    if kind == "digits":
        return " ".join(str(r.randrange(10 ** r.randint(3, 9))) for _ in range(n))[:n]
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))[:n]


def kept_by_bands(t):
    import zstandard

    return quality_rules.within_bands(t, quality_rules.Bands(), zstandard.ZstdCompressor(level=3).compress)


@pytest.mark.parametrize("kind", ["hex", "base64", "cut base64", "digits", "letters"])
@pytest.mark.parametrize("n", [12_000, 20_500, 50_000, 200_000])
def test_bands_reject_noise_of_every_kind(kind, n):
    assert not kept_by_bands(noise_of(kind, n))


def test_bands_reject_letters_and_base64_of_a_page():
    assert not any(kept_by_bands(noise_of(k, n)) for k in ("base64", "cut base64", "letters") for n in (1_600, 2_048, 2_600, 4_000, 8_000))


@pytest.mark.parametrize("kind", ["base64", "cut base64", "letters"])
@pytest.mark.parametrize("share", [0.3, 0.45])
def test_bands_reject_half_noise(kind, share):
    clean = table_prose()
    noise = noise_of(kind, int(len(clean) * share / (1 - share)))
    assert kept_by_bands(clean) and not kept_by_bands(clean + " " + noise)
    assert kept_by_bands(clean[:3_400]) and not kept_by_bands(clean[:2_300] + noise[:1_100])  # in the last partial chunk alone


def table_prose():
    """The longest English text of the smallest documents table."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["lang", "text"]).to_pylist()
    return max((r["text"] for r in rows if r["lang"] == "en" and r["text"]), key=len)


@pytest.mark.parametrize("lang", CLEAN)
def test_bands_keep_clean_text(lang):
    assert all(kept_by_bands(CLEAN[lang][:n]) for n in (120, 220, 330, 420, 500))
    assert kept_by_bands(CLEAN[lang])


# Language model


def test_unigram_scores_equal_brute_force(documents, rows, empty):
    params = lm.LmParams(vocabulary=16, tails=3, class_size=4, min_count=1, size=4, rounds=1, batch=512, least_steps=4, frequent=0.02)
    got = lm.score(documents, params).collect()
    assert len(got) == len(rows)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*words_of(low(r[1])), "\n"] for r in rows]
    c = collections.Counter()
    for r, t in zip(rows, tokens):
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 4)) for r, t in zip(rows, tokens))
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score(empty, params).count() == 0


def plain_log_probability(w, word, one, two, p):
    """The model's formula for one token, all classes and words of the class written out."""
    hidden = w["context"][one] @ w["first"] + w["context"][two] @ w["second"]
    of_class = [math.exp(hidden @ t + b) for t, b in zip(w["class"], w["class_bias"])]
    c = word // p.class_size
    in_class = {i: math.exp(hidden @ w["target"][i] + w["bias"][i]) for i in range(c * p.class_size, min((c + 1) * p.class_size, len(w["bias"])))}
    return math.log(of_class[c] / sum(of_class)) + math.log(in_class[word] / sum(in_class.values()))


def test_model_scores_equal_brute_force(documents, rows, monkeypatch):
    p = lm.LmParams(vocabulary=30, tails=5, class_size=7, min_count=1, size=5, frequent=0.02)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*words_of(low(r[1])), "\n"] for r in rows]
    c = collections.Counter()
    for r, t in zip(rows, tokens):
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            c.update(t)
    top = sorted((x for x in c if x != "\n" and len(x.encode()) <= p.word_bytes), key=lambda x: (-c[x], x))[:29]
    number = {x: i for i, x in enumerate(["\n", *top])}
    tail = lambda x: zlib.crc32(x[-2:].encode()) % 5
    mass = [0.5 + sum(c[x] + 0.5 for x in c if x not in number and tail(x) == g) for g in range(5)]
    rng = np.random.default_rng(4)
    weights = {k: rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in lm.start(np.full(35, 1 / 35), p).items()}
    monkeypatch.setattr(lm, "train", lambda *_: weights)
    got = collections.Counter((r.doc_id, r.n_tokens, round(r.score, 2)) for r in lm.score(documents, p).collect())
    want = collections.Counter()
    seen = {}
    for r, t in zip(rows, tokens):
        ids = [0, 0, *(number.get(x, 30 + tail(x)) for x in t)]
        total = 0.0
        for x, two, one, word in zip(t, ids, ids[1:], ids[2:]):
            key = (word, one, two)
            seen[key] = seen.get(key) or plain_log_probability(weights, *key, p)
            total += seen[key] / math.log(10) + (math.log10((c[x] + 0.5) / mass[word - 30]) if word >= 30 else 0)
        want[r[0], len(t), round(total, 2)] += 1
    near = sum(min(n, sum(m for k, m in got.items() if k[:2] == key[:2] and abs(k[2] - key[2]) <= 0.011 + 1e-6 * abs(key[2]))) for key, n in want.items())
    assert near == len(rows) == sum(got.values()), (sorted(got, key=str)[:8], sorted(want, key=str)[:8])


def test_model_probabilities_are_normalised_and_learn_context():
    rng = np.random.default_rng(1)
    ids = rng.integers(2, 10, 20_000)
    ids[1::2] = (ids[::2] - 2 + 1) % 8 + 2  # each second word follows from the one before
    one, two = lm.contexts(ids, np.array([0, len(ids)]))
    unigram = (np.bincount(ids, minlength=10) + 0.5) / (len(ids) + 5)
    p = lm.LmParams(size=8, class_size=4, class_noise=3, word_noise=4, batch=256)
    trainer = lm.Trainer(lm.start(unigram, p), unigram, p, 0)
    for _ in range(6):
        trainer.walk(ids, one, two, p.rate)
    whole = np.stack([lm.log_probabilities(trainer.w, np.full(len(ids), x), one, two, p) for x in range(10)])
    assert np.allclose(np.exp(whole).sum(axis=0), 1, atol=1e-4)
    assert whole[ids, np.arange(len(ids))].mean() > np.log(unigram[ids]).mean() + 0.5


def test_model_is_better_than_the_unigram_on_held_out_documents(spark):
    rng = np.random.default_rng(3)
    tongues = [[f"{a}{w}" for w in WORDS] for a in "abcd"]  # four languages, no word in two of them
    docs = [(i, " ".join(rng.choice(tongues[i % 4], 120))) for i in range(800)]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), lm.LmParams(class_size=32, rounds=2, shard_tokens=20_000, batch=1024)).filter("held_out").collect()
    assert len(got) > 100 and sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


# HTML extraction


def test_main_text_of_layouts(spark):
    pages = {
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav>"
        "<div class='ad'>Buy a lot of things today in our big shop now</div><article><h1>Head&amp;line</h1><p>First <b>bo</b>ld\n text &lt;x&gt; 1 < 2.<br>Next<p>One.</p>"
        "<div class=comments><p>I think that this is a very nice and long comment</p></div></article><footer>&copy; all of it</footer></body></html>": "Head&line First bold text <x> 1 < 2. Next One.",
        "<body><div id='sidebar'><p>" + "many words " * 40 + "</p></div><p>" + "plain story text goes on " * 10 + "</p><form>Your name please</form>": ("plain story text goes on " * 10).strip(),
        "<article><p>kept</p></article><!-- <p>no": "kept",
        "<article><p aria-hidden=true data-id='ad'>kept too</p><div hidden>not</div><p style='display: none'>nor this</p></article>": "kept too",
        "": "",
        "<nav>only a menu": "",
    }
    data = [(i, f"u{i}", k) for i, k in enumerate(pages)] + [(99, None, None), (0, "u0", next(iter(pages)))]
    got = html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(data)
    for r in got:
        want = "" if r.page_id == 99 else [*pages.values()][r.page_id]
        assert r.text == want and r.n_chars == len(want)


# Embeddings


@pytest.mark.parametrize("sizes", [{"block": 16}, {"block": 150, "hot": 160}])
def test_near_vectors_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = [base[i % 20] + 0.15 * rng.normal(size=32) for i in range(200)]
    vectors = [*base, *near, *base[:5], *[base[7]] * 12]
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    data += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 32, 0), (1003, [float("nan")] * 32, 0), (1004, [None] * 32, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (None, data[0][1], 0), (3, data[3][1], 0)]
    got = lattice.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), lattice.LatticeParams(**sizes)).collect()
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in data]
    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(data, ok)]
    link = [[j for j in range(len(data)) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(data))]
    counts = collections.Counter((r.vec_id, r.n_links) for r in got)
    want = collections.Counter((d[0], len(x)) for d, x in zip(data, link))
    assert sum(n for _, n in counts.elements()) >= 0.97 * sum(n for _, n in want.elements())
    assert all(n <= max(m for k, m in want if k == v) for v, n in counts)
    assert {r.vec_id for r in got if r.component_id == r.vec_id} == {r.vec_id for r in got if r.kept and r.vec_id is not None}
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def isolated_pairs(rng, dim, n):
    """2n unit vectors: n of random directions, and for each of them one at cosine 0.95 to 0.96."""
    a, r = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r -= (r * a).sum(axis=1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    c = rng.uniform(0.9501, 0.96, n)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * r


@pytest.mark.parametrize("dim", [8, 32, 64, 768])
@pytest.mark.parametrize("n", [20_000, 1_000_000])
def test_cells_find_isolated_pairs_in_every_dimension(dim, n):
    p = lattice.LatticeParams()
    a, b = isolated_pairs(np.random.default_rng(dim), dim, 500)
    (own_a, probes_a), (own_b, probes_b) = (lattice.cells(x, p.tables(n), p.blocks(n), p.scale) for x in (a, b))
    meets = lambda x, y: (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert (meets(own_a, np.hstack([own_b, probes_b])) | meets(probes_a, own_b)).mean() >= 0.98
    if dim >= 64:  # strangers rarely share a cell of a table, so cells stay small
        assert (own_a == np.roll(own_a, 1, axis=0)).mean() < 0.01


def test_blocks_and_tables_follow_the_number_of_vectors():
    p = lattice.LatticeParams()
    assert [p.blocks(n) for n in (1_000, 50_000, 1_000_000)] == [1, 2, 3]
    for n in (1_000, 50_000, 1_000_000):
        assert p.tables(n) < p.tables(n, 1) < p.tables(n, 2)
    a, b = isolated_pairs(np.random.default_rng(11), 64, 500)
    for more in (0, 1):  # two and three blocks: recall of the cells as planned
        (own_a, probes_a), (own_b, probes_b) = (lattice.cells(x, p.tables(50_000, more), 2 + more, p.scale) for x in (a, b))
        meets = (own_a[:, :, None] == np.hstack([own_b, probes_b])[:, None, :]).any(axis=(1, 2)) | (probes_a[:, :, None] == own_b[:, None, :]).any(axis=(1, 2))
        assert meets.mean() >= 0.97


def test_sketches_of_near_vectors_are_near():
    p = lattice.LatticeParams()
    for dim in (8, 64, 768):
        a, b = isolated_pairs(np.random.default_rng(dim), dim, 2_000)
        x, y = lattice.sketches(a, p.sketch_bits), lattice.sketches(b, p.sketch_bits)
        assert (np.bitwise_count(x ^ y).sum(axis=1) <= p.sketch_limit).mean() > 0.999
        if dim > 8:
            assert (np.bitwise_count(x ^ np.roll(x, 1, axis=0)).sum(axis=1) <= p.sketch_limit).mean() < 0.001


def test_isolated_near_vectors_equal_brute_force_in_every_dimension(spark):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for dim in (8, 32, 64, 768):
        x = np.concatenate(isolated_pairs(rng, dim, 500 if dim < 768 else 250))
        links = (x @ x.T >= 0.95).sum(axis=1) - 1
        want[dim] = {len(data) + i: int(k) for i, k in enumerate(links)}
        data += [(len(data) + i, v) for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    for dim, links in want.items():
        assert all(got[i] <= k for i, k in links.items())
        assert sum(got[i] for i in links) >= 0.97 * sum(links.values()), dim


def test_e8_points_are_lattice_points_and_nearest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    near, other = lattice.decode_e8(x)
    for p in (near, other):
        assert ((p % 2 == p[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    gap = lambda p: ((x - p / 2) ** 2).sum(axis=1)
    assert (gap(near) <= gap(other)).all() and (gap(near) <= 1 + 1e-9).all()  # the covering radius is 1


# SentencePiece


def test_sentencepiece_parity_and_round_trip(documents, rows, empty):
    got = sp_codec.verify(documents).collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    back = sp_codec.decode(sp_codec.encode(documents)).collect()
    assert collections.Counter(r.text for r in back) == collections.Counter(r[1] or "" for r in rows)
    assert sp_codec.verify(empty).count() == 0


def test_sentencepiece_odd_texts():
    import sentencepiece

    codec, path = sp_codec.codec(sp_codec.SpParams())
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  a  b ", "\u2581x\u2581 y", "a\n\n b\t ", "日本語 テキスト ", "🙂 ok  🙂🙂", "<s> hi </s> <0x41>", "ab" * 2000, " "]
    for t, ids in zip(odd, codec.encode(pa.array(odd, pa.large_string()))):
        assert ids.tolist() == other.encode(t)
        assert codec.decode(ids) == other.decode(ids.tolist()) == codec.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_unigram_models_are_rebuilt():
    model = sp_codec.SpModel([("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -2.6, 1)], sp_codec.UNIGRAM)
    assert sp_codec.build(model).encode("▁abab", add_special_tokens=False).tokens == ["▁ab", "ab"]


# Pipeline


def test_pipeline_stages(spark, tmp_path, rows):
    toxic = [(2000 + i, prose(700 + i, 80) + (" you scumbag vermin" if i % 3 == 0 else ""), "en", "t", 9) for i in range(300)]
    private = [(3000, prose(1, 60) + " write to joe@mail.example.com today", "en", "p", 9)]
    table = [r for r in rows if r[0] != 5] + toxic + private
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("scumbag" in (r[1] or ""))) for r in table if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(docs.collect())
    clean = [r for r in seen[0] if "scumbag" not in (r.text or "")]
    assert len(clean) == len(seen[0]) == sum("scumbag" not in (r[1] or "") for r in table)
    assert all(len(words_of(r.text)) >= 20 for r in seen[1])
    _, root = brute_links([tuple(r) for r in seen[1]])
    assert len(seen[2]) == len(set(root))
    assert any("<EMAIL>" in r.text for r in seen[3]) and len(seen[3]) == len(seen[2])
    check_packing(seen[4], [(r.doc_id, r.text) for r in seen[3]])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("cosine", [0.80, 0.85, 0.90])
def test_vectors_that_are_only_alike_form_no_group(spark, cosine):
    rng = np.random.default_rng(int(100 * cosine))
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    away = rng.normal(size=(400, 64))
    away -= np.outer(away @ base, base)
    away /= np.linalg.norm(away, axis=1)[:, None]
    v = np.sqrt(cosine) * base + np.sqrt(1 - cosine) * away
    twin = v[7] + 0.05 * away[9]
    data = [(i, x.tolist()) for i, x in enumerate([*v, twin])]
    unit = np.stack([np.array(x) / np.linalg.norm(x) for _, x in data])
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert links[400] >= 1 and links.sum() <= 20
    got = lattice.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist()))
    assert next(r.component_id for r in got if r.vec_id == 400) == 7 and all(r.kept for r in got if not links[r.vec_id])


def test_compared_pairs_of_alike_vectors_are_those_of_a_cell(spark):
    """Without links nothing is compared beyond what shares a cell, and no group is formed."""
    rng = np.random.default_rng(5)
    base, p = rng.normal(size=64), lattice.LatticeParams()
    v = lattice._directions(base / np.linalg.norm(base) * 0.92 + rng.normal(size=(400, 64)) * 0.049)
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    with lattice.Scratch(spark) as scratch:
        classes = lattice.prepared(frame).select("vec").withColumn("num", F.monotonically_increasing_id())
        labels = lattice._linked(scratch.table(classes, "classes"), scratch, p)
        near = int(((v @ v.T) >= 0.95).sum() - 400)
        assert labels.count() <= 2 * near
