"""DuckDB texts of the corpus queries that SQL can express."""

from __future__ import annotations

from schemaloom.llm.url_rules import UrlParams

_P = UrlParams()
_FITS = lambda rule: (lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')")(*rule.split("/", 1))
_LONGEST = sorted(_P.listed, key=lambda x: -len(x[1]))

#: Item sets are enumerated page by page; the rules are those of FP-growth with one consequent. Tokens of equal rows are one item.
URL_RULES = f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(coalesce(url, ''), '^[^?#]*[?]([^#]*)', 1) AS query FROM cut),
tok AS (SELECT page_id, url, host, path, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    CASE WHEN len(string_split(host, '.')) > 1 THEN ['d:' || array_to_string(string_split(host, '.')[-2:], '.')] ELSE [] END,
    list_transform(list_filter(list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x))) AS items FROM parts),
label AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
page AS MATERIALIZED (SELECT row_number() OVER () AS r, bad, items FROM tok JOIN label ON page_id = doc_id),
page_bad AS (SELECT r, bad FROM page),
size AS (SELECT count(*) AS n, avg(bad) AS base, greatest({_P.min_count}, ceil({_P.min_support} * count(*))) AS least FROM page),
each AS (SELECT r, unnest(items) AS token FROM page),
item AS (SELECT token, list(r ORDER BY r) AS rows FROM each GROUP BY 1 HAVING count(*) >= (SELECT least FROM size) AND count(*) < (SELECT n FROM size)),
merged AS (SELECT rows, list(token ORDER BY token) AS members FROM item GROUP BY 1),
basket AS (SELECT r, bad, coalesce(items, []) AS items FROM page_bad LEFT JOIN (SELECT r, list(members) AS items FROM (SELECT unnest(rows) AS r, members FROM merged) GROUP BY 1) USING (r)),
sets AS (SELECT bad, list_sort(flatten(list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1))) AS ante FROM (SELECT bad, items, unnest(range(1, 1 << len(items))) AS m FROM basket)),
rule AS (SELECT ante, array_to_string(ante, ' ') AS pattern, sum(bad) / count(*)::DOUBLE AS confidence FROM sets GROUP BY 1
  HAVING sum(bad) >= (SELECT least FROM size) AND sum(bad) / count(*)::DOUBLE >= {_P.min_confidence} AND sum(bad) / count(*)::DOUBLE / (SELECT base FROM size) >= {_P.min_lift}),
best AS (SELECT url, max(struct_pack(confidence := confidence, pattern := pattern)) AS m FROM (SELECT DISTINCT url, items FROM tok WHERE url IS NOT NULL) JOIN rule ON list_has_all(items, ante) GROUP BY 1)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS(t)} THEN '{t}'" for _, t in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS(t)} THEN '{v}'" for v, t in _LONGEST)} WHEN m.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, m.pattern AS pattern, m.confidence AS confidence
FROM tok LEFT JOIN best USING (url)"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k, 0) AS n_links, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM w LEFT JOIN low ON low.a = doc_id LEFT JOIN deg ON deg.a = doc_id"""

#: Brute force over all pairs; the lattice's recall on these tables is complete.
LATTICE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""

_LOWER = lambda x: f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A CTE with the 256 steps of CRC-32, and the checksum of the bytes that ``h`` spells in hexadecimal, given that table's ``t``.
_CRC_TABLE = """tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384::UBIGINT) ELSE e >> 1 END) AS v FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"""

#: Here the n-grams are strings.
RESAMPLE = rf"""
WITH {_CRC_TABLE},
w AS MATERIALIZED (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, -row_number() OVER (), NULL, regexp_extract_all({_LOWER("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
n AS MATERIALIZED (SELECT kind, r, g, count(*) AS n FROM (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w) GROUP BY ALL),
hashed AS (SELECT g, ({_CRC} % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM n), tab),
f AS MATERIALIZED (SELECT kind, r, bucket, n FROM n JOIN hashed USING (g)),
side AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM f GROUP BY 1),
whole AS (SELECT sum(s)::DOUBLE + 10000 AS s_all, sum(t)::DOUBLE + 10000 AS t_all FROM side),
gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * s_all / ((s::DOUBLE + 1) * t_all)))::BIGINT AS gain FROM side, whole),
doc AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM f JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
score AS (SELECT r, doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END ELSE 0 END AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS noise FROM w LEFT JOIN doc USING (r) WHERE kind = 0),
placed AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM score WHERE fit)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN rank <= 25 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank
FROM score LEFT JOIN placed USING (r)"""

#: Words meet by what is left of them without one character: at the same place if one is replaced, or as the other word.
SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all({_LOWER("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC} AS h FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS h FROM runs), tab),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN run[:(h % len(run))::BIGINT] || run[(h % len(run))::BIGINT + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT p.word, count(*) AS n_near, min(struct_pack(less := -w.n, near := encode(w.word))) AS m FROM pairs p JOIN words w ON p.near = w.word GROUP BY 1),
told AS MATERIALIZED (SELECT word, CASE WHEN -m.less >= 5 * n THEN decode(m.near) END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 5 * n THEN -m.less END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM told UNION ALL SELECT steps.word, told.form FROM steps JOIN told ON told.word = steps.root WHERE told.form IS NOT NULL),
ends AS (SELECT steps.word, root FROM steps JOIN told ON told.word = root WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)"""
