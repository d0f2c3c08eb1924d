"""SQL of the operators whose results SQL can express, for small tables."""

from __future__ import annotations

import string

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::INT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT *, strpos(role, '|') = 0 AND strpos(text || '<|/|>' || chr(10), '<|/|>' || chr(10)) = length(text) + 1 AS plain,
  length(role || text) AS size, length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '|', '')) AS marks FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + 13 - 1 + CASE WHEN plain THEN 0 ELSE marks END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

#: Exact neighbours.
NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

#: Every alignment of an item and a document that share a word; a window counts from an equal word on.
CONTAMINATED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d), bw AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM b),
m AS (SELECT doc_id, item_id, n, i - j AS shift, j FROM dw JOIN bw USING (x)),
c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS same FROM m),
f AS (SELECT DISTINCT doc_id, item_id FROM c WHERE same >= CASE WHEN n < 4 THEN n ELSE ceil(least(n, 16) * 13 / 16.0) END)
SELECT doc_id, count(f.item_id) > 0 AS contaminated, coalesce(string_agg(f.item_id::VARCHAR, ',' ORDER BY f.item_id), '') AS items FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""

STATED = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages), r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k(verdict, rule, rh, rp) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS stated FROM h JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, stated FROM h LEFT JOIN f USING (page_id)
"""

#: Unsigned crc32 of UTF-8 strings: ``tab`` has the table of bytes, ``_crc`` is an expression of a string in a query over ``tab`` too.
CRC_TABLE = """tab AS (
  SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::UBIGINT) ORDER BY i) AS crc
  FROM range(256) r(i))"""


def _crc(x: str) -> str:
    values = f"list_transform(range(0, length(hex(encode({x}))), 2), lambda j: ('0x' || substr(hex(encode({x})), j + 1, 2))::UBIGINT)"
    return f"xor(list_reduce({values}, lambda a, b: xor(a >> 8, crc[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295)"


#: Turns are 32 hex digits, so the first d turns of a conversation are the first 32 d characters of its key.
TRIE = rf"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS pos, md5(strlen(r) || ':' || r || x) AS k, strlen(x) AS size
  FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
s AS (SELECT c.conv_id, pos, k, size FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h UNION ALL SELECT c.conv_id, pos, k, size FROM c JOIN t ON t.conv_id = base AND pos <= h),
w AS (SELECT c.conv_id, coalesce(string_agg(k, '' ORDER BY pos), '') AS path, list(size ORDER BY pos) AS sizes, count(k) AS turns FROM c LEFT JOIN s USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, d, substr(path, 1, 32 * d) AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = turns AS ends FROM w, unnest(range(0, turns + 1)) AS u(d)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
b AS (SELECT substr(n.path, 1, 32 * e) AS path, sum((n - 1) * size) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM n LEFT JOIN k USING (path), unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN b USING (path) LEFT JOIN k USING (path) LEFT JOIN n AS up ON n.d > 0 AND up.path = substr(n.path, 1, 32 * (n.d - 1))
"""

def _importance() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "SELECT id, array_to_string(w[i : i + k - 1], ' ') AS g FROM {0}, unnest(range(1, len(w) + 1)) AS u(i), unnest([1, 2, 3]) AS v(k) WHERE i + k - 1 <= len(w)"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id AS id, {words} AS w FROM documents), b AS (SELECT item_id AS id, {words} AS w FROM benchmark),
df AS (SELECT id, g, count(*) AS n FROM ({runs.format("d")}) GROUP BY 1, 2), bf AS (SELECT g, count(*) AS n FROM ({runs.format("b")}) GROUP BY 1),
u AS (SELECT g, {_crc("g")} % 10000 AS k FROM (SELECT g FROM df UNION SELECT g FROM bf), tab),
s AS (SELECT k, sum(n) AS s FROM df JOIN u USING (g) GROUP BY 1), t AS (SELECT k, sum(n) AS t FROM bf JOIN u USING (g) GROUP BY 1),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000 AS s_all, coalesce((SELECT sum(t) FROM t), 0) + 10000 AS t_all),
x AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * s_all::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (k), a),
m AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM df JOIN u USING (g) JOIN x USING (k) GROUP BY 1),
e AS (SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id::BIGINT AS doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND r <= floor(5 * n / 100) THEN r END::BIGINT AS rank FROM r
"""


ORACLES = {
    "op3_ngram_jaccard_join": JACCARD,
    "op5_chat_formatting": CHAT,
    "exact_neighbours": NEIGHBOURS,
    "op8_spaced_seed_decontamination": CONTAMINATED,
    "op11_conversation_prefix_trie": TRIE,
    "op12_importance_resampling": _importance(),
    "url_stated_rules": STATED,
}
