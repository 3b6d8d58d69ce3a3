"""DuckDB SQL for the operators that SQL can express; each gives the rows of the query of that name."""

from funcrisk.llm.common import LOWER, UPPER
from funcrisk.llm.quality import STOP_WORDS
from funcrisk.llm.urls import RULES

WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, ws[i] AS word, i FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM d))),
f AS (SELECT *, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS g
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, e, g) AS n FROM f WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS i FROM k WHERE n > 1) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
  sum(CASE WHEN lower(word) IN ({", ".join(repr(x) for x in sorted(set(STOP_WORDS)))}) THEN 1 ELSE 0 END) AS n_stop FROM w GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars >= 1.5 * n_words AND word_chars <= 25 * n_words
  AND n_symbols <= 0.25 * n_words AND (n_words < 40 OR n_stop >= 0.02 * n_words) AND n_dup_lines <= 0.5 * n_lines AS kept
FROM m
"""

OP10 = rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT k, page_id, x, regexp_extract(x, '^[^/?#]*') AS raw FROM u),
p AS (SELECT k, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(x, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (SELECT p.k, p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.k ORDER BY length(r.rh || r.rp) DESC, r.verdict DESC, r.rh || r.rp DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
b AS (SELECT p.page_id, g.keep, strlen(p.h) AS n, unhex(sha1(p.h))::BIT::VARCHAR AS bits FROM p JOIN g ON p.h = g.h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
    + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
    + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM b
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, greatest(1, CAST(sum(len(ts)) AS BIGINT)) AS l FROM d),
p AS (SELECT k, doc_id, term, count(*) AS tf, any_value(len) AS n FROM (SELECT k, doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY k, doc_id, term),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM i),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(s.n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
r AS (SELECT q.item_id, q.text, p.k, p.doc_id, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN f ON q.term = f.term JOIN p ON p.term = q.term, s GROUP BY q.item_id, q.text, p.k, p.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, k) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

OP11 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
  sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda a, y: list_reduce(list_prepend(xor(a, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, z: xor(p >> 1, 3988292384 * (p & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, pos, r, x FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
q AS (SELECT c.conv_id, coalesce(list({'r': r, 'x': x} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, d, len(seq) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(seq[d].x) END AS chars, min(conv_id) OVER p AS node, count(*) OVER p AS n
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM q) WINDOW p AS (PARTITION BY d, seq[1:d])),
n AS (SELECT node, d, any_value(n) AS n_convs, (any_value(n) - 1) * any_value(chars) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
k AS (SELECT u.*, count(w.node) AS n_children FROM u LEFT JOIN u AS w ON w.parent = u.node AND w.d = u.d + 1 GROUP BY ALL),
s AS (SELECT m.node, m.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM k JOIN m ON m.conv_id = k.node AND m.d <= k.d GROUP BY m.node, m.d)
SELECT k.node AS conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.node = k.node AND s.d = k.d
"""
