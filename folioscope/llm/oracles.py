"""SQL statements (DuckDB) for the operators that SQL can express whole."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


QUALITY = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
dup AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * word_chars < 20 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 20 * n_words
    OR (n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR 100 * len(regexp_extract_all(text, '\p{{Lu}}')) > 60 * len(regexp_extract_all(text, '\p{{L}}'))
    OR 100 * len(regexp_extract_all(text, '[!?]{{2,}}')) > 20 * n_words
    OR 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 40 * n_words) AS kept
FROM b"""

JACCARD = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '{BLANK_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN c ON t.doc_id = c.a"""

INDEX = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '{ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({lowered('text')}, '{ALNUM_WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS s(k, r)),
x AS (
  SELECT *, coalesce(lag(role) OVER o <> role, true) AS opens, coalesce(lead(role) OVER o <> role, true) AS closes
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({ESCAPED.format('text')})
    + CASE WHEN opens THEN length('<|im_start|>') + 1 + length(replace({ESCAPED.format('role')}, chr(10), '\n')) ELSE length('<|im_next|>') END
    + CASE WHEN closes THEN length('<|im_end|>') + 1 ELSE 0 END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""


TRIE = """
WITH RECURSIVE bits AS (
  SELECT n, 0 AS i, n AS c FROM range(256) t(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE i = 8),
o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
h AS (
  SELECT n.c, n.c - n.c % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(n.c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]))) % 9 AS h
  FROM n, crc),
k AS (SELECT h.*, least(h.h, coalesce(n.n, 0)) AS kept FROM h LEFT JOIN n ON n.c = h.base),
r AS (
  SELECT k.c, o.i, role, text FROM k JOIN o ON o.c = k.base AND o.i <= k.h
  UNION ALL SELECT k.c, k.kept + o.i - k.h, role, text FROM k JOIN o ON o.c = k.c AND o.i > k.h),
l AS (
  SELECT k.c, coalesce(p.p, []) AS p
  FROM k LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS p FROM r GROUP BY c) p ON p.c = k.c),
x AS (SELECT c, len(p) AS length, d, p[1:d] AS node, p[1:d - 1] AS above, p[d].text AS said FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM l)),
g AS (
  SELECT node, d, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(strlen(said)), 0) AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = d), '')) AS ends_sha256
  FROM x GROUP BY node, d),
b AS (SELECT above AS node, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
s AS (
  SELECT x.node, x.d, sum((b.n IS NULL)::INT) AS n_leaves, sum(g.own) AS saved_tokens
  FROM g LEFT JOIN b ON b.node = g.node AND b.d = g.d JOIN x ON x.c = g.conv_id AND x.d <= g.d GROUP BY 1, 2)
SELECT g.conv_id, g.d AS depth, a.conv_id AS parent_conv_id, g.n_convs, coalesce(b.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN s ON s.node = g.node AND s.d = g.d LEFT JOIN b ON b.node = g.node AND b.d = g.d
LEFT JOIN g a ON g.d > 0 AND a.node = g.above AND a.d = g.d - 1"""

ORACLES = {
    "op3_quality_cascade": QUALITY,
    "op5_ngram_jaccard": JACCARD,
    "op6_positional_index": INDEX,
    "op8_chat_format": CHAT,
    "op12_prefix_trie": TRIE,
}
