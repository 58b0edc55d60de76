"""The queries that SQL can express, for a row-by-row comparison. Plain formulations, without any index."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({}, '[ \\t-\\r]+'), lambda x: x <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, coalesce(len(s.s), 0) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM w LEFT JOIN s USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY id) c USING (doc_id)
"""

DECONTAMINATION = f"""
WITH masks(m, span, offs) AS (VALUES (0, 8, [0, 1, 3, 4, 6, 7]), (1, 10, [0, 1, 3, 6, 7, 9])),
d AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
dp AS (SELECT doc_id, w, m, offs, unnest(range(0, len(w) - span + 1)) AS p FROM d, masks),
bp AS (SELECT item_id, w, m, offs, unnest(range(0, len(w) - span + 1)) AS q FROM b, masks),
hits AS (SELECT DISTINCT doc_id, item_id, p, q FROM (SELECT doc_id, p, m, list_transform(offs, lambda o: w[p + o + 1]) AS key FROM dp)
  JOIN (SELECT item_id, q, m, list_transform(offs, lambda o: w[q + o + 1]) AS key FROM bp) USING (m, key)),
steps AS (SELECT doc_id, item_id, p, q, d.w AS dw, b.w AS bw,
  unnest(range(greatest(q - 64, 0, q - p), least(q + 74, len(b.w), q - p + len(d.w)))) AS k
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
sums AS (SELECT doc_id, item_id, len(bw) AS n, p, q, k, sum(CASE WHEN bw[k + 1] = dw[p - q + k + 1] THEN 1 ELSE -2 END)
  OVER (PARTITION BY doc_id, item_id, p, q ORDER BY k) AS s FROM steps),
best AS (SELECT doc_id, item_id, n, s - least(0, min(s) OVER (PARTITION BY doc_id, item_id, p, q ORDER BY k)) AS score FROM sums)
SELECT doc_id, item_id, max(n) AS item_words, max(score)::BIGINT AS score FROM best GROUP BY doc_id, item_id HAVING max(score) >= least(10, CASE WHEN max(n) < 8 THEN max(n) ELSE max(n) - 3 END)
"""

LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM cut),
s AS (SELECT doc_id, line_no, list_sort(list_distinct({_WORDS.format("lower(line)")})) AS w FROM l),
c AS (SELECT w, min((doc_id, line_no)) AS id, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
t AS (SELECT id, n, unnest(w) AS x FROM c),
late AS (SELECT DISTINCT id FROM (SELECT a.id FROM t a JOIN t b ON a.x = b.x AND a.id > b.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY a.id, b.id HAVING 10 * count(*) >= 8 * (any_value(a.n) + any_value(b.n) - count(*)))),
kept AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM late)),
out AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM l JOIN s USING (doc_id, line_no) WHERE len(w) = 0 OR (doc_id, line_no) IN (SELECT id FROM kept) GROUP BY l.doc_id)
SELECT cut.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls), 0) - coalesce(out.n, 0) AS n_removed,
  CASE WHEN ls IS NOT NULL THEN sha256(coalesce(out.text, '')) END AS text_sha256 FROM cut LEFT JOIN out USING (doc_id)
"""

CHAT_COLLAPSE = """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, l FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l),
t AS (SELECT conv_id, len(l) AS n, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM m)
SELECT conv_id, i // 1000 AS segment, n AS n_turns,
  string_agg('<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) AS text
FROM t GROUP BY ALL
"""

# crc32 of a decimal number, one character and one bit at a time
_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

PREFIX_TRIE = f"""
WITH c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC32.format("conv_id")} % 4 AS h FROM c),
s AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY p),
o AS (SELECT *, CASE WHEN depth > 0 THEN p[1:depth - 1] END AS above, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len({_WORDS.format("p[depth].t")}) END AS own FROM n),
k AS (SELECT above AS p, count(*) AS n FROM o WHERE depth > 0 GROUP BY above),
f AS (SELECT o.*, coalesce(k.n, 0) AS n_children FROM o LEFT JOIN k ON o.p = k.p),
u AS (SELECT p[1:i] AS p, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM f) GROUP BY p[1:i])
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN u ON f.p = u.p LEFT JOIN n a ON a.p = f.above
"""

SQL: dict[str, str] = {
    "op13_prefix_trie": PREFIX_TRIE,
    "op8_chat_collapse": CHAT_COLLAPSE,
    "op4_near_dedup": NEAR_DEDUP,
    "op6_decontamination": DECONTAMINATION,
    "op9_line_dedup": LINE_DEDUP,
}
