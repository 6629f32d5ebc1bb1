"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION SELECT u.a, min(c.root) FROM c JOIN u ON u.b = c.node JOIN recurring.c AS r ON r.node = u.a WHERE c.root < r.root GROUP BY u.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.root, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.node = n.doc_id
"""

OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM a),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, list_distinct(list(k)) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM r) GROUP BY doc_id),
x AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
e AS (SELECT DISTINCT doc_id, unnest(gone) AS k FROM g),
t AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.k) AS kept FROM p ANTI JOIN e ON e.doc_id = p.doc_id AND e.k = p.k GROUP BY p.doc_id)
SELECT x.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM x LEFT JOIN t ON t.doc_id = x.doc_id
"""

_BUCKET = "CASE WHEN v < 32 THEN v ELSE 32 + (len(bin(v)) - 6) * 8 + ((v >> (len(bin(v)) - 4)) & 7) END"
_VALUE = "CASE WHEN b < 32 THEN b ELSE (8 + (b - 32) % 8) << ((b - 32) // 8 + 2) END"

OP2 = rf"""
WITH w AS (SELECT *, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM a),
r AS (SELECT doc_id, i FROM h JOIN (SELECT doc_id, h FROM h GROUP BY ALL HAVING count(*) > 1) USING (doc_id, h)),
k AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM r) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)),
m AS (SELECT *, [n_symbols * 1000 // greatest(word_chars, 1), n_upper * 1000 // greatest(word_chars, 1), n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1)] AS m FROM f),
b AS (SELECT lang, source, metric, {_BUCKET} AS b FROM (SELECT lang, source, unnest([0, 1, 2, 3]) AS metric, unnest(m) AS v FROM m WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words))),
s AS (SELECT *, {_VALUE} AS low FROM b),
q AS (SELECT lang, source, metric, count(*) AS n, quantile_disc(low, 0.05) AS q0, quantile_disc(low, 0.25) AS q1, quantile_disc(low, 0.75) AS q3, quantile_disc(low, 0.95) AS q4, [20, 40, 150, 90][metric + 1] AS slack FROM s GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
e AS (SELECT *, least(q4 + slack + 2 * (q4 - q3), q1 + 2 * slack + 12 * (q1 - q0)) AS fence FROM q),
g AS (SELECT a.lang, a.source, a.metric, (a.n * a.fence + 50 * ((b.n * b.fence + 50 * c.fence) // (b.n + 50))) // (a.n + 50) AS fence
  FROM e a JOIN e b ON b.lang = a.lang AND b.source IS NULL AND b.metric = a.metric JOIN e c ON c.lang IS NULL AND c.source IS NULL AND c.metric = a.metric WHERE a.source IS NOT NULL),
o AS (SELECT lang, source, list(fence ORDER BY metric) AS fences FROM g GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(m[1] <= fences[1] AND m[2] <= fences[2] AND m[3] <= fences[3] AND m[4] <= fences[4], true) AS kept
FROM m LEFT JOIN o ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
"""
