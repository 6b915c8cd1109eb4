"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force, round trips or held-out labels."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
windows AS (SELECT rid, i, w || ' ' || lead(w) OVER s || ' ' || lead(w, 2) OVER s AS k FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows WHERE k IS NOT NULL) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, doc_id, host, t, l, len(regexp_extract_all(l, '{_WORD}')) AS n,
  array_to_string(regexp_extract_all(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '{_WORD}'), ' ') AS k
  FROM (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d)),
full_lines AS (SELECT * FROM lines WHERE n > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM full_lines GROUP BY rid),
hosts AS (SELECT host, count(*) AS n FROM (SELECT DISTINCT doc_id, host, t FROM d) GROUP BY host),
frequent AS (SELECT f.host, f.k FROM (SELECT host, k, count(*) AS n FROM (SELECT DISTINCT doc_id, host, t, k FROM full_lines) GROUP BY host, k) f
  JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host WHERE f.n >= 10 AND f.n >= h.n * 0.001),
taken AS (SELECT rid, sum(n) AS n FROM full_lines l JOIN frequent f ON l.host IS NOT DISTINCT FROM f.host AND l.k = f.k GROUP BY rid),
base AS (SELECT d.rid, doc_id, len(regexp_extract_all(t, '{_WORD}')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(taken.n, 0) AS taken
  FROM d LEFT JOIN dups USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN taken USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - taken AS words_left FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (words_left < n_words * 0.5 OR words_left < 20) AS kept, words_left::BIGINT AS words_left
FROM judged
"""

OP6 = r"""
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
  CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') END AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(rh, rp, v)),
ruled AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM (SELECT row_number() OVER () AS rid, * FROM p) p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid, page_id, host, path),
o AS (SELECT host, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bad FROM p JOIN labels ON page_id = doc_id WHERE quality IN (0, 1)),
h AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS dom, list_extract(string_split(host, '.'), -1) AS suf, sum(bad)::DOUBLE AS b, count(*)::DOUBLE AS n FROM o GROUP BY host),
d AS (SELECT dom, suf, sum(b) AS b, sum(n) AS n FROM h GROUP BY dom, suf),
s AS (SELECT suf, sum(b) AS b, sum(n) AS n FROM d GROUP BY suf),
s1 AS (SELECT *, (SELECT sum(b) / sum(n) FROM s) AS up FROM s),
ks AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * (b / n - up) ** 2) - sum(up * (1 - up))) / nullif(sum(up * (1 - up) * (n - 1)), 0), 0.001))) - 1 AS k FROM s1),
s2 AS (SELECT suf, (b + k * up) / (n + k) AS up FROM s1, ks),
d1 AS (SELECT d.*, up FROM d JOIN s2 USING (suf)),
kd AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * (b / n - up) ** 2) - sum(up * (1 - up))) / nullif(sum(up * (1 - up) * (n - 1)), 0), 0.001))) - 1 AS k FROM d1),
d2 AS (SELECT dom, (b + k * up) / (n + k) AS up FROM d1, kd),
h1 AS (SELECT h.*, up FROM h JOIN d2 USING (dom)),
kh AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * (b / n - up) ** 2) - sum(up * (1 - up))) / nullif(sum(up * (1 - up) * (n - 1)), 0), 0.001))) - 1 AS k FROM h1),
top AS (SELECT sum(b) / sum(n) AS up FROM s),
others AS (SELECT DISTINCT host FROM p WHERE host NOT IN (SELECT host FROM h)),
o1 AS (SELECT host, coalesce(d2.up, s2.up, top.up) AS up FROM others LEFT JOIN d2 ON d2.dom = array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') LEFT JOIN s2 ON s2.suf = list_extract(string_split(host, '.'), -1) CROSS JOIN top),
h2 AS (SELECT host, b + k * up AS x, n - b + k * (1 - up) AS y FROM (SELECT host, b, n, up FROM h1 UNION ALL SELECT host, 0, 0, up FROM o1), kh),
blocked AS (SELECT host FROM h2 WHERE x / (x + y) - 1.645 * sqrt(x * y / ((x + y) ** 2 * (x + y + 1))) > 0.5)
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size) AS s, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * s AS cap, 2.0::DOUBLE * s / w AS full_at FROM s),
o AS (SELECT *, sum(cap) OVER f - cap AS filled, sum(w) OVER f - w AS spent, 1.5::DOUBLE * sum(s) OVER () AS budget, sum(w) OVER () AS weights FROM r
  WINDOW f AS (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, s, cap, w, max(CASE WHEN (budget - filled) / (weights - spent) <= full_at THEN (budget - filled) / (weights - spent) END) OVER () AS rate FROM o),
target AS (SELECT source, s::BIGINT AS source_size, least(cap, coalesce(rate * w, cap)) AS target, floor(least(cap, coalesce(rate * w, cap)) + 0.5)::BIGINT AS whole FROM t),
p AS (SELECT d.*, source_size, target, whole, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS rounds,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target, (rounds * size + least(size, greatest(0, whole - rounds * source_size - start)))::BIGINT AS taken FROM p
"""

OP10 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, b.vec_id AS id FROM good a JOIN good b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y, id) AS (SELECT rid, rid, vec_id FROM v UNION SELECT r.x, l.y, l.id FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON v.rid = c.x JOIN (SELECT x, min(id) AS component_id FROM reach GROUP BY x) m ON v.rid = m.x
"""

OP12 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.rid AS q, b.rid AS r, a.vec_id AS query_id, b.vec_id, list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda x, y: x + y) AS score
  FROM good a JOIN good b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN isnan(score) THEN '-infinity'::DOUBLE ELSE score END DESC, vec_id NULLS LAST, r) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: crc32 of a text's bytes by its table of 256 entries, each made by eight steps from its number.
OP13 = r"""
WITH table8 AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS k FROM (SELECT unnest(range(256))::BIGINT AS n)),
texts AS (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT side, rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
features AS (SELECT side, rid, w AS f FROM words UNION ALL
  SELECT side, rid, f FROM (SELECT side, rid, w || ' ' || lead(w) OVER (PARTITION BY side, rid ORDER BY i) AS f FROM words) WHERE f IS NOT NULL),
distinct_features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM distinct_features, table8),
per_text AS (SELECT side, rid, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY side, rid, bucket),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM per_text GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM totals),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS g FROM totals, whole),
means AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM per_text JOIN gain USING (bucket) WHERE side = 's' GROUP BY rid),
scored AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN means USING (rid) WHERE side = 's'),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM ranked) THEN place END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_frequency": OP2, "op6_host_reputation": OP6, "op9_mixing": OP9, "op10_epsilon_grid_join": OP10, "op12_onebit_codes": OP12, "op13_importance_resampling": OP13}
