"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
often AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, no, line, keep IS NOT NULL AND keep <> doc_id AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM grams),
places AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN grams USING (g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT doc_id, min(r) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM reach LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) l ON l.a = reach.doc_id GROUP BY doc_id"""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeat_ AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS k FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(line.n, 0) AS n_lines, coalesce(repeat_.n, 0) AS n_repeat_words
  FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN repeat_ ON repeat_.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols > 0.25 * greatest(n_words, 1) OR n_dup_lines > 0.5 * greatest(n_lines, 1) AS own_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR own_failed) AS fails FROM f GROUP BY source),
p AS (SELECT greatest(1e-6, least(1 - 1e-6, sum(fails) / sum(n))) AS mean, var_pop(fails / n) AS var, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, least(1e6, greatest(2.0, mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-9) - 1)) AS weight FROM p),
v AS (SELECT source, (fails + mean * weight) / (n + weight) > 0.8 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR own_failed OR bad) AS kept FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM k"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
s1 AS (SELECT *, 2.0::DOUBLE * size AS bound, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(size) OVER () AS want FROM s0),
s2 AS (SELECT *, coalesce(sum(bound) OVER before, 0.0::DOUBLE) AS held, sum(weight) OVER after AS free FROM s1
  WINDOW before AS (ORDER BY bound / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY bound / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
scale AS (SELECT arg_min((want - held) / free, held) AS scale FROM s2 WHERE weight * ((want - held) / free) < bound),
s3 AS (SELECT source, size AS source_size, least(weight * scale, bound) AS target FROM s1, scale),
s4 AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END + 1e-12), 2) AS sure FROM s3),
s5 AS (SELECT *, greatest(target - sure * source_size, 0.0) AS rest FROM s4),
e AS (SELECT d.*, source_size, target, sure, rest, CASE WHEN d.size >= 50 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS lev FROM d JOIN s5 ON s5.source IS NOT DISTINCT FROM d.source),
l0 AS (SELECT source, lev, sum(size)::DOUBLE AS s, any_value(rest) AS rest FROM e GROUP BY source, lev),
l1 AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY source ORDER BY lev DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS held,
  sum(s * lev) OVER (PARTITION BY source ORDER BY lev DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM l0),
l2 AS (SELECT *, CASE WHEN free > 0 THEN (rest - held) / free ELSE 0.0 END AS f FROM l1),
l3 AS (SELECT source, coalesce(max(f) FILTER (f * lev <= 1.0), max(f), 0.0) AS factor FROM l2 GROUP BY source),
p AS (SELECT e.*, least(greatest(factor * lev, 0.0), 1.0) AS p, (CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || size), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM e JOIN l3 ON l3.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, CASE WHEN p >= 1.0 THEN 0.0 WHEN p <= 0.0 THEN 1e300 ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q),
t AS (SELECT *, start + size <= rest AS fits, rest - sum(CASE WHEN start + size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r),
u AS (SELECT doc_id, true AS also FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start2 FROM t WHERE NOT fits AND size > 0 AND size <= gap) WHERE start2 + size / 2.0 <= gap)
SELECT doc_id, size, source_size, target, size * CAST(least(sure + CASE WHEN (rest > 0 AND fits) OR also THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken FROM t LEFT JOIN u USING (doc_id)"""

SQL = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_decontaminate": DECONTAMINATE,
    "op5_jaccard_join": JACCARD_JOIN,
    "op7_mixing": MIXING,
    "op8_quality_rules": QUALITY_RULES,
    "op10_warc": WARC,
}
