"""DuckDB SQL for those queries which it can express over whole tables."""

from .licenses import TEMPLATES, THRESHOLD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_QUOTED = ", ".join("({}, '{}', '{}')".format(k, i, t.replace("'", "''")) for k, (i, t) in enumerate(TEMPLATES))

ORACLES = {
    "op3_license_scan": rf"""
WITH t AS (SELECT * FROM (VALUES {_QUOTED}) AS v(template, license_id, text)),
u AS (
  SELECT doc_id, CAST(p - 1 AS INTEGER) AS unit, parts[p] AS text FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM (
      SELECT doc_id, list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\n[ \t\r]*\n'), [x]) AS parts
      FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)))),
first AS (SELECT doc_id, text, min(unit) AS place FROM u GROUP BY doc_id, text),
ranked AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS unit FROM first),
g AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT doc_id, unit, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM ranked)),
tg AS (
  SELECT template, license_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT template, license_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM t)),
rows AS (SELECT doc_id, unit, len(g) AS n, unnest(g) AS gram FROM g WHERE len(g) > 0),
trows AS (SELECT template, license_id, len(g) AS size, unnest(g) AS gram FROM tg),
c AS (
  SELECT doc_id, unit, template, license_id, 2 * count(*) / (n + size) AS dice
  FROM rows JOIN trows USING (gram) GROUP BY doc_id, unit, template, license_id, n, size)
SELECT doc_id, unit, license_id, dice FROM c WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) = 1""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON e.a = r.other),
c AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id""",
    "op5_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_mixture": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 2 AS most FROM r),
l AS (
  SELECT *, most / weight AS ratio,
    ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(CAST(sum(most) OVER o AS BIGINT), 0))
      / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT level AS found FROM l WHERE most > weight * level ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT source, source_size, weight, CASE WHEN found IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), weight * found) END AS target
  FROM l LEFT JOIN first ON true),
p AS (
  SELECT d.doc_id, d.size, t.*, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    least(CAST(floor(target + 0.5) AS BIGINT), source_size * 2) AS goal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p),
k AS (SELECT *, passes * size + greatest(0, least(goal - passes * source_size - before, size)) AS taken, before / target AS u FROM q)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE weight
    WHEN 5 THEN 0.0::DOUBLE + (sqrt(2.25::DOUBLE + -2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE
    WHEN 2 THEN 0.0::DOUBLE + u
    ELSE 0.0::DOUBLE + (sqrt(0.25::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE)) - 0.5::DOUBLE) / 1.0::DOUBLE END END AS position
FROM k""",
    "op9_warc": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top OR top IS NULL THEN NULL ELSE top END AS refers_to
FROM p JOIN f USING (h)""",
}
