"""DuckDB SQL for the registered queries, written from the semantics and not from
the Spark plans: nested loops and recursion where the engine uses arithmetic."""

from __future__ import annotations

from . import derived as d
from .queries import ASSIGN_FLOORS, ASSIGN_LABELS, SET_COVER_LABELS, SPACE

_KEY = "image_id, l_orderkey, l_linenumber, l_partkey, confidence"
_LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
WORKED_CLASS = "CASE class_id WHEN 9 THEN '__background__' ELSE coalesce(name, CAST(class_id AS VARCHAR)) END"


def _grid(size: int, step: int) -> str:
    return f"""grid AS (SELECT image_id, w, h, CAST(i * {step} AS INTEGER) AS tile_x, CAST(j * {step} AS INTEGER) AS tile_y
  FROM images, range(40) a(i), range(40) b(j) WHERE i * {step} < w AND j * {step} < h)"""


def _tiled(size: int, step: int, fit: bool) -> str:
    keep = "true" if fit else "CAST((cx2 - cx1) * (cy2 - cy1) AS DOUBLE) / ((ox2 - ox1) * (oy2 - oy1)) > 0.5"
    p = "c" if fit else "o"
    return f"""WITH {d.BOXES_SQL}, {_grid(size, step)},
met AS (SELECT b.*, tile_x, tile_y, x1 - tile_x AS ox1, y1 - tile_y AS oy1, x2 - tile_x AS ox2, y2 - tile_y AS oy2 FROM boxes b JOIN grid USING (image_id)),
cut AS (SELECT *, greatest(0, ox1) AS cx1, greatest(0, oy1) AS cy1, least({size}, ox2) AS cx2, least({size}, oy2) AS cy2 FROM met),
tiled AS (SELECT * EXCLUDE (cx1, cy1, cx2, cy2), {p}x1 AS cx1, {p}y1 AS cy1, {p}x2 AS cx2, {p}y2 AS cy2 FROM cut WHERE cx2 > cx1 AND cy2 > cy1 AND {keep})"""


_NORM = """(cx1 + cx2) / 2 / 1280 AS xc, (cy1 + cy2) / 2 / 1280 AS yc, (cx2 - cx1) / 1280 AS bw, (cy2 - cy1) / 1280 AS bh"""


# label space, spelt out: groups by name, then the classes in no group, then the background
def _space_sql() -> str:
    listed = ", ".join(f"({i}, '{c}')" for i, c in enumerate(SPACE["classes"]))
    grouped = ", ".join(f"('{m}', '{g}')" for g, ms in SPACE["groups"].items() for m in ms)
    return f"""{d.CLASSES_SQL}, listed AS (SELECT * FROM (VALUES {listed}) v(position, name)), grouped AS (SELECT * FROM (VALUES {grouped}) v(name, label)),
named AS (SELECT position, l.name, coalesce(g.label, l.name) AS label, g.label IS NULL AS own FROM listed l LEFT JOIN grouped g ON l.name = g.name),
places AS (SELECT label, CAST(row_number() OVER (ORDER BY own, CASE WHEN own THEN '' ELSE label END, first) - 1 AS INTEGER) AS label_id
  FROM (SELECT label, own, min(position) AS first FROM named GROUP BY label, own)),
spaces AS (SELECT * FROM places UNION ALL SELECT '__background__', CAST(count(*) AS INTEGER) FROM places),
pol AS (SELECT class_id AS src_id, label_id AS dst_id FROM named JOIN classes USING (name) JOIN places USING (label))"""


_BG = "(SELECT label_id FROM spaces WHERE label = '__background__')"

_PARSED = r"""parsed AS (SELECT *, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS t FROM lines)"""
_LENIENT = rf"""{d.LINES_SQL}, {_PARSED},
lenient AS (SELECT {_LINE_KEY}, CAST(regexp_extract(t, '^([+-]?[0-9]+)\s+(.+)$', 1) AS INTEGER) AS class_id, regexp_extract(t, '^([+-]?[0-9]+)\s+(.+)$', 2) AS rest
  FROM parsed WHERE regexp_matches(t, '^[+-]?[0-9]+\s+.+$'))"""


def _nms(source: str, group: str, threshold: float = 0.5) -> str:
    """Boxes of a group one after the other, each against those kept so far: a list
    of who is kept, and for each box the places before it that overlap it."""
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in group.split(", "))
    of = lambda x: ", ".join(f"{x}.{c}" for c in group.split(", "))
    inter = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY confidence DESC, det_id) AS rn FROM {source}),
near AS MATERIALIZED (SELECT {of("b")}, b.rn, list(a.rn) AS above FROM ranked a JOIN ranked b ON {same("a", "b")} AND a.rn < b.rn
  WHERE {inter} > 0 AND {inter} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {inter}) >= {threshold} GROUP BY ALL),
row_of AS MATERIALIZED (SELECT {of("r")}, r.rn, n.above FROM ranked r LEFT JOIN near n ON {same("r", "n")} AND r.rn = n.rn),
steps AS (
  SELECT {group}, CAST(1 AS BIGINT) AS rn, [true] AS kept FROM row_of WHERE rn = 1
  UNION ALL
  SELECT {of("r")}, r.rn, list_append(s.kept, r.above IS NULL OR len(list_filter(r.above, lambda k: s.kept[k])) = 0)
  FROM steps s JOIN row_of r ON {same("s", "r")} AND r.rn = s.rn + 1),
ends AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY rn DESC) = 1),
ids AS (SELECT {group}, unnest(kept) AS stays, unnest(range(1, len(kept) + 1)) AS rn FROM ends),
survivors AS (SELECT ranked.* FROM ranked JOIN ids i ON {same("ranked", "i")} AND ranked.rn = i.rn WHERE stays)"""


_DET = "image_id, class_id, det_id, x1, y1, x2, y2, confidence"
_NMS_CLASS = f"WITH RECURSIVE {d.DETECTIONS_SQL}, {_nms('det', 'image_id, class_id')} SELECT {_DET} FROM survivors"

_EDGES = """edges AS (SELECT a.page_key, a.tile_id AS a_id, b.tile_id AS b_id FROM tiles a JOIN tiles b ON a.page_key = b.page_key AND a.tile_id < b.tile_id
  AND NOT (a.rx2 <= b.rx1 + 1 OR b.rx2 <= a.rx1 + 1 OR a.ry2 <= b.ry1 + 1 OR b.ry2 <= a.ry1 + 1))"""
_FLAGS = """flags AS (SELECT page_key, count(*) AS n_images, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(DISTINCT (w, h)) AS n_sizes,
  bool_or(kind = 'full') AND (bool_or(kind = 'subregion') OR count(DISTINCT (w, h)) > 1) AS collapsed FROM geo GROUP BY page_key)"""
_ATOMS = f"""{d.PAGES_SQL}, {_EDGES}, {_FLAGS},
open_edges AS (SELECT a_id, b_id FROM edges JOIN flags USING (page_key) WHERE NOT collapsed),
links AS (SELECT a_id AS s, b_id AS t FROM open_edges UNION SELECT b_id, a_id FROM open_edges UNION SELECT tile_id, tile_id FROM tiles),
reach AS (SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s),
least_of AS (SELECT s AS tile_id, min(t) AS least FROM reach GROUP BY s),
atoms AS (SELECT tile_id, page_key, CAST(CASE WHEN collapsed THEN min(tile_id) OVER (PARTITION BY page_key) ELSE least END AS BIGINT) AS atom_id
  FROM tiles JOIN flags USING (page_key) JOIN least_of USING (tile_id))"""
_RARE = "CAST(floor(sqrt((l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 160000)) AS INTEGER)"
_TILE_CLASSES = f"""tile_classes AS MATERIALIZED (SELECT l_suppkey * 1000 + (l_linenumber % 2) * 10 + l_partkey % 2 AS tile_id, {_RARE} AS class_id, count(*) AS n
  FROM lineitem GROUP BY ALL)"""


def _set_cover(rounds: int) -> str:
    wanted = ", ".join(map(str, SET_COVER_LABELS))
    out = [
        f"""WITH {d.BOXES_SQL}, counts AS MATERIALIZED (SELECT image_id // 4 AS page_key, {_RARE} AS class_id, count(*) AS n, (image_id // 4 * 7919 + 13) % 1009 AS ord FROM boxes GROUP BY ALL),
sizes AS (SELECT page_key, ord, sum(n) AS size FROM counts GROUP BY ALL),
chosen0 AS (SELECT CAST(NULL AS INTEGER) AS position, CAST(NULL AS BIGINT) AS page_key WHERE false)"""
    ]
    for k in range(rounds):
        out.append(f"""gain{k} AS (SELECT page_key, ord, size, (SELECT count(*) FROM counts c WHERE c.page_key = s.page_key AND class_id IN ({wanted})
    AND class_id NOT IN (SELECT class_id FROM counts WHERE page_key IN (SELECT page_key FROM chosen{k}))) AS gain FROM sizes s WHERE page_key NOT IN (SELECT page_key FROM chosen{k})),
chosen{k + 1} AS (SELECT * FROM chosen{k} UNION ALL SELECT {k}, page_key FROM (SELECT page_key FROM gain{k} WHERE gain > 0 ORDER BY gain DESC, size, ord, page_key LIMIT 1))""")
    return ",\n".join(out) + f"\nSELECT CAST(position AS INTEGER) AS position, page_key FROM chosen{rounds}"


def _assign() -> str:
    wanted = ", ".join(f"({i}, {c})" for i, c in enumerate(ASSIGN_LABELS))
    out = [
        f"""{_ATOMS}, {_TILE_CLASSES},
ac AS (SELECT DISTINCT atom_id, class_id FROM tile_classes JOIN atoms USING (tile_id)),
all_atoms AS (SELECT DISTINCT atom_id, (atom_id * 7919 + 13) % 1000003 AS ord FROM atoms),
wanted AS (SELECT v.class_id, row_number() OVER (ORDER BY (SELECT count(*) FROM ac WHERE ac.class_id = v.class_id), i) AS r FROM (VALUES {wanted}) v(i, class_id)),
got0 AS (SELECT CAST(NULL AS BIGINT) AS atom_id, CAST(NULL AS VARCHAR) AS split WHERE false)"""
    ]
    k = 0
    for target, floor in zip(("test", "valid"), ASSIGN_FLOORS, strict=True):
        for r in range(1, len(ASSIGN_LABELS) + 1):
            out.append(f"""have{k} AS (SELECT class_id, r, (SELECT count(*) FROM got{k} g JOIN ac USING (atom_id) WHERE g.split = '{target}' AND ac.class_id = wanted.class_id) AS have FROM wanted),
cand{k} AS (SELECT a.atom_id, row_number() OVER (ORDER BY (SELECT count(*) FROM ac JOIN have{k} USING (class_id) WHERE ac.atom_id = a.atom_id AND have < {floor}) DESC, ord, a.atom_id) AS rn
  FROM all_atoms a WHERE a.atom_id NOT IN (SELECT atom_id FROM got{k}) AND a.atom_id IN (SELECT atom_id FROM ac WHERE class_id = (SELECT class_id FROM wanted WHERE r = {r}))),
got{k + 1} AS (SELECT * FROM got{k} UNION ALL SELECT atom_id, '{target}' FROM cand{k} WHERE rn <= {floor} - (SELECT have FROM have{k} WHERE r = {r}))""")
            k += 1
    out.append(f"""need AS (SELECT greatest(0, CAST(round_even((SELECT count(*) FROM all_atoms) * CAST(0.12 AS DOUBLE), 0) AS BIGINT) - (SELECT count(*) FROM got{k} WHERE split = 'test')) AS t,
  greatest(0, CAST(round_even((SELECT count(*) FROM all_atoms) * CAST(0.10 AS DOUBLE), 0) AS BIGINT) - (SELECT count(*) FROM got{k} WHERE split = 'valid')) AS v),
rest AS (SELECT atom_id, row_number() OVER (ORDER BY ord, atom_id) AS rn FROM all_atoms WHERE atom_id NOT IN (SELECT atom_id FROM got{k})),
assigned AS (SELECT * FROM got{k} UNION ALL SELECT atom_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'valid' ELSE 'train' END FROM rest, need)""")
    return "WITH RECURSIVE " + ",\n".join(out)


_DEALT = f"""{d.PAGES_SQL}, dealt AS (SELECT *, concat('t', tile_id % 400) AS tile_name,
  CASE WHEN page_key % 3 = 0 THEN CASE WHEN tile_id % 2 = 0 THEN 'valid' ELSE 'train' END WHEN page_key % 3 = 1 THEN 'train' ELSE 'test' END AS split FROM tiles)"""

_FILE_PARTS = r"""plain AS (SELECT *, regexp_replace(file_name, '(?i)\.rf\.[0-9a-f]+\.(jpe?g|png)$', '') AS p FROM files),
sub AS (SELECT *, '(?i)^(.+?)_(?:png|jpg|jpeg)_[0-9]+_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)_(?:png|jpg|jpeg)$' AS sr, '(?i)^(.+?)_(?:png|jpg|jpeg)$' AS fr FROM plain)"""
_SR = r"'(?i)^(.+?)_(?:png|jpg|jpeg)_[0-9]+_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)_(?:png|jpg|jpeg)$'"
_FR = r"'(?i)^(.+?)_(?:png|jpg|jpeg)$'"
_TRIM = r"'(?i)(_png_[0-9]+_[0-9]+_[0-9]+_[0-9]+_[0-9]+)?(\.rf\.[0-9a-f]+)?$'"

_SCORED = _tiled(1280, 960, True).replace("WITH ", "", 1) + """,
local AS (SELECT image_id, w, h, tile_x, tile_y, class_id, confidence / 105000 AS confidence, cx1 - 0.5::DOUBLE AS lx1, cy1 + 0.25::DOUBLE AS ly1,
  CASE WHEN l_orderkey % 91 = 0 THEN cx1 - 0.5::DOUBLE ELSE cx2 + 0.5::DOUBLE END AS lx2, cy2 + 0.75::DOUBLE AS ly2, l_orderkey, l_linenumber, l_partkey
  FROM tiled JOIN images USING (image_id)),
scored AS (SELECT *, CAST('0x' || substr(md5(concat_ws('-', CAST(image_id AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
  CAST(CAST(round(confidence * 10500000) AS BIGINT) AS VARCHAR), CAST(tile_x AS VARCHAR), CAST(tile_y AS VARCHAR))), 1, 15) AS BIGINT) AS det_id FROM local),
lifted AS (SELECT image_id, class_id, det_id, confidence,
  least(CAST(w AS INTEGER) - 1, greatest(0, CAST(trunc(lx1) AS INTEGER) + tile_x)) AS x1, least(CAST(h AS INTEGER) - 1, greatest(0, CAST(trunc(ly1) AS INTEGER) + tile_y)) AS y1,
  least(CAST(w AS INTEGER) - 1, greatest(0, CAST(trunc(lx2) AS INTEGER) + tile_x)) AS x2, least(CAST(h AS INTEGER) - 1, greatest(0, CAST(trunc(ly2) AS INTEGER) + tile_y)) AS y2
  FROM scored WHERE confidence >= 0.25 AND lx2 > lx1 AND ly2 > ly1)"""

_NAMED = "LEFT JOIN classes USING (class_id)"

ORACLES = {
    "tile_grid": f"WITH {d.IMAGES_SQL}, {_grid(1280, 960)} SELECT image_id, tile_x, tile_y FROM grid",
    "tile_box_counts": f"{_tiled(1280, 960, False)} SELECT image_id, tile_x, tile_y, class_id, count(*) AS n FROM tiled GROUP BY ALL",
    "tile_boxes_majority": f"{_tiled(1280, 1280, False)} SELECT {_KEY}, class_id, tile_x, tile_y, {_NORM} FROM tiled",
    "tile_boxes_clip": f"{_tiled(1280, 1280, True)} SELECT {_KEY}, class_id, tile_x, tile_y, {_NORM} FROM tiled",
    "lost_boxes": f"{_tiled(1280, 1280, False)} SELECT {_KEY}, x1, y1, x2, y2 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM tiled t WHERE (t.image_id, t.l_orderkey, t.l_linenumber, t.l_partkey, t.confidence) = (b.image_id, b.l_orderkey, b.l_linenumber, b.l_partkey, b.confidence))",
    "relabel_background": f"WITH {d.BOXES_SQL}, {_space_sql()} SELECT {_KEY}, class_id, coalesce(dst_id, {_BG}) AS dst_id FROM boxes LEFT JOIN pol ON class_id = src_id",
    "relabel_drop": f"WITH {d.BOXES_SQL}, {_space_sql()} SELECT {_KEY}, class_id, dst_id FROM boxes JOIN pol ON class_id = src_id",
    "label_space": f"WITH {_space_sql()} SELECT label_id, label, src_id FROM spaces LEFT JOIN pol ON label_id = dst_id",
    "missing_classes": f"WITH {_space_sql()} SELECT position, name FROM listed WHERE name NOT IN (SELECT name FROM classes)",
    "class_counts": f"WITH {d.ANNOTATIONS_SQL} SELECT split, class_id, count(*) AS n FROM ann GROUP BY ALL",
    "class_table": f"""WITH {d.ANNOTATIONS_SQL}, {d.CLASSES_SQL}, c AS (SELECT class_id, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'test') AS test_count FROM ann WHERE class_id <> 7 GROUP BY class_id)
SELECT class_id, name, coalesce(train_count, 0) AS train_count, coalesce(test_count, 0) AS test_count, coalesce(train_count + test_count, 0) AS total_count FROM classes LEFT JOIN c USING (class_id)""",
    "top_classes": f"""WITH {d.ANNOTATIONS_SQL}, {d.CLASSES_SQL}, c AS (SELECT split, class_id, count(*) AS n FROM ann GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY n DESC, class_id) AS INTEGER) AS rank FROM c)
SELECT split, rank, class_id, CASE WHEN class_id <> 3 THEN name END AS name, n FROM r {_NAMED} WHERE rank <= 10""",
    "split_summary": f"""WITH {d.ANNOTATIONS_SQL} SELECT split, (SELECT count(*) FROM split_images s WHERE s.split = x.split) AS n_images, (SELECT count(*) FROM ann a WHERE a.split = x.split) AS n_annotations,
(SELECT count(DISTINCT class_id) FROM ann a WHERE a.split = x.split) AS n_classes FROM (SELECT DISTINCT split FROM split_images) x""",
    "name_summary": f"WITH {d.CLASSES_SQL} SELECT count(*) AS n_classes, count(*) FILTER (regexp_full_match(name, '[0-9]{{4}}')) AS n_four_digit, n_four_digit / n_classes AS share FROM classes",
    "filter_report": f"""WITH {d.ANNOTATIONS_SQL}, {_space_sql()}, c AS (SELECT split, count(dst_id) AS n_kept, count(*) - count(dst_id) AS n_background FROM ann LEFT JOIN pol ON class_id = src_id GROUP BY split)
SELECT split, n_images, coalesce(n_kept, 0) AS n_kept, coalesce(n_background, 0) AS n_background, CAST(0 AS BIGINT) AS n_dropped FROM (SELECT split, count(*) AS n_images FROM split_images GROUP BY split) LEFT JOIN c USING (split)""",
    "label_split_grid": f"""WITH {d.ANNOTATIONS_SQL}, {_space_sql()}, c AS (SELECT split, coalesce(dst_id, {_BG}) AS label_id, count(*) AS n FROM ann LEFT JOIN pol ON class_id = src_id WHERE split <> 'valid' GROUP BY ALL)
SELECT split, label_id, label, coalesce(n, 0) AS n FROM spaces CROSS JOIN (VALUES ('train'), ('valid'), ('test')) v(split) LEFT JOIN c USING (split, label_id)""",
    "parse_labels_strict": rf"""WITH {d.lines_sql(True)}, {_PARSED}, s AS (SELECT *, regexp_split_to_array(t, '\s+') AS k FROM parsed)
SELECT {_LINE_KEY}, CAST(k[1] AS INTEGER) AS class_id, CAST(k[2] AS DOUBLE) AS xc, CAST(k[3] AS DOUBLE) AS yc, CAST(k[4] AS DOUBLE) AS bw, CAST(k[5] AS DOUBLE) AS bh FROM s WHERE len(k) = 5""",
    "parse_labels_lenient": f"WITH {_LENIENT} SELECT {_LINE_KEY}, class_id, rest FROM lenient",
    "label_line_counts": rf"""WITH {d.lines_sql(True)}, {_PARSED} SELECT l_suppkey, count(*) AS n_lines, count(*) FILTER (regexp_matches(t, '^\S+(\s+\S+){{4}}$')) AS n_strict,
  count(*) FILTER (regexp_matches(t, '^[+-]?[0-9]+\s+\S')) AS n_lenient FROM parsed GROUP BY l_suppkey""",
    "label_files": f"""WITH {_LENIENT}, {d.IMAGES_SQL}, {_space_sql()},
f AS (SELECT l_suppkey, string_agg(concat_ws(' ', CAST(dst_id AS VARCHAR), rest), chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, rest, concat_ws(' ', CAST(dst_id AS VARCHAR), rest)) || chr(10) AS text
  FROM lenient JOIN pol ON class_id = src_id WHERE l_suppkey % 6 <> 0 GROUP BY l_suppkey)
SELECT 'train' AS split, concat('img', image_id) AS stem, coalesce(text, '') AS text FROM images LEFT JOIN f ON image_id = l_suppkey""",
    "first_page_keys": rf"""WITH {d.FILES_SQL}, s AS (SELECT image_id, file_name, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM files), t AS (SELECT *, regexp_replace(stem, {_TRIM}, '') AS x FROM s)
SELECT image_id, file_name, stem, CASE WHEN contains(x, '_png') THEN string_split(x, '_png')[1] WHEN contains(x, '_jpg') THEN string_split(x, '_jpg')[1] WHEN contains(x, '_jpeg') THEN string_split(x, '_jpeg')[1] ELSE x END AS page_key FROM t""",
    "source_geometry": rf"""WITH {d.FILES_SQL}, {_FILE_PARTS}, k AS (SELECT *, regexp_matches(p, {_SR}) AS is_sub, regexp_matches(p, {_FR}) AS is_full FROM plain)
SELECT image_id, file_name, CASE WHEN is_sub THEN regexp_extract(p, {_SR}, 1) WHEN is_full THEN regexp_extract(p, {_FR}, 1) ELSE p END AS page_key,
  CASE WHEN is_sub THEN 'subregion' WHEN is_full THEN 'full' ELSE 'unparsed' END AS kind,
  CAST(CASE WHEN is_sub THEN TRY_CAST(regexp_extract(p, {_SR}, 2) AS INTEGER) ELSE 0 END AS INTEGER) AS px1, CAST(CASE WHEN is_sub THEN TRY_CAST(regexp_extract(p, {_SR}, 3) AS INTEGER) ELSE 0 END AS INTEGER) AS py1,
  CAST(CASE WHEN is_sub THEN TRY_CAST(regexp_extract(p, {_SR}, 4) AS INTEGER) ELSE w END AS INTEGER) AS px2, CAST(CASE WHEN is_sub THEN TRY_CAST(regexp_extract(p, {_SR}, 5) AS INTEGER) ELSE h END AS INTEGER) AS py2 FROM k""",
    "tile_names": rf"""WITH {d.FILES_SQL}, {_grid(1280, 1280)} SELECT image_id, concat(stem, '_slice_', tile_x, '_', tile_y) AS tile_name, stem, tile_x, tile_y
FROM (SELECT image_id, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM files) JOIN grid USING (image_id)""",
    "normalize_records": f"""WITH {d.RECORDS_SQL}, j AS (SELECT *, json_keys(record) AS keys FROM recs),
f AS (SELECT *, coalesce(nullif(record->>'$.id', ''), nullif(record->>'$.ID', ''), nullif(record->>'$.crop_id', '')) AS crop_id,
  TRY_CAST(record->>'$.x1' AS DOUBLE) AS x1, TRY_CAST(record->>'$.y1' AS DOUBLE) AS y1, TRY_CAST(record->>'$.x2' AS DOUBLE) AS x2, TRY_CAST(record->>'$.y2' AS DOUBLE) AS y2,
  CAST(CASE WHEN list_contains(keys, 'conf') THEN record->>'$.conf' ELSE record->>'$.confidence' END AS DOUBLE) AS c,
  CASE WHEN list_contains(keys, 'class_id') THEN record->>'$.class_id' ELSE record->>'$.class' END AS k,
  coalesce(nullif(record->>'$.class_name', ''), nullif(record->>'$.label', ''), nullif(record->>'$.name', ''), 'symbol') AS class_name FROM j)
SELECT {_LINE_KEY}, crop_id, x1, y1, x2, y2, CASE WHEN coalesce(c, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE c END AS confidence, coalesce(CAST(k AS INTEGER), 0) AS class_id, class_name
FROM f WHERE crop_id IS NOT NULL AND x2 > x1 AND y2 > y1""",
    "nms_per_class": _NMS_CLASS,
    "nms_by_rounds": _NMS_CLASS,
    "nms_agnostic": f"WITH RECURSIVE {d.DETECTIONS_SQL}, chosen AS (SELECT * FROM det WHERE confidence >= 2000), {_nms("chosen", "image_id")} SELECT {_DET} FROM survivors",
    "iou_pairs": f"""WITH {d.DETECTIONS_SQL}, p AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS total
  FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id)
SELECT image_id, a_id, b_id, inter, total - inter AS union_area FROM p WHERE inter > 0""",
    "stitch_detections": f"""WITH RECURSIVE {_SCORED}, {d.CLASSES_SQL}, {_nms('lifted', 'image_id, class_id')}
SELECT image_id, class_id, CASE WHEN class_id = 4 THEN '4' ELSE name END AS class_name, det_id, x1, y1, x2, y2, confidence FROM survivors {_NAMED} WHERE class_id <> 9""",
    "infer_detections": f"""WITH {d.IMAGES_SQL}, {d.CLASSES_SQL}, {_grid(1280, 960)},
r AS (SELECT *, (image_id * 37 + tile_x + i * 13) % 1000 AS x, (image_id * 53 + tile_y + i * 29) % 1000 AS y, (20 + (image_id + tile_x + tile_y + i * 17) % 61) / 100 AS confidence, CAST((image_id + i) % 2 AS INTEGER) AS class_id
  FROM grid, range(3) v(i))
SELECT image_id, class_id, name AS class_name, CAST(least(w - 1, x + tile_x) AS INTEGER) AS x1, CAST(least(h - 1, y + tile_y) AS INTEGER) AS y1,
  CAST(least(w - 1, x + 100 + i * 40 + tile_x) AS INTEGER) AS x2, CAST(least(h - 1, y + 80 + i * 30 + tile_y) AS INTEGER) AS y2, confidence
FROM r JOIN classes USING (class_id) WHERE confidence >= 0.25""",
    "localized_records": """SELECT concat('img', s_suppkey) AS image, concat('img', s_suppkey, '-', i) AS crop_id, CAST(s_suppkey % 50 AS DOUBLE) AS x1, CAST(i AS DOUBLE) AS y1, CAST(s_suppkey % 50 + i * 5 AS DOUBLE) AS x2,
  CAST(20 AS DOUBLE) AS y2, CAST(0.5 AS DOUBLE) AS confidence, CAST(0 AS INTEGER) AS class_id, 'tap' AS class_name FROM supplier, range(1, 3) v(i)""",
    "tiles_touched": f"""WITH {d.BOXES_SQL}, {_grid(1280, 1280)} SELECT image_id, tile_x, tile_y, count(*) AS n FROM boxes JOIN grid USING (image_id)
WHERE NOT (x2 < tile_x OR x1 > tile_x + 1280 OR y2 < tile_y OR y1 > tile_y + 1280) GROUP BY ALL""",
    "detection_lists": f"""WITH RECURSIVE {d.DETECTIONS_SQL}, {_nms('det', 'image_id, class_id')}
SELECT image_id, count(*) AS num_detections, sha256(string_agg(concat_ws(':', CAST(class_id AS VARCHAR), CAST(x1 AS VARCHAR), CAST(y1 AS VARCHAR), CAST(x2 AS VARCHAR), CAST(y2 AS VARCHAR)), ',' ORDER BY det_id)) AS digest FROM survivors GROUP BY image_id""",
    "truth_pixel_boxes": f"""WITH {d.BOXES_SQL}, c AS (SELECT b.*, w, h, (x1 + x2) / 2 / w AS xc, (y1 + y2) / 2 / h AS yc, (bw0 + 60) / w AS nw, (bh0 + 31) / h AS nh FROM boxes b JOIN images USING (image_id))
SELECT {_KEY}, class_id, greatest(0, CAST(round_even((xc - nw / 2) * w, 0) AS INTEGER)) AS x1, greatest(0, CAST(round_even((yc - nh / 2) * h, 0) AS INTEGER)) AS y1,
  least(CAST(w - 1 AS INTEGER), CAST(round_even((xc + nw / 2) * w, 0) AS INTEGER)) AS x2, least(CAST(h - 1 AS INTEGER), CAST(round_even((yc + nh / 2) * h, 0) AS INTEGER)) AS y2 FROM c""",
    "truth_and_predicted": f"""WITH {d.DETECTIONS_SQL}, {d.CLASSES_SQL}, u AS (SELECT image_id, class_id, 'truth' AS side, CAST(NULL AS DOUBLE) AS confidence FROM boxes UNION ALL SELECT image_id, class_id, 'predicted', confidence FROM det),
k AS (SELECT image_id, side, {WORKED_CLASS} AS class_name, confidence FROM u {_NAMED})
SELECT image_id, CASE WHEN class_name = '__background__' THEN side || '_background' ELSE side END AS kind, class_name, count(*) AS n, count(confidence) AS n_scored FROM k GROUP BY ALL""",
    "precision_recall": f"""WITH {d.DETECTIONS_SQL}, t AS (SELECT * FROM det WHERE det_id % 2 = 0), p AS (SELECT * FROM det WHERE det_id % 2 = 1),
i AS (SELECT t.image_id, t.class_id, t.det_id AS t, p.det_id AS p, greatest(least(t.x2, p.x2) - greatest(t.x1, p.x1), 0) * greatest(least(t.y2, p.y2) - greatest(t.y1, p.y1), 0) AS inter,
  (t.x2 - t.x1) * (t.y2 - t.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS total FROM t JOIN p ON t.image_id = p.image_id AND t.class_id = p.class_id),
v AS (SELECT *, inter / (total - inter) AS v FROM i WHERE inter > 0 AND inter / (total - inter) >= 0.5),
m AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, p) AS rt, row_number() OVER (PARTITION BY p ORDER BY v DESC, t) AS rp FROM v),
c AS (SELECT class_id, (SELECT count(*) FROM t WHERE t.class_id = x.class_id) AS n_truth, (SELECT count(*) FROM p WHERE p.class_id = x.class_id) AS n_predicted,
  (SELECT count(*) FROM m WHERE m.class_id = x.class_id AND rt = 1 AND rp = 1) AS n_matched FROM (SELECT DISTINCT class_id FROM det) x)
SELECT *, CASE WHEN n_predicted > 0 THEN n_matched / n_predicted END AS precision, CASE WHEN n_truth > 0 THEN n_matched / n_truth END AS recall FROM c""",
    "page_homogeneity": f"WITH {d.PAGES_SQL}, {_FLAGS} SELECT page_key, n_images, kinds, n_sizes, collapsed FROM flags",
    "tile_page_rect": f"WITH {d.PAGES_SQL} SELECT tile_id, page_key, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, rx1 AS x1, ry1 AS y1, rx2 AS x2, ry2 AS y2 FROM tiles",
    "tile_overlap_pairs": f"WITH {d.PAGES_SQL}, {_EDGES} SELECT page_key, a_id, b_id FROM edges",
    "tile_atoms": f"WITH RECURSIVE {_ATOMS} SELECT tile_id, page_key, atom_id FROM atoms",
    "page_grouped_split": f"""WITH {d.PAGES_SQL}, g AS (SELECT page_key, count(*) AS n, (page_key * 7919 + 13) % 1009 AS ord FROM geo GROUP BY page_key),
b AS (SELECT page_key, coalesce(sum(n) OVER (ORDER BY ord, page_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g)
SELECT concat('img', image_id) AS name, page_key, CASE WHEN ahead < (SELECT round_even(count(*) * CAST(0.10 AS DOUBLE), 0) FROM geo) THEN 'valid' ELSE 'train' END AS split FROM geo JOIN b USING (page_key)""",
    "ungrouped_split": """WITH f AS (SELECT concat('img', s_suppkey) AS name, row_number() OVER (ORDER BY (s_suppkey * 7919 + 13) % 1009, concat('img', s_suppkey)) AS rn FROM supplier)
SELECT name, CASE WHEN rn <= (SELECT round_even(count(*) * CAST(0.15 AS DOUBLE), 0) FROM f) THEN 'valid' ELSE 'train' END AS split FROM f""",
    "deployment_pages": _set_cover(4),
    "uncovered_labels": f"""WITH {d.BOXES_SQL}, counts AS (SELECT image_id // 4 AS page_key, {_RARE} AS class_id FROM boxes GROUP BY ALL),
w AS (SELECT CAST(i AS INTEGER) AS class_id FROM (SELECT unnest(range(0, 40, 3)) AS i UNION ALL SELECT 999)),
h AS (SELECT class_id, (SELECT count(DISTINCT page_key) FROM counts c WHERE c.class_id = w.class_id AND page_key % 6 = 0) AS n_pages FROM w)
SELECT class_id, n_pages FROM h WHERE n_pages < 3""",
    "tile_name_collisions": f"WITH {_DEALT} SELECT tile_name, count(DISTINCT tile_id) AS n_tiles, count(DISTINCT split) AS n_splits FROM dealt GROUP BY tile_name HAVING count(DISTINCT tile_id) > 1",
    "stratified_assign": f"{_assign()} SELECT atom_id, split FROM assigned",
    "leakage_checks": f"""WITH {_DEALT}, {_EDGES},
w AS (SELECT count(*) AS n FROM dealt WHERE page_key % 2 = 0 AND split <> 'train'), h AS (SELECT count(*) AS n FROM dealt WHERE page_key % 10 = 0),
t AS (SELECT count(*) AS n FROM (SELECT tile_name FROM dealt GROUP BY tile_name HAVING count(DISTINCT split) > 1)),
s AS (SELECT count(*) AS n FROM edges JOIN dealt a ON a.tile_id = a_id JOIN dealt b ON b.tile_id = b_id WHERE a.split <> b.split)
SELECT 'page_split' AS check, n FROM w UNION ALL SELECT 'deployment_page', n FROM h UNION ALL SELECT 'tile_name', n FROM t UNION ALL SELECT 'shared_pixels', n FROM s""",
    "page_splits": f"WITH {_DEALT} SELECT page_key, CASE WHEN count(DISTINCT split) = 1 THEN min(split) ELSE '<multi>' END AS split FROM dealt GROUP BY page_key",
    "assignment_summary": f"{_assign()} SELECT split, count(DISTINCT atom_id) AS n_atoms, count(*) AS n_tiles FROM atoms JOIN assigned USING (atom_id) GROUP BY split",
    "split_instances": f"WITH {_DEALT}, {_TILE_CLASSES} SELECT split, class_id, CAST(sum(n) AS BIGINT) AS n FROM dealt JOIN tile_classes USING (tile_id) GROUP BY ALL",
    "atom_histogram": f"WITH RECURSIVE {_ATOMS}, z AS (SELECT atom_id, count(*) AS size FROM atoms GROUP BY atom_id) SELECT size, count(*) AS n_atoms FROM z GROUP BY size ORDER BY size LIMIT 20",
}
