"""Boxes, images, pages and files made from the driver's tables by whole-number
arithmetic, so that both engines make the same; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
N_CLASSES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    """One image a supplier."""
    return table(spark, d, "supplier").selectExpr("s_suppkey AS image_id", "2048 + 512 * (s_suppkey % 5) AS w", "1536 + 512 * (s_suppkey % 3) AS h")


_BOX = """l_suppkey AS image_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS confidence, CAST(l_partkey % 25 AS INT) AS class_id,
  (l_orderkey * 37 + l_linenumber * 101 + l_partkey * 13) % (w - 200) AS x1, (l_orderkey * 53 + l_partkey * 29) % (h - 200) AS y1,
  CAST(8 + CAST(l_quantity AS INT) * 3 AS BIGINT) AS bw0, CAST(8 + CAST(l_quantity AS INT) * 2 + l_linenumber AS BIGINT) AS bh0"""

IMAGES_SQL = "images AS (SELECT s_suppkey AS image_id, 2048 + 512 * (s_suppkey % 5) AS w, 1536 + 512 * (s_suppkey % 3) AS h FROM supplier)"
BOXES_SQL = f"""{IMAGES_SQL},
raw AS (SELECT {_BOX} FROM lineitem JOIN images ON l_suppkey = image_id),
boxes AS (SELECT *, x1 + bw0 AS x2, y1 + bh0 AS y2 FROM raw)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """One box a line item; all lie inside their images."""
    joined = table(spark, d, "lineitem").join(images(spark, d), F.col("l_suppkey") == F.col("image_id")).drop("image_id")
    rows = joined.selectExpr(*[x.strip() for x in _split(_BOX)])
    return rows.withColumn("x2", F.col("x1") + F.col("bw0")).withColumn("y2", F.col("y1") + F.col("bh0"))


def _split(cols: str) -> list[str]:
    """A list of expressions at its outer commas."""
    out, depth = [""], 0
    for c in cols:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def classes(spark: SparkSession) -> DataFrame:
    """25 names; leading zeros count."""
    rows = spark.range(N_CLASSES).select(F.col("id").cast("int").alias("class_id"))
    name = F.when(F.col("class_id") < 23, F.lpad(F.col("class_id").cast("string"), 4, "0")).when(F.col("class_id") == 23, "P").otherwise("null-1")
    return rows.withColumn("name", name)


CLASSES_SQL = """classes AS (SELECT CAST(i AS INTEGER) AS class_id,
  CASE WHEN i < 23 THEN lpad(CAST(i AS VARCHAR), 4, '0') WHEN i = 23 THEN 'P' ELSE 'null-1' END AS name FROM range(25) t(i))"""

SPLIT = "CASE image_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).withColumn("split", F.expr(SPLIT))


ANNOTATIONS_SQL = f"{BOXES_SQL}, ann AS (SELECT *, {SPLIT} AS split FROM boxes), split_images AS (SELECT *, {SPLIT} AS split FROM images)"


def split_images(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).withColumn("split", F.expr(SPLIT))


def detections(spark: SparkSession, d: str) -> DataFrame:
    """All boxes, each with a weaker copy moved by (3, 2); det_id is unique over the
    table."""
    two = boxes(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    moved = two.withColumns({c: F.col(c) + F.col("k") * (3 if c[0] == "x" else 2) for c in ("x1", "x2", "y1", "y2")})
    moved = moved.withColumn("confidence", F.col("confidence") * (F.lit(1.0) - F.lit(0.25) * F.col("k")))
    # unique, and the same in both engines: the five keys are, and k tells copies apart
    ident = F.conv(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "image_id", F.expr("CAST(round(confidence * 100) AS BIGINT)"), "k").cast("binary")), 1, 15), 16, 10)
    return moved.withColumn("det_id", ident.cast("long")).select("image_id", "class_id", "det_id", "x1", "y1", "x2", "y2", "confidence")


DETECTIONS_SQL = f"""{BOXES_SQL},
two AS MATERIALIZED (SELECT * EXCLUDE (x1, y1, x2, y2, confidence), k, x1 + 3 * k AS x1, y1 + 2 * k AS y1, x2 + 3 * k AS x2, y2 + 2 * k AS y2,
  confidence * (CAST(1.0 AS DOUBLE) - CAST(0.25 AS DOUBLE) * k) AS confidence
  FROM boxes, (VALUES (0), (1)) v(k)),
det AS MATERIALIZED (SELECT image_id, class_id, x1, y1, x2, y2, confidence, CAST('0x' || substr(md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
  CAST(image_id AS VARCHAR), CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR), CAST(k AS VARCHAR))), 1, 15) AS BIGINT) AS det_id FROM two)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Images as parts of pages, four to a page; the page says of which kind."""
    base = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS image_id", "s_suppkey DIV 4 AS page", "s_suppkey % 4 AS m", "(s_suppkey DIV 4) % 4 AS k",
        "2048 + 512 * ((s_suppkey DIV 4) % 5) AS w", "1536 + 512 * ((s_suppkey DIV 4) % 3) AS h",
    )
    return base.selectExpr(
        "image_id", "page AS page_key", "w", "h",
        "CASE WHEN k = 0 THEN 'subregion' WHEN k = 1 THEN 'full' WHEN k = 2 AND m = 0 THEN 'full' WHEN k = 2 THEN 'subregion' ELSE 'unparsed' END AS kind",
        "CASE WHEN k IN (0, 2) THEN (m % 2) * (w - 64) ELSE 0 END AS px1", "CASE WHEN k IN (0, 2) THEN (m DIV 2) * (h - 64) ELSE 0 END AS py1",
    ).withColumn("px2", F.col("px1") + F.col("w")).withColumn("py2", F.col("py1") + F.col("h"))


PAGES_SQL = """pim AS (SELECT s_suppkey AS image_id, s_suppkey // 4 AS page, s_suppkey % 4 AS m, (s_suppkey // 4) % 4 AS k,
  2048 + 512 * ((s_suppkey // 4) % 5) AS w, 1536 + 512 * ((s_suppkey // 4) % 3) AS h FROM supplier),
pg AS (SELECT image_id, page AS page_key, w, h,
  CASE WHEN k = 0 THEN 'subregion' WHEN k = 1 THEN 'full' WHEN k = 2 AND m = 0 THEN 'full' WHEN k = 2 THEN 'subregion' ELSE 'unparsed' END AS kind,
  CASE WHEN k IN (0, 2) THEN (m % 2) * (w - 64) ELSE 0 END AS px1, CASE WHEN k IN (0, 2) THEN (m // 2) * (h - 64) ELSE 0 END AS py1 FROM pim),
geo AS (SELECT *, px1 + w AS px2, py1 + h AS py2 FROM pg),
tiles AS (SELECT geo.*, tx AS tile_x, ty AS tile_y, image_id * 1000 + (ty // 1280) * 10 + tx // 1280 AS tile_id,
  CAST(px1 + tx * ((px2 - px1) / w) AS DOUBLE) AS rx1, CAST(py1 + ty * ((py2 - py1) / h) AS DOUBLE) AS ry1,
  CAST(px1 + (tx + 1280) * ((px2 - px1) / w) AS DOUBLE) AS rx2, CAST(py1 + (ty + 1280) * ((py2 - py1) / h) AS DOUBLE) AS ry2
  FROM geo, (SELECT i * 1280 AS tx FROM range(4) a(i)), (SELECT i * 1280 AS ty FROM range(4) b(i)) WHERE tx < w AND ty < h)"""

FILE_NAME = {
    "spark": "concat(lpad(page, 4, '0'), CASE image_id % 7 WHEN 6 THEN '' WHEN 5 THEN '_PNG' ELSE '_png' END, CASE WHEN image_id % 3 = 1 THEN concat('_', image_id % 4, '_0_0_', 100 + image_id, '_200_png') ELSE '' END, CASE WHEN image_id % 11 = 0 THEN '' ELSE concat('.rf.', substr(md5(CAST(CAST(image_id AS STRING) AS BINARY)), 1, 8)) END, CASE image_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' ELSE '.png' END)",
    "duckdb": "concat(lpad(CAST(page AS VARCHAR), 4, '0'), CASE image_id % 7 WHEN 6 THEN '' WHEN 5 THEN '_PNG' ELSE '_png' END, CASE WHEN image_id % 3 = 1 THEN concat('_', image_id % 4, '_0_0_', 100 + image_id, '_200_png') ELSE '' END, CASE WHEN image_id % 11 = 0 THEN '' ELSE concat('.rf.', substr(md5(CAST(image_id AS VARCHAR)), 1, 8)) END, CASE image_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' ELSE '.png' END)",
}


def files(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "supplier").selectExpr("s_suppkey AS image_id", "CAST(s_suppkey DIV 4 AS STRING) AS page")
    return base.join(images(spark, d), "image_id").selectExpr("image_id", f"{FILE_NAME['spark']} AS file_name", "w", "h")


FILES_SQL = f"""{IMAGES_SQL}, files AS (SELECT image_id, {FILE_NAME['duckdb']} AS file_name, w, h
  FROM (SELECT s_suppkey AS image_id, s_suppkey // 4 AS page FROM supplier) JOIN images USING (image_id))"""

_LINE = """CASE l_orderkey % 17 WHEN 0 THEN concat_ws(' ', {c}, '0.5', '0.25', '0.125') WHEN 1 THEN concat_ws(' ', {c}, '.1', '.2', '.3', '.4', '.5', '.6')
  WHEN 2 THEN concat('x', {c}, ' 0.5 0.5 0.1 0.1') WHEN 3 THEN '   ' WHEN 4 THEN {c} WHEN 5 THEN concat('  ', {c}, '   0.5  0.5 0.25 0.', {q}, '  ')
  ELSE concat({c}, ' 0.', {q}, ' 0.5 0.125 0.0625') END"""
_TEXT = {"spark": "CAST({} AS STRING)", "duckdb": "CAST({} AS VARCHAR)"}


def _line(kind: str, numbers: bool = False) -> str:
    cast = _TEXT[kind]
    line = _LINE.replace("concat('x', {c}, ' 0.5 0.5 0.1 0.1')", "concat({c}, ' 0.5 0.5 0.1 0.1 x')") if numbers else _LINE
    return line.format(c=cast.format("l_partkey % 25"), q=cast.format("CAST(l_quantity AS INT) + 100"))


def label_lines(spark: SparkSession, d: str, numbers: bool = False) -> DataFrame:
    """Label lines, some of them damaged; numbers: where there are five tokens, all
    are numbers."""
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_line('spark', numbers)} AS line")


def lines_sql(numbers: bool = False) -> str:
    return f"lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_line('duckdb', numbers)} AS line FROM lineitem)"


LINES_SQL = lines_sql()

_RECORD = """concat('{{"', CASE l_linenumber % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'ID' ELSE 'crop_id' END, '":"', CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE concat({o}, '-', {p}) END, '","x1":', {x},
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE concat(',"x2":', {x2}) END, ',"y1":10,"y2":', CASE WHEN l_orderkey % 11 = 0 THEN '"ten"' ELSE '20.5' END,
  CASE l_orderkey % 7 WHEN 0 THEN ',"conf":0' WHEN 1 THEN ',"conf":null,"confidence":0.5' WHEN 2 THEN '' WHEN 3 THEN ',"confidence":0.25' ELSE ',"conf":0.75' END,
  CASE l_partkey % 3 WHEN 0 THEN concat(',"class_id":', {k}) WHEN 1 THEN concat(',"class":', {k}) ELSE '' END,
  CASE l_partkey % 4 WHEN 0 THEN ',"class_name":"valve"' WHEN 1 THEN ',"class_name":"","label":"pump"' WHEN 2 THEN ',"name":"tap"' ELSE '' END, '}}')"""


def _record(kind: str) -> str:
    cast = _TEXT[kind].format
    return _RECORD.format(o=cast("l_orderkey"), p=cast("l_partkey"), x=cast("l_partkey % 50"), x2=cast("20 + l_orderkey % 40"), k=cast("l_partkey % 25"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_record('spark')} AS record")


RECORDS_SQL = f"recs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_record('duckdb')} AS record FROM lineitem)"
