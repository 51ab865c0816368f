"""Registered queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import names as n
from ..operators import atoms, detections, labels, nms, splits, tiling, verify
from ..sources import sinks
from . import derived as d

SIZE = 1280
#: Every second named class, one that the source lacks, and two groups.
SPACE = {
    "classes": [f"{k:04d}" for k in range(1, 20, 2)] + ["P", "9999"],
    "groups": {"pipe": ["0001", "0003"], "cap": ["0005", "P"]},
}
BOX_KEY = ["image_id", "l_orderkey", "l_linenumber", "l_partkey", "confidence"]
_BOX = ["x1", "y1", "x2", "y2"]


def space(policy: str = "background") -> labels.LabelSpace:
    return labels.LabelSpace(SPACE["classes"], SPACE["groups"], policy=policy)


# -- tiles --------------------------------------------------------------------


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.tile_grid(d.images(spark, sf), SIZE, 0.25).select("image_id", "tile_x", "tile_y")


def tile_box_counts(spark: SparkSession, sf: str) -> DataFrame:
    tiled = tiling.tile_boxes(d.boxes(spark, sf), d.images(spark, sf), SIZE, 0.25)
    return tiling.tile_class_counts(tiled)


def _tiled(spark: SparkSession, sf: str, fit: bool) -> DataFrame:
    tiled = tiling.tile_boxes(d.boxes(spark, sf), d.images(spark, sf), SIZE, 0.0, fit)
    return tiled.select(*BOX_KEY, "class_id", "tile_x", "tile_y", "xc", "yc", "bw", "bh")


def tile_boxes_majority(spark: SparkSession, sf: str) -> DataFrame:
    return _tiled(spark, sf, False)


def tile_boxes_clip(spark: SparkSession, sf: str) -> DataFrame:
    return _tiled(spark, sf, True)


def lost_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = d.boxes(spark, sf)
    tiled = tiling.tile_boxes(boxes, d.images(spark, sf), SIZE, 0.0)
    return tiling.lost_boxes(boxes, tiled, BOX_KEY).select(*BOX_KEY, *_BOX)


# -- labels -------------------------------------------------------------------


def _policy(spark: SparkSession, kind: str) -> tuple[DataFrame, labels.LabelSpace]:
    s = space(kind)
    return labels.policy_table(d.classes(spark), s), s


def relabel_background(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.relabel(d.boxes(spark, sf), *_policy(spark, "background"))
    return rows.select(*BOX_KEY, "class_id", "dst_id")


def relabel_drop(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.relabel(d.boxes(spark, sf), *_policy(spark, "drop"))
    return rows.select(*BOX_KEY, "class_id", "dst_id")


def label_space(spark: SparkSession, sf: str) -> DataFrame:
    policy, s = _policy(spark, "background")
    return labels.label_table(spark, s).join(policy, F.col("label_id") == F.col("dst_id"), "left").select("label_id", "label", "src_id")


def missing_classes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.missing_classes(d.classes(spark), space())


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return labels.class_counts(d.annotations(spark, sf))


def class_table(spark: SparkSession, sf: str) -> DataFrame:
    few = d.annotations(spark, sf).where("class_id <> 7")
    return labels.class_table(d.classes(spark), few).orderBy(F.desc("total_count"), "name")


def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.top_classes(d.annotations(spark, sf), d.classes(spark).where("class_id <> 3"))


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_summary(d.split_images(spark, sf), d.annotations(spark, sf))


def name_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.name_summary(d.classes(spark))


def filter_report(spark: SparkSession, sf: str) -> DataFrame:
    return labels.filter_report(d.split_images(spark, sf), d.annotations(spark, sf), *_policy(spark, "background"))


def label_split_grid(spark: SparkSession, sf: str) -> DataFrame:
    policy, s = _policy(spark, "background")
    rows = labels.relabel(d.annotations(spark, sf).where("split <> 'valid'"), policy, s)
    counts = rows.groupBy("split", F.col("dst_id").alias("label_id")).agg(F.count("*").alias("n"))
    return labels.label_grid(counts, labels.label_table(spark, s))


# -- parsing ------------------------------------------------------------------

_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def parse_labels_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose class isn't a number are an error to the strict scan; here they
    have another number of tokens."""
    rows = d.label_lines(spark, sf, numbers=True).withColumn("l", n.strict_label(F.col("line"))).where("l IS NOT NULL")
    return rows.select(*_LINE_KEY, "l.*")


def parse_labels_lenient(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.label_lines(spark, sf).withColumn("l", n.lenient_label(F.col("line"))).where("l IS NOT NULL")
    return rows.select(*_LINE_KEY, "l.*")


def label_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each scan makes of an image's lines: they differ for lines of more or
    fewer than five tokens."""
    rows = d.label_lines(spark, sf, numbers=True)
    strict, lenient = n.strict_label(F.col("line")).isNotNull(), n.lenient_label(F.col("line")).isNotNull()
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.count_if(strict).alias("n_strict"), F.count_if(lenient).alias("n_lenient"))


def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """Relabelled label files of all images, empty ones too."""
    rows = d.label_lines(spark, sf).withColumn("l", n.lenient_label(F.col("line"))).where("l IS NOT NULL")
    rows = rows.where("l_suppkey % 6 <> 0").select(*_LINE_KEY, "l.class_id", "l.rest")
    policy, s = _policy(spark, "drop")
    kept = labels.relabel(rows, policy, s)
    lines = kept.select(
        F.lit("train").alias("split"), F.concat(F.lit("img"), "l_suppkey").alias("stem"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "rest").alias("line_no"), F.concat_ws(" ", F.col("dst_id").cast("string"), "rest").alias("line"),
    )
    files = d.images(spark, sf).select(F.lit("train").alias("split"), F.concat(F.lit("img"), "image_id").alias("stem"))
    return sinks.label_texts(files, lines)


def first_page_keys(spark: SparkSession, sf: str) -> DataFrame:
    return d.files(spark, sf).select("image_id", "file_name", n.stem(F.col("file_name")).alias("stem"), n.first_page_key(F.col("file_name")).alias("page_key"))


def source_geometry(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.files(spark, sf).withColumn("g", n.source_geometry(F.col("file_name"), F.col("w"), F.col("h")))
    return rows.select("image_id", "file_name", "g.*")


def tile_names(spark: SparkSession, sf: str) -> DataFrame:
    grid = tiling.tile_grid(d.files(spark, sf), SIZE, 0.0)
    named = grid.withColumn("tile_name", n.tile_name(n.stem(F.col("file_name")), F.col("tile_x"), F.col("tile_y")))
    return named.select("image_id", "tile_name", n.tile_place(F.col("tile_name")).alias("p")).select("image_id", "tile_name", "p.*")


def normalize_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections.normalize_records(d.records(spark, sf))
    return rows.select(*_LINE_KEY, "crop_id", *_BOX, "confidence", "class_id", "class_name")


# -- detections ---------------------------------------------------------------


def nms_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppress(d.detections(spark, sf), ["image_id", "class_id"], 0.5)


def nms_agnostic(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppress(d.detections(spark, sf), ["image_id"], 0.5, 2000.0)


def nms_by_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppress_large(d.detections(spark, sf), ["image_id", "class_id"], 0.5)


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return nms.iou_pairs(d.detections(spark, sf), ["image_id"])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """What a scorer would say of tiles: each box in each tile that it meets, with
    half pixels, some of them of no width."""
    tiled = tiling.tile_boxes(d.boxes(spark, sf), d.images(spark, sf), SIZE, 0.25, fit=True)
    rows = tiled.select(
        "image_id", "w", "h", "tile_x", "tile_y", "class_id", (F.col("confidence") / 105000).alias("confidence"),
        (F.col("cx1") - F.lit(0.5)).alias("lx1"), (F.col("cy1") + F.lit(0.25)).alias("ly1"),
        F.when(F.col("l_orderkey") % 91 == 0, F.col("cx1") - F.lit(0.5)).otherwise(F.col("cx2") + F.lit(0.5)).alias("lx2"), (F.col("cy2") + F.lit(0.75)).alias("ly2"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    ident = F.conv(F.substring(F.md5(F.concat_ws("-", "image_id", "l_orderkey", "l_linenumber", "l_partkey", F.expr("CAST(round(confidence * 10500000) AS BIGINT)"), "tile_x", "tile_y").cast("binary")), 1, 15), 16, 10)
    return rows.withColumn("det_id", ident.cast("long")).drop("l_orderkey", "l_linenumber", "l_partkey")


def stitch_detections(spark: SparkSession, sf: str) -> DataFrame:
    classes = d.classes(spark).where("class_id <> 4").withColumn("name", F.when(F.col("class_id") == 9, labels.BACKGROUND).otherwise(F.col("name")))
    rows = detections.stitch(_scored(spark, sf), classes, 0.25, 0.5)
    return rows.select("image_id", "class_id", "class_name", "det_id", *_BOX, "confidence")


def _stub_scorer(tiles):
    """Three boxes a tile, by arithmetic."""
    out = []
    for t in tiles.itertuples():
        found = []
        for i in range(3):
            x, y = (t.image_id * 37 + t.tile_x + i * 13) % 1000, (t.image_id * 53 + t.tile_y + i * 29) % 1000
            found.append((x + 0.5, y + 0.25, x + 100.5 + i * 40, y + 80.75 + i * 30, (20 + (t.image_id + t.tile_x + t.tile_y + i * 17) % 61) / 100, int((t.image_id + i) % 2)))
        out.append(found)
    return out


def infer_detections(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections.infer(d.images(spark, sf), _stub_scorer, d.classes(spark), SIZE, 0.25, 0.25, 4, 1.1)
    return rows.select("image_id", "class_id", "class_name", *_BOX, "confidence")


def localized_records(spark: SparkSession, sf: str) -> DataFrame:
    """A service's answers for images, normalised."""

    def service(image: str) -> list:
        k = int(image.removeprefix("img"))
        return [{"ID": f"{image}-{i}", "x1": k % 50, "y1": i, "x2": k % 50 + i * 5, "y2": 20, "confidence": 0.5, "name": "tap"} for i in range(3)] + ["noise", None]

    images = d.images(spark, sf).select(F.concat(F.lit("img"), "image_id").alias("image"))
    rows = detections.normalize_records(detections.localize(images, service))
    return rows.select("image", "crop_id", *_BOX, "confidence", "class_id", "class_name")


def tiles_touched(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that a box meets, a line being enough, against those that it falls into."""
    return tiling.tiles_touched(d.boxes(spark, sf), d.images(spark, sf), SIZE).groupBy("image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


def detection_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections.per_image(nms.suppress(d.detections(spark, sf), ["image_id", "class_id"], 0.5), ["class_id", *_BOX])
    return rows.select("image_id", "num_detections", F.sha2(F.array_join(F.transform("detections", lambda r: F.concat_ws(":", *[r[c].cast("string") for c in ["class_id", *_BOX]])), ",").cast("binary"), 256).alias("digest"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes by way of a normalised centre and size, back in whole pixels."""
    c = F.col
    rows = d.boxes(spark, sf).join(d.images(spark, sf), "image_id")
    rows = rows.withColumns({"xc": (c("x1") + c("x2")) / 2 / c("w"), "yc": (c("y1") + c("y2")) / 2 / c("h"), "nw": (c("bw0") + 60) / c("w"), "nh": (c("bh0") + 31) / c("h")})
    return rows.withColumns(g.rounded_corners(c("xc"), c("yc"), c("nw"), c("nh"), c("w"), c("h")))


def truth_pixel_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).select(*BOX_KEY, "class_id", *_BOX)


def truth_and_predicted(spark: SparkSession, sf: str) -> DataFrame:
    classes = d.classes(spark).withColumn("name", F.when(F.col("class_id") == 9, labels.BACKGROUND).otherwise(F.col("name")))
    cols = ["image_id", "class_id", *_BOX]
    truth = detections.named(d.boxes(spark, sf).select(*cols), classes)
    found = detections.named(d.detections(spark, sf).select(*cols, "confidence"), classes)
    return detections.overlay(truth, found).groupBy("image_id", "kind", "class_name").agg(F.count("*").alias("n"), F.count("confidence").alias("n_scored"))


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = d.detections(spark, sf)
    return verify.precision_recall(found.where("det_id % 2 = 0"), found.where("det_id % 2 = 1"))


# -- pages, atoms, splits -----------------------------------------------------


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    tiles = tiling.with_page_rect(tiling.tile_grid(d.pages(spark, sf), SIZE, 0.0), SIZE)
    ident = F.expr("image_id * 1000 + (tile_y DIV 1280) * 10 + tile_x DIV 1280")
    return tiles.withColumn("tile_id", ident).select("tile_id", "image_id", "page_key", "tile_x", "tile_y", "page_rect")


def page_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.homogeneity(d.pages(spark, sf)).withColumn("kinds", F.array_join("kinds", ","))


def tile_page_rect(spark: SparkSession, sf: str) -> DataFrame:
    return _tiles(spark, sf).select("tile_id", "page_key", "tile_x", "tile_y", "page_rect.*")


def tile_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.overlap_edges(_tiles(spark, sf))


def _atoms(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.build_atoms(_tiles(spark, sf), d.pages(spark, sf))


def tile_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return _atoms(spark, sf)


def page_grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    files = d.pages(spark, sf).select(F.concat(F.lit("img"), "image_id").alias("name"), "page_key", ((F.col("page_key") * 7919 + 13) % 1009).alias("ord"))
    return splits.page_grouped(files, 0.10).select("name", "page_key", "split")


def ungrouped_split(spark: SparkSession, sf: str) -> DataFrame:
    files = d.pages(spark, sf).select(F.concat(F.lit("img"), "image_id").alias("name"), ((F.col("image_id") * 7919 + 13) % 1009).alias("ord"))
    return splits.ungrouped(files, 0.15).select("name", "split")


#: A class of 400; class c has (2 c + 1) of 160,000 boxes, so that low ones are rare.
RARE = "CAST(sqrt((l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 160000) AS INT)"
SET_COVER_LABELS = list(range(0, 26, 2))


def _page_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of pages: of 400 by arithmetic, some common and many rare."""
    rows = d.boxes(spark, sf).withColumns({"page_key": F.expr("image_id DIV 4"), "class_id": F.expr(RARE)})
    counts = rows.groupBy("page_key", "class_id").agg(F.count("*").alias("n"))
    return counts.withColumn("ord", (F.col("page_key") * 7919 + 13) % 1009)


def deployment_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = splits.deployment_pages(_page_classes(spark, sf), SET_COVER_LABELS, 1, 4)
    return spark.createDataFrame([(i, k) for i, k in enumerate(pages)], "position int, page_key long")


def uncovered_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that pages chosen by arithmetic hold fewer than 3 times."""
    counts = _page_classes(spark, sf)
    return splits.uncovered_labels(counts, [*range(0, 40, 3), 999], counts.where("page_key % 6 = 0"), 3)


ASSIGN_LABELS, ASSIGN_FLOORS = [0, 7, 11], (2, 1)
_ORD = "({} * 7919 + 13) % 1000003"


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    members = _atoms(spark, sf)
    keyed = members.select("atom_id").distinct().withColumn("ord", F.expr(_ORD.format("atom_id")))
    return splits.stratified(keyed, _atom_classes(spark, sf, members), ASSIGN_LABELS, {"test": 0.12, "valid": 0.10}, *ASSIGN_FLOORS)


def _tile_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of tiles, by arithmetic over line items."""
    tile = "l_suppkey * 1000 + (l_linenumber % 2) * 10 + l_partkey % 2 AS tile_id"
    keyed = d.table(spark, sf, "lineitem").selectExpr(tile, f"{RARE} AS class_id")
    return keyed.groupBy("tile_id", "class_id").agg(F.count("*").alias("n"))


def _atom_classes(spark: SparkSession, sf: str, members: DataFrame) -> DataFrame:
    return _tile_classes(spark, sf).join(members, "tile_id").select("atom_id", "class_id").distinct()


def stratified_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)


def _dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with a split by arithmetic, so that leaks are there to be found."""
    tiles = _tiles(spark, sf).withColumn("tile_name", F.expr("concat('t', tile_id % 400)"))
    return tiles.withColumn("split", F.expr("CASE WHEN page_key % 3 = 0 THEN CASE WHEN tile_id % 2 = 0 THEN 'valid' ELSE 'train' END WHEN page_key % 3 = 1 THEN 'train' ELSE 'test' END"))


def leakage_checks(spark: SparkSession, sf: str) -> DataFrame:
    tiles = _dealt(spark, sf)
    held = tiles.where("page_key % 10 = 0").select("page_key")
    asked = tiles.select("page_key").distinct().withColumn("split", F.expr("CASE WHEN page_key % 2 = 0 THEN 'train' ELSE '<multi>' END"))
    return verify.leaks(tiles, held, asked)


def tile_name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return verify.name_collisions(_dealt(spark, sf))


def page_splits(spark: SparkSession, sf: str) -> DataFrame:
    return verify.page_splits(_dealt(spark, sf))


def assignment_summary(spark: SparkSession, sf: str) -> DataFrame:
    tiles = _atoms(spark, sf).join(_assigned(spark, sf), "atom_id")
    return verify.assignment_summary(tiles)


def split_instances(spark: SparkSession, sf: str) -> DataFrame:
    return verify.instances(_dealt(spark, sf), _tile_classes(spark, sf))


def atom_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return verify.atom_histogram(_atoms(spark, sf)).orderBy("size").limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        tile_grid, tile_box_counts, tile_boxes_majority, tile_boxes_clip, lost_boxes, relabel_background, relabel_drop, label_space,
        missing_classes, class_counts, class_table, top_classes, split_summary, name_summary, filter_report, label_split_grid,
        parse_labels_strict, parse_labels_lenient, label_line_counts, label_files, first_page_keys, source_geometry, tile_names, normalize_records,
        nms_per_class, nms_agnostic, nms_by_rounds, iou_pairs, stitch_detections, infer_detections, localized_records, tiles_touched, detection_lists, truth_pixel_boxes, truth_and_predicted,
        precision_recall, page_homogeneity, tile_page_rect, tile_overlap_pairs, tile_atoms, page_grouped_split, ungrouped_split,
        deployment_pages, uncovered_labels, stratified_assign, leakage_checks, tile_name_collisions, page_splits, assignment_summary, split_instances, atom_histogram,
    )
}
