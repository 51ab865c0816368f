"""Leakage checks and summaries of an assignment of tiles to splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .atoms import overlap_edges


def page_splits(tiles: DataFrame) -> DataFrame:
    """The split of each page's tiles, or <multi>."""
    one = F.when(F.countDistinct("split") == 1, F.first("split")).otherwise("<multi>")
    return tiles.groupBy("page_key").agg(one.alias("split"))


def leaks(tiles: DataFrame, deployment: DataFrame, expected: DataFrame | None = None, eps: float = 1.0) -> DataFrame:
    """What must not be, as rows (check, n):

    * tiles with another split than their page's expected one,
    * tiles of pages that are held out for deployment,
    * tile names in more than one split,
    * pairs of tiles in different splits that share pixels of a page.

    tiles: tile_id, tile_name, page_key, split and page_rect.
    """
    expected = page_splits(tiles) if expected is None else expected
    asked = expected.where(F.col("split") != "<multi>").select("page_key", F.col("split").alias("asked"))
    wrong = tiles.join(asked, "page_key", "left").where(F.col("asked") != F.col("split"))
    held = tiles.join(deployment.select("page_key").distinct(), "page_key", "left_semi")
    twice = tiles.groupBy("tile_name").agg(F.countDistinct("split").alias("k")).where("k > 1")
    side = lambda k: tiles.select(F.col("tile_id").alias(f"{k}_id"), F.col("split").alias(f"{k}_split"))
    shared = overlap_edges(tiles, eps).join(side("a"), "a_id").join(side("b"), "b_id").where("a_split <> b_split")
    checks = [("page_split", wrong), ("deployment_page", held), ("tile_name", twice), ("shared_pixels", shared)]
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionAll(c)
    return out


def name_collisions(tiles: DataFrame) -> DataFrame:
    """Tile names that more than one tile has: one would overwrite the other."""
    return tiles.groupBy("tile_name").agg(F.countDistinct("tile_id").alias("n_tiles"), F.countDistinct("split").alias("n_splits")).where("n_tiles > 1")


def verify(tiles: DataFrame, deployment: DataFrame, **options) -> None:
    """Raise AssertionError if there is a leak."""
    found = [f"{r['check']}: {r['n']}" for r in leaks(tiles, deployment, **options).where("n > 0").collect()]
    if found:
        raise AssertionError("splits leak: " + ", ".join(found))


def assignment_summary(tiles: DataFrame) -> DataFrame:
    """Atoms, tiles of each split; tiles: tile_id, atom_id, split."""
    return tiles.groupBy("split").agg(F.countDistinct("atom_id").alias("n_atoms"), F.count("*").alias("n_tiles"))


def instances(tiles: DataFrame, tile_classes: DataFrame) -> DataFrame:
    """Boxes of each class in each split; tile_classes: tile_id, class_id, n."""
    return tiles.join(tile_classes, "tile_id").groupBy("split", "class_id").agg(F.sum("n").alias("n"))


def atom_histogram(tiles: DataFrame) -> DataFrame:
    """Atoms of each size; sort and limit for a report."""
    sizes = tiles.groupBy("atom_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_atoms"))


def precision_recall(truth: DataFrame, predicted: DataFrame, iou: float = 0.5, cell: int = 256) -> DataFrame:
    """Per class: predictions that are the best for a truth box at this IoU, and
    what that makes of all predictions and all truth boxes."""
    from ..functions import geometry as g
    from .pairs import overlapping

    side = lambda df, k: df.select("image_id", "class_id", (F.col("det_id") * 2 + k).alias("det_id"), "x1", "y1", "x2", "y2")
    both = side(truth, 0).unionAll(side(predicted, 1))
    inter = g.intersection("a", "b")
    value = g.iou(inter, g.area("a") + g.area("b") - inter)
    met = overlapping(both, ["image_id", "class_id"], "det_id", cell, (value >= iou) & (F.col("a.det_id") % 2 != F.col("b.det_id") % 2))
    t = F.when(F.col("a.det_id") % 2 == 0, F.col("a.det_id")).otherwise(F.col("b.det_id"))
    p = F.when(F.col("a.det_id") % 2 == 1, F.col("a.det_id")).otherwise(F.col("b.det_id"))
    pairs = met.select("image_id", "class_id", t.alias("t"), p.alias("p"), value.alias("v"))
    best_t = pairs.groupBy("image_id", "class_id", "t").agg(F.max(F.struct("v", -F.col("p"))).alias("b"))
    best_p = pairs.groupBy("image_id", "class_id", "p").agg(F.max(F.struct("v", -F.col("t"))).alias("b"))
    mutual = best_t.select("image_id", "class_id", "t", (-F.col("b.col2")).alias("p")).join(
        best_p.select("image_id", "class_id", "p", (-F.col("b.col2")).alias("t")), ["image_id", "class_id", "t", "p"]
    )
    counts = [df.groupBy("class_id").agg(F.count("*").alias(n)) for df, n in ((truth, "n_truth"), (predicted, "n_predicted"), (mutual, "n_matched"))]
    out = counts[0].join(counts[1], "class_id", "full").join(counts[2], "class_id", "full").na.fill(0)
    return out.withColumn("precision", F.try_divide("n_matched", "n_predicted")).withColumn("recall", F.try_divide("n_matched", "n_truth"))
