"""Tiles of images, and the boxes that fall into them.

Boxes find their tiles by arithmetic: the tiles that a box meets are a range on
each axis, which is exploded; no box is compared with a tile that it misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def tile_grid(images: DataFrame, size: int = 1280, overlap: float = 0.0) -> DataFrame:
    """A row for each tile of each image (image_id, w, h): tile_x, tile_y.  Edge
    tiles reach past the image; none is moved back to fit."""
    step = g.tile_step(size, overlap)
    rows = images.withColumn("tile_y", F.explode(g.tile_origins(F.col("h"), step)))
    return rows.withColumn("tile_x", F.explode(g.tile_origins(F.col("w"), step)))


def tile_boxes(boxes: DataFrame, images: DataFrame, size: int = 1280, overlap: float = 0.0, fit: bool = False) -> DataFrame:
    """Boxes (image_id, x1, y1, x2, y2, ...) in each tile that keeps them, with
    coordinates in the tile (cx1 ... cy2) and normalised (xc, yc, bw, bh).

    fit: a box is cut to the tile.  Else a tile keeps a whole box, though it
    reach outside, if more than half of its area is inside, and no other: a box
    that no tile has more than half of is in none.
    """
    step = g.tile_step(size, overlap)
    sized = boxes.join(images.select("image_id", "w", "h"), "image_id")
    c = F.col
    first_x, last_x = g.tile_range(c("x1"), c("x2"), c("w"), size, step)
    first_y, last_y = g.tile_range(c("y1"), c("y2"), c("h"), size, step)
    met = sized.withColumns({"_a": first_x, "_b": last_x, "_c": first_y, "_d": last_y}).where("_a <= _b AND _c <= _d")
    met = met.withColumn("tile_x", F.explode(F.sequence(c("_a") * step, c("_b") * step, F.lit(step))))
    met = met.withColumn("tile_y", F.explode(F.sequence(c("_c") * step, c("_d") * step, F.lit(step)))).drop("_a", "_b", "_c", "_d")

    whole = {"x1": c("x1") - c("tile_x"), "y1": c("y1") - c("tile_y"), "x2": c("x2") - c("tile_x"), "y2": c("y2") - c("tile_y")}
    cut = {k: F.greatest(v * 0, v) if k[1] == "1" else F.least(v * 0 + size, v) for k, v in whole.items()}
    inside = met.withColumns({f"w{k}": v for k, v in whole.items()} | {f"c{k}": v for k, v in cut.items()})
    inside = inside.where("cx2 > cx1 AND cy2 > cy1")
    if not fit:
        all_area = (c("wx2") - c("wx1")) * (c("wy2") - c("wy1"))
        cut_area = (c("cx2") - c("cx1")) * (c("cy2") - c("cy1"))
        inside = inside.where((all_area > 0) & (cut_area / all_area > 0.5))
        inside = inside.withColumns({f"c{k}": c(f"w{k}") for k in whole})
    inside = inside.drop(*[f"w{k}" for k in whole])
    norm = {
        "xc": (c("cx1") + c("cx2")) / 2 / size,
        "yc": (c("cy1") + c("cy2")) / 2 / size,
        "bw": (c("cx2") - c("cx1")) / size,
        "bh": (c("cy2") - c("cy1")) / size,
    }
    return inside.withColumns(norm).where("bw > 0 AND bh > 0")


def tiles_touched(boxes: DataFrame, images: DataFrame, size: int = 1280, overlap: float = 0.0) -> DataFrame:
    """Boxes with each tile that they meet, be it in a line only."""
    step = g.tile_step(size, overlap)
    c = F.col
    met = boxes.join(images.select("image_id", "w", "h"), "image_id")
    for axis, extent in (("x", "w"), ("y", "h")):
        first = F.greatest(F.lit(0), F.ceil((c(f"{axis}1") - size) / step).cast("int"))
        last = F.least(F.ceil(c(extent) / step).cast("int") - 1, F.floor(c(f"{axis}2") / step).cast("int"))
        met = met.withColumns({"_a": first, "_b": last}).where("_a <= _b")
        met = met.withColumn(f"tile_{axis}", F.explode(F.sequence(c("_a") * step, c("_b") * step, F.lit(step)))).drop("_a", "_b")
    return met


def tile_class_counts(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("image_id", "tile_x", "tile_y", "class_id").agg(F.count("*").alias("n"))


def lost_boxes(boxes: DataFrame, tiled: DataFrame, key: list[str]) -> DataFrame:
    """Boxes that no tile keeps."""
    return boxes.join(tiled.select(*key).distinct(), key, "left_anti")


def with_page_rect(tiles: DataFrame, size: int = 1280) -> DataFrame:
    """tiles with a kind and px1 ... py2 of their image, and w, h: page_rect."""
    c = F.col
    scale_x, scale_y = (c("px2") - c("px1")) / c("w"), (c("py2") - c("py1")) / c("h")
    return tiles.withColumn("page_rect", g.page_rect(c("tile_x"), c("tile_y"), size, scale_x, scale_y, c("px1"), c("py1")))
