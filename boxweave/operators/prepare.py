"""The two preparation runs as one lazy plan each, but for the splits' rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import names as n
from ..sources.config import PrepareConfig
from ..storage import stored
from . import atoms as a
from . import labels as lb
from . import splits as sp
from . import tiling as t


def stratified(
    images: DataFrame, boxes: DataFrame, classes: DataFrame, space: lb.LabelSpace, config: PrepareConfig,
    order: Column | None = None,
) -> dict[str, DataFrame]:
    """Deployment pages, and the tiles of all other pages with atoms and splits.

    images: image_id, file_name, w, h; boxes: image_id, class_id, x1 ... y2.
    order: what puts pages and atoms in order, over a column ``key``.
    """
    order = sp.hashed_order(F.col("key"), config.seed) if order is None else order
    geo = n.source_geometry(F.col("file_name"), F.col("w"), F.col("h"))
    placed = images.withColumn("_g", geo).select("image_id", "file_name", "w", "h", "_g.*")
    kept = stored(lb.relabel(boxes, lb.policy_table(classes, space), space), "relabelled")

    counts = kept.join(placed.select("image_id", "page_key"), "image_id").groupBy("page_key", F.col("dst_id").alias("class_id")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("key", F.col("page_key").cast("string")).withColumn("ord", order).drop("key")
    held = sp.deployment_pages(counts, space.kept_ids, config.min_pages, config.max_pages)
    held_df = images.sparkSession.createDataFrame([(k,) for k in held], "page_key string")
    pool = placed.join(held_df, "page_key", "left_anti")

    grid = t.with_page_rect(t.tile_grid(pool, config.tile_size, config.overlap), config.tile_size)
    grid = grid.withColumn("tile_name", n.tile_name(n.stem(F.col("file_name")), F.col("tile_x"), F.col("tile_y")))
    step = g.tile_step(config.tile_size, config.overlap)
    # as many numbers for each image as its largest grid has tiles: no two tiles share one
    across, down = images.agg(F.max(F.ceil(F.col("w") / step)), F.max(F.ceil(F.col("h") / step))).first()
    row, column = F.expr(f"tile_y DIV {step}"), F.expr(f"tile_x DIV {step}")
    grid = grid.withColumn("tile_id", (F.col("image_id").cast("long") * int(down or 1) + row) * int(across or 1) + column)
    tiled = t.tile_boxes(kept, pool, config.tile_size, config.overlap, config.fit)

    members = stored(a.build_atoms(grid, pool).select("tile_id", "atom_id"), "atoms")
    keyed = members.select("atom_id").distinct().withColumn("key", F.col("atom_id").cast("string")).withColumn("ord", order).drop("key")
    ids = grid.select("image_id", "tile_x", "tile_y", "tile_id")
    tile_classes = tiled.join(ids, ["image_id", "tile_x", "tile_y"]).groupBy("tile_id", F.col("dst_id").alias("class_id")).agg(F.count("*").alias("n"))
    atom_classes = tile_classes.join(members, "tile_id").select("atom_id", "class_id").distinct()
    assigned = sp.stratified(keyed, atom_classes, space.kept_ids, config.fractions, config.min_test_atoms, config.min_valid_atoms)
    tiles = grid.join(members, "tile_id").join(assigned, "atom_id")
    return {
        "deployment": placed.join(held_df, "page_key", "left_semi"),
        "tiles": tiles,
        "boxes": tiled.join(tiles.select("image_id", "tile_x", "tile_y", "tile_name", "split"), ["image_id", "tile_x", "tile_y"]),
        "tile_classes": tile_classes,
    }


def page_grouped(images: DataFrame, annotations: DataFrame, classes: DataFrame, space: lb.LabelSpace, config: PrepareConfig, order: Column | None = None) -> dict[str, DataFrame]:
    """Train images dealt to train and valid by page, test as it is; relabelled
    annotations; a report.  images: split, file_name, stem."""
    order = sp.hashed_order(F.col("key"), config.seed) if order is None else order
    key = n.first_page_key(F.col("file_name")) if config.group_by_page else F.col("file_name")
    train = images.where("split = 'train'").withColumns({"name": F.col("file_name"), "page_key": key, "key": key}).withColumn("ord", order).drop("key")
    if config.group_by_page and config.valid_fraction > 0:
        dealt = sp.page_grouped(train.drop("split"), config.valid_fraction)
    else:
        dealt = sp.ungrouped(train.drop("split"), config.valid_fraction)
    files = dealt.select("split", "file_name", "stem").unionByName(images.where("split = 'test'").select("split", "file_name", "stem"))
    mine = annotations.where("split IN ('train', 'test')").drop("split").join(files, "stem")
    policy = lb.policy_table(classes, space)
    return {"images": files, "annotations": lb.relabel(mine, policy, space), "report": lb.filter_report(files, mine, policy, space)}
