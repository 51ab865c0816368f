"""Atoms: groups of tiles that share pixels of a page and must stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .components import connected
from .pairs import overlapping


def homogeneity(images: DataFrame) -> DataFrame:
    """Per page: its kinds, the number of distinct image sizes, and whether the
    whole page is one atom (its images' coordinates can't be compared)."""
    kinds, sizes = F.sort_array(F.collect_set("kind")), F.countDistinct("w", "h")
    pages = images.groupBy("page_key").agg(F.count("*").alias("n_images"), kinds.alias("kinds"), sizes.alias("n_sizes"))
    full = F.array_contains("kinds", "full")
    return pages.withColumn("collapsed", full & (F.array_contains("kinds", "subregion") | (F.col("n_sizes") > 1)))


def overlap_edges(tiles: DataFrame, eps: float = 1.0, cell: int = 4096) -> DataFrame:
    """Pairs (page_key, a_id, b_id) of tiles of a page that share over eps pixels
    on both axes."""
    flat = tiles.select("page_key", "tile_id", "page_rect.*")
    met = overlapping(flat, ["page_key"], "tile_id", cell, g.overlaps("a", "b", eps))
    return met.select("page_key", F.col("a.tile_id").alias("a_id"), F.col("b.tile_id").alias("b_id"))


def build_atoms(tiles: DataFrame, images: DataFrame, eps: float = 1.0) -> DataFrame:
    """tile_id, page_key, atom_id (the least tile_id of the atom).  tiles: tile_id,
    page_key and page_rect; images: page_key, kind, w and h."""
    flags = homogeneity(images).select("page_key", "collapsed")
    marked = tiles.join(flags, "page_key", "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(False)))
    edges = overlap_edges(marked.where(~F.col("collapsed")), eps)
    labels = connected(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    whole = marked.where("collapsed").groupBy("page_key").agg(F.min("tile_id").alias("_whole"))
    out = marked.join(labels, marked["tile_id"] == labels["id"], "left").join(whole, "page_key", "left")
    return out.select("tile_id", "page_key", F.coalesce("_whole", "component_id", "tile_id").alias("atom_id"))
