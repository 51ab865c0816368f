"""Boxes and tiles as column expressions, in pixels unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_step(size: int, overlap: float) -> int:
    """Pixels between tile origins; the product is cut, not rounded."""
    step = int(size * (1 - overlap))
    if not 0 <= overlap < 1 or step < 1:
        raise ValueError(f"an overlap of {overlap} leaves no step between tiles of {size}")
    return step


def tile_origins(extent: Column, step: int) -> Column:
    """0, step, 2 * step, ... below the extent; empty for an empty extent."""
    ext = extent.cast("int")
    return F.when(ext > 0, F.sequence(F.lit(0), ext - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def tile_range(low: Column, high: Column, extent: Column, size: int, step: int) -> tuple[Column, Column]:
    """First and last index of the tiles that share more than a line with
    [low, high); last < first if there is none."""
    first = F.greatest(F.lit(0), F.floor((low - size) / step).cast("int") + 1)
    last = F.least(F.ceil(extent / step).cast("int") - 1, F.ceil(high / step).cast("int") - 1)
    return first, last


def intersection(a: str, b: str) -> Column:
    """Shared area of the boxes of two aliases; 0 if they don't meet."""
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def touches(x1: Column, y1: Column, x2: Column, y2: Column, tile_x: Column, tile_y: Column, size: int) -> Column:
    """Whether a box meets a tile, be it in a line only; a coarser test than the
    one which decides what a tile keeps."""
    return (x2 >= tile_x) & (x1 <= tile_x + size) & (y2 >= tile_y) & (y1 <= tile_y + size)


def area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def iou(inter: Column, union: Column) -> Column:
    """Intersection over union; 0 where the union isn't positive."""
    return F.when((union > 0) & (inter > 0), inter / union).otherwise(F.lit(0.0))


def overlaps(a: str, b: str, eps: float = 1.0) -> Column:
    """Whether two boxes share more than eps pixels on both axes."""
    return (
        (F.col(f"{a}.x2") > F.col(f"{b}.x1") + eps) & (F.col(f"{b}.x2") > F.col(f"{a}.x1") + eps)
        & (F.col(f"{a}.y2") > F.col(f"{b}.y1") + eps) & (F.col(f"{b}.y2") > F.col(f"{a}.y1") + eps)
    )


def corners(xc: Column, yc: Column, bw: Column, bh: Column, w: Column, h: Column) -> dict[str, Column]:
    """Pixel corners of a normalised centre and size."""
    x, y, dx, dy = xc * w, yc * h, bw * w / 2, bh * h / 2
    return {"x1": x - dx, "y1": y - dy, "x2": x + dx, "y2": y + dy}


def rounded_corners(xc: Column, yc: Column, bw: Column, bh: Column, w: Column, h: Column) -> dict[str, Column]:
    """Whole pixels, halves to even; the near corner is held at 0, the far one
    inside the image."""
    at = lambda v, extent: F.bround(v * extent).cast("int")
    return {
        "x1": F.greatest(F.lit(0), at(xc - bw / 2, w)),
        "y1": F.greatest(F.lit(0), at(yc - bh / 2, h)),
        "x2": F.least((w - 1).cast("int"), at(xc + bw / 2, w)),
        "y2": F.least((h - 1).cast("int"), at(yc + bh / 2, h)),
    }


def lifted(local: Column, offset: Column, extent: Column) -> Column:
    """A tile's local coordinate, cut to whole pixels, on the image and inside it."""
    return F.least(extent.cast("int") - 1, F.greatest(F.lit(0), local.cast("int") + offset.cast("int")))


def page_rect(tile_x: Column, tile_y: Column, size: int, scale_x: Column, scale_y: Column, page_x: Column, page_y: Column) -> Column:
    """A whole tile's rectangle on its page, though it may end past the image."""
    return F.struct(
        (page_x + tile_x * scale_x).cast("double").alias("x1"),
        (page_y + tile_y * scale_y).cast("double").alias("y1"),
        (page_x + (tile_x + size) * scale_x).cast("double").alias("x2"),
        (page_y + (tile_y + size) * scale_y).cast("double").alias("y2"),
    )
