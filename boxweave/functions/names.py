"""What file names and label lines say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the grammar of image file names.
HASH_SUFFIX = r"(?i)\.rf\.[0-9a-f]+\.(jpe?g|png)$"
SUBREGION = r"(?i)^(.+?)_(?:png|jpg|jpeg)_[0-9]+_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)_(?:png|jpg|jpeg)$"
FULL = r"(?i)^(.+?)_(?:png|jpg|jpeg)$"
FIRST_KEY_TRIM = r"(?i)(_png_[0-9]+_[0-9]+_[0-9]+_[0-9]+_[0-9]+)?(\.rf\.[0-9a-f]+)?$"
MARKERS = ("_png", "_jpg", "_jpeg")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
TILE = r"^(.*)_slice_([0-9]+)_([0-9]+)$"

_BLANK = r"\s+"
_WHOLE = r"^[+-]?[0-9]+$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*IMAGE_EXTENSIONS)


def first_page_key(name: Column) -> Column:
    """The older key: the stem less hash and sub-tile, cut at the first marker
    that it has, by the markers' order."""
    # once, at the first place where it fits: an empty match at the end changes nothing
    trimmed = F.regexp_replace(stem(name), FIRST_KEY_TRIM, "")
    out = trimmed
    for marker in reversed(MARKERS):
        out = F.when(F.instr(trimmed, marker) > 0, F.substring_index(trimmed, marker, 1)).otherwise(out)
    return out


def source_geometry(name: Column, width: Column, height: Column) -> Column:
    """Page key, kind (subregion, full, unparsed) and rectangle on the page."""
    plain = F.regexp_replace(name, HASH_SUFFIX, "")
    sub, full = plain.rlike(SUBREGION), plain.rlike(FULL)
    part = lambda g: F.regexp_extract(plain, SUBREGION, g).cast("int")
    edge = lambda g, whole: F.when(sub, part(g)).otherwise(whole.cast("int"))
    return F.struct(
        F.when(sub, F.regexp_extract(plain, SUBREGION, 1)).when(full, F.regexp_extract(plain, FULL, 1)).otherwise(plain).alias("page_key"),
        F.when(sub, "subregion").when(full, "full").otherwise("unparsed").alias("kind"),
        edge(2, F.lit(0)).alias("px1"),
        edge(3, F.lit(0)).alias("py1"),
        edge(4, width).alias("px2"),
        edge(5, height).alias("py2"),
    )


def tile_name(image_stem: Column, tile_x: Column, tile_y: Column) -> Column:
    return F.concat_ws("_", image_stem, F.lit("slice"), tile_x.cast("string"), tile_y.cast("string"))


def tile_place(name: Column) -> Column:
    """The image stem and origin that a tile's name tells; nulls if it isn't one."""
    at = lambda g: F.regexp_extract(name, TILE, g)
    return F.when(name.rlike(TILE), F.struct(at(1).alias("stem"), at(2).cast("int").alias("tile_x"), at(3).cast("int").alias("tile_y")))


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, _BLANK, " ")), " ")


def strict_label(line: Column) -> Column:
    """Class and box of a line of five numbers; null for another number of
    tokens; an error for a token that is no number."""
    t = tokens(line)
    num = lambda k: F.get(t, F.lit(k)).cast("double")
    fields = [F.get(t, F.lit(0)).cast("int").alias("class_id"), *[num(k + 1).alias(n) for k, n in enumerate(("xc", "yc", "bw", "bh"))]]
    return F.when(F.size(t) == 5, F.struct(*fields))


def lenient_label(line: Column) -> Column:
    """Class and the rest of the line as it stands; null without a rest or where
    the class is no whole number."""
    t = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), _BLANK, 2)
    head = F.get(t, F.lit(0))
    fields = F.struct(head.cast("int").alias("class_id"), F.get(t, F.lit(1)).alias("rest"))
    return F.when((F.size(t) == 2) & head.rlike(_WHOLE), fields)
