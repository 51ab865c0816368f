import pytest
from pyspark.sql import functions as F

from boxweave.functions import geometry as g
from boxweave.functions import names as n


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("size", "overlap", "step"), [(1280, 0.0, 1280), (1280, 0.25, 960), (100, 0.9, 9)]
)
def test_tile_step(size, overlap, step):
    assert g.tile_step(size, overlap) == step


@pytest.mark.parametrize("overlap", [1.0, -0.1, 0.9999])
def test_tile_step_refuses(overlap):
    with pytest.raises(ValueError):
        g.tile_step(1280, overlap)


def test_tile_origins(spark):
    got = col(spark, [3000, 1280, 1000, 0], lambda v: g.tile_origins(v, 1280), "int")
    assert got == [[0, 1280, 2560], [0], [0], []]
    assert col(spark, [1280, 2048], lambda v: g.tile_origins(v, 960), "int") == [[0, 960], [0, 960, 1920]]


def test_page_keys(spark):
    names = ["00_png.rf.21a3.jpg", "00_png_1_0_2700_3600_5400_png.rf.b612.jpg", "a_png_b_png.rf.ab.jpg", "p_jpg_1_0_0_100_200_png.rf.0f.jpg", "A_PNG.rf.AB.JPG", "foo.rf.ab.jpg", "plan.jpg"]
    assert col(spark, names, n.first_page_key) == ["00", "00", "a", "p_jpg_1_0_0_100_200", "A_PNG", "foo", "plan"]
    geo = col(spark, names, lambda v: n.source_geometry(v, F.lit(7), F.lit(8)))
    assert [(r.page_key, r.kind) for r in geo] == [("00", "full"), ("00", "subregion"), ("a_png_b", "full"), ("p", "subregion"), ("A", "full"), ("foo", "unparsed"), ("plan.jpg", "unparsed")]
    assert [getattr(geo[1], k) for k in ("px1", "py1", "px2", "py2")] == [0, 2700, 3600, 5400]
    assert [getattr(geo[0], k) for k in ("px1", "py1", "px2", "py2")] == [0, 0, 7, 8]


def test_labels(spark):
    lines = ["3 0.5 0.5 0.1 0.1", "3 0.5 0.5 0.1", "3 .1 .2 .3 .4 .5 .6", "3", "", None, "\t4  .5 .5 .1   .2 "]
    strict = col(spark, lines, n.strict_label)
    assert [r and r.class_id for r in strict] == [3, None, None, None, None, None, 4]
    lenient = col(spark, [*lines, "x 0.5 0.5 0.1 0.1", "3.7 1"], n.lenient_label)
    assert [r and (r.class_id, r.rest) for r in lenient] == [(3, "0.5 0.5 0.1 0.1"), (3, "0.5 0.5 0.1"), (3, ".1 .2 .3 .4 .5 .6"), None, None, None, (4, ".5 .5 .1   .2"), None, None]


def test_strict_label_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        col(spark, ["x 0.5 0.5 0.1 0.1"], n.strict_label)


def test_rounding_is_half_to_even(spark):
    assert col(spark, [2.5, 3.5], F.bround, "double") == [2, 4]


def test_tile_place(spark):
    got = col(spark, ["a_slice_1_slice_20_30", "a"], n.tile_place)
    assert (got[0].stem, got[0].tile_x, got[0].tile_y) == ("a_slice_1", 20, 30) and got[1] is None
