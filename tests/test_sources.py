import struct
import zlib

import pytest
from pyspark.sql import functions as F

from boxweave.operators import prepare
from boxweave.operators.labels import LabelSpace
from boxweave.sources import config, sinks
from boxweave.sources.dataset import Dataset, class_names, per_image


def png(w, h):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + b"\7\7\7" * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture()
def root(tmp_path):
    for folder, stems in {"train": ["a+1", "b"], "val": ["c"], "valid": ["d"], "nolabels": ["e"]}.items():
        (tmp_path / folder / "images").mkdir(parents=True)
        if folder != "nolabels":
            (tmp_path / folder / "labels").mkdir()
        for s in stems:
            (tmp_path / folder / "images" / f"{s}.PNG").write_bytes(png(6, 4))
    (tmp_path / "train/images/notes.md").write_text("x")
    (tmp_path / "train/images/broken.png").write_bytes(b"no image")
    (tmp_path / "train/labels/a+1.txt").write_text("1 .5 .5 .1 .1\n\n0 .5 .5 .2\n 2  .1 .2 .3 .4 \n")
    (tmp_path / "val/labels/c.txt").write_text("")
    (tmp_path / "data.yaml").write_text("names: {1: b, 0: '007', 2: c}\ntrain: elsewhere\n")
    return tmp_path


def test_dataset(spark, root):
    ds = Dataset.open(spark, str(root))
    assert ds.names == ["007", "b", "c"] and ds.folders == {"train": "train", "valid": "val"}
    assert sorted((r.split, r.stem) for r in ds.images().collect()) == [("train", "a+1"), ("train", "b"), ("train", "broken"), ("valid", "c")]
    assert sorted((r.stem, r.w, r.h) for r in ds.image_sizes().collect()) == [("a+1", 6, 4), ("b", 6, 4), ("c", 6, 4)]
    assert sorted((r.split, r.stem, r.class_id, r.bh) for r in ds.annotations().collect()) == [("train", "a+1", 1, 0.1), ("train", "a+1", 2, 0.4)]
    assert sorted(r.rest for r in ds.raw_annotations().collect()) == [".1 .2 .3 .4", ".5 .5 .1 .1", ".5 .5 .2"]
    assert {r.stem: len(r.rows) for r in per_image(ds.images(), ds.annotations()).collect()} == {"a+1": 2, "b": 0, "broken": 0, "c": 0}
    ds.register()
    assert spark.sql("SELECT count(*) FROM annotations").first()[0] == 2


def test_split_is_told_below_the_root(spark, tmp_path):
    """A folder named as a split above the root says nothing."""
    root = tmp_path / "test" / "images" / "a b"
    for folder in ("images", "labels"):
        (root / "train" / folder).mkdir(parents=True)
    (root / "train/images/x y.png").write_bytes(png(2, 2))
    (root / "train/labels/x y.txt").write_text("0 .5 .5 .1 .1\n")
    (root / "data.yaml").write_text("names: [a]")
    ds = Dataset.open(spark, str(root))
    assert [r.split for df in (ds.images(), ds.image_sizes(), ds.annotations()) for r in df.collect()] == ["train"] * 3
    assert [r.stem for df in (ds.images(), ds.image_sizes(), ds.annotations()) for r in df.collect()] == ["x y"] * 3


def test_dataset_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset.open(spark, str(tmp_path))
    (tmp_path / "data.yaml").write_text("x: 1")
    with pytest.raises(ValueError, match="names"):
        Dataset.open(spark, str(tmp_path))
    (tmp_path / "data.yaml").write_text("names: [a]")
    with pytest.raises(ValueError, match="split"):
        Dataset.open(spark, str(tmp_path))
    with pytest.raises(ValueError):
        class_names("a")


def test_label_files(spark, root, tmp_path):
    ds = Dataset.open(spark, str(root))
    lines = ds.raw_annotations().select("split", "stem", "line_no", F.concat_ws(" ", "class_id", "rest").alias("line"))
    out = tmp_path / "out"
    sinks.export_label_files(sinks.label_texts(ds.images(), lines), str(out))
    assert (out / "train/labels/a+1.txt").read_text() == "1 .5 .5 .1 .1\n0 .5 .5 .2\n2 .1 .2 .3 .4\n"
    assert (out / "train/labels/b.txt").read_text() == ""


def test_tile_label_texts(spark):
    tiles = spark.createDataFrame([("train", "a_slice_0_0"), ("test", "b_slice_0_0")], "split string, tile_name string")
    boxes = spark.createDataFrame([("train", "a_slice_0_0", 2, 1, 0.5, 0.25, 0.1, 0.2), ("train", "a_slice_0_0", 1, 0, 1 / 3, 0.5, 0.1, 0.2)], "split string, tile_name string, det_id long, dst_id int, xc double, yc double, bw double, bh double")
    got = {r.stem: r.text for r in sinks.tile_label_texts(tiles, boxes).collect()}
    assert got == {"a_slice_0_0": "0 0.333333 0.500000 0.100000 0.200000\n1 0.500000 0.250000 0.100000 0.200000\n", "b_slice_0_0": ""}


def test_moved_catalogue():
    assert config.parse_yaml(sinks.moved_data_yaml("path: /a\nnames: [x]\n", "/b")) == {"path": "/b", "names": ["x"]}


def test_data_yaml(spark, tmp_path):
    text = sinks.data_yaml("/x", ["a", "b"], False, True)
    assert config.parse_yaml(text) == {"path": "/x", "train": "train/images", "nc": 2, "names": ["a", "b"], "val": "test/images", "test": "test/images"}
    sinks.write_text(spark, f"file://{tmp_path}/data.yaml", text)
    assert (tmp_path / "data.yaml").read_text() == text


def test_config(tmp_path):
    assert config.parse_yaml("") == {}
    space = config.label_space({"kept_classes": ["0038", 40], "class_groups": {"g": ["0038"]}, "other_policy": "background"})
    assert space.labels == ["g", "40", "__background__"]
    assert config.PrepareConfig.of({"seed": 7}).seed == 7
    nested = config.parse_yaml("""
split:
  mode: page_grouped
  seed: 7
  group_by_page_prefix: false
  stratified_tile: {train_fraction: 0.7, valid_fraction: 0.2, min_test_atoms_per_class: 4}
  drawing_test: {enabled: true, min_clusters_per_class: 2, max_clusters: null}
slicing: {slice_size: 640, overlap: 0.25, fit_box_to_slice: true}
training: {epochs: 50}
inference: {slice_size: 320, model_input_size: 640, conf_threshold: 0.5, nms_iou_threshold: 0.6}
""")
    c = config.PrepareConfig.of(nested)
    assert (c.mode, c.seed, c.group_by_page, c.min_test_atoms, c.min_valid_atoms, c.min_pages, c.max_pages) == ("page_grouped", 7, False, 4, 3, 2, None)
    assert c.fractions == {"train": 0.7, "valid": 0.2, "test": 0.12} and (c.tile_size, c.overlap, c.fit) == (640, 0.25, True)
    assert config.PrepareConfig.of({"split": {"drawing_test": {"enabled": False}}}).max_pages == 0
    assert config.InferenceConfig.of(nested) == config.InferenceConfig(320, 0.25, 0.5, 16, 0.6)
    for wrong in ({"seed": 7, "unknown": 1}, {"split": {"sed": 7}}, {"split": {"stratified_tile": {"x": 1}}}, {"split": {}, "slicing": {"size": 3}}):
        with pytest.raises(ValueError, match="unknown"):
            config.PrepareConfig.of(wrong)
    with pytest.raises(ValueError):
        config.PrepareConfig(mode="other")
    assert config.resolve("a/b", "/r") == "/r/a/b" and config.resolve("/a") == "/a" and config.resolve("s3://a") == "s3://a"


def test_prepare_runs(spark):
    images = spark.createDataFrame([(i, f"{i // 2:02d}_png_{i % 2}_0_{i % 2 * 100}_100_{i % 2 * 100 + 100}_png.rf.a{i}.jpg", 100, 100) for i in range(40)], "image_id long, file_name string, w int, h int")
    boxes = spark.createDataFrame([(i, i % 3, 10.0 * k, 5.0, 10.0 * k + 8, 20.0) for i in range(40) for k in range(5)], "image_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, name string")
    conf = config.PrepareConfig(tile_size=50, min_test_atoms=2, min_valid_atoms=1)
    out = prepare.stratified(images, boxes, classes, LabelSpace(["a", "b"]), conf)
    tiles = {r.tile_id: r.split for r in out["tiles"].collect()}
    held = {r.page_key for r in out["deployment"].collect()}
    assert set(tiles.values()) == {"train", "valid", "test"} and held and len(tiles) == (40 - 2 * len(held)) * 4
    from boxweave.operators import verify

    verify.verify(out["tiles"], out["deployment"])
    files = images.select(F.lit("train").alias("split"), "file_name", F.col("image_id").cast("string").alias("stem"))
    ann = boxes.select(F.lit("train").alias("split"), F.col("image_id").cast("string").alias("stem"), "class_id")
    grouped = prepare.page_grouped(files, ann, classes, LabelSpace(["a"], policy="drop"), conf)
    assert {r["split"]: r["count"] for r in grouped["images"].groupBy("split").count().collect()} == {"train": 36, "valid": 4}
    assert grouped["annotations"].count() == 70


def test_label_stream(spark, tmp_path):
    from boxweave.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 .5 .5 .1 .1\n1 .2 .2 .1 .1\nx\n")
    query = watch.count_classes(watch.label_stream(spark, str(tmp_path / "in")), "arrived", str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("arrived").collect()] == [(1, 2)]
