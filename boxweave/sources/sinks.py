"""Writing datasets, reports and detections.  Tables are written anew each time:
nothing of an earlier run stays."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = "split") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def label_texts(images: DataFrame, lines: DataFrame) -> DataFrame:
    """split, stem, text of a label file for every image: lines (line_no, line) in
    order, each ended, and nothing for an image without any."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    files = lines.groupBy("split", "stem").agg(F.concat(text, F.lit("\n")).alias("text"))
    return images.select("split", "stem").join(files, ["split", "stem"], "left").na.fill("", ["text"])


def yolo_line(class_id: str = "dst_id") -> F.Column:
    """A label line with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", F.col(class_id), F.col("xc"), F.col("yc"), F.col("bw"), F.col("bh"))


def tile_label_texts(tiles: DataFrame, boxes: DataFrame, class_id: str = "dst_id", order: str = "det_id") -> DataFrame:
    """split, stem, text of a label file for every tile (split, tile_name), of the
    boxes (split, tile_name, xc ... bh) that it keeps, in their order."""
    lines = boxes.select("split", F.col("tile_name").alias("stem"), F.col(order).alias("line_no"), yolo_line(class_id).alias("line"))
    return label_texts(tiles.select("split", F.col("tile_name").alias("stem")), lines)


def export_label_files(texts: DataFrame, root: str) -> None:
    """Label files <root>/<split>/labels/<stem>.txt, where root is a folder that
    all executors share as a path of their file systems."""

    def write(rows: Iterable[Row]) -> None:
        for r in rows:
            folder = Path(root, r["split"], "labels")
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{r['stem']}.txt").write_text(r["text"])

    texts.select("split", "stem", "text").foreachPartition(write)


def data_yaml(root: str, labels: list[str], has_valid: bool, has_test: bool) -> str:
    """The catalogue of a written dataset; without a valid split, test is val."""
    import yaml

    data = {"path": root, "train": "train/images", "nc": len(labels), "names": list(labels)}
    if has_valid or has_test:
        data["val"] = "valid/images" if has_valid else "test/images"
    if has_test:
        data["test"] = "test/images"
    return yaml.safe_dump(data, sort_keys=False)


def moved_data_yaml(text: str, root: str) -> str:
    """A catalogue for a copy of its dataset at another place."""
    import yaml

    return yaml.safe_dump({**(yaml.safe_load(text) or {}), "path": root}, sort_keys=False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver, to any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_class_csv(table: DataFrame, path: str) -> None:
    """The class table, most frequent first, then by name."""
    cols = ["class_id", "name", "train_count", "test_count", "total_count"]
    table.select(*cols).orderBy(F.desc("total_count"), "name").write.mode("overwrite").option("header", True).csv(path)


def write_detections(per_image: DataFrame, path: str) -> None:
    per_image.write.mode("overwrite").json(path)
