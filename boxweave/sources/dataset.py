"""A dataset on a file tree: data.yaml, and per split images/ and labels/.

Everything is read by Spark's readers, so any store that Spark knows will do.
Image bytes are read only where ``image_sizes`` or ``pixels`` is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as n
from ..storage import file_system
from .config import parse_yaml

#: Folder to split; a later folder takes the place of an earlier one of its split.
FOLDERS = {"train": "train", "valid": "valid", "test": "test", "val": "valid"}


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def decoded_path(path: Column) -> Column:
    """A path that a reader gives as part of a URL."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def class_names(given: list | dict) -> list[str]:
    """Names by position: of a list, or of a dict by its keys as numbers."""
    if isinstance(given, dict):
        given = [given[k] for k in sorted(given, key=int)]
    if not isinstance(given, list):
        raise ValueError("names must be a list or a dict")
    return [str(x) for x in given]


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    root: str
    names: list[str]
    folders: dict[str, str]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        root = root.rstrip("/")
        if not path_exists(spark, f"{root}/data.yaml"):
            raise FileNotFoundError(f"{root}/data.yaml")
        config = parse_yaml(spark.read.text(f"{root}/data.yaml", wholetext=True).first()["value"])
        if "names" not in config:
            raise ValueError("data.yaml has no names")
        found = {s: f for f, s in FOLDERS.items() if all(path_exists(spark, f"{root}/{f}/{d}") for d in ("images", "labels"))}
        if not found:
            raise ValueError(f"{root} has no split with images and labels")
        return cls(spark, root, class_names(config["names"]), found)

    def classes(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.names)), "class_id int, name string")

    def _of(self, df: DataFrame, folder: str, path_col: str, coded: bool = False) -> DataFrame:
        # told by the folder that a file lies in below the root, as the store spells the root
        fs, p = file_system(self.spark, self.root)
        root = fs.makeQualified(p).toUri().getPath().rstrip("/")
        inner = F.regexp_replace(F.col(path_col), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        if coded:
            inner = decoded_path(inner)
        split = F.lit(None).cast("string")
        for s, f in self.folders.items():
            split = F.when(inner.startswith(f"{root}/{f}/{folder}/"), s).otherwise(split)
        return df.withColumn("split", split)

    def _paths(self, folder: str) -> list[str]:
        return [f"{self.root}/{f}/{folder}" for f in self.folders.values()]

    def images(self) -> DataFrame:
        """split, file_name, stem, path of each image, of all splits."""
        files = self._of(self.spark.read.format("binaryFile").load(self._paths("images")).select("path"), "images", "path")
        out = files.withColumn("file_name", n.base_name(F.col("path"))).where(n.is_image(F.col("file_name")))
        return out.withColumn("stem", n.stem(F.col("file_name"))).select("split", "file_name", "stem", "path")

    def image_sizes(self) -> DataFrame:
        """images with w and h; those that can't be decoded are left out."""
        decoded = self.spark.read.format("image").option("dropInvalid", True).load(self._paths("images"))
        files = self._of(decoded.select("image.origin", F.col("image.width").alias("w"), F.col("image.height").alias("h")), "images", "origin", coded=True)
        out = files.withColumn("file_name", n.base_name(decoded_path(F.col("origin")))).where(n.is_image(F.col("file_name")))
        return out.withColumn("stem", n.stem(F.col("file_name"))).select("split", "file_name", "stem", "w", "h")

    def pixels(self) -> DataFrame:
        """file_name and the decoded raster, for operators that need it."""
        decoded = self.spark.read.format("image").option("dropInvalid", True).load(self._paths("images"))
        return decoded.select(n.base_name(decoded_path(F.col("image.origin"))).alias("file_name"), "image.*")

    def label_lines(self) -> DataFrame:
        """split, stem, line_no, line of all label files."""
        files = self.spark.read.text(self._paths("labels"), wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
        rows = self._of(files, "labels", "path", coded=True).withColumn("stem", n.stem(n.base_name(decoded_path(F.col("path")))))
        return rows.select("split", "stem", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))

    def annotations(self) -> DataFrame:
        """Boxes of lines of five numbers; a token that is no number is an error."""
        rows = self.label_lines().withColumn("_l", n.strict_label(F.col("line"))).where("_l IS NOT NULL")
        return rows.select("split", "stem", "line_no", "_l.*")

    def raw_annotations(self) -> DataFrame:
        """class_id and the rest as it stands, of every line that has both."""
        rows = self.label_lines().withColumn("_l", n.lenient_label(F.col("line"))).where("_l IS NOT NULL")
        return rows.select("split", "stem", "line_no", "_l.*")

    def register(self) -> None:
        """Temporary views classes, images and annotations."""
        self.classes().createOrReplaceTempView("classes")
        self.images().createOrReplaceTempView("images")
        self.annotations().createOrReplaceTempView("annotations")


def per_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with the list of its annotations, empty where it has none."""
    cols = [c for c in annotations.columns if c not in ("split", "stem")]
    lists = annotations.groupBy("split", "stem").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))
    return images.join(lists, ["split", "stem"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)))
