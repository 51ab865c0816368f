"""Class counts of label files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names as n


def label_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """stem, class_id, rest of each line of new label files."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    named = lines.select(n.lenient_label(F.col("value")).alias("_l"), n.stem(n.base_name(F.col("_metadata.file_path"))).alias("stem"))
    return named.where("_l IS NOT NULL").select("stem", "_l.*")


def count_classes(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts by class in a memory table of this name."""
    counts = stream.groupBy("class_id").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
