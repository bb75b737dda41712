"""Manifests of crops to label and the labels given to them, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .measurements import box_struct

MANIFEST_SCHEMA = ("photo string, key string, bbox array<double>, blend double, ear double, crop string, "
                   "who string, score double")
LABEL_SCHEMA = "crop string, label string"
UNLABELLED = "unlabelled"
ORDER = ("file", "block", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, line: the lines of all files, in an order that is their order in
    each file, however the files are split over tasks."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("line"))


def manifest_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """photo, key, bbox (x, y, w, h), blend, ear, crop, who, score of readable lines with a
    crop or key; fields a line lacks are unknown."""
    rows = lines.select(F.from_json(value, MANIFEST_SCHEMA).alias("m")).select("m.*")
    return rows.where("crop IS NOT NULL OR key IS NOT NULL").withColumn("bbox", box_struct(F.col("bbox")))


def label_rows(lines: DataFrame, value: str = "value", order=ORDER) -> DataFrame:
    """crop, label: the last label given to each crop; unreadable lines are left out."""
    rows = lines.select(F.from_json(value, LABEL_SCHEMA).alias("l"), F.struct(*order).alias("_at")).select("l.*", "_at")
    known = rows.where("crop IS NOT NULL AND label IS NOT NULL")
    return known.groupBy("crop").agg(F.max_by("label", "_at").alias("label"))


def labelled(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """The manifest with `label`; crops nobody has labelled are UNLABELLED."""
    return manifest.join(labels, "crop", "left").withColumn("label", F.coalesce("label", F.lit(UNLABELLED)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(read_lines(spark, path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return label_rows(read_lines(spark, path))
