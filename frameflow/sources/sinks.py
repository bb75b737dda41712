"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str = "shoot_id") -> None:
    """Overwrite only the shoots present in df; others keep their files.

    Rebalancing writes few files per shoot and still splits a huge shoot.
    """
    (df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))


def append_selection(entries: DataFrame, path: str) -> None:
    """Selections are never changed once written, only added."""
    entries.write.mode("append").partitionBy("selection_id").parquet(path)


def editable(selections: DataFrame) -> DataFrame:
    """Selections that may still change: not exported."""
    return selections.where("exported_at IS NULL")


def export_list(entries: DataFrame, path: str) -> DataFrame:
    """path and state of the frames to deliver."""
    return entries.where(F.col("state").isin("pick", "alt")).select(F.col(path).alias("path"), "state")


def write_export_list(entries: DataFrame, path: str, out: str) -> None:
    export_list(entries, path).write.mode("overwrite").option("header", "true").csv(out)
