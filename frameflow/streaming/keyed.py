"""What the streams with state per key have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of several variables, timers and expiry need the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order; those without a place in it left out."""
    every = [r for r in rows if len(r)]
    if not every:
        return pd.DataFrame()
    return pd.concat(every, ignore_index=True).dropna(subset=order).sort_values(order, kind="stable", ignore_index=True)


def plain(value):
    """A cell as the state store takes it: no numpy types, None for every kind of missing."""
    if value is None or isinstance(value, (list, str)):
        return value
    if hasattr(value, "tolist"):
        value = value.tolist()
    return value if isinstance(value, list) or not pd.isna(value) else None


def split_output(late: str, out_path: str, late_path: str):
    """foreachBatch target: rows go to `out_path`, those with a true column `late` to
    `late_path`. A batch that is run again replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        write_batch(batch.where(f"NOT {late}").drop(late), out_path, batch_id)
        write_batch(batch.where(late).drop(late), late_path, batch_id)
        batch.unpersist()
    return write


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch's rows; running the batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
