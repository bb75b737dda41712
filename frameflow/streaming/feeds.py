"""Streams of measurements and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.measurements import MEASUREMENT_SCHEMA, latest_per_key, split_errors
from .keyed import in_order, plain, use_state_store, write_batch


def bank_measurements(spark: SparkSession, source: str, out: str, errors: str, checkpoint_dir: str):
    """Read JSON lines as they arrive; good rows and error rows are banked per
    batch, so a failing batch loses nothing that came before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = split_errors(batch)
        write_batch(good, out, batch_id)
        write_batch(bad, errors, batch_id)
        batch.unpersist()
    stream = spark.readStream.schema(MEASUREMENT_SCHEMA).json(source)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def current_measurements(spark: SparkSession, out: str) -> DataFrame:
    """The newest row per path over all banked batches."""
    return latest_per_key(spark.read.parquet(out), ("path",), ("batch",)).drop("batch")


def stream_rate(samples: DataFrame, *, job: str = "job", time: str = "ts", completed: str = "completed",
                window: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """Rate per job over a sliding window, first to last sample; NULL without gain."""
    sample = F.struct(F.col(time).alias("t"), F.col(completed).alias("c"))
    grouped = samples.withWatermark(time, late).groupBy(job, F.window(time, window, slide).alias("w")).agg(
        F.min(sample).alias("first"), F.max(sample).alias("last"))
    dt = F.col("last.t").cast("timestamp").cast("double") - F.col("first.t").cast("timestamp").cast("double")
    dc = F.col("last.c") - F.col("first.c")
    return grouped.select(job, F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                          F.when((dt > 0) & (dc > 0), dc / dt).alias("rate"))


def stream_sessions(events: DataFrame, *, key: str, time: str = "ts", gap: str = "4 hours",
                    late: str = "1 hour") -> DataFrame:
    """Sessions per key closed by a gap."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"),
                                             F.col("s.end").alias("end"), "n")


class ChangeProcessor(StatefulProcessor):
    """The order and the watched columns of the last row of every key."""

    def __init__(self, columns: list[str], order: list[str], watched: list[str], state: T.StructType, ttl_ms: int | None) -> None:
        self.columns, self.order, self.watched, self.schema, self.ttl_ms = columns, order, watched, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = in_order(rows, self.order)
        if not len(frames):
            return
        at, n = None, len(self.order)
        if self.last.exists():
            at = tuple(plain(v) for v in self.last.get())
        take, late = [], []
        for i, values in enumerate(zip(*(frames[c] for c in (*self.order, *self.watched)), strict=True)):
            now = tuple(plain(v) for v in values)
            if at is not None and now[:n] <= at[:n]:
                take.append(i)
                late.append(True)
                continue
            if at is None or now[n:] != at[n:]:
                take.append(i)
                late.append(False)
            at = now
        self.last.update(at)
        yield frames.iloc[take][self.columns].assign(late=late)

    def close(self) -> None:
        pass


def stream_changes(log: DataFrame, part, order, watched, ttl_ms: int | None = None) -> DataFrame:
    """part, order, watched, late: only the rows whose watched columns differ from the row
    of their key before, as `change_feed` gives them in batch.

    Rows that aren't after the last one of their key in an earlier micro-batch are given
    as `late`. With `ttl_ms` a key without rows for so long (of processing time) is
    forgotten; its next row counts as a change.
    """
    use_state_store(log.sparkSession)
    part, order, watched = list(part), list(order), list(watched)
    columns = [*part, *order, *watched]
    state = T.StructType([T.StructField(c, log.schema[c].dataType) for c in (*order, *watched)])
    out = T.StructType([*[T.StructField(c, log.schema[c].dataType) for c in columns], T.StructField("late", T.BooleanType())])
    return log.select(*columns).groupBy(*part).transformWithStateInPandas(
        ChangeProcessor(columns, order, watched, state, ttl_ms), out, "Append", "ProcessingTime" if ttl_ms else "None")
