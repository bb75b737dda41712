"""Ordered scans that stay distributed when one partition key is huge.

A window over a key runs in one task per key. `ordered_rows` measures the keys
first, in bytes. While every key fits MAX_GROUP_BYTES the plain window is used. Beyond
that the rows are range-partitioned by (key, order) into ranges of that size, every
range is scanned on its own, and what one range hands to the next (last row, running
total, largest or last value) is computed over one summary row per range and joined
back. Summaries combine in any grouping: fractional sums are taken as decimals, so the
result doesn't depend on where ranges begin.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpoint, shuffle_partitions, small

#: About how much of one key a task sorts and scans.
MAX_GROUP_BYTES = 128 << 20
#: Rows looked at for the size of arrays, and what a row and a column take besides.
SAMPLE_ROWS, ROW_BYTES, FIXED_BYTES = 64, 48, 16
EXACT = "decimal(38,12)"
#: Every range is a task with a result to the driver in each step, so their number doesn't
#: follow the rows while ranges have room.
RANGES_PER_PARTITION = 4


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a total order inside each key; `chunks` > 0 when split."""

    df: DataFrame
    part: tuple[str, ...]
    order: tuple[str, ...]
    chunks: int = 0

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.part, "_chunk") if self.chunks else self.part

    def window(self):
        spec = W.partitionBy(*self.keys) if self.keys else W.partitionBy(F.lit(0))
        return spec.orderBy(*self.order)

    def with_columns(self, columns: dict[str, Column]) -> OrderedRows:
        return replace(self, df=self.df.withColumns(columns))

    def select(self, *columns) -> OrderedRows:
        keep = ("_chunk",) if self.chunks else ()
        return replace(self, df=self.df.select(*columns, *keep))

    def result(self) -> DataFrame:
        return self.df.drop("_chunk") if self.chunks else self.df

    def lag(self, name: str, *columns: str) -> OrderedRows:
        """Add struct `name` with `columns` of the previous row, NULL at a start."""
        row = F.struct(*columns)
        df = self.df.withColumn(name, F.lag(row).over(self.window()))
        if self.chunks:
            last = F.max_by(row, F.struct(*self.order))
            carry = self._carry(self.df, last, lambda w: F.lag("_end").over(w))
            df = self._join(df, carry).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
        return replace(self, df=df)

    def running_sum(self, name: str, value: Column) -> OrderedRows:
        """Add the sum of `value` from the key's first row to this one; NULL before the
        first known value. Fractions are summed to twelve places."""
        kind = self.df.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            exact = self.running_sum(name, value.cast(EXACT))
            return exact.with_columns({name: F.col(name).cast("double")})
        frame = self.window().rowsBetween(W.unboundedPreceding, 0)
        df = self.df.withColumn(name, F.sum(value).over(frame))
        if self.chunks:
            carry = self._carry(
                self.df, F.sum(value),
                lambda w: F.sum("_end").over(w.rowsBetween(W.unboundedPreceding, -1)))
            df = self._join(df, carry).withColumn(
                name, F.when(F.col(name).isNotNull() | F.col("_carry").isNotNull(),
                             F.coalesce(name, F.lit(0)) + F.coalesce("_carry", F.lit(0)))).drop("_carry")
        return replace(self, df=df)

    def running_max(self, name: str, value: Column) -> OrderedRows:
        """Add the largest known `value` from the key's first row to this one."""
        df = self.df.withColumn(name, F.max(value).over(self.window().rowsBetween(W.unboundedPreceding, 0)))
        if self.chunks:
            carry = self._carry(
                self.df, F.max(value),
                lambda w: F.max("_end").over(w.rowsBetween(W.unboundedPreceding, -1)))
            df = self._join(df, carry).withColumn(name, F.greatest(name, "_carry")).drop("_carry")
        return replace(self, df=df)

    def running_last(self, name: str, value: Column) -> OrderedRows:
        """Add the latest non-NULL `value` at or before this row."""
        frame = self.window().rowsBetween(W.unboundedPreceding, 0)
        df = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
        if self.chunks:
            at = F.when(value.isNotNull(), F.struct(*self.order))
            carry = self._carry(
                self.df, F.max_by(value, at),
                lambda w: F.last("_end", ignorenulls=True).over(
                    w.rowsBetween(W.unboundedPreceding, -1)))
            df = self._join(df, carry).withColumn(
                name, F.coalesce(name, "_carry")).drop("_carry")
        return replace(self, df=df)

    def row_number(self, name: str) -> OrderedRows:
        if not self.chunks:
            return self.with_columns({name: F.row_number().over(self.window()).cast("long")})
        return self.running_sum(name, F.lit(1).cast("long"))

    def _carry(self, df, end, over):
        """What each range receives from the ranges before it in the same key;
        at most one row per range, because a key can only enter a range once."""
        ends = df.groupBy(*self.keys).agg(end.alias("_end"))
        spec = (W.partitionBy(*self.part) if self.part else W.partitionBy(F.lit(0))).orderBy("_chunk")
        return ends.select(*self.keys, over(spec).alias("_carry")).where("_carry IS NOT NULL")

    def _join(self, df, carry):
        right = carry.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], "_carry")
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        joined = df.join(small(right, self.chunks), on, "left")
        return joined.drop(*[f"_k_{k}" for k in self.keys])


def row_bytes(df: DataFrame) -> int:
    """About what a row of df takes, by the arrays, maps and blobs of a few rows."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType))]
    known = ROW_BYTES + FIXED_BYTES * len(df.columns)
    if not wide:
        return known
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in wide])))  # at least what it takes in memory
    return known + int(df.select(*wide).limit(SAMPLE_ROWS).agg(F.avg(size)).first()[0] or 0)


def ordered_rows(df: DataFrame, part, order, max_rows: int | None = None) -> OrderedRows:
    """Prepare df for ordered scans. Runs one count per key to find hot keys; `max_rows`
    sets the rows of a range instead of MAX_GROUP_BYTES, up to RANGES_PER_PARTITION ranges
    per shuffle partition; ranges grow beyond that, up to MAX_GROUP_BYTES.

    `order` must be a total order within `part`.
    """
    part, order = tuple(part), tuple(order)
    full = max(1, MAX_GROUP_BYTES // row_bytes(df))
    limit = max_rows or full
    size = df.groupBy(*part).count().agg(
        F.max("count").alias("top"), F.sum("count").alias("rows")).first()
    if (size.top or 0) <= limit:
        return OrderedRows(df, part, order)
    partitions = shuffle_partitions(df.sparkSession)
    wanted = min(2 * ceil(size.rows / limit), RANGES_PER_PARTITION * partitions)
    chunks = max(partitions, wanted, 2 * ceil(size.rows / full))
    ranged = df.repartitionByRange(chunks, *part, *order)
    return OrderedRows(checkpoint(ranged.withColumn("_chunk", F.spark_partition_id())),
                       part, order, chunks)


def row_numbers(df: DataFrame, part, order, name: str = "pos", max_rows=None) -> DataFrame:
    """Number the rows of each key from 1; safe for keys of any size."""
    return ordered_rows(df, part, order, max_rows).row_number(name).result()
