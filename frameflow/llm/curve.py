"""Shards along a Hilbert curve through several metadata dimensions, DataFrame only.

Rows that are close in all dimensions get nearby curve numbers, so each shard covers
small ranges of every dimension and readers can skip most shards by their min and max.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ordered_rows
from ..runtime import small

SHARDS, BITS = 16, 4
#: Most cells of the grid; the table of cells is bounded by it.
MOST_CELLS = 1 << 16
#: A cell's rows are numbered in parts of about so many rows of the table.
PART_ROWS = 1 << 20


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def value_cuts(rows: DataFrame, name: str, total: int, shares: Sequence[float]) -> list:
    """The least values at which the shares of all rows are passed, in the values' own order
    (of all bytes of a string): the distinct values are counted and summed up in order."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered_rows(counts, (), (name,)).running_sum("_upto", F.col("_n")).result()
    known = counts.agg(F.sum("_n")).first()[0] or 0
    needs = [s * total - (total - known) for s in shares]  # nulls lie before all values
    found = upto.agg(*[F.min(F.when(F.col("_upto") > need, F.col(name))) for need in needs]).first()
    return [v for v in found if v is not None]


def cell_of(value: Column, cuts: Sequence) -> Column:
    """How many cuts lie at or below the value; none for null."""
    steps = [F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts]
    return sum(steps[1:], steps[0]) if steps else F.lit(0)


def hilbert(axes: Column, dims: int, bits: int) -> Column:
    """Curve number of a cell, given as an array of `dims` integers of `bits` bits."""
    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")

    def turn(x: Column, i: int, q: Column) -> Column:
        low = q - 1
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(
            x[i].bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when(
            (j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))
    # one axis after the other within one bit plane; planes from the highest
    order = F.transform(F.flatten(F.transform(planes, lambda q: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.struct(q.alias("q"), i.alias("i"))))), lambda s: s)

    def step(x: Column, s: Column) -> Column:
        out = x
        for i in reversed(range(dims)):
            out = F.when(s["i"] == i, turn(x, i, s["q"])).otherwise(out) if i < dims - 1 else turn(x, i, s["q"])
        return out
    unturned = F.aggregate(order, axes, step)
    # one pass of `aggregate` hands a finished array to the next expression
    gray = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(
        F.slice(unturned, F.lit(1), i + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    flip = F.aggregate(planes, F.lit(0), lambda t, q: F.when(
        F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    places = F.sequence(F.lit(0), F.lit(dims * bits - 1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a * 2 + (F.shiftright(
        gray[k % dims].bitwiseXOR(flip), 0) / F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / dims))).cast("long") % 2)


def assign(documents: DataFrame, dimensions: Sequence[str], key: str = "doc_id", text: str = "text", *,
           shards: int = SHARDS, bits: int = BITS, carry: Sequence[str] = ()) -> DataFrame:
    """Cut all documents into `shards` runs along the curve, as even in rows as can be.

    Result: key, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, law
    ("rows"), shard, slot (gapless from 0 in each shard), grown_shard (null), curve (the
    cell's number) and the columns in `carry`. A dimension is a number, date or string;
    each is cut at its quantiles over all rows, a string by the order of all its bytes; null
    lies before all values. Ties on the
    curve are ordered by a hash of key and text, then by key. Rows with a null key and
    repeated rows get places of their own. An empty table gives no rows.
    """
    if not dimensions or len(dimensions) * bits > MOST_CELLS.bit_length() - 1:
        raise ValueError(f"one dimension at least, and {MOST_CELLS} cells at most")
    if clash := {"size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve", key} & set(carry):
        raise ValueError(f"the result has columns of its own by these names: {sorted(clash)}")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("_key"), (F.octet_length(value) + 1).cast("long").alias("_size"),
                            F.crc32(value.cast("binary")).alias("_crc"), *[F.col(c) for c in carry],
                            *[(F.col(d).cast("double") if is_number(documents, d) else F.col(d)).alias(f"_d{i}") for i, d in enumerate(dimensions)])
    shares = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    numbers = [i for i, d in enumerate(dimensions) if is_number(documents, d)]
    seen = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(f"_d{i}", shares, 10_000) for i in numbers]).first()
    total = seen[0]
    cuts = [sorted({c for c in (seen[1 + numbers.index(i)] if i in numbers else value_cuts(rows, f"_d{i}", total, shares)) or []})
            for i in range(len(dimensions))]
    axes = F.array(*[cell_of(F.col(f"_d{i}"), c) for i, c in enumerate(cuts)])
    parts = max(16, min(4096, total // PART_ROWS))
    rows = rows.withColumn("_cell", axes).withColumn("_part", F.pmod(F.xxhash64("_key", "_crc"), F.lit(parts)).cast("int"))

    amounts = rows.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    amounts = amounts.withColumn("_before", F.sum("_n").over(within) - F.col("_n"))
    cells = amounts.groupBy("_cell").agg(F.sum("_n").alias("_n"))
    cells = cells.withColumn("curve", hilbert(F.col("_cell"), len(dimensions), bits))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, 0)  # at most MOST_CELLS rows
    cells = cells.select("_cell", "curve", (F.sum("_n").over(along) - F.col("_n")).alias("_base"))
    places = amounts.drop("_n").join(small(cells, 1 << len(dimensions) * bits), "_cell")
    order = Window.partitionBy("_cell", "_part").orderBy("_key", "_crc")
    ranked = rows.withColumn("_i", F.row_number().over(order) - 1).join(places, ["_cell", "_part"])
    ranked = ranked.withColumn("_pos", F.col("_base") + F.col("_before") + F.col("_i"))
    shard = F.expr(f"_pos * {shards} div {max(total, 1)}")
    ranked = ranked.withColumn("_shard", shard)
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return ranked.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                         F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
                         (F.col("_pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         "curve", *carry)


def write(assigned: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order, for min and max pruning by readers."""
    (assigned.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("error").parquet(path))
