"""Splitting an ordered sequence where a boundary condition holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.vectors import cosine_distance
from .ordered import OrderedRows, ordered_rows


def sessionize(df: DataFrame, part, order, time_col: str, gap, name: str = "session",
               max_rows=None) -> DataFrame:
    """Number sessions per key from 1; a new one starts after more than `gap`."""
    rows = ordered_rows(df, part, order, max_rows).lag("_prev", time_col)
    new = F.col("_prev").isNull() | (F.col(time_col) - F.col(f"_prev.{time_col}") > gap)
    return rows.running_sum(name, new.cast("long")).result().drop("_prev")


def capture_steps(df: DataFrame, *, part="shoot_id", time="t_ms", key="photo_id", vec="vec",
                  extra=(), distance=cosine_distance, max_rows=None) -> OrderedRows:
    """Dated captures in order, each with `prev`, `gap_ms` and `step_dist`."""
    dated = df.where(F.col(time).isNotNull())
    rows = ordered_rows(dated, (part,), (time, key), max_rows)
    rows = rows.lag("prev", key, time, vec, *extra)
    return rows.with_columns({
        "gap_ms": F.col(time) - F.col(f"prev.{time}"),
        "step_dist": F.when(F.col("prev").isNotNull(),
                            distance(F.col(f"prev.{vec}"), F.col(vec))),
    })


def scene_boundary() -> Column:
    """A long gap always splits; a short one only together with a new view."""
    return (F.col("prev").isNull() | (F.col("gap_ms") > P.SCENE_GAP_MS)
            | ((F.col("gap_ms") > P.SCENE_SHORT_GAP_MS) & (F.col("step_dist") > P.SCENE_DIST)))


def group_scenes(steps: OrderedRows, name: str = "scene") -> OrderedRows:
    """Number the scenes of each shoot from 1."""
    return steps.running_sum(name, scene_boundary().cast("long"))


def bracket_runs(steps: OrderedRows, *, bias="bias", name: str = "run") -> OrderedRows:
    """Number maximal runs of close, similar frames whose bias keeps changing."""
    linked = ((F.col("gap_ms") <= P.BRACKET_GAP_MS) & (F.col("step_dist") <= P.BRACKET_DIST)
              & (F.col(bias) != F.col(f"prev.{bias}")))
    return steps.running_sum(name, (~F.coalesce(linked, F.lit(False))).cast("long"))


def bracket_stats(runs: OrderedRows, *, part="shoot_id", time="t_ms", key="photo_id",
                  bias="bias", name: str = "run") -> DataFrame:
    """One row per run of at least three frames, with its verdict.

    Valid: no bias repeats, the extremes straddle 0 and are symmetric.
    """
    per_run = runs.df.groupBy(part, name).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(bias).alias("n_bias"),
        F.min(bias).alias("lo"), F.max(bias).alias("hi"),
        F.min(time).alias("start_ms"),
        F.min_by(key, F.struct(time, key)).alias("first_id"))
    valid = ((F.col("n_bias") == F.col("n")) & (F.col("lo") < 0) & (F.col("hi") > 0)
             & (F.abs(F.col("lo") + F.col("hi")) <= P.BRACKET_SYMMETRY))
    return per_run.where(F.col("n") >= P.BRACKET_MIN_FRAMES).withColumn("valid", valid)


def mark_brackets(steps: OrderedRows, *, part="shoot_id", time="t_ms", key="photo_id",
                  bias="bias") -> OrderedRows:
    """Add `run` and `bracket`, the run number where the run is a valid bracket.

    While a key fits one task its runs do too, and windows over (key, run) need
    no further shuffle. Split keys get the verdicts by a join.
    """
    runs = bracket_runs(steps, bias=bias)
    if runs.chunks:
        valid = (bracket_stats(runs, part=part, time=time, key=key, bias=bias).where("valid")
                 .select(F.col(part).alias("_part"), F.col("run").alias("bracket")))
        on = F.col(part).eqNullSafe(F.col("_part")) & (F.col("run") == F.col("bracket"))
        joined = runs.df.join(valid, on, "left").drop("_part")
        return OrderedRows(joined, runs.part, runs.order, runs.chunks)
    run = W.partitionBy(part, "run")
    same = F.lag(bias).over(run.orderBy(bias)) == F.col(bias)
    rows = runs.df.withColumn("_same", F.coalesce(same, F.lit(False)))
    low, high = F.min(bias).over(run), F.max(bias).over(run)
    valid = ((F.count(F.lit(1)).over(run) >= P.BRACKET_MIN_FRAMES) & ~F.max("_same").over(run)
             & (low < 0) & (high > 0) & (F.abs(low + high) <= P.BRACKET_SYMMETRY))
    rows = rows.withColumn("bracket", F.when(valid, F.col("run"))).drop("_same")
    return OrderedRows(rows, runs.part, runs.order)


def segment_sizes(df: DataFrame, part, segment) -> DataFrame:
    return df.groupBy(*part, segment).agg(F.count(F.lit(1)).alias("size"))


def group_stats(sizes: DataFrame, size: str = "size") -> DataFrame:
    """Groups, singletons and upper median size, the element n/2 of the sorted sizes.

    Works on the histogram of sizes, so its cost follows the number of
    different sizes and not the number of groups.
    """
    histogram = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("c"))
    total = histogram.agg(
        F.sum("c").alias("groups"),
        F.coalesce(F.sum(F.when(F.col(size) == 1, F.col("c"))), F.lit(0)).alias("singletons"))
    rows = ordered_rows(histogram, (), (size,)).running_sum("_upto", F.col("c")).result()
    median = (rows.join(F.broadcast(total))
              .where(F.col("_upto") > F.floor(F.col("groups") / 2))
              .agg(F.min(size).alias("median_size")))
    return total.join(F.broadcast(median)).select(
        F.col("groups").cast("long"), F.col("singletons").cast("long"),
        F.col("median_size").cast("long"))


def flicker_rate(steps: OrderedRows, *, count="face_count") -> DataFrame:
    """Share of near-identical consecutive pairs whose count differs anyway."""
    near = (F.col("step_dist") <= P.FLICKER_DIST) & (F.col("gap_ms") <= P.FLICKER_GAP_MS)
    differs = (F.col(count) != F.col(f"prev.{count}")).cast("double")
    return steps.df.where(near).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(differs), 6).alias("flicker_rate"))


def pair_distances(steps: OrderedRows) -> DataFrame:
    """Distances of consecutive pairs close in time."""
    return steps.df.where(F.col("gap_ms") <= P.FLICKER_GAP_MS).select("step_dist")
