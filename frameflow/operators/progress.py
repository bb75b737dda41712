"""Job progress from event logs: attempts, state, rate, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .ordered import ordered_rows

RATE_WINDOW_MS = 60_000


def attempt_ledger(log: DataFrame, part, order, event: str = "event") -> DataFrame:
    """Current state and attempts of each item from its log of
    claim / complete / fail / requeue events.

    A requeue counts only while the item is running, that is directly after a
    claim. At the attempt cap the item is failed.
    """
    part = list(part)
    rows = ordered_rows(log, part, order).lag("_prev", event).result()
    before = F.coalesce(F.col(f"_prev.{event}"), F.lit(""))
    kind = (F.when(F.col(event) != "requeue", F.col(event))
            .when(before == "claim", "fail"))
    rows = rows.withColumn("_kind", kind).where(F.col("_kind").isin("claim", "complete", "fail"))
    folded = rows.groupBy(*part).agg(
        F.sum((F.col("_kind") == "fail").cast("long")).alias("attempts"),
        F.max_by("_kind", F.struct(*order)).alias("_last"))
    items = log.select(*part).distinct().join(folded, part, "left").fillna(0, ["attempts"])
    state = (F.when(F.col("_last") == "complete", "done").when(F.col("_last") == "claim", "running")
             .when((F.col("_last") == "fail") & (F.col("attempts") >= P.MAX_ATTEMPTS), "failed")
             .otherwise("pending"))
    return items.withColumn("state", state).withColumn(
        "is_pending", (state == "pending") & (F.col("attempts") < P.MAX_ATTEMPTS)).drop("_last")


def progress_rollup(items: DataFrame, job: str, state: str = "state") -> DataFrame:
    """Per job: counts by state and the final state."""
    def n(value):
        return F.sum((F.col(state) == value).cast("long"))
    return items.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"), n("done").alias("completed"), n("failed").alias("failed"),
    ).withColumn("final_state", F.when(F.col("failed") > 0, "failed").otherwise("done"))


def rolling_rate(samples: DataFrame, job: str, t_ms: str, seq: str, completed: str,
                 total: Column | None = None, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """Rate over the trailing window, and with `total` the seconds left at that rate
    (`eta_sec`).

    Time is cut into buckets of one window's length, so a window reaches over two of
    them: each sample lies in its bucket and, as what came before, in the next one. The
    window's first sample is found by an ordered merge per job and bucket: every sample
    also sends a probe to the time its window opens, and takes the next sample at or
    after it. NULL when nothing was gained in the window.
    """
    bucket = F.floor(F.col("_t") / window_ms)
    base = samples.select(job, F.col(t_ms).cast("long").alias("_t"), F.col(seq).cast("long").alias("_seq"),
                          F.col(completed).cast("long").alias("_c"))
    point, own = F.struct("_t", "_c"), F.struct("_t", "_c", "_seq")
    points = base.select(job, F.explode(F.array(bucket, bucket + 1)).alias("_bucket"), (-F.col("_t")).alias("_at"),
                         F.lit(0).alias("_probe"), (-F.col("_seq")).alias("_tie"), point.alias("_point"),
                         F.lit(None).cast("struct<_t:bigint,_c:bigint,_seq:bigint>").alias("_own"))
    probes = base.select(job, bucket.alias("_bucket"), (F.lit(window_ms) - F.col("_t")).alias("_at"), F.lit(1).alias("_probe"),
                         (-F.col("_seq")).alias("_tie"), F.lit(None).cast("struct<_t:bigint,_c:bigint>").alias("_point"), own.alias("_own"))
    merge = W.partitionBy(job, "_bucket").orderBy("_at", "_probe", "_tie").rowsBetween(W.unboundedPreceding, 0)
    merged = points.unionByName(probes).withColumn("_first", F.last("_point", ignorenulls=True).over(merge)).where("_probe = 1")
    dt = (F.col("_own._t") - F.col("_first._t")) / 1000.0
    dc = F.col("_own._c") - F.col("_first._c")
    out = merged.select(job, F.col("_own._t").alias(t_ms), F.col("_own._seq").alias(seq),
                        F.col("_own._c").alias(completed),
                        F.when((dt > 0) & (dc > 0), dc / dt).alias("rate"))
    if total is None:
        return out
    left = total - F.col(completed)
    return out.withColumn("eta_sec", F.when(left > 0, F.floor(left / F.col("rate")).cast("long")))


def change_feed(log: DataFrame, part, order, watched, max_rows=None) -> DataFrame:
    """Only the rows whose watched columns differ from the row before."""
    rows = ordered_rows(log, part, order, max_rows).lag("_prev", *watched).result()
    before = F.struct(*[F.col(f"_prev.{c}").alias(c) for c in watched])
    return rows.where(F.col("_prev").isNull()
                      | ~F.struct(*watched).eqNullSafe(before)).drop("_prev")
