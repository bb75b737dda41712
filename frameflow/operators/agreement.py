"""Comparing two measurements of the same items, and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint, join_same
from .ordered import row_numbers


def ranked(rows: DataFrame, column: str, key: str, name: str, descending: bool = False) -> DataFrame:
    """Ordinal rank from 1 over the whole table; ties in key order."""
    value = -F.col(column) if descending else F.col(column)
    keyed = rows.withColumn("_value", value)
    return row_numbers(keyed, (), ("_value", key), name).drop("_value")


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rank correlation on ordinal ranks; NaN when there is no variance."""
    both = ranked(checkpoint(ranked(rows.select(key, a, b), a, key, "_ra")), b, key, "_rb")
    stats = both.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("r"))
    return stats.select("n", F.coalesce("r", F.lit(float("nan"))).alias("spearman"))


def rank_disagreement(rows: DataFrame, a: str, b: str, key: str, n: int = 5) -> DataFrame:
    """The items whose rank (best first) differs most; ties keep the order of a."""
    both = ranked(checkpoint(ranked(rows.select(key, a, b), a, key, "rank_a", True)),
                  b, key, "rank_b", True)
    gap = F.abs(F.col("rank_a") - F.col("rank_b"))
    return (both.withColumn("rank_gap", gap).orderBy(F.desc("rank_gap"), key).limit(n)
            .select(key, (F.col("rank_a") - 1).alias("rank_a"),
                    (F.col("rank_b") - 1).alias("rank_b"), "rank_gap"))


def count_agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.agg(F.sum((a == b).cast("long")).alias("agree"), F.count(F.lit(1)).alias("n"),
                    F.sum(a).alias("total_a"), F.sum(b).alias("total_b"))


#: Distinct values of a target that are looked through at once, and the bins of a round.
FINAL_VALUES, BINS = 4096, 256


def select_at(values: DataFrame, part, targets: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """(part, name, value): for each target (part, name, need) the smallest value at which the
    running weight of its part reaches `need`; the largest value if none does.

    Selection by counting, without a sort of the rows: weights are summed per distinct
    value; while a target has more than FINAL_VALUES candidates, these are counted in
    BINS about equally full bins, and only the bin in which `need` lies goes on. Weights
    are integers or decimals, so sums don't depend on their order.
    """
    part = list(part)
    total = values.groupBy(*part, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    open_ = join_same(total, targets, part) if part else total.join(F.broadcast(targets))
    keys = [*part, "name"]
    open_ = open_.withColumn("_before", F.col("need") * 0)
    done = None
    while True:
        sizes = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        many = sizes.where(F.col("_n") > FINAL_VALUES).drop("_n")
        if many.isEmpty():
            break
        many = checkpoint(many)
        few = join_same(open_, many, keys, "left_anti")
        done = few if done is None else done.unionByName(few)
        open_ = checkpoint(_refined(join_same(open_, many, keys, "left_semi"), keys))  # `done` reads the one before
    rows = open_ if done is None else done.unionByName(open_)
    listed = rows.groupBy(*keys, "need", "_before").agg(F.array_sort(F.collect_list(F.struct("_v", "_w"))).alias("_l"))
    found = F.aggregate("_l", F.struct(F.col("_before").alias("sum"), F.lit(False).alias("hit"), F.get("_l", F.lit(0))["_v"].alias("v")), _reach(listed))
    return listed.select(*keys, found["v"].alias("value"))


def _reach(listed: DataFrame):
    kind = dict(listed.dtypes)["_before"]

    def step(acc, x):
        after = (acc["sum"] + x["_w"]).cast(kind)
        return F.struct(after.alias("sum"), (acc["hit"] | (after >= F.col("need"))).alias("hit"),
                        F.when(acc["hit"], acc["v"]).otherwise(x["_v"]).alias("v"))
    return step


def _refined(rows: DataFrame, keys) -> DataFrame:
    """The candidates of the one bin that holds `need`, with the weight before it."""
    kind = dict(rows.dtypes)["_before"]
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", shares, 10_000).alias("_cuts"))
    binned = join_same(rows, cuts, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = binned.groupBy(*keys, "need", "_before", "_bin").agg(F.sum("_w").alias("_w"))
    listed = sums.groupBy(*keys, "need", "_before").agg(F.array_sort(F.collect_list(F.struct("_bin", "_w"))).alias("_l"))

    def step(acc, x):
        after = (acc["sum"] + x["_w"]).cast(kind)
        return F.struct(after.alias("sum"), F.when(acc["hit"], acc["before"]).otherwise(acc["sum"]).alias("before"),
                        (acc["hit"] | (after >= F.col("need"))).alias("hit"), F.when(acc["hit"], acc["bin"]).otherwise(x["_bin"]).alias("bin"))
    start = F.struct(F.col("_before").alias("sum"), F.col("_before").alias("before"), F.lit(False).alias("hit"), F.lit(0).alias("bin"))
    chosen = listed.select(*keys, F.aggregate("_l", start, step).alias("_c"))
    chosen = chosen.select(*keys, F.col("_c.bin").alias("_bin"), F.col("_c.before").alias("_at"))
    kept = join_same(binned, chosen, [*keys, "_bin"]).withColumn("_before", F.col("_at").cast(kind))
    return kept.drop("_at", "_bin")


def nearest_percentiles(rows: DataFrame, column: str, key: str, shares) -> DataFrame:
    """Sorted element int(n * p), not beyond the last; one row (p, value) per share.
    Unknown values are left out."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.lit(1).cast("long").alias("weight"))
    n = known.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    need = F.least(F.col("_n"), F.floor(F.col("_n") * F.col("name")) + 1).cast("long")
    targets = n.select("_n", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("name")).select("name", need.alias("need"))
    return select_at(known, [], targets).withColumnRenamed("name", "p")


def percentiles(rows: DataFrame, column: str, key: str, shares, part=()) -> DataFrame:
    """Interpolated percentiles (part, p, value), exact for any number of rows; unknown
    values are left out."""
    part = list(part)
    known = rows.where(F.col(column).isNotNull()).select(*part, F.col(column).alias("value"), F.lit(1).cast("long").alias("weight"))
    n = known.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    at = (F.col("_n") - 1) * F.col("p")
    wanted = n.select(*part, "_n", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("p"))
    ends = wanted.select(*part, F.explode(F.array(*[F.struct(
        F.struct("p", (at - F.floor(at)).alias("frac"), F.lit(high).alias("high")).alias("name"),
        ((F.ceil(at) if high else F.floor(at)) + 1).cast("long").alias("need")) for high in (False, True)])).alias("t"))
    found = select_at(known, part, ends.select(*part, "t.name", "t.need"))
    low, high = (F.max(F.when(F.col("name.high") == h, F.col("value"))) for h in (False, True))
    frac = F.max("name.frac")
    return found.groupBy(*part, F.col("name.p").alias("p")).agg((low + (high - low) * frac).alias("value"))


def latency_stats(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Median, p90, p99 and the hours 10,000 items would take at the median."""
    marks = nearest_percentiles(rows, column, key, (0.9, 0.99)).agg(
        F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("p90"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99"))
    median = percentiles(rows, column, key, (0.5,)).select(F.col("value").alias("median"))
    return median.join(F.broadcast(marks)).select(
        "median", "p90", "p99", (F.col("median") * 10_000 / 3600).alias("hours_10k"))


WEIGHT = "decimal(28,9)"


def weighted_median(rows: DataFrame, part, value: str, weight: str, key: str, *,
                    max_abs: float = 25.0, min_total: Column | float = 0.0) -> DataFrame:
    """First value whose running weight reaches half the total.

    Only values within max_abs count; NULL where their weight is below min_total. Weights
    are summed as decimals of nine places, so that halves are met exactly.
    """
    part = list(part)
    used = rows.where((F.abs(F.col(value)) <= max_abs) & (F.col(weight) > 0)).select(
        *part, F.col(value).alias("value"), F.col(weight).cast(WEIGHT).alias("weight"))
    totals = used.groupBy(*part).agg(F.sum("weight").alias("_total"))
    targets = totals.select(*part, F.lit("half").alias("name"), (F.col("_total") / 2).cast("decimal(38,10)").alias("need"))
    everyone = join_same(rows.select(*part).distinct(), totals, part, "left")
    limit = min_total if isinstance(min_total, Column) else F.lit(float(min_total))
    hits = select_at(used, part, targets).select(*part, F.col("value").alias("_median"))
    joined = join_same(everyone, hits, part, "left").withColumn("total_weight", F.col("_total").cast("double"))
    return joined.select(*part, "total_weight", F.when(F.col("total_weight") >= limit, F.col("_median")).alias("weighted_median"))
