"""Learning edit deltas from history: targets, families, blending, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import join_same
from .agreement import percentiles
from .neighbors import knn


def delta_targets(rows: DataFrame, parameters, *, value="final_{}", base="base_{}") -> DataFrame:
    """`delta_p` = final - baseline per parameter; temperature as a log ratio."""
    deltas = {}
    for p in parameters:
        now, before = F.col(value.format(p)), F.col(base.format(p))
        ratio = F.when((now > 0) & (before > 0), F.ln(now / before))
        deltas[f"delta_{p}"] = ratio if p == "temperature" else now - before
    return rows.withColumns(deltas)


def look_families(rows: DataFrame, deltas, families: int, seed: int = 7) -> DataFrame:
    """Cluster scaled deltas with bisecting k-means; adds `family`, NULL for rows that
    lack a delta.

    Deltas are scaled but not centred: a centre at exactly 0 cannot be split.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    stages = [VectorAssembler(inputCols=list(deltas), outputCol="_raw", handleInvalid="error"),
              StandardScaler(inputCol="_raw", outputCol="_scaled"),
              BisectingKMeans(featuresCol="_scaled", predictionCol="family", k=families, seed=seed)]
    whole = F.lit(True)
    for d in deltas:
        whole = whole & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    known = rows.where(whole)
    if known.isEmpty():
        return rows.withColumn("family", F.lit(None).cast("int"))
    found = Pipeline(stages=stages).fit(known).transform(known).drop("_raw", "_scaled")
    return found.unionByName(rows.where(~whole).withColumn("family", F.lit(None).cast("int")))


def knn_blend(rows: DataFrame, key: str, vec: str, family: str, deltas, k: int = 8,
              tau: float = 0.1) -> DataFrame:
    """Predict each row's deltas from its k nearest in the same family; a row without
    any has 0 neighbours and NULL predictions.

    Weights are softmax(similarity / tau); confidence is the mean similarity.
    """
    deltas = list(deltas)
    near = knn(rows, key, vec, k, part=[family]).withColumn("_sim", 1.0 - F.col("distance"))
    values = rows.select(F.col(key).alias("neighbor"), *deltas)
    weight = F.exp(F.col("_sim") / tau)
    blended = near.join(values, "neighbor").groupBy(family, key).agg(
        F.count(F.lit(1)).alias("n_neighbors"), F.avg("_sim").alias("confidence"),
        *[(F.sum(weight * F.col(d)) / F.sum(F.when(F.col(d).isNotNull(), weight))).alias(f"pred_{d}")
          for d in deltas])
    found = join_same(rows.select(family, key), blended, [family, key], "left")
    return found.withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0).cast("long")))


def clamp_to_family(predictions: DataFrame, history: DataFrame, family: str, deltas,
                    gate: Column | None = None, opt_out=()) -> DataFrame:
    """Keep predictions inside the range the family's history has shown.

    A family without history gives no prediction. Rows failing `gate` and parameters in `opt_out` get no prediction.
    """
    bounds = history.groupBy(family).agg(
        *[F.min(d).alias(f"_lo_{d}") for d in deltas], *[F.max(d).alias(f"_hi_{d}") for d in deltas])
    rows = join_same(predictions, bounds, [family], "left")
    gate = F.lit(True) if gate is None else gate
    clamped = {}
    for d in deltas:
        low, high, p = F.col(f"_lo_{d}"), F.col(f"_hi_{d}"), F.col(f"pred_{d}")
        value = F.when(p.isNotNull() & low.isNotNull(), F.least(high, F.greatest(low, p)))
        clamped[f"pred_{d}"] = F.lit(None).cast("double") if d in opt_out else F.when(gate, value)
    return rows.withColumns(clamped).drop(*[f"_lo_{d}" for d in deltas], *[f"_hi_{d}" for d in deltas])


def eval_vs_median(rows: DataFrame, family: str, key: str, actual: str, predicted: str) -> DataFrame:
    """Per family: error, sign agreement and coverage, and the error of giving
    everything the family's median."""
    medians = percentiles(rows, actual, key, (0.5,), part=[family]).select(
        family, F.col("value").alias("family_median"))
    joined = join_same(rows, medians, [family], "left")
    covered = F.col(predicted).isNotNull()
    same_sign = (F.signum(predicted) == F.signum(actual)).cast("double")
    return joined.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.avg(covered.cast("double")).alias("coverage"),
        F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"),
        F.avg(F.when(covered, same_sign)).alias("sign_agreement"),
        F.avg(F.when(covered, F.abs(F.col("family_median") - F.col(actual)))).alias("median_mae"))
