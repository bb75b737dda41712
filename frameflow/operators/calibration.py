"""Thresholds and decisions measured against labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 100  # thresholds 0.00, 0.01 .. 1.00


def class_counts(rows: DataFrame, score: str, is_open: Column, part=()) -> DataFrame:
    """Histogram of scores by the first threshold step that flags them.

    A score is flagged closed when it is below the threshold, so it belongs to
    the step floor(score * 100) + 1 or, where floating error matters, the
    neighbour that satisfies score < step / 100.
    """
    guess = F.floor(F.col(score) * STEPS).cast("long")
    step = F.when(F.col(score) < guess / STEPS, guess).when(
        F.col(score) < (guess + 1) / STEPS, guess + 1).otherwise(guess + 2)
    clipped = F.greatest(F.lit(0), F.least(F.lit(STEPS + 1), step))
    return rows.where(F.col(score).isNotNull()).groupBy(*part, clipped.alias("step")).agg(
        F.sum(is_open.cast("long")).alias("open"), F.sum((~is_open).cast("long")).alias("closed"))


def sweep(rows: DataFrame, score: str, is_open: Column, part=()) -> DataFrame:
    """False reject, false accept and balanced accuracy at every threshold.

    One pass over the rows makes a histogram of 102 steps; the rest works on it.
    """
    part = list(part)
    counts = class_counts(rows, score, is_open, part)
    grid = F.explode(F.sequence(F.lit(0), F.lit(STEPS + 1))).alias("step")
    steps = (counts.select(*part).distinct() if part else counts.limit(1)).select(*part, grid)
    full = steps.join(counts, [*part, "step"], "left").fillna(0, ["open", "closed"])
    whole = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    below = whole.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    full = full.select(
        *part, "step", F.sum("open").over(below).alias("_fr"), F.sum("open").over(whole).alias("_open"),
        F.sum("closed").over(whole).alias("_closed"), F.sum("closed").over(below).alias("_flagged"))
    fr = F.col("_fr") / F.nullif("_open", F.lit(0))
    fa = (F.col("_closed") - F.col("_flagged")) / F.nullif("_closed", F.lit(0))
    return full.where(F.col("step") <= STEPS).select(
        *part, (F.col("step") / STEPS).alias("threshold"), fr.alias("false_reject"),
        fa.alias("false_accept"), (((1 - fr) + (1 - fa)) / 2).alias("balanced_accuracy"))


def best_threshold(rows: DataFrame, score: str, is_open: Column, part=()) -> DataFrame:
    """Highest balanced accuracy; equal ones go to the lower threshold.

    Accuracies are compared after rounding, so ties do not hang on the last bit.
    """
    part = list(part)
    fields = ["threshold", "false_reject", "false_accept", "balanced_accuracy"]
    order = F.struct(F.round("balanced_accuracy", 9).alias("b"), (-F.col("threshold")).alias("t"))
    return (sweep(rows, score, is_open, part).groupBy(*part)
            .agg(F.max_by(F.struct(*fields), order).alias("r")).select(*part, "r.*"))


def evaluate(rows: DataFrame, score: str, is_open: Column, threshold: float, part=()) -> DataFrame:
    """Rates at one threshold; a score below it is flagged closed."""
    low = F.col(score) < threshold
    fr = F.avg(F.when(is_open, low.cast("double")))
    fa = F.avg(F.when(~is_open, (~low).cast("double")))
    return rows.where(F.col(score).isNotNull()).groupBy(*part).agg(
        fr.alias("false_reject"), fa.alias("false_accept"),
        (((1 - fr) + (1 - fa)) / 2).alias("balanced_accuracy"))


def label_report(rows: DataFrame, score: str, label: str, source: str,
                 positive: str = "open", negative: str = "closed") -> DataFrame:
    """Coverage and class means per source; other labels do not count."""
    is_open, is_closed = F.col(label) == positive, F.col(label) == negative
    return rows.where(is_open | is_closed).groupBy(source).agg(
        F.count(F.lit(1)).alias("labelled"), F.count(score).alias("measured"),
        F.count(F.when(is_open, F.col(score))).alias("n_positive"),
        F.count(F.when(is_closed, F.col(score))).alias("n_negative"),
        F.avg(F.when(is_open, F.col(score))).alias("mean_positive"),
        F.avg(F.when(is_closed, F.col(score))).alias("mean_negative"))


def label_precision(items: DataFrame, labels: DataFrame, key: str, source: str) -> DataFrame:
    """Counts per source and label, unlabelled included, and the precision."""
    rows = items.join(labels.select(key, "label"), key, "left")

    def n(value):
        return F.sum((F.coalesce("label", F.lit("unlabelled")) == value).cast("long"))
    counts = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("total"), n("real").alias("real"), n("not_face").alias("not_face"),
        n("unclear").alias("unclear"), n("unlabelled").alias("unlabelled"))
    judged = F.col("real") + F.col("not_face")
    return counts.withColumn("precision", F.when(judged > 0, F.col("real") / judged))


def override_agreement(rows: DataFrame, engine: str, user: str, part=()) -> DataFrame:
    """Agreement with the user, and how often a frame the user picked was rejected."""
    return rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(engine) == F.col(user)).cast("double")).alias("agreement"),
        F.avg(F.when(F.col(user) == "pick", (F.col(engine) == "reject").cast("double")))
        .alias("false_reject"))


def refit_weights(rows: DataFrame, metrics, label: str, prior: dict[str, float],
                  strength: float = 10.0, most_rounds: int = 100) -> dict[str, float]:
    """Logistic fit of a label on metric values, pulled toward prior weights.

    Minimises mean loss plus strength/n * |w - prior|^2 by Newton steps, each one
    aggregation over the table that returns the gradient and the curvature (a number
    per pair of metrics), until a step no longer moves; an error if that never happens.
    A NULL metric adds nothing, as in the score.
    """
    metrics = list(metrics)
    values = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics] + [F.lit(1.0)]
    data = rows.select(*metrics, F.col(label).cast("double").alias("_y")).where("_y IS NOT NULL")
    n = data.count()
    if n == 0:
        return dict(prior)
    goal = np.array([prior[m] for m in metrics] + [0.0])
    pull = np.array([2 * strength / n] * len(metrics) + [0.0])
    w = goal.copy()
    size = len(values)

    def sums(w: np.ndarray):
        z = sum((v * float(x) for v, x in zip(values, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.avg(F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z))) - F.col("_y") * z)
        got = data.agg(loss, *[F.avg((p - F.col("_y")) * v) for v in values],
                       *[F.avg(p * (1 - p) * values[i] * values[j]) for i in range(size) for j in range(size)]).first()
        return got[0] + (pull / 2 * (w - goal) ** 2).sum(), np.array(got[1:size + 1]), np.array(got[size + 1:]).reshape(size, size)
    loss, gradient, curvature = sums(w)
    for _ in range(most_rounds):
        step = np.linalg.solve(curvature + np.diag(pull + 1e-9), gradient + pull * (w - goal))
        if np.abs(step).max() < 1e-9:
            return dict(zip(metrics, w[:-1].tolist(), strict=True))
        scale = 1.0
        while True:  # shorter until the loss falls
            tried = sums(w - scale * step)
            if tried[0] <= loss or scale < 1e-6:
                break
            scale /= 2
        w = w - scale * step
        loss, gradient, curvature = tried
    raise RuntimeError(f"the fit still moves after {most_rounds} rounds")
