"""Percentiles and medians by selection against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from frameflow.operators import agreement


def sample(n, seed=1):
    """Groups of very different sizes; many ties, wide ranges, negative and unknown values."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        value = rnd.choice([0.0, 1.5, -2.0]) if kind < .3 else rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 12) if kind < .95 else None
        out.append((i, min(3, int(rnd.expovariate(1))) if i % 50 else None, value, rnd.choice([0.1, 0.2, 0.7, 1.0, 0.0, 3.0])))
    return out


SCHEMA = "id long, g int, v double, w double"


@pytest.mark.parametrize("final", [agreement.FINAL_VALUES, 40, 3])
def test_percentiles_in_any_number_of_rounds(spark, monkeypatch, final):
    monkeypatch.setattr(agreement, "FINAL_VALUES", final)
    monkeypatch.setattr(agreement, "BINS", 8)
    rows, shares = sample(1500), (0.0, .25, .5, .9, .999, 1.0)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.p): r.value for r in agreement.percentiles(df, "v", "id", shares, part=["g"]).collect()}
    expected = {}
    for g in {r[1] for r in rows}:
        v = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        for p in shares:
            at = (len(v) - 1) * p
            low, high = v[int(at)], v[min(len(v) - 1, int(at) + (at > int(at)))]
            expected[g, p] = low + (high - low) * (at - int(at))
    assert got == expected
    v = sorted(r[2] for r in rows if r[2] is not None)
    near = {r.p: r.value for r in agreement.nearest_percentiles(df, "v", "id", shares).collect()}
    assert near == {p: v[min(len(v) - 1, int(len(v) * p))] for p in shares}


@pytest.mark.parametrize("final", [agreement.FINAL_VALUES, 5])
def test_weighted_median_meets_halves_exactly(spark, monkeypatch, final):
    monkeypatch.setattr(agreement, "FINAL_VALUES", final)
    rows = sample(700, 3) + [(-1, 99, 1.0, .1), (-2, 99, 2.0, .2), (-3, 99, 3.0, .3), (-4, 98, 30.0, 1.0)]
    got = {r.g: (r.total_weight, r.weighted_median) for r in agreement.weighted_median(spark.createDataFrame(rows, SCHEMA), ["g"], "v", "w", "id", min_total=.5).collect()}
    for g in {r[1] for r in rows}:
        used = sorted((v, round(w * 10)) for _, k, v, w in rows if k == g and v is not None and abs(v) <= 25 and w > 0)
        total, upto, median = sum(w for _, w in used), 0, None
        for v, w in used:
            upto += w
            if median is None and 2 * upto >= total:
                median = v
        assert got[g] == ((total / 10, median) if used else (None, None)), g
    assert got[99] == (.6, 2.0)  # .1 + .2 is half of .6, whatever doubles say


def test_no_rows_are_sorted(spark):
    df = spark.createDataFrame(sample(300), SCHEMA)
    for found in (agreement.latency_stats(df, "v", "id"), agreement.percentiles(df, "v", "id", (.5,)), agreement.weighted_median(df, ["g"], "v", "w", "id")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort " not in plan and "Window" not in plan


def test_nothing_to_select(spark):
    none = spark.createDataFrame([(1, 1, None, 1.0)], SCHEMA)
    assert agreement.percentiles(none, "v", "id", (.5,)).count() == 0 and agreement.nearest_percentiles(none, "v", "id", (.5,)).count() == 0
    assert agreement.weighted_median(none, ["g"], "v", "w", "id").collect()[0].weighted_median is None
