"""Scans over split keys give what plain windows give."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameflow import runtime
from frameflow.operators import ordered
from frameflow.operators.ordered import ordered_rows, row_numbers


def _data(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randrange(40), i, rnd.choice([None, 1, 2, 5]))
            for i in range(n)]
    return spark.createDataFrame(rows, "p int, t int, id int, v int")


def test_split_scans_equal_windows(spark):
    df = _data(spark)
    w = W.partitionBy("p").orderBy("t", "id")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    wanted = df.select("id", F.lag("v").over(w).alias("lag"), F.lag("id").over(w).alias("lag_id"),
                       F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(running)).alias("total"),
                       F.last("v", ignorenulls=True).over(running).alias("latest"),
                       F.row_number().over(w).alias("rn"))
    rows = ordered_rows(df, ("p",), ("t", "id"), max_rows=20)
    assert rows.chunks > 1
    rows = (rows.lag("prev", "v", "id").running_sum("total", F.coalesce("v", F.lit(0)))
            .running_last("latest", F.col("v")).row_number("rn"))
    got = rows.result().select("id", F.col("prev.v").alias("lag"), F.col("prev.id").alias("lag_id"),
                               "total", "latest", "rn")
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_one_key_holding_everything(spark):
    df = spark.range(500).select(F.lit(1).alias("p"), F.lit(7).alias("t"), "id")
    got = row_numbers(df, ("p",), ("t", "id"), "rn", max_rows=10)
    assert got.where("rn <> id + 1").count() == 0


def test_global_order(spark):
    got = row_numbers(spark.range(300), (), ("id",), "rn", max_rows=25)
    assert got.where("rn <> id + 1").count() == 0 and got.count() == 300


def test_running_sum_starts_at_the_first_known_value(spark):
    df = _data(spark, seed=8).withColumn("v", F.when(F.col("t") > 15, F.col("v")))
    running = W.partitionBy("p").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    wanted = df.select("id", F.sum("v").over(running).alias("total"))
    for limit in (5, 40):
        rows = ordered_rows(df, ("p",), ("t", "id"), max_rows=limit)
        assert rows.chunks > 1
        got = rows.running_sum("total", F.col("v")).result().select("id", "total")
        assert sorted(got.collect()) == sorted(wanted.collect())


@pytest.mark.parametrize("max_rows", [1, 7, None])
def test_fractions_and_maxima_do_not_depend_on_ranges(spark, max_rows):
    rnd = random.Random(11)
    rows = [(k, i, rnd.choice([.1, .2, .7, 1e6, -3.3, None])) for k in (1, 2, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    scan = ordered_rows(df, ("k",), ("i",), max_rows).running_sum("s", F.col("v")).running_max("m", F.col("v"))
    got = {(r.k, r.i): (r.s, r.m) for r in scan.result().collect()}
    for k in (1, 2, None):
        upto, top = None, None
        for _, i, v in (r for r in rows if r[0] == k):
            if v is not None:
                upto, top = (upto or 0) + Decimal(str(v)), v if top is None else max(top, v)
            assert got[k, i] == (None if upto is None else float(upto), top)


def test_ranges_follow_bytes(spark, monkeypatch):
    df = spark.range(400).selectExpr("1 AS k", "id", "array_repeat(0.123456789D, 100) AS vec")
    monkeypatch.setattr(ordered, "MAX_GROUP_BYTES", 100_000)
    assert ordered.row_bytes(df) > 800
    assert ordered_rows(df, ("k",), ("id",)).chunks and not ordered_rows(df.drop("vec"), ("k",), ("id",)).chunks


def test_superseded_checkpoints_are_deleted(spark):
    df = runtime.checkpoint(spark.range(10))
    folder = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    after = runtime.checkpoint(df.where("id > 3"))
    runtime.forget(df, None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert after.count() == 6


def test_ranges_do_not_follow_the_rows(spark):
    rows = spark.range(6000).withColumn("part", F.lit("a"))
    scan = ordered.ordered_rows(rows, ("part",), ("id",), max_rows=5)
    assert 4 < scan.chunks <= ordered.RANGES_PER_PARTITION * 4
    got = scan.row_number("pos").lag("_prev", "id").result().where("pos <> id + 1 OR coalesce(_prev.id, -1) <> id - 1")
    assert got.isEmpty()
