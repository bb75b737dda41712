"""Streams give what the batch operators give."""

import json

from conftest import SF_DIR
from pyspark.sql import functions as F

from frameflow import params as P
from frameflow.operators.progress import change_feed
from frameflow.operators.shots import group_shots
from frameflow.plans.frames import frames, table
from frameflow.streaming import feeds
from frameflow.streaming.feeds import stream_changes
from frameflow.streaming.keyed import split_output
from frameflow.streaming.shots import ROW_SCHEMA, Shoot, stream_shots


def frames_with_faces(spark):
    """Captures with faceprints and poses, both unknown at times."""
    rows = frames(spark, SF_DIR).where("photo_id < 260 AND t_ms IS NOT NULL")
    turn = "CASE WHEN photo_id % {0} = 1 THEN NULL ELSE array(CAST(cos(photo_id div {1}) AS FLOAT), CAST(sin(photo_id div {1}) AS FLOAT)) END"
    return rows.withColumn("faceprint", F.expr(turn.format(9, 13))).withColumn("pose", F.expr(turn.format(7, 11))).withColumn(
        "profile", F.expr("CASE WHEN shoot_id = 0 THEN 'portrait' ELSE profile END")).select(
        *[F.col(f.name).cast(f.dataType) for f in ROW_SCHEMA.fields])


def heartbeat(spark, t_ms):
    return spark.createDataFrame([(0, None, t_ms)], "shoot_id long, photo_id long, t_ms long").select(
        *[(F.col(f.name) if f.name in ("shoot_id", "photo_id", "t_ms") else F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW_SCHEMA.fields])


def file_stream(spark, folder, schema=ROW_SCHEMA):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(str(folder)))


def run(result, folder, name="q"):
    """All that is new, in micro-batches of one file, to `out` and `late`; the query when it has ended."""
    query = (result.writeStream.foreachBatch(split_output("late", f"{folder}/out", f"{folder}/late"))
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


COLUMNS = ["shoot_id", "photo_id", "is_bracket", "shot_id"]


def test_stream_of_shots_equals_batch_over_restarts(spark, tmp_path):
    rows = frames_with_faces(spark).cache()
    order = rows.orderBy("t_ms", "photo_id").select("t_ms").collect()
    cuts = [order[0].t_ms, order[31].t_ms + 1, order[33].t_ms + 1, order[110].t_ms + 1, order[-1].t_ms + 1]  # inside brackets, too
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows.where(f"t_ms >= {a} AND t_ms < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        run(stream_shots(file_stream(spark, tmp_path / "in")), tmp_path)  # a new query, from the checkpoint
    first = order[5].t_ms
    rows.where(f"t_ms = {first}").coalesce(1).write.parquet(f"{tmp_path}/in/again")  # comes too late
    heartbeat(spark, cuts[-1] + 10_000_000).write.parquet(f"{tmp_path}/in/end")
    run(stream_shots(file_stream(spark, tmp_path / "in")), tmp_path)
    expected = group_shots(rows, faceprint="faceprint", pose="pose").select(*COLUMNS).collect()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(*COLUMNS).collect()) == sorted(expected)
    assert sorted(expected) != sorted(group_shots(rows).select(*COLUMNS).collect())  # the rules for faces and poses matter
    assert [r.t_ms for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [first]
    rows.unpersist()


def test_state_of_ended_shoots_is_dropped(spark, tmp_path):
    day = 86_400_000
    frame = "{s} AS shoot_id, {s} * 100 + id AS photo_id, {s} * {day} + id * 700 AS t_ms, 'event' AS profile, (id % 3 - 1) * 2.0D AS bias, 1L AS face_count, array(1F, 0F) AS vec"
    for s in range(20):
        part = spark.sql(f"SELECT {frame.format(s=s, day=day)} FROM range(30)")
        part = part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW_SCHEMA.fields])
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{s:02d}")
    query = run(stream_shots(file_stream(spark, tmp_path / "in")), tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(kept) >= 20 and max(kept[10:]) <= max(kept[:4])
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.groupBy("shoot_id").count().where("count = 30").count() == 20


def test_a_run_that_repeats_a_bias_does_not_wait():
    shoot, final = Shoot(P.DEFAULT_SHOT), []
    for i in range(1000):
        final += shoot.add({"photo_id": i, "t_ms": i * 500, "profile": None, "bias": (i % 2) * 1.0, "face_count": None, "vec": [1.0, 0.0], "faceprint": None, "pose": None})
        assert len(shoot.run) <= 2
    assert {f[2:] for f in final} == {(False, 0)}


def test_changes_across_batches(spark, tmp_path):
    log = table(spark, SF_DIR, "events").where("user_id < 4").select("user_id", "event_id", "event_type")
    expected = sorted(change_feed(log, ("user_id",), ("event_id",), ("event_type",)).collect())
    log.where("event_id < 400").coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    stream = stream_changes(file_stream(spark, tmp_path / "in", log.schema), ["user_id"], ["event_id"], ["event_type"])
    run(stream, tmp_path)
    log.where("event_id >= 400").coalesce(1).write.parquet(f"{tmp_path}/in/b1")
    log.where("event_id < 3").coalesce(1).write.parquet(f"{tmp_path}/in/b2")
    run(stream, tmp_path)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(*log.columns).collect()) == expected
    assert spark.read.parquet(f"{tmp_path}/late").select("event_id").distinct().count() == log.where("event_id < 3").count()


def test_banked_measurements(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = [str(source), f"{tmp_path}/out", f"{tmp_path}/err", f"{tmp_path}/cp"]

    def lines(name, *rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
    lines("1.json", {"path": "a", "engine_version": "v1"}, {"path": "b", "error": "corrupt"})
    feeds.bank_measurements(spark, *run).awaitTermination()
    lines("2.json", {"path": "a", "engine_version": "v2"}, {"path": "c", "engine_version": "v1"})
    feeds.bank_measurements(spark, *run).awaitTermination()  # resumes after the first file
    got = {(r.path, r.engine_version) for r in feeds.current_measurements(spark, run[1]).collect()}
    assert got == {("a", "v2"), ("c", "v1")}
    assert [r.path for r in spark.read.parquet(run[2]).collect()] == ["b"]


def test_windowed_rate_and_sessions(spark, tmp_path):
    rows = [("j", f"2024-01-01 00:00:{s:02d}", c) for s, c in ((0, 0), (10, 20), (50, 60))]
    rows.append(("j", "2024-01-02 00:00:00", 61))
    df = spark.createDataFrame(rows, "job string, ts string, completed long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run(result, name):
        query = (result.writeStream.format("memory").queryName(name).outputMode("append")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.table(name).collect()
    rates = {str(r.start): r.rate for r in run(feeds.stream_rate(stream), "rates")}
    assert rates["2024-01-01 00:00:00"] == 60 / 50 and rates["2024-01-01 00:00:10"] == 1.0
    sessions = run(feeds.stream_sessions(stream, key="job"), "sessions")
    assert [r.n for r in sessions] == [3]
