"""Queries on capture sequences: scenes, brackets, shots, corrections, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import agreement, corrections, lookups, progress, segments, shots
from ..operators.ordered import ordered_rows, row_numbers
from ..streaming.feeds import stream_sessions
from .checks import (MARKED_SQL, RUNS_SQL, SCENE_RULE, SEGMENTS_SQL, SHOTS_SQL, neighbour_rule,
                     shots_sql)
from .frames import FRAMES_SQL, STEPS_SQL, frames, table
from .registry import query

HALF_DAY_MS = 12 * 3_600_000


# milliseconds since 1970 of a timestamp without zone, whatever the session's zone
EPOCH_MS = """datediff(CAST(ts AS DATE), DATE'1970-01-01') * 86400000L + hour(ts) * 3600000L
 + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t_ms", F.expr(EPOCH_MS))


@query("sessionize", f"""SELECT user_id, event_id, CAST(SUM(new) OVER (PARTITION BY user_id
 ORDER BY t_ms, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER
 (PARTITION BY user_id ORDER BY t_ms, event_id) <= {HALF_DAY_MS} THEN 0 ELSE 1 END AS new
 FROM (SELECT *, epoch_us(ts) // 1000 AS t_ms FROM events))""")
def sessionize(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", "t_ms")
    return segments.sessionize(rows, ("user_id",), ("t_ms", "event_id"), "t_ms",
                               HALF_DAY_MS).drop("t_ms")


@query("gap_sessions", f"""SELECT part, session, COUNT(*) AS n, MIN(t_ms) AS start_ms,
 MAX(t_ms) AS end_ms FROM (SELECT *, CAST(SUM(new) OVER (PARTITION BY part ORDER BY t_ms, event_id)
 AS BIGINT) AS session FROM (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY part
 ORDER BY t_ms, event_id) <= {P.SESSION_GAP_MS} THEN 0 ELSE 1 END AS new FROM
 (SELECT event_id, event_type || '/' || CAST(user_id % 20 AS VARCHAR) AS part, epoch_us(ts) // 1000 AS t_ms
 FROM events))) GROUP BY part, session""")
def gap_sessions(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        "event_id", "t_ms", F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string"))
        .alias("part"))
    found = segments.sessionize(rows, ("part",), ("t_ms", "event_id"), "t_ms", P.SESSION_GAP_MS)
    return found.groupBy("part", "session").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))


# one key holds all rows, in many more ranges than one
HOT_RANGE_ROWS = 1500


@query("hot_key_scan", """SELECT event_id, lag(event_id) OVER w AS before, row_number() OVER w AS pos,
 CAST(SUM(CAST(value AS DECIMAL(38, 12))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total,
 MAX(value) OVER (w ROWS UNBOUNDED PRECEDING) AS top,
 last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS purchase
 FROM (SELECT *, epoch_us(ts) // 1000 AS t_ms FROM events) WINDOW w AS (ORDER BY t_ms, event_id)""")
def hot_key_scan(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "t_ms", "value", "event_type", F.lit("all").alias("part"))
    scan = ordered_rows(rows, ("part",), ("t_ms", "event_id"), HOT_RANGE_ROWS).lag("_prev", "event_id").row_number("pos")
    scan = scan.running_sum("total", F.col("value")).running_max("top", F.col("value"))
    scan = scan.running_last("purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return scan.result().select("event_id", F.col("_prev.event_id").alias("before"), "pos", "total", "top", "purchase")


def _steps(spark, sf_dir):
    return segments.capture_steps(frames(spark, sf_dir), extra=("bias", "face_count"))


@query("scenes", f"""WITH {STEPS_SQL} SELECT shoot_id, photo_id, CAST(SUM(CASE WHEN {SCENE_RULE}
 THEN 1 ELSE 0 END) OVER (PARTITION BY shoot_id ORDER BY rn) AS BIGINT) AS scene FROM steps""")
def scenes(spark, sf_dir):
    return segments.group_scenes(_steps(spark, sf_dir)).result().select("shoot_id", "photo_id", "scene")


@query("brackets", f"WITH {RUNS_SQL} SELECT shoot_id, n, lo, hi, start_ms, first_id, valid FROM run_stats")
def brackets(spark, sf_dir):
    runs = segments.bracket_runs(_steps(spark, sf_dir))
    return segments.bracket_stats(runs).select(
        "shoot_id", "n", "lo", "hi", "start_ms", "first_id", "valid")


@query("shot_segments", f"""WITH {SEGMENTS_SQL} SELECT shoot_id, photo_id, boundary,
 bracket IS NOT NULL AS is_bracket FROM segments""")
def shot_segments(spark, sf_dir):
    return shots.shot_segments(frames(spark, sf_dir)).result().select(
        "shoot_id", "photo_id", "boundary", F.col("bracket").isNotNull().alias("is_bracket"))


@query("shots", f"WITH RECURSIVE {SHOTS_SQL} SELECT shoot_id, photo_id, t_ms, is_bracket, shot_id FROM shots")
def all_shots(spark, sf_dir):
    return shots.group_shots(frames(spark, sf_dir))


@query("group_stats", f"""WITH {SEGMENTS_SQL}, sizes AS (SELECT COUNT(*) AS size FROM numbered_segments
 GROUP BY shoot_id, seg), ordered AS (SELECT size, row_number() OVER (ORDER BY size) AS rn,
 COUNT(*) OVER () AS n FROM sizes)
 SELECT MAX(n) AS groups, CAST(SUM(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons,
 MAX(CASE WHEN rn = n // 2 + 1 THEN size END) AS median_size FROM ordered""")
def group_stats(spark, sf_dir):
    rows = shots.shot_segments(frames(spark, sf_dir))
    numbered = rows.running_sum("segment", F.col("boundary").cast("long")).result()
    return segments.group_stats(segments.segment_sizes(numbered, ["shoot_id"], "segment"))


@query("flicker_rate", f"""WITH {STEPS_SQL} SELECT COUNT(*) AS pairs,
 round(AVG(CASE WHEN face_count <> p_faces THEN 1.0 ELSE 0.0 END), 6) AS flicker_rate FROM steps
 WHERE step_dist <= {P.FLICKER_DIST} AND gap_ms <= {P.FLICKER_GAP_MS}""")
def flicker_rate(spark, sf_dir):
    return segments.flicker_rate(_steps(spark, sf_dir))


QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


@query("pair_quantiles", f"""WITH {STEPS_SQL} SELECT p, round(value, 6) AS value FROM (
 """ + " UNION ALL ".join(f"""SELECT CAST({p} AS DOUBLE) AS p, quantile_cont(step_dist, {p}) AS value
 FROM steps WHERE gap_ms <= {P.FLICKER_GAP_MS}""" for p in QUANTILES) + ")")
def pair_quantiles(spark, sf_dir):
    near = _steps(spark, sf_dir).df.where(F.col("gap_ms") <= P.FLICKER_GAP_MS)
    return agreement.percentiles(near, "step_dist", "photo_id", QUANTILES).select(
        "p", F.round("value", 6).alias("value"))


_SWEEP = " UNION ALL ".join(
    f"""SELECT '{name}' AS param_id, CAST(SUM(CASE WHEN rn = 1 OR COALESCE({neighbour_rule(limits)}, FALSE)
 THEN 1 ELSE 0 END) AS BIGINT) AS segments, round(AVG(CASE WHEN (rn = 1 OR COALESCE(
 {neighbour_rule(limits)}, FALSE)) = (rn = 1 OR COALESCE({neighbour_rule(P.SHOT_SWEEP['t20'])}, FALSE))
 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM steps""" for name, limits in P.SHOT_SWEEP.items())


@query("sweep_segments", f"WITH {STEPS_SQL} {_SWEEP}")
def sweep_segments(spark, sf_dir):
    return shots.sweep_boundaries(frames(spark, sf_dir), P.SHOT_SWEEP, "t20")


_SWEPT = ",\n".join(shots_sql(limits, f"_{name}") for name, limits in P.SHOT_SWEEP.items())
_COUNTED = " UNION ALL ".join(f"""SELECT '{name}' AS param_id, g.groups, g.singletons, a.agreement FROM
 (SELECT COUNT(*) AS groups, CAST(SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons FROM
 (SELECT COUNT(*) AS n FROM shots_{name} GROUP BY shoot_id, shot_id)) g,
 (SELECT round(AVG(CASE WHEN (s.shot_id = s.photo_id) = (b.shot_id = b.photo_id) THEN 1.0 ELSE 0.0 END), 6)
 AS agreement FROM shots_{name} s JOIN shots_t20 b USING (photo_id)) a""" for name in P.SHOT_SWEEP)


@query("shot_sweep", f"WITH RECURSIVE {MARKED_SQL},\n{_SWEPT} {_COUNTED}")
def shot_sweep(spark, sf_dir):
    return shots.shot_sweep(frames(spark, sf_dir), P.SHOT_SWEEP, "t20")


@query("split_pins", f"""WITH RECURSIVE {SHOTS_SQL} SELECT shoot_id, photo_id, is_bracket,
 last_value(CASE WHEN photo_id = shot_id OR (photo_id % 50 = 7 AND NOT is_bracket) THEN photo_id END
 IGNORE NULLS) OVER (PARTITION BY shoot_id ORDER BY t_ms, photo_id) AS shot_id FROM shots""")
def split_pins(spark, sf_dir):
    found = shots.group_shots(frames(spark, sf_dir))
    pins = found.where("photo_id % 50 = 7").select(
        "shoot_id", "photo_id", F.col("photo_id").alias("pin_order"), F.lit("split_before").alias("kind"))
    return corrections.apply_pins(found, pins).drop("t_ms")


# every pin in its order changes the list of starts of its shoot; brackets stand apart
_PINS_SQL = f"""{SHOTS_SQL},
spots AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY t_ms, photo_id) AS pos FROM shots),
given AS (SELECT shoot_id, list(pos) AS starts, list(pos) FILTER (is_bracket) AS seals FROM spots
 WHERE photo_id = shot_id GROUP BY shoot_id),
pins AS (SELECT shoot_id, pos, photo_id % 3 = 0 AS split, row_number() OVER (PARTITION BY shoot_id
 ORDER BY photo_id * 7919 % 1000003) AS k FROM spots WHERE photo_id % 40 IN (3, 7, 9) AND NOT is_bracket),
replayed AS (SELECT shoot_id, CAST(0 AS BIGINT) AS k, starts, COALESCE(seals, []) AS seals FROM given
 UNION ALL SELECT shoot_id, k, CASE WHEN split THEN list_distinct(list_append(starts, pos))
  WHEN prev IS NULL OR list_contains(seals, prev) OR list_contains(seals, head) THEN starts
  ELSE list_filter(starts, lambda x: x <> head) END, seals
 FROM (SELECT *, list_max(list_filter(starts, lambda x: x < head)) AS prev FROM (
  SELECT r.shoot_id, p.k, r.starts, r.seals, p.split, p.pos, list_max(list_filter(r.starts, lambda x: x <= p.pos)) AS head
  FROM replayed r JOIN pins p ON p.shoot_id = r.shoot_id AND p.k = r.k + 1))),
heads AS (SELECT shoot_id, unnest(max_by(starts, k)) AS pos FROM replayed GROUP BY shoot_id)"""


@query("mixed_pins", f"""WITH RECURSIVE {_PINS_SQL} SELECT s.shoot_id, s.photo_id, s.is_bracket,
 last_value(CASE WHEN h.pos IS NOT NULL THEN s.photo_id END IGNORE NULLS) OVER (PARTITION BY s.shoot_id
 ORDER BY s.pos) AS shot_id FROM spots s LEFT JOIN heads h ON h.shoot_id = s.shoot_id AND h.pos = s.pos""")
def mixed_pins(spark, sf_dir):
    found = shots.group_shots(frames(spark, sf_dir))
    kind = F.when(F.col("photo_id") % 3 == 0, "split_before").otherwise("merge_with_prev")
    pins = found.where("photo_id % 40 IN (3, 7, 9)").select(
        "shoot_id", "photo_id", (F.col("photo_id") * 7919 % 1000003).alias("pin_order"), kind.alias("kind"))
    return corrections.apply_pins(found, pins).drop("t_ms")


_MEMBERS_SQL = f"""{FRAMES_SQL}, members AS (SELECT photo_id // 10 AS group_id, photo_id,
 photo_id AS t_ms, (photo_id // 10) % 13 = 0 AS is_bracket FROM frames)"""


def _members(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 10 AS group_id", "event_id AS photo_id", "event_id AS t_ms",
        "(event_id div 10) % 13 = 0 AS is_bracket")


@query("group_edits", f"""WITH {_MEMBERS_SQL},
 last_group AS (SELECT MAX(group_id) AS g FROM members),
 s AS (SELECT photo_id, is_bracket, CASE WHEN group_id % 7 = 0 AND NOT is_bracket AND photo_id % 10 >= 5
  AND group_id * 10 + 5 <= (SELECT MAX(photo_id) FROM members)
  THEN 1000000000 + group_id ELSE group_id END AS group_id FROM members),
 m AS (SELECT photo_id, is_bracket, CASE WHEN group_id % 11 = 3 AND group_id < 1000000000 AND NOT is_bracket
  AND (group_id - 1) % 13 <> 0 THEN group_id - 1 ELSE group_id END AS group_id FROM s)
 SELECT photo_id, is_bracket, CASE WHEN photo_id % 10 = 9 AND NOT is_bracket AND group_id % 5 = 2
  AND group_id < 1000000000 AND (group_id + 1) IN (SELECT group_id FROM m WHERE NOT is_bracket)
  THEN group_id + 1 ELSE group_id END AS group_id FROM m""")
def group_edits(spark, sf_dir):
    members = _members(spark, sf_dir)
    groups = members.select("group_id").distinct()
    splits = groups.where("group_id % 7 = 0").select(
        "group_id", (F.col("group_id") * 10 + 5).alias("at_key"),
        (F.col("group_id") + 1_000_000_000).alias("new_group_id"))
    after_split = corrections.split_groups(members, splits)
    merges = groups.where("group_id % 11 = 3").select(
        "group_id", (F.col("group_id") - 1).alias("target"))
    merged = corrections.merge_groups(after_split, merges)
    moves = merged.where("photo_id % 10 = 9 AND group_id % 5 = 2 AND group_id < 1000000000").select(
        "group_id", "photo_id", (F.col("group_id") + 1).alias("target"))
    return corrections.move_members(merged, moves).select("photo_id", "is_bracket", "group_id")


@query("split_checks", f"""WITH {_MEMBERS_SQL}, edits AS (SELECT DISTINCT group_id,
 CASE group_id % 4 WHEN 0 THEN group_id * 10 WHEN 1 THEN group_id * 10 + 3 WHEN 2 THEN group_id * 10 + 25
 ELSE group_id * 10 + 9 END AS at_key FROM members)
 SELECT e.group_id, e.at_key, CASE WHEN e.group_id % 13 = 0 THEN 'bracket_immutable'
 WHEN m.photo_id IS NULL THEN 'not_in_group' WHEN e.at_key = e.group_id * 10 THEN 'no_change'
 ELSE 'ok' END AS status FROM edits e LEFT JOIN members m
 ON m.group_id = e.group_id AND m.photo_id = e.at_key""")
def split_checks(spark, sf_dir):
    members = _members(spark, sf_dir)
    at = F.expr("""CASE group_id % 4 WHEN 0 THEN group_id * 10 WHEN 1 THEN group_id * 10 + 3
      WHEN 2 THEN group_id * 10 + 25 ELSE group_id * 10 + 9 END""")
    edits = members.select("group_id").distinct().withColumn("at_key", at)
    return corrections.check_splits(members, edits).select("group_id", "at_key", "status")


@query("ordered_groups", f"""WITH {FRAMES_SQL}, m AS (SELECT shoot_id, photo_id // 7 AS group_id, photo_id,
 t_ms FROM frames WHERE t_ms IS NOT NULL), heads AS (SELECT shoot_id, group_id, MIN(t_ms) AS t0,
 MIN(photo_id) AS k0 FROM m GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY shoot_id
 ORDER BY t0, k0, group_id) AS group_order FROM heads)
 SELECT m.shoot_id, m.group_id, m.photo_id, m.t_ms, group_order, row_number() OVER (PARTITION BY m.shoot_id,
 m.group_id ORDER BY m.t_ms, m.photo_id) AS pos FROM m JOIN numbered n USING (shoot_id, group_id)""")
def ordered_groups(spark, sf_dir):
    members = frames(spark, sf_dir).where("t_ms IS NOT NULL").selectExpr(
        "shoot_id", "photo_id div 7 AS group_id", "photo_id", "t_ms")
    return lookups.ordered_members(members, "group_id", "t_ms", "photo_id", "shoot_id")


# --- progress -----------------------------------------------------------------

_EVENT = """CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete'
 WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'requeue' ELSE 'note' END"""

_LEDGER_SQL = f"""log AS (SELECT user_id AS job, event_id // 400 AS item, event_id, {_EVENT} AS event
 FROM events), prev AS (SELECT *, lag(event) OVER (PARTITION BY job, item ORDER BY event_id) AS p FROM log),
 kinds AS (SELECT *, CASE WHEN event <> 'requeue' THEN event WHEN p = 'claim' THEN 'fail' END AS kind
 FROM prev), used AS (SELECT * FROM kinds WHERE kind IN ('claim', 'complete', 'fail')),
 folded AS (SELECT job, item, CAST(SUM(CASE WHEN kind = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS attempts,
 max_by(kind, event_id) AS last FROM used GROUP BY job, item),
 ledger AS (SELECT l.job, l.item, COALESCE(attempts, 0) AS attempts,
 CASE WHEN last = 'complete' THEN 'done' WHEN last = 'claim' THEN 'running'
 WHEN last = 'fail' AND attempts >= {P.MAX_ATTEMPTS} THEN 'failed' ELSE 'pending' END AS state
 FROM (SELECT DISTINCT job, item FROM log) l LEFT JOIN folded f USING (job, item))"""


def _ledger(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr(
        "user_id AS job", "event_id div 400 AS item", "event_id", f"{_EVENT} AS event")
    return progress.attempt_ledger(log, ("job", "item"), ("event_id",))


@query("attempt_ledger", f"""WITH {_LEDGER_SQL} SELECT job, item, attempts, state,
 state = 'pending' AND attempts < {P.MAX_ATTEMPTS} AS is_pending FROM ledger""")
def attempt_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query("progress_rollup", f"""WITH {_LEDGER_SQL} SELECT job, COUNT(*) AS total,
 CAST(SUM(CASE WHEN state = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
 CAST(SUM(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
 CASE WHEN SUM(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) > 0 THEN 'failed' ELSE 'done' END AS final_state
 FROM ledger GROUP BY job""")
def progress_rollup(spark, sf_dir):
    return progress.progress_rollup(_ledger(spark, sf_dir), "job")


RATE_WINDOW_MS = 3_600_000
RATE_TOTAL = 20_000


@query("rolling_rate", f"""WITH s AS (SELECT event_type AS job, epoch_us(ts) // 1000 AS t_ms, event_id,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS completed FROM events),
 r AS (SELECT *, MIN(completed) OVER w AS c0, MIN(t_ms) OVER w AS t0 FROM s WINDOW w AS
 (PARTITION BY job ORDER BY t_ms RANGE BETWEEN {RATE_WINDOW_MS} PRECEDING AND CURRENT ROW))
, v AS (SELECT *, CASE WHEN t_ms > t0 AND completed > c0 THEN
 (completed - c0) / ((t_ms - t0) / CAST(1000 AS DOUBLE)) END AS speed FROM r)
 SELECT job, t_ms, event_id, completed, round(speed, 6) AS rate, CASE WHEN completed < {RATE_TOTAL} THEN
 CAST(floor(({RATE_TOTAL} - completed) / speed) AS BIGINT) END AS eta_sec FROM v""")
def rolling_rate(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("job"), "t_ms", "event_id")
    samples = row_numbers(rows, ("job",), ("t_ms", "event_id"), "completed")
    return progress.rolling_rate(samples, "job", "t_ms", "event_id", "completed", F.lit(RATE_TOTAL),
                                 window_ms=RATE_WINDOW_MS).withColumn("rate", F.round("rate", 6))


@query("change_feed", """SELECT user_id, event_id, state, level FROM (SELECT *,
 lag(state) OVER w AS ps, lag(level) OVER w AS pl, row_number() OVER w AS rn FROM (SELECT user_id, event_id,
 event_type AS state, CAST(floor(value / 100) AS BIGINT) AS level FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 WHERE rn = 1 OR ps IS DISTINCT FROM state OR pl IS DISTINCT FROM level""")
def change_feed(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("state"),
        F.floor(F.col("value") / 100).cast("long").alias("level"))
    return progress.change_feed(log, ("user_id",), ("event_id",), ("state", "level"))


@query("session_window", f"""SELECT user_id, start_ms, end_ms, n FROM (SELECT user_id, session,
 MIN(t_ms) AS start_ms, MAX(t_ms) + {HALF_DAY_MS} AS end_ms, COUNT(*) AS n FROM (SELECT *,
 SUM(new) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS session FROM (SELECT *,
 CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) <= {HALF_DAY_MS}
 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t_ms FROM events)))
 GROUP BY user_id, session)""")
def session_window(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("ts", F.timestamp_millis("t_ms"))
    return stream_sessions(events, key="user_id", gap="12 hours").select(
        "user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")
