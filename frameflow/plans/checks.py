"""Comparison SQL shared by several queries."""

from __future__ import annotations

from .. import params as P
from .frames import FACES_SQL, PHOTOS_SQL, STEPS_SQL, FRAMES_SQL, distance_sql


def num(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def half_up(x: str, digits: int) -> str:
    """Rounding by the printed decimal digits, halves up, as Spark's round does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 24)), {digits}) AS DOUBLE)"


def piecewise_sql(x: str, points) -> str:
    first, last = points[0], points[-1]
    text = f"CASE WHEN {x} <= {num(first[0])} THEN {num(first[1])}"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        text += (f" WHEN {x} <= {num(x1)} THEN {num(y0)} + {num(y1 - y0)} * ({x} - {num(x0)})"
                 f" / {num(x1 - x0)}")
    return text + f" WHEN {x} IS NOT NULL THEN {num(last[1])} END"


SCENE_RULE = f"""(gap_ms IS NULL OR gap_ms > {P.SCENE_GAP_MS}
 OR (gap_ms > {P.SCENE_SHORT_GAP_MS} AND step_dist > {P.SCENE_DIST}))"""

RUNS_SQL = f"""{STEPS_SQL},
runs AS (SELECT *, CAST(SUM(CASE WHEN gap_ms <= {P.BRACKET_GAP_MS} AND step_dist <= {P.BRACKET_DIST}
 AND bias <> p_bias THEN 0 ELSE 1 END) OVER (PARTITION BY shoot_id ORDER BY rn) AS BIGINT) AS run
 FROM steps),
run_stats AS (SELECT shoot_id, run, COUNT(*) AS n, MIN(bias) AS lo, MAX(bias) AS hi,
 MIN(t_ms) AS start_ms, MIN(photo_id) AS first_id,
 COUNT(DISTINCT bias) = COUNT(*) AND MIN(bias) < 0 AND MAX(bias) > 0
 AND abs(MIN(bias) + MAX(bias)) <= {P.BRACKET_SYMMETRY} AS valid
 FROM runs GROUP BY shoot_id, run HAVING COUNT(*) >= {P.BRACKET_MIN_FRAMES})"""


def neighbour_rule(limits: P.ShotThresholds) -> str:
    gap = " ".join(f"WHEN '{name}' THEN {ms}" for name, ms in P.SHOT_GAP_MS.items())
    return f"""(gap_ms > CASE profile {gap} ELSE {P.SHOT_GAP_MS_OTHER} END OR step_dist > {limits.step}
 OR (face_count <> p_faces AND step_dist > {limits.corroboration}))"""


MARKED_SQL = f"""{RUNS_SQL},
marked AS (SELECT r.*, s.run AS bracket FROM runs r LEFT JOIN run_stats s
 ON s.shoot_id = r.shoot_id AND s.run = r.run AND s.valid),
before AS (SELECT *, lag(bracket) OVER (PARTITION BY shoot_id ORDER BY rn) AS p_bracket FROM marked)"""


def segments_sql(limits: P.ShotThresholds, tag: str = "") -> str:
    return f"""segments{tag} AS (SELECT *, rn = 1 OR bracket IS DISTINCT FROM p_bracket
 OR (bracket IS NULL AND {neighbour_rule(limits)}) AS boundary FROM before),
numbered_segments{tag} AS (SELECT *, SUM(CASE WHEN boundary THEN 1 ELSE 0 END)
 OVER (PARTITION BY shoot_id ORDER BY rn) AS seg FROM segments{tag})"""


def shots_sql(limits: P.ShotThresholds, tag: str = "") -> str:
    """CTEs ending in `shots`; the drift rule walks every segment one frame per
    step, all segments at once."""
    return f"""{segments_sql(limits, tag)},
placed{tag} AS (SELECT *, row_number() OVER (PARTITION BY shoot_id, seg ORDER BY rn) AS k
 FROM numbered_segments{tag}),
walk{tag} AS (
 SELECT shoot_id, seg, k, photo_id, t_ms, bracket, photo_id AS shot_id, vx0, vy0, no_vec, TRUE AS fresh
 FROM placed{tag} WHERE k = 1
 UNION ALL
 SELECT shoot_id, seg, k, photo_id, t_ms, bracket,
  CASE WHEN split THEN photo_id ELSE shot_id END, CASE WHEN split THEN bx ELSE ax END,
  CASE WHEN split THEN by0 ELSE ay END, CASE WHEN split THEN b_no ELSE a_no END, split
 FROM (SELECT b.shoot_id, b.seg, b.k, b.photo_id, b.t_ms, b.bracket, a.shot_id, a.vx0 AS ax,
  a.vy0 AS ay, a.no_vec AS a_no, b.vx0 AS bx, b.vy0 AS by0, b.no_vec AS b_no,
  b.bracket IS NULL AND NOT a.fresh AND {distance_sql('a', 'b')} > {limits.anchor} AS split
  FROM walk{tag} a JOIN placed{tag} b ON b.shoot_id = a.shoot_id AND b.seg = a.seg AND b.k = a.k + 1)),
shots{tag} AS (SELECT shoot_id, photo_id, t_ms, bracket IS NOT NULL AS is_bracket, shot_id FROM walk{tag})"""


SEGMENTS_SQL = f"{MARKED_SQL},\n{segments_sql(P.DEFAULT_SHOT)}"
SHOTS_SQL = f"{MARKED_SQL},\n{shots_sql(P.DEFAULT_SHOT)}"

_NEAR = f"""(has_saliency AND abs(x + w / 2 - (sal_x + {num(0.2)} / 2)) < {P.SUBJECT_REACH}
 AND abs(y + h / 2 - (sal_y + {num(0.2)} / 2)) < {P.SUBJECT_REACH})"""

# Photos with the primary face's columns (NULL without a face), subject box and flags.
SUBJECT_SQL = f"""{FRAMES_SQL}, {PHOTOS_SQL}, {FACES_SQL},
seen AS (SELECT f.*, {_NEAR} AS near,
 COALESCE(least(open_l, open_r) < {P.BLINK_BELOW}, FALSE) AS blinks,
 (x < {P.EDGE_EPS} OR y < {P.EDGE_EPS} OR x + w > {num(1 - P.EDGE_EPS)}
  OR y + h > {num(1 - P.EDGE_EPS)}) AS clip
 FROM faces f JOIN photos USING (photo_id)),
ranked_faces AS (SELECT *, row_number() OVER (PARTITION BY photo_id
 ORDER BY near DESC, w * h DESC, idx) AS rn FROM seen),
face_totals AS (SELECT photo_id, COUNT(*) AS n_faces, bool_or(clip) AS any_clipped,
 CAST(SUM(CASE WHEN blinks AND rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS other_blinking
 FROM ranked_faces GROUP BY photo_id),
subjects AS (SELECT p.*, f.idx, f.near, f.yaw, f.capture_quality, f.sharp_l, f.sharp_r, f.open_l,
 f.open_r, f.eye_source, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh,
 COALESCE(t.n_faces, 0) AS n_faces, COALESCE(t.any_clipped, FALSE) AS any_clipped,
 COALESCE(t.other_blinking, 0) AS other_blinking,
 COALESCE(f.x, CASE WHEN has_saliency THEN sal_x END) AS sx,
 COALESCE(f.y, CASE WHEN has_saliency THEN sal_y END) AS sy,
 COALESCE(f.w, CASE WHEN has_saliency THEN {num(0.2)} END) AS sw,
 COALESCE(f.h, CASE WHEN has_saliency THEN {num(0.2)} END) AS sh
 FROM photos p LEFT JOIN ranked_faces f ON f.photo_id = p.photo_id AND f.rn = 1
 LEFT JOIN face_totals t ON t.photo_id = p.photo_id),
flagged AS (SELECT *,
 least(sx + sw / 2, sy + sh / 2, 1 - (sx + sw / 2), 1 - (sy + sh / 2)) AS edge_distance,
 sqrt(least(abs(sx + sw / 2 - {num(1 / 3)}), abs(sx + sw / 2 - {num(2 / 3)})) ** 2
  + least(abs(sy + sh / 2 - {num(1 / 3)}), abs(sy + sh / 2 - {num(2 / 3)})) ** 2) AS thirds_distance,
 COALESCE(fy + fh > {num(1 - P.HEADROOM)}, FALSE) AS no_headroom,
 COALESCE(abs(yaw) > {P.LEAD_ROOM_YAW} AND ((yaw > 0 AND fx + fw / 2 > 0.5)
  OR (yaw <= 0 AND fx + fw / 2 < 0.5)), FALSE) AS lead_room_inverted,
 COALESCE(abs(horizon_angle) > {P.HORIZON_TILT_DEG}, FALSE) AS horizon_tilt FROM subjects),
flags AS (SELECT *, COALESCE(edge_distance < {P.NEAR_EDGE}, FALSE) AS subject_near_edge FROM flagged)"""


def _weight(metric: str) -> str:
    text = "CASE profile"
    for name, weights in P.PROFILE_WEIGHTS.items():
        if metric in weights:
            value = num(weights[metric])
            if metric == "composition" and name != "landscape":
                more = num(weights[metric] + P.GROUP_SHOT_BONUS)
                value = f"(CASE WHEN n_faces >= {P.GROUP_SHOT_FACES} THEN {more} ELSE {value} END)"
            text += f" WHEN '{name}' THEN {value}"
    return text + " END"


_AWAY = f"COALESCE(abs(yaw) > {P.MAX_EYE_YAW}, FALSE)"
_OPEN = "CASE eye_source " + " ".join(
    f"WHEN '{source}' THEN {piecewise_sql('least(open_l, open_r)', points)}"
    for source, points in P.EYES_OPEN_CURVES.items()) + (
    f" ELSE {piecewise_sql('least(open_l, open_r)', P.EYES_OPEN_CURVE)} END")
_VALUES = {
    "eye_focus": f"""CASE WHEN idx IS NULL OR {_AWAY}
      OR COALESCE(sharpness_max < {P.MIN_FRAME_SHARPNESS}, FALSE) THEN NULL
      ELSE {piecewise_sql('greatest(sharp_l, sharp_r)', P.EYE_FOCUS_CURVE)} END""",
    "eyes_open": f"CASE WHEN idx IS NULL OR {_AWAY} THEN NULL ELSE {_OPEN} END",
    "sharpness": f"""CASE WHEN sharpness_max IS NULL OR sharpness_mean IS NULL THEN NULL
      WHEN sharpness_max < {P.MIN_FRAME_SHARPNESS} THEN {num(0)}
      ELSE {piecewise_sql('sharpness_max', P.FRAME_SHARPNESS_CURVE)} END""",
    "composition": "greatest(CAST(0 AS DOUBLE), 1 - (" + " + ".join(
        f"(CASE WHEN {flag} THEN {num(P.FLAG_PENALTIES[name])} ELSE {num(0)} END)" for name, flag in (
            ("face_clipped", "any_clipped"), ("no_headroom", "no_headroom"),
            ("lead_room_inverted", "lead_room_inverted"),
            ("subject_near_edge", "subject_near_edge"), ("horizon_tilt", "horizon_tilt"))) + "))",
    "face_quality": "capture_quality",
    "exposure": f"""CASE WHEN clipped_hi IS NULL OR clipped_lo IS NULL THEN NULL
      ELSE greatest(CAST(0 AS DOUBLE), 1 - {num(10)} * clipped_hi - {num(5)} * clipped_lo) END""",
}


def score_sql(source: str = "flags", in_bracket: str = "FALSE") -> str:
    """CTEs ending in `scores`: metrics, total and hint for the rows of source."""
    metrics = P.METRICS
    sealed = {"exposure": f"CASE WHEN {in_bracket} THEN NULL ELSE {_VALUES['exposure']} END"}
    measured = {**_VALUES, **sealed}
    weights = ",\n ".join(f"{_weight(m)} AS w_{m}" for m in metrics)
    values = ",\n ".join(f"CASE WHEN w_{m} IS NOT NULL THEN {measured[m]} END AS {m}" for m in metrics)
    live = " + ".join(f"(CASE WHEN {m} IS NOT NULL THEN w_{m} ELSE 0 END)" for m in metrics)
    total = " + ".join(
        f"COALESCE({m} * (CASE WHEN live_weight > 0 THEN w_{m} / live_weight END), {num(0)})"
        for m in metrics)
    return f"""weighted AS (SELECT *, {weights} FROM {source}),
valued AS (SELECT *, {values} FROM weighted),
lived AS (SELECT *, {live} AS live_weight FROM valued),
scores AS (SELECT *, {half_up(total, 4)} AS total,
 CASE WHEN profile <> 'landscape' AND n_faces = 0 THEN 'no_faces_detail_shot'
  WHEN profile <> 'landscape' AND n_faces >= {P.GROUP_SHOT_FACES} THEN 'group_shot' END AS hint
 FROM lived)"""


def keep_sql() -> str:
    return "CASE profile " + " ".join(
        f"WHEN '{name}' THEN greatest(1, least({cap}, ceil(size * {num(rate)})))"
        for name, (rate, cap) in P.KEEP_RATES.items()) + " END"


_SIM = """CASE WHEN r.u OR pick.u THEN 0.0 ELSE (r.x * pick.x + r.y * pick.y)
 / (sqrt(r.x * r.x + r.y * r.y) * sqrt(pick.x * pick.x + pick.y * pick.y)) END"""


def diverse_sql(source: str, key: str) -> str:
    """CTE `diverse` (key, photo_id, rank): a walk that takes one row of every
    group per step. source: key columns, photo_id, total, x, y, no_vec."""
    return f"""diverse AS (SELECT {key}, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS photo_id,
 list({{'t': total, 'n': -photo_id, 'x': x, 'y': y, 'u': no_vec, 'm': CAST(NULL AS DOUBLE)}}) AS rest FROM {source}
 GROUP BY {key} UNION ALL SELECT {key}, rank + 1, -pick.n, list_transform(list_filter(rest, lambda r: r.n <> pick.n),
 lambda r: {{'t': r.t, 'n': r.n, 'x': r.x, 'y': r.y, 'u': r.u, 'm': greatest(r.m, {_SIM})}}) FROM (SELECT {key}, rank, rest,
 list_max(list_transform(rest, lambda r: {{'v': CASE WHEN r.m IS NULL THEN r.t ELSE r.t - {P.DIVERSITY_LAMBDA} * r.m END,
 't': r.t, 'n': r.n, 'x': r.x, 'y': r.y, 'u': r.u}})) AS pick FROM diverse WHERE len(rest) > 0))"""


# The whole chain: shots, scores with bracket frames marked, ranks, states.
SELECTION_SQL = f"""{SHOTS_SQL}, {SUBJECT_SQL.replace(FRAMES_SQL + ', ', '', 1)},
tagged AS (SELECT f.*, s.shot_id, s.is_bracket FROM flags f JOIN shots s USING (photo_id)),
{score_sql('tagged', 'is_bracket')},
members AS (SELECT s.*, other_blinking AS blinks, CAST(f.vx0 AS DOUBLE) AS x, CAST(f.vy0 AS DOUBLE) AS y, f.no_vec
 FROM scores s JOIN frames f USING (photo_id)),
unsealed AS (SELECT *, COUNT(*) OVER g AS size, MAX(blinks) OVER g AS group_blinks FROM members WHERE NOT is_bracket
 WINDOW g AS (PARTITION BY shoot_id, shot_id)),
{diverse_sql('unsealed', 'shoot_id, shot_id')},
ordered AS (SELECT u.*, row_number() OVER (PARTITION BY u.shoot_id, u.shot_id ORDER BY CASE WHEN group_blinks > 0 THEN
 blinks ELSE 0 END, CASE WHEN group_blinks > 0 THEN -total ELSE 0 END, d.rank) AS rnk FROM unsealed u JOIN diverse d
 ON d.shoot_id = u.shoot_id AND d.shot_id = u.shot_id AND d.photo_id = u.photo_id),
topped AS (SELECT r.*, t.total AS top_total, {keep_sql()} AS keep, CASE WHEN r.no_vec OR t.no_vec THEN 0.0 ELSE
 (r.x * t.x + r.y * t.y) / (sqrt(r.x * r.x + r.y * r.y) * sqrt(t.x * t.x + t.y * t.y)) END AS similarity
 FROM ordered r JOIN (SELECT shoot_id, shot_id, total, x, y, no_vec FROM ordered WHERE rnk = 1) t
 USING (shoot_id, shot_id)),
states AS (SELECT *, top_total < {P.QUALITY_FLOOR} AS no_good, CASE WHEN top_total < {P.QUALITY_FLOOR} THEN 'alt'
 WHEN rnk <= keep THEN 'pick' WHEN rnk <= keep + {P.ALT_COUNT} THEN 'alt' ELSE 'reject' END AS state FROM topped),
entries AS (SELECT shoot_id, shot_id, photo_id, state, rnk AS rank, no_good, CASE WHEN size = 1 AND no_good THEN
 'only_below_floor' WHEN size = 1 THEN 'only_frame' WHEN no_good THEN 'no_good_frame' WHEN state = 'pick' AND rnk = 1
 THEN 'best' WHEN state = 'pick' THEN 'diversity_pick' WHEN state = 'alt' THEN 'runner_up'
 WHEN eyes_open < {P.EYES_CLOSED_BELOW} THEN 'eyes_closed' WHEN eye_focus < {P.FOCUS_MISSED_BELOW} THEN 'focus_missed'
 WHEN similarity > {P.NEAR_DUPLICATE_ABOVE} THEN 'near_duplicate' ELSE 'outscored' END AS reason_code FROM states
 UNION ALL SELECT shoot_id, shot_id, photo_id, 'pick', NULL, FALSE, 'bracket' FROM members WHERE is_bracket)"""
