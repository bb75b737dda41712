"""The given `events` table seen as captures, with measurements and faces.

One expression per column, computed from the event's own row: a closed form in
event_id replaces running sums, so building the view needs no window and a
third of all rows can sit in one shoot. The same text serves Spark and the
comparison SQL; only the spelling of integer division differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# event number inside its block of 60 decides brackets; block decides the shoot
_SHOOT = "CASE WHEN (e // 60) % 3 = 0 THEN 0 ELSE 1 + (e // 60) // 50 END"

_T_MS = """1704067200000 + 5000 * (e // 5)
 + CASE e % 5 WHEN 0 THEN 400 WHEN 1 THEN 1100 WHEN 2 THEN 2100 WHEN 3 THEN 3400 ELSE 5000 END
 + 9000 * (e // 17) + 120000 * (e // 23) + 600000 * (e // 97)
 + 3000 * ((e + 30) // 60) + 3000 * ((e + 87) // 120)"""

_THETA = """240 * (e // 4) + CASE e % 4 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 120 ELSE 240 END
 + 500 * (e // 19) + 700 * (e // 37) + 1100 * (e // 71)"""

_BIAS = """CASE WHEN e % 60 NOT IN (30, 31, 32) THEN 0.0
 WHEN (e // 60) % 5 = 4 THEN CAST(e % 60 - 30 AS DOUBLE)
 ELSE CAST(2 * (e % 60 - 31) AS DOUBLE) END"""

_FACES = "CASE WHEN e % 17 = 3 THEN 8 ELSE e % 3 END"

_PROFILE = """CASE ({shoot}) % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'landscape'
 WHEN 2 THEN 'portrait' ELSE 'street' END"""

_FRAME_COLUMNS = [
    ("photo_id", "e"),
    ("shoot_id", _SHOOT),
    ("t_ms", f"CASE WHEN e % 211 = 7 THEN NULL ELSE {_T_MS} END"),
    ("theta", f"({_THETA}) % 6283"),
    ("no_vec", "e % 101 = 50"),
    ("bias", f"CAST({_BIAS} AS DOUBLE)"),
    ("face_count", _FACES),
    ("profile", _PROFILE.format(shoot=_SHOOT)),
    ("cents", "CAST(round(value * 100) AS BIGINT)"),
]

_PHOTO_COLUMNS = [
    ("photo_id", "photo_id"), ("shoot_id", "shoot_id"), ("profile", "profile"),
    ("face_count", "face_count"), ("cents", "cents"),
    ("sharpness_max", "CASE WHEN photo_id % 19 = 0 THEN NULL "
                      "ELSE CAST(cents % 1300 AS DOUBLE) / 10000 END"),
    ("sharpness_mean", "CASE WHEN photo_id % 19 = 0 THEN NULL "
                       "ELSE CAST(cents % 1300 AS DOUBLE) / 20000 END"),
    ("clipped_hi", "CASE WHEN photo_id % 37 = 0 THEN NULL "
                   "ELSE CAST(cents % 13 AS DOUBLE) / 200 END"),
    ("clipped_lo", "CAST(cents % 9 AS DOUBLE) / 200"),
    ("horizon_angle", "CASE WHEN photo_id % 6 = 0 THEN NULL "
                      "ELSE CAST(cents % 80 - 40 AS DOUBLE) / 10 END"),
    ("has_saliency", "photo_id % 5 <> 0"),
    ("sal_x", "CAST(cents % 60 AS DOUBLE) / 100"),
    ("sal_y", "CAST((cents // 60) % 60 AS DOUBLE) / 100"),
]

_FACE_COLUMNS = [
    ("photo_id", "photo_id"), ("idx", "idx"),
    ("x", "CAST((cents + 37 * idx) % 80 AS DOUBLE) / 100"),
    ("y", "CAST((cents // 7 + 29 * idx) % 80 AS DOUBLE) / 100"),
    ("w", "CAST(10 + (cents + 13 * idx) % 25 AS DOUBLE) / 100"),
    ("h", "CAST(10 + (cents + 17 * idx) % 25 AS DOUBLE) / 100"),
    ("yaw", "CASE WHEN (cents + idx) % 7 = 0 THEN NULL "
            "ELSE CAST((cents + 11 * idx) % 150 - 75 AS DOUBLE) / 100 END"),
    ("capture_quality", "CASE WHEN (cents + idx) % 5 = 0 THEN NULL "
                        "ELSE CAST((cents + 3 * idx) % 101 AS DOUBLE) / 100 END"),
    ("sharp_l", "CASE WHEN (cents + idx) % 4 = 0 THEN NULL "
                "ELSE CAST((cents + 19 * idx) % 120 AS DOUBLE) / 100 END"),
    ("sharp_r", "CASE WHEN (cents + idx) % 6 = 0 THEN NULL "
                "ELSE CAST((cents + 23 * idx) % 120 AS DOUBLE) / 100 END"),
    ("open_l", "CASE WHEN (cents + idx) % 9 = 0 THEN NULL "
               "ELSE CAST((cents + 31 * idx) % 101 AS DOUBLE) / 100 END"),
    ("open_r", "CASE WHEN (cents + idx) % 3 = 0 THEN NULL "
               "ELSE CAST((cents + 41 * idx) % 101 AS DOUBLE) / 100 END"),
    ("eye_source", "CASE (cents + idx) % 3 WHEN 0 THEN 'ear_landmarks' "
                   "WHEN 1 THEN 'mediapipe_blendshapes' ELSE 'unknown' END"),
]


def _list(columns) -> str:
    return ",\n ".join(f"{text} AS {name}" for name, text in columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark(columns) -> list[str]:
    return [f"{text.replace('//', 'div')} AS {name}" for name, text in columns]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: photo_id, shoot_id, profile, t_ms, vec, bias, face_count."""
    base = table(spark, sf_dir, "events").selectExpr("event_id AS e", "value")
    return base.selectExpr(*_spark(_FRAME_COLUMNS)).selectExpr(
        "photo_id", "shoot_id", "profile", "t_ms", "bias", "face_count", "cents", "theta",
        "CASE WHEN no_vec THEN NULL ELSE array(CAST(cos(theta / 1000D) AS FLOAT), "
        "CAST(sin(theta / 1000D) AS FLOAT)) END AS vec")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo-level measurements; NULL where the detector abstained."""
    measured = frames(spark, sf_dir).selectExpr(*_spark(_PHOTO_COLUMNS))
    return measured.selectExpr(
        "*", "CASE WHEN has_saliency THEN named_struct('x', sal_x, 'y', sal_y, "
             "'w', 0.2D, 'h', 0.2D) END AS saliency").drop("sal_x", "sal_y", "has_saliency")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per face."""
    base = frames(spark, sf_dir).where("face_count > 0").selectExpr(
        "photo_id", "cents", "explode(sequence(0L, face_count - 1)) AS idx")
    return base.selectExpr(*_spark(_FACE_COLUMNS)).selectExpr(
        "photo_id", "idx", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS bbox",
        "yaw", "capture_quality", "sharp_l", "sharp_r", "open_l", "open_r", "eye_source")


FRAMES_SQL = f"""frames AS (SELECT *, CAST(cos(theta / CAST(1000 AS DOUBLE)) AS FLOAT) AS vx0,
 CAST(sin(theta / CAST(1000 AS DOUBLE)) AS FLOAT) AS vy0 FROM (SELECT {_list(_FRAME_COLUMNS)}
 FROM (SELECT event_id AS e, value FROM events)))"""

PHOTOS_SQL = f"photos AS (SELECT {_list(_PHOTO_COLUMNS)} FROM frames)"

FACES_SQL = f"""faces AS (SELECT {_list(_FACE_COLUMNS)} FROM
 (SELECT photo_id, cents, unnest(range(face_count)) AS idx FROM frames))"""

_COSINE = """(CAST(a.vx0 AS DOUBLE) * CAST(b.vx0 AS DOUBLE)
 + CAST(a.vy0 AS DOUBLE) * CAST(b.vy0 AS DOUBLE))
 / (sqrt(CAST(a.vx0 AS DOUBLE) * CAST(a.vx0 AS DOUBLE) + CAST(a.vy0 AS DOUBLE) * CAST(a.vy0 AS DOUBLE))
 * sqrt(CAST(b.vx0 AS DOUBLE) * CAST(b.vx0 AS DOUBLE) + CAST(b.vy0 AS DOUBLE) * CAST(b.vy0 AS DOUBLE)))"""


def distance_sql(a: str, b: str) -> str:
    """Cosine distance between two rows of `frames` named a and b."""
    text = _COSINE.replace("a.", f"{a}.").replace("b.", f"{b}.")
    return f"CASE WHEN {a}.no_vec OR {b}.no_vec THEN 1.0 ELSE 1.0 - {text} END"


# Dated frames in order with the step from the previous one.
STEPS_SQL = f"""{FRAMES_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY t_ms, photo_id) AS rn
 FROM frames WHERE t_ms IS NOT NULL),
steps AS (SELECT c.*, p.photo_id AS p_id, p.bias AS p_bias, p.face_count AS p_faces,
 c.t_ms - p.t_ms AS gap_ms,
 CASE WHEN p.photo_id IS NOT NULL THEN {distance_sql('p', 'c')} END AS step_dist
 FROM numbered c LEFT JOIN numbered p ON p.shoot_id = c.shoot_id AND p.rn = c.rn - 1)"""
