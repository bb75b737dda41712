"""Queries on scores, flags, measurements and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import geometry
from ..functions.curves import piecewise as piecewise_column
from ..operators import lookups, measure, scoring, selection, shots
from ..operators.flags import flag_columns
from ..operators.ordered import row_numbers
from ..runtime import checkpoint, shuffle_partitions
from .checks import FRAMES_SQL, SELECTION_SQL, SHOTS_SQL, SUBJECT_SQL, diverse_sql, half_up, num, piecewise_sql, score_sql
from .frames import FACES_SQL, PHOTOS_SQL, faces, frames, photos, table
from .registry import query

# --- scalar functions -------------------------------------------------------------


@query("piecewise", "SELECT event_id, " + ", ".join(
    f"round({piecewise_sql('x', points)}, 9) AS {name}" for name, points in (
        ("eye", P.EYE_FOCUS_CURVE), ("ear", P.EYES_OPEN_CURVES["ear_landmarks"]),
        ("frame", P.FRAME_SHARPNESS_CURVE))) + """ FROM (SELECT event_id,
 CASE WHEN event_id % 10 <> 0 THEN value / 490 END AS x FROM events)""")
def piecewise(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 10 <> 0 THEN value / 490 END AS x")
    curves = {"eye": P.EYE_FOCUS_CURVE, "ear": P.EYES_OPEN_CURVES["ear_landmarks"],
              "frame": P.FRAME_SHARPNESS_CURVE}
    return rows.select("event_id", *[F.round(piecewise_column("x", points), 9).alias(name)
                                     for name, points in curves.items()])




@query("ear_openness", """SELECT event_id, CASE WHEN event_id % 6 <> 0 AND d > 0 THEN round(least(1.0, greatest(0.0,
 (hi - 0.0) / (3 * d) * 5 - 0.5)), 6) END AS openness FROM (SELECT event_id, event_id % 5 AS d,
 greatest(CAST(event_id % 17 AS DOUBLE), 1.0) AS hi FROM events)""")
def ear_openness(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", """CASE WHEN event_id % 6 = 0 THEN array(0D, 1D, 2D) ELSE array(0D,
          CAST(event_id % 5 AS DOUBLE), CAST(2 * (event_id % 5) AS DOUBLE), CAST(3 * (event_id % 5) AS DOUBLE))
          END AS xs""", "array(0D, CAST(event_id % 17 AS DOUBLE), 1D, 0.5D) AS ys")
    return rows.select("event_id", F.round(geometry.ear_openness("xs", "ys"), 6).alias("openness"))


_ANGLES = "value / 500 AS a, CAST(event_id % 100 AS DOUBLE) / 100 AS b, CAST(event_id % 37 AS DOUBLE) / 40 AS c"


@query("euler", f"""SELECT event_id, round(atan2(sin(b), sqrt((cos(a) * cos(b)) ** 2 + (sin(a) * cos(b)) ** 2)), 6)
 AS yaw, round(atan2(sin(a) * cos(b), cos(a) * cos(b)), 6) AS roll, round(atan2(sin(c), cos(c)), 6) AS pitch
 FROM (SELECT event_id, {_ANGLES} FROM events)""")
def euler(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", *_ANGLES.split(", "))
    a, b, c, zero = F.col("a"), F.col("b"), F.col("c"), F.lit(0.0)
    matrix = [[F.cos(a) * F.cos(b), zero, zero], [F.sin(a) * F.cos(b), zero, zero],
              [-F.sin(b), F.sin(c), F.cos(c)]]
    return rows.select("event_id", *[F.round(v, 6).alias(k)
                                     for k, v in geometry.euler_angles(matrix).items()])


@query("bbox_convert", f"""WITH {FRAMES_SQL}, {FACES_SQL}, u AS (SELECT photo_id, idx, (x * 6000 - 60) / 6000 AS ux,
 1 - ((y * 4000 - 40) + h * 4000) / 4000 AS uy, w * 6000 / 6000 AS uw, h * 4000 / 4000 AS uh FROM faces)
 SELECT photo_id, idx, round(least(1.0, greatest(0.0, ux)), 6) AS x, round(least(1.0, greatest(0.0, uy)), 6) AS y,
 round(least(1.0 - least(1.0, greatest(0.0, ux)), greatest(0.0, uw)), 6) AS w,
 round(least(1.0 - least(1.0, greatest(0.0, uy)), greatest(0.0, uh)), 6) AS h FROM u""")
def bbox_convert(spark, sf_dir):
    box = F.col("bbox")
    pixels = geometry.make_box(box["x"] * 6000 - 60, box["y"] * 4000 - 40, box["w"] * 6000, box["h"] * 4000)
    unit = geometry.pixel_box_to_unit(pixels, F.lit(6000), F.lit(4000))
    rows = faces(spark, sf_dir).select("photo_id", "idx", unit.alias("u"))
    rows = rows.select("photo_id", "idx", geometry.clamp_box("u").alias("b"))
    return rows.select("photo_id", "idx", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query("eye_box", f"""WITH {FRAMES_SQL}, {FACES_SQL}, s AS (SELECT *, unnest(['left', 'right']) AS side FROM faces)
 SELECT photo_id, idx, side, round(greatest(0.0, CASE WHEN side = 'left' THEN x + w - w * {num(.62)} ELSE x END
 - w * {num(.05)}), 6) AS x, round(greatest(0.0, y + h * {num(.55)}), 6) AS y,
 round(least(1.0, w * {num(.62)} + w * {num(.1)}), 6) AS w, round(least(1.0, h * {num(.45)}), 6) AS h FROM s""")
def eye_box(spark, sf_dir):
    sides = faces(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    rows = sides.select("photo_id", "idx", "side", geometry.eye_box("bbox", F.col("side")).alias("b"))
    return rows.select("photo_id", "idx", "side", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query("eye_sharp_ratio", f"""SELECT event_id, CASE WHEN w > 8 AND h > 8 AND m > 0 THEN
 {half_up('least(1.5, value / 100 / m)', 4)} END AS ratio FROM (SELECT event_id, value, event_id % 30 AS w, event_id % 41 AS h, event_id % 7 AS m FROM events)""")
def eye_sharp_ratio(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", geometry.eye_sharp_ratio(
        F.col("value") / 100, F.col("event_id") % 7, F.col("event_id") % 30, F.col("event_id") % 41).alias("ratio"))


# --- faces, flags, scores -----------------------------------------------------------

@query("primary_subject", f"""WITH {SUBJECT_SQL} SELECT photo_id, idx AS primary_idx, n_faces, CASE WHEN near THEN
 'largest_face_near_saliency_peak' WHEN idx IS NOT NULL THEN 'largest_face' WHEN has_saliency THEN
 'saliency_peak_no_faces' ELSE 'frame_center_fallback' END AS why FROM subjects""")
def primary_subject(spark, sf_dir):
    rows = scoring.with_subject(photos(spark, sf_dir), faces(spark, sf_dir))
    return rows.select("photo_id", F.col("primary.idx").alias("primary_idx"), "n_faces", "why")


@query("other_blinking", f"WITH {SUBJECT_SQL} SELECT photo_id, other_blinking FROM subjects")
def other_blinking(spark, sf_dir):
    return scoring.with_subject(photos(spark, sf_dir), faces(spark, sf_dir)).select("photo_id", "other_blinking")


@query("flags", f"""WITH {SUBJECT_SQL} SELECT photo_id, any_clipped, subject_near_edge, no_headroom,
 lead_room_inverted, horizon_tilt, round(edge_distance, 6) AS edge_distance,
 round(thirds_distance, 6) AS thirds_distance FROM flags""")
def flags(spark, sf_dir):

    rows = flag_columns(scoring.with_subject(photos(spark, sf_dir), faces(spark, sf_dir)))
    return rows.select("photo_id", "any_clipped", "subject_near_edge", "no_headroom", "lead_room_inverted",
                       "horizon_tilt", F.round("edge_distance", 6).alias("edge_distance"),
                       F.round("thirds_distance", 6).alias("thirds_distance"))


_SCORE_COLUMNS = ["photo_id", "profile", "total", *P.METRICS, "hint", "n_faces", "other_blinking"]
_SCORE_LIST = "photo_id, profile, total, " + ", ".join(
    f"round({m}, 9) AS {m}" for m in P.METRICS) + ", hint, n_faces, other_blinking"


def _rounded(scores):
    return scores.select(*_SCORE_COLUMNS).withColumns({m: F.round(m, 9) for m in P.METRICS})


@query("score", f"WITH {SUBJECT_SQL}, {score_sql()} SELECT {_SCORE_LIST} FROM scores")
def score(spark, sf_dir):
    return _rounded(scoring.score(photos(spark, sf_dir), faces(spark, sf_dir)))


_PROFILES = ", ".join(f"'{p}'" for p in P.PROFILE_WEIGHTS)


@query("score_all_profiles", f"""WITH {SUBJECT_SQL}, every AS (SELECT * EXCLUDE (profile), unnest([{_PROFILES}])
 AS profile FROM flags), {score_sql('every')} SELECT {_SCORE_LIST} FROM scores""")
def score_all_profiles(spark, sf_dir):
    return _rounded(scoring.score_all_profiles(photos(spark, sf_dir), faces(spark, sf_dir)))


_REASONS_SQL = {
    "eye_focus": f"""CASE WHEN idx IS NULL THEN 'no_face' WHEN COALESCE(abs(yaw) > {P.MAX_EYE_YAW}, FALSE) THEN 'abstained_extreme_yaw'
 WHEN COALESCE(sharp_l, sharp_r) IS NULL THEN 'eyes_not_measured' WHEN sharpness_max < {P.MIN_FRAME_SHARPNESS} THEN 'frame_soft_motion_blur' END""",
    "eyes_open": f"""CASE WHEN idx IS NULL THEN 'no_face' WHEN COALESCE(abs(yaw) > {P.MAX_EYE_YAW}, FALSE) THEN 'abstained_extreme_yaw'
 WHEN COALESCE(open_l, open_r) IS NULL THEN 'detector_unavailable' END""",
    "sharpness": "CASE WHEN sharpness_mean IS NULL OR sharpness_max IS NULL THEN 'not_measured' END",
    "composition": "CAST(NULL AS VARCHAR)",
    "face_quality": "CASE WHEN capture_quality IS NULL THEN 'no_face_or_not_measured' END",
    "exposure": "CASE WHEN exposure IS NULL THEN 'not_measured' END"}
_COMPONENTS_SQL = " UNION ALL ".join(f"""SELECT photo_id, '{m}' AS metric, {half_up(m, 4)} AS value, {half_up(
    f'CASE WHEN {m} IS NOT NULL AND live_weight > 0 THEN w_{m} / live_weight ELSE w_{m} END', 4)} AS weight, {half_up(
    f'CASE WHEN live_weight > 0 THEN {m} * (w_{m} / live_weight) END', 4)} AS contrib, {reason} AS reason
 FROM scores WHERE w_{m} IS NOT NULL""" for m, reason in _REASONS_SQL.items())


@query("score_components", f"WITH {SUBJECT_SQL}, {score_sql()} {_COMPONENTS_SQL}")
def score_components(spark, sf_dir):
    rows = scoring.component_rows(scoring.score(photos(spark, sf_dir), faces(spark, sf_dir)))
    return rows.select("photo_id", "metric", "value", "weight", "contrib", F.try_element_at("evidence", F.lit("reason")).alias("reason"))


@query("profile_errors", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'wedding' WHEN 1 THEN NULL ELSE 'Portrait' END AS profile,
 'unknown_profile' AS error FROM events WHERE event_id % 6 < 3""")
def profile_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", """CASE event_id % 6 WHEN 0 THEN 'wedding' WHEN 1 THEN NULL
      WHEN 2 THEN 'Portrait' WHEN 3 THEN 'portrait' WHEN 4 THEN 'street' ELSE 'event' END AS profile""")
    return scoring.profile_errors(rows, "event_id")


# a photo's nested payload, taken apart again face by face
@query("capture_payload", f"""WITH {SUBJECT_SQL}, {score_sql()}, listed AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY idx) - 1
 AS pos FROM faces), sizes AS (SELECT photo_id // 7 AS shot_id, COUNT(*) AS size FROM frames GROUP BY shot_id)
 SELECT p.photo_id, l.pos, l.idx, l.x, l.yaw, l.sharp_l, l.open_r, l.eye_source, p.sharpness_max, s.total,
 {half_up('s.exposure', 4)} AS exposure, len(list_filter([s.any_clipped, s.no_headroom, s.lead_room_inverted, s.subject_near_edge,
 s.horizon_tilt], lambda f: f)) > 0 AS flagged, z.size, p.photo_id // 7 % 5 = 0 AS is_bracket,
 CASE WHEN p.photo_id % 3 = 0 THEN CASE WHEN p.photo_id % 2 = 0 THEN 'alt' ELSE 'pick' END WHEN p.photo_id % 3 = 1 THEN 'pick' END AS state
 FROM photos p LEFT JOIN listed l USING (photo_id) LEFT JOIN scores s USING (photo_id) JOIN sizes z ON z.shot_id = p.photo_id // 7""")
def capture_payload(spark, sf_dir):
    shown, found = photos(spark, sf_dir), faces(spark, sf_dir)
    analysis = shown.select("photo_id", F.lit("v1").alias("engine_version"), F.lit("full").alias("decode_mode"), F.struct(
        F.lit(None).cast("array<array<double>>").alias("sharpness_tiles"), "sharpness_max", "sharpness_mean").alias("frame"))
    members = shown.selectExpr("photo_id div 7 AS group_id", "photo_id", "photo_id div 7 % 5 = 0 AS is_bracket")
    # every third photo is in two selections, every third in none; the newer one counts
    entry = "photo_id, '{s}' AS state, 1L AS rank, '' AS reason, false AS user_override"
    entries = shown.where("photo_id % 3 < 2").selectExpr("1L AS selection_id", *entry.format(s="pick").split(", ")).unionByName(
        shown.where("photo_id % 6 = 0").selectExpr("2L AS selection_id", *entry.format(s="alt").split(", ")))
    selections = spark.sql("SELECT * FROM VALUES (1L, DATE'2024-01-01'), (2L, DATE'2024-01-02') AS s(selection_id, created_at)")
    rows = lookups.capture_payload(shown.select("photo_id", "profile"), analysis, found, scoring.score_all_profiles(shown, found), members, entries, selections)
    parts = rows.select("*", F.posexplode_outer("faces").alias("pos", "face"))
    flagged = F.exists("score.flags", lambda f: F.substring_index(f, ":", 1).isin(*P.FLAG_PENALTIES))
    return parts.select(
        "photo_id", F.col("pos").cast("long").alias("pos"), "face.idx", "face.bbox.x", "face.yaw", F.col("face.eyes.left.sharp_norm").alias("sharp_l"),
        F.col("face.eyes.right.open").alias("open_r"), "face.eye_source", "analysis.frame.sharpness_max", "score.total",
        F.col("score.components.exposure.value").alias("exposure"), flagged.alias("flagged"), "group.size", "group.is_bracket", "selection.state")


@query("composition", f"WITH {SUBJECT_SQL}, {score_sql()} SELECT photo_id, round(composition, 6) AS composition FROM scores")
def composition(spark, sf_dir):
    rows = scoring.add_flags(scoring.with_subject(photos(spark, sf_dir), faces(spark, sf_dir)))
    return rows.select("photo_id", F.round(scoring.composition(F.col("flags")), 6).alias("composition"))


@query("stale_scores", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'portrait' WHEN 1 THEN 'event' "
       "WHEN 2 THEN 'landscape' ELSE 'street' END AS profile FROM events WHERE event_id % 3 = 0 OR event_id % 4 <> 1")
def stale_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", """CASE event_id % 4 WHEN 0 THEN 'portrait'
      WHEN 1 THEN 'event' WHEN 2 THEN 'landscape' ELSE 'street' END AS profile""")
    made = F.when(F.col("event_id") % 3 != 0, scoring.weights_hash("event")).otherwise("ev1-00000000")
    return scoring.stale_scores(rows.withColumn("weights_hash", made)).select("event_id", "profile")


_TILE = "CAST(({c} * (r + 1) + 31 * r * k + 17 * k) % 1000 AS DOUBLE) / 10000"
_TILES_SQL = ("SELECT photo_id, sharpness_max AS m, sharpness_mean, list_transform(range(16), lambda r: "
              "list_transform(range(16), lambda k: " + _TILE.format(c="cents") + ")) AS t FROM photos")
_CORNERS = " + ".join(f"t[{y}][{x}]" for y in (1, 2, 15, 16) for x in (1, 2, 15, 16))


@query("tile_lookup", f"""WITH {FRAMES_SQL}, {PHOTOS_SQL}, tiled AS ({_TILES_SQL}), cells AS (SELECT photo_id, r AS row, k AS col,
 t[r + 1][k + 1] AS value, list_max(flatten(t)) AS tile_max, list_sum(flatten(t)) / 256 AS tile_mean FROM tiled, range(16) AS x(r),
 range(16) AS y(k)) SELECT photo_id, row, SUM(col * value) AS weighted, MAX(tile_max) AS tile_max, round(MAX(tile_mean), 9) AS tile_mean
 FROM cells WHERE value IS NOT NULL GROUP BY photo_id, row""".replace("SUM(col * value)", "round(SUM(col * value), 9)"))
def tile_lookup(spark, sf_dir):
    tile = _TILE.format(c="cents")
    # dealt out while a row is two numbers: the tiles are then made on all cores, and summed where they are
    dealt = photos(spark, sf_dir).select("photo_id", "cents").repartition(shuffle_partitions(spark), "photo_id")
    rows = dealt.selectExpr("photo_id", f"transform(sequence(0, 15), r -> transform(sequence(0, 15), k -> {tile})) AS tiles")
    found = lookups.tile_lookup(rows, "photo_id").where("value IS NOT NULL")
    return found.groupBy("photo_id", F.col("row").cast("long").alias("row")).agg(
        F.round(F.sum(F.col("col") * F.col("value")), 9).alias("weighted"), F.max("tile_max").alias("tile_max"),
        F.round(F.max("tile_mean"), 9).alias("tile_mean"))


@query("focus_coverage", f"""WITH {FRAMES_SQL}, {PHOTOS_SQL}, tiled AS ({_TILES_SQL}), stats AS (SELECT *,
 len(list_filter(flatten(t), lambda v: v >= m * 0.25)) / CAST(256 AS DOUBLE) AS coverage,
 ({_CORNERS}) / 16 / m AS corner_ratio FROM tiled)
 SELECT photo_id, round(CASE WHEN m IS NOT NULL THEN coverage END, 9) AS coverage,
 round(CASE WHEN m > 0 THEN corner_ratio END, 9) AS corner_ratio,
 round(CASE WHEN m IS NULL THEN NULL WHEN m < 0.005 THEN 0.0 WHEN corner_ratio < 0.05
 THEN least({piecewise_sql('coverage', P.FOCUS_COVERAGE_CURVE)}, 0.7)
 ELSE {piecewise_sql('coverage', P.FOCUS_COVERAGE_CURVE)} END, 9) AS sharpness FROM stats""")
def focus_coverage(spark, sf_dir):
    tile = _TILE.format(c="cents")
    rows = photos(spark, sf_dir).selectExpr(
        "photo_id", "sharpness_max", "sharpness_mean",
        f"transform(sequence(0, 15), r -> transform(sequence(0, 15), k -> {tile})) AS sharpness_tiles")
    rows = scoring.with_focus_plane(rows)
    value = scoring.landscape_sharpness(F.col("sharpness_max"), F.col("sharpness_mean"))
    return rows.select(
        "photo_id", F.round(F.when(F.col("sharpness_max").isNotNull(), F.col("coverage")), 9).alias("coverage"),
        F.round(F.when(F.col("sharpness_max") > 0, F.col("corner_ratio")), 9).alias("corner_ratio"),
        F.round(value, 9).alias("sharpness"))


PLANE_WIDTH = 48


# Sobel sums by rows, then columns: differences and weighted sums of three neighbours
_TILES_SQL = f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
 lambda x: CAST('0x' || x AS INTEGER)) AS b FROM documents),
 s AS (SELECT doc_id, b, CAST(ceil(len(b) / CAST({PLANE_WIDTH} AS DOUBLE)) AS BIGINT) AS h FROM d),
 px AS (SELECT doc_id, h, unnest(list_concat(b, list_transform(range(h * {PLANE_WIDTH} - len(b)), lambda i: 32))) AS v,
 unnest(range(h * {PLANE_WIDTH})) AS i FROM s),
 xy AS (SELECT doc_id, h // 16 AS th, v, i // {PLANE_WIDTH} AS y, i % {PLANE_WIDTH} AS x FROM px),
 across AS (SELECT *, lead(v) OVER r - lag(v) OVER r AS a, lag(v) OVER r + 2 * v + lead(v) OVER r AS t FROM xy
 WINDOW r AS (PARTITION BY doc_id, y ORDER BY x)),
 sobel AS (SELECT *, lag(a) OVER c + 2 * a + lead(a) OVER c AS gx, lead(t) OVER c - lag(t) OVER c AS gy FROM across
 WINDOW c AS (PARTITION BY doc_id, x ORDER BY y)),
 energy AS (SELECT doc_id, y // th AS ty, x // {PLANE_WIDTH // 16} AS tx, SUM(CAST(gx * gx + gy * gy AS BIGINT))
 / CAST((th - 2) * {PLANE_WIDTH // 16 - 2} AS DOUBLE) / CAST(4 * 255 * 255 AS DOUBLE) AS e FROM sobel
 WHERE th > 2 AND y < 16 * th AND y % th BETWEEN 1 AND th - 2 AND x % {PLANE_WIDTH // 16} = 1 GROUP BY doc_id, th, ty, tx),
 tiled AS (SELECT doc_id, MAX(e) AS top, SUM(e) / 256 AS mean, SUM(e * (16 * ty + tx + 1)) AS placed FROM energy GROUP BY doc_id),
 clip AS (SELECT doc_id, AVG(CASE WHEN v >= {P.CLIP_HIGH} THEN 1.0 ELSE 0.0 END) AS hi, AVG(CASE WHEN v <= {P.CLIP_LOW} THEN 1.0 ELSE 0.0 END) AS lo
 FROM xy GROUP BY doc_id)"""


@query("tile_energy", f"""{_TILES_SQL} SELECT doc_id, round(COALESCE(top, 0), 9) AS sharpness_max, round(COALESCE(mean, 0), 9) AS sharpness_mean,
 round(COALESCE(placed, 0), 6) AS placed_energy, round(hi, 9) AS clipped_hi, round(lo, 9) AS clipped_lo
 FROM s LEFT JOIN tiled USING (doc_id) LEFT JOIN clip USING (doc_id)""")
def tile_energy(spark, sf_dir):
    """Each document's bytes, padded with spaces, as a plane 48 pixels wide; each tile's
    energy enters `placed_energy` with the number of its place."""
    data = F.encode("text", "UTF-8")
    height = F.ceil(F.octet_length("text") / PLANE_WIDTH).cast("int")
    planes = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(PLANE_WIDTH).alias("width"), height.alias("height"),
        F.rpad(data, height * PLANE_WIDTH, F.lit(" ").cast("binary")).alias("pixels"))
    placed = F.aggregate(F.transform(F.flatten("tiles"), lambda e, i: e * (i + 1)), F.lit(0.0), lambda a, e: a + e)
    return measure.measure_frames(planes, "doc_id").select(
        "doc_id", *[F.round(c, 9).alias(c) for c in ("sharpness_max", "sharpness_mean", "clipped_hi", "clipped_lo")],
        F.round(placed, 6).alias("placed_energy"))


# --- selection ----------------------------------------------------------------------

@query("keep_n", "SELECT size, profile, CAST(greatest(1, least(cap, ceil(size * rate))) AS BIGINT) AS keep FROM "
       "(SELECT DISTINCT n AS size FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey)), (VALUES "
       + ", ".join(f"('{name}', {num(rate)}, {cap})" for name, (rate, cap) in P.KEEP_RATES.items())
       + ") AS k(profile, rate, cap)")
def keep_n(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    names = F.explode(F.array(*[F.lit(p) for p in P.KEEP_RATES])).alias("profile")
    rows = sizes.select("size").distinct().select("size", names)
    return rows.withColumn("keep", selection.keep_n(F.col("size"), F.col("profile")).cast("long"))


_CULL_SQL = f"""{SUBJECT_SQL}, {score_sql()}, grouped AS (SELECT *, photo_id // 6 AS group_id,
 (photo_id // 6) % 10 = 0 AS is_bracket, other_blinking AS blinks FROM scores),
 stats AS (SELECT group_id, COUNT(*) AS size, MAX(blinks) AS group_blinks FROM grouped GROUP BY group_id),
 ranks AS (SELECT g.*, size, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN group_blinks > 0 THEN
 blinks ELSE 0 END, total DESC, photo_id) AS rnk FROM grouped g JOIN stats USING (group_id)),
 tops AS (SELECT *, MAX(CASE WHEN rnk = 1 THEN total END) OVER (PARTITION BY group_id) AS top_total,
 CASE profile WHEN 'portrait' THEN least(5, ceil(size * {num(.35)})) WHEN 'event' THEN least(3, ceil(size * {num(.2)}))
 WHEN 'landscape' THEN least(4, ceil(size * {num(.5)})) ELSE least(6, ceil(size * {num(.6)})) END AS keep FROM ranks),
 states AS (SELECT *, CASE WHEN is_bracket THEN 'pick' WHEN top_total < 0.35 THEN 'alt' WHEN rnk <= keep THEN 'pick'
 WHEN rnk <= keep + 1 THEN 'alt' ELSE 'reject' END AS state FROM tops),
 culled AS (SELECT *, CASE WHEN NOT is_bracket THEN rnk END AS rank, CASE WHEN is_bracket THEN 'bracket'
 WHEN size = 1 AND top_total < 0.35 THEN 'only_below_floor' WHEN size = 1 THEN 'only_frame'
 WHEN top_total < 0.35 THEN 'no_good_frame' WHEN state = 'pick' AND rnk = 1 THEN 'best'
 WHEN state = 'pick' THEN 'diversity_pick' WHEN state = 'alt' THEN 'runner_up'
 WHEN eyes_open < 0.4 THEN 'eyes_closed' WHEN eye_focus < 0.3 THEN 'focus_missed' ELSE 'outscored' END AS reason_code,
 NOT is_bracket AND top_total < 0.35 AS no_good FROM states)"""


def _candidates(spark, sf_dir):
    """Scores in groups of six ids, without embeddings."""
    scores = scoring.score(photos(spark, sf_dir), faces(spark, sf_dir))
    return scores.selectExpr(
        "photo_id", "profile", "total", "eye_focus", "eyes_open", "other_blinking AS blinks",
        "photo_id div 6 AS group_id", "(photo_id div 6) % 10 = 0 AS is_bracket",
        "CAST(NULL AS ARRAY<FLOAT>) AS vec")


@query("cull", f"WITH {_CULL_SQL} SELECT group_id, photo_id, state, rank, reason_code, no_good FROM culled")
def cull(spark, sf_dir):
    return selection.select_frames(_candidates(spark, sf_dir), ["group_id"], "photo_id").drop("reason")


@query("blink_rank", f"""WITH {_CULL_SQL} SELECT group_id, photo_id, blinks, rnk AS rank FROM ranks""")
def blink_rank(spark, sf_dir):
    ranked = selection.rank_members(_candidates(spark, sf_dir), ["group_id"], "photo_id")
    return ranked.select("group_id", "photo_id", "blinks", "rank")


_ENTRIES = """l_orderkey AS shoot_id, l_orderkey * 10 + l_linenumber AS photo_id, CASE WHEN l_discount > 0.07 THEN
 'pick' WHEN l_discount > 0.05 THEN 'alt' ELSE 'reject' END AS state, l_extendedprice AS total, l_linenumber % 7 = 3
 AS user_override, l_suppkey AS person"""
_ENTRIES_SQL = f"""raw AS (SELECT {_ENTRIES} FROM lineitem), entries AS (SELECT shoot_id, photo_id, MIN(state) AS state,
 MAX(total) AS total, bool_or(user_override) AS user_override FROM raw GROUP BY shoot_id, photo_id),
 persons AS (SELECT DISTINCT photo_id, person FROM raw)"""


def _entries(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS shoot_id", "l_orderkey * 10 + l_linenumber AS photo_id", """CASE WHEN l_discount > 0.07 THEN
        'pick' WHEN l_discount > 0.05 THEN 'alt' ELSE 'reject' END AS state""", "l_extendedprice AS total",
        "l_linenumber % 7 = 3 AS user_override", "l_suppkey AS person")
    entries = raw.groupBy("shoot_id", "photo_id").agg(
        F.min("state").alias("state"), F.max("total").alias("total"), F.max("user_override").alias("user_override"))
    return entries, raw.select("photo_id", "person").distinct()


@query("overrides", f"""WITH {_ENTRIES_SQL} SELECT photo_id, CASE WHEN photo_id % 13 = 1 THEN 'reject'
 WHEN photo_id % 13 = 2 THEN 'pick' ELSE state END AS state, photo_id % 13 IN (1, 2) AS user_override FROM entries""")
def overrides(spark, sf_dir):
    entries = _entries(spark, sf_dir)[0].withColumns({"reason": F.lit(""), "reason_code": F.lit("")})
    chosen = entries.where("photo_id % 13 IN (1, 2)").select(
        "photo_id", F.expr("CASE WHEN photo_id % 13 = 1 THEN 'reject' ELSE 'pick' END AS state"))
    return selection.apply_overrides(entries, chosen, "photo_id").select("photo_id", "state", "user_override")


@query("coverage_gaps", f"""WITH {_ENTRIES_SQL}, seen AS (SELECT * FROM persons JOIN entries USING (photo_id)),
 best AS (SELECT *, row_number() OVER (PARTITION BY shoot_id, person ORDER BY user_override, total DESC, photo_id)
 AS rn, bool_or(state <> 'reject') OVER (PARTITION BY shoot_id, person) AS covered FROM seen)
 SELECT shoot_id, person, photo_id AS best FROM best WHERE rn = 1 AND NOT covered AND NOT user_override""")
def coverage_gaps(spark, sf_dir):
    entries, persons = _entries(spark, sf_dir)
    return selection.coverage_gaps(entries, persons, "photo_id", "person", "shoot_id").drop("first_seen")


@query("coverage_guard", f"""WITH RECURSIVE {_ENTRIES_SQL}, seen AS (SELECT * FROM persons JOIN entries USING (photo_id)),
 best AS (SELECT *, row_number() OVER (PARTITION BY shoot_id, person ORDER BY user_override, total DESC, photo_id)
 AS rn, bool_or(state <> 'reject') OVER (PARTITION BY shoot_id, person) AS covered FROM seen),
 info AS (SELECT shoot_id, person, MIN(photo_id) AS first_seen, list(photo_id) AS mine FROM seen GROUP BY shoot_id, person),
 asked AS (SELECT shoot_id, person, photo_id AS best, mine, row_number() OVER (PARTITION BY shoot_id ORDER BY first_seen,
 person) AS k FROM best JOIN info USING (shoot_id, person) WHERE rn = 1 AND NOT covered AND NOT user_override),
 walk AS (SELECT shoot_id, k, best, TRUE AS promote, [best] AS done FROM asked WHERE k = 1 UNION ALL
 SELECT shoot_id, k, best, promote, CASE WHEN promote THEN list_append(done, best) ELSE done END FROM (SELECT n.shoot_id,
 n.k, n.best, w.done, NOT list_has_any(n.mine, w.done) AS promote FROM walk w JOIN asked n ON n.shoot_id = w.shoot_id
 AND n.k = w.k + 1)), lifted AS (SELECT DISTINCT best FROM walk WHERE promote)
 SELECT shoot_id, photo_id, CASE WHEN best IS NOT NULL THEN 'pick' ELSE state END AS state,
 CASE WHEN best IS NOT NULL THEN 'coverage_guard' ELSE '' END AS reason_code
 FROM entries LEFT JOIN lifted ON best = photo_id""")
def coverage_guard(spark, sf_dir):
    entries, persons = _entries(spark, sf_dir)
    entries = entries.withColumns({"reason": F.lit(""), "reason_code": F.lit("")})
    return selection.guard_coverage(entries, persons, "photo_id", "person", "shoot_id").select(
        "shoot_id", "photo_id", "state", "reason_code")


@query("best_per_key", f"""WITH {_ENTRIES_SQL} SELECT person, photo_id, total FROM (SELECT *, row_number() OVER
 (PARTITION BY person ORDER BY total DESC, photo_id) AS rn FROM persons JOIN entries USING (photo_id)) WHERE rn = 1""")
def best_per_key(spark, sf_dir):
    entries, persons = _entries(spark, sf_dir)
    return selection.best_per_person(entries, persons, "photo_id", "person")


def propose(spark, sf_dir):
    """The whole chain: frames, shots, scores, proposal."""
    found = checkpoint(shots.group_shots(frames(spark, sf_dir)).select(
        "shoot_id", "photo_id", "is_bracket", "shot_id"))
    scores = scoring.score(photos(spark, sf_dir), faces(spark, sf_dir), brackets=found.where("is_bracket"))
    vectors = frames(spark, sf_dir).select("photo_id", "vec")
    members = (found.join(scores.select("photo_id", "profile", "total", "eye_focus", "eyes_open",
                                        F.col("other_blinking").alias("blinks")), "photo_id")
               .join(vectors, "photo_id"))
    return selection.select_frames(members, ["shoot_id", "shot_id"], "photo_id")


@query("selection", f"WITH RECURSIVE {SELECTION_SQL} SELECT * FROM entries")
def full_selection(spark, sf_dir):
    return propose(spark, sf_dir).drop("reason")


@query("selection_states", f"""WITH RECURSIVE {SHOTS_SQL}, members AS (SELECT *, COUNT(*) OVER (PARTITION BY shoot_id,
 shot_id) AS size FROM shots) SELECT shoot_id, shot_id, is_bracket, MAX(size) AS size, CAST(CASE WHEN is_bracket THEN
 MAX(size) END AS BIGINT) AS bracket_picks FROM members GROUP BY shoot_id, shot_id, is_bracket""")
def selection_states(spark, sf_dir):
    entries = propose(spark, sf_dir)
    sealed = F.col("reason_code") == "bracket"
    return entries.groupBy("shoot_id", "shot_id", sealed.alias("is_bracket")).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.when(sealed & (F.col("state") == "pick"), 1)).alias("bracket_picks"))


# totals differ within a group, so no order hangs on the last bit of a similarity
_GROUPED = """photo_id, photo_id {div} 20 AS group_id,
 CAST(cents % 101 AS DOUBLE) / 100 + CAST(photo_id % 1000 AS DOUBLE) / 1000000 AS total"""


@query("diversity_rank", f"""WITH RECURSIVE {FRAMES_SQL}, c AS (SELECT {_GROUPED.format(div='//')}, CAST(vx0 AS DOUBLE) AS x,
 CAST(vy0 AS DOUBLE) AS y, no_vec FROM frames), {diverse_sql('c', 'group_id')}
 SELECT group_id, photo_id, rank FROM diverse WHERE rank > 0""")
def diversity_rank(spark, sf_dir):
    rows = frames(spark, sf_dir).selectExpr(*_GROUPED.format(div="div").split(","), "vec")
    return selection.rank_diverse(rows, ["group_id"], "photo_id")


@query("selection_entries", """SELECT l_orderkey AS group_id, l_partkey AS photo_id, rank, row_number() OVER (ORDER BY
 l_orderkey, rank NULLS FIRST, l_partkey, l_linenumber, l_suppkey) AS pos FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END
 AS rank FROM lineitem)""")
def selection_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS group_id", "l_partkey AS photo_id", "l_linenumber", "l_suppkey",
        "CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS rank")
    return row_numbers(rows, (), ("group_id", "rank", "photo_id", "l_linenumber", "l_suppkey")).select(
        "group_id", "photo_id", "rank", "pos")


@query("compare_set", """WITH e AS (SELECT l_orderkey, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey AS photo_id,
 l_linenumber = 1 AS cur, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS rank, l_partkey FROM lineitem),
 u AS (SELECT l_orderkey, photo_id, bool_or(cur) AS cur, MIN(rank) AS rank FROM e GROUP BY l_orderkey, photo_id)
 SELECT l_orderkey, photo_id, CAST(0 AS INTEGER) AS slot FROM u WHERE cur UNION ALL
 SELECT l_orderkey, photo_id, CAST(slot AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY COALESCE(rank, 99), photo_id) AS slot FROM u WHERE NOT cur) WHERE slot <= 3""")
def compare_set(spark, sf_dir):

    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey AS photo_id", "l_linenumber = 1 AS cur",
        "CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS rank")
    entries = rows.groupBy("l_orderkey", "photo_id").agg(F.max("cur").alias("cur"), F.min("rank").alias("rank"))
    return lookups.compare_set(entries, ["l_orderkey"], F.col("cur"), "photo_id").select("l_orderkey", "photo_id", "slot")
