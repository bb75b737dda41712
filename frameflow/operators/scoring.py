"""Null-aware weighted quality score.

A metric that could not be measured is NULL, never 0, and its weight is spread
over the metrics that were measured. Everything is a column expression; faces
meet photos in one join and one aggregation on the photo key.
"""

from __future__ import annotations

import zlib
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.curves import piecewise
from .flags import add_flags, clipped

FACE_FIELDS = ("idx", "bbox", "yaw", "capture_quality", "sharp_l", "sharp_r",
               "open_l", "open_r", "eye_source")


# --- faces ------------------------------------------------------------------

def _near(box: Column, subject: Column) -> Column:
    dx = F.abs(box["x"] + box["w"] / 2 - (subject["x"] + subject["w"] / 2))
    dy = F.abs(box["y"] + box["h"] / 2 - (subject["y"] + subject["h"] / 2))
    return F.coalesce((dx < P.SUBJECT_REACH) & (dy < P.SUBJECT_REACH), F.lit(False))


def blinking() -> Column:
    """The worse measured eye of a face row is below the blink cut."""
    return F.coalesce(F.least("open_l", "open_r") < P.BLINK_BELOW, F.lit(False))


def summarize_faces(faces: DataFrame, photos: DataFrame, key: str = "photo_id") -> DataFrame:
    """Per photo: the primary face and why, face, blink and clip counts.

    The primary face is the largest near the saliency box, else the largest;
    equal areas go to the lower index.
    """
    seen = faces.join(photos.select(key, "saliency"), key)
    rank = F.struct(_near(F.col("bbox"), F.col("saliency")).alias("near"),
                    (F.col("bbox.w") * F.col("bbox.h")).alias("area"),
                    (-F.col("idx")).alias("first"))
    chosen = F.struct(*FACE_FIELDS, rank["near"].alias("near"), blinking().alias("blinks"))
    return seen.groupBy(key).agg(
        F.max_by(chosen, rank).alias("primary"),
        F.count(F.lit(1)).alias("n_faces"),
        F.sum(blinking().cast("int")).alias("_blinks"),
        F.max(clipped(F.col("bbox"))).alias("_clipped"))


def with_subject(photos: DataFrame, faces: DataFrame, key: str = "photo_id") -> DataFrame:
    """Photos with primary face, `why`, face count and other blinking faces."""
    joined = photos.join(summarize_faces(faces, photos, key), key, "left")
    why = (F.when(F.col("primary.near"), "largest_face_near_saliency_peak")
           .when(F.col("primary").isNotNull(), "largest_face")
           .when(F.col("saliency").isNotNull(), "saliency_peak_no_faces")
           .otherwise("frame_center_fallback"))
    others = F.col("_blinks") - F.col("primary.blinks").cast("int")
    return joined.withColumns({
        "why": why,
        "n_faces": F.coalesce("n_faces", F.lit(0)).cast("long"),
        "other_blinking": F.coalesce(others, F.lit(0)).cast("long"),
        "any_clipped": F.coalesce("_clipped", F.lit(False)),
    }).drop("_blinks", "_clipped")


# --- metrics ----------------------------------------------------------------

def _turned_away(face: Column) -> Column:
    return F.coalesce(F.abs(face["yaw"]) > P.MAX_EYE_YAW, F.lit(False))


def eye_focus(face: Column, frame_max: Column) -> tuple[Column, Column]:
    """(value, reason): the sharper eye on the focus curve."""
    best = F.greatest(face["sharp_l"], face["sharp_r"])
    reason = (F.when(face.isNull(), "no_face")
              .when(_turned_away(face), "abstained_extreme_yaw")
              .when(best.isNull(), "eyes_not_measured")
              .when(frame_max < P.MIN_FRAME_SHARPNESS, "frame_soft_motion_blur"))
    return F.when(reason.isNull(), piecewise(best, P.EYE_FOCUS_CURVE)), reason


def eyes_open(face: Column) -> tuple[Column, Column]:
    """(value, reason): the more closed eye on its detector's curve."""
    worst = F.least(face["open_l"], face["open_r"])
    reason = (F.when(face.isNull(), "no_face")
              .when(_turned_away(face), "abstained_extreme_yaw")
              .when(worst.isNull(), "detector_unavailable"))
    curve = F.when(F.lit(False), F.lit(None).cast("double"))
    for source, points in P.EYES_OPEN_CURVES.items():
        curve = curve.when(face["eye_source"] == source, piecewise(worst, points))
    return F.when(reason.isNull(), curve.otherwise(piecewise(worst, P.EYES_OPEN_CURVE))), reason


def sharpness(frame_max: Column, frame_mean: Column) -> Column:
    """A frame soft everywhere is a real 0, not an unknown."""
    return (F.when(frame_mean.isNull() | frame_max.isNull(), F.lit(None).cast("double"))
            .when(frame_max < P.MIN_FRAME_SHARPNESS, F.lit(0.0))
            .otherwise(piecewise(frame_max, P.FRAME_SHARPNESS_CURVE)))


def focus_plane(tiles: Column, frame_max: Column) -> tuple[Column, Column]:
    """(coverage, corner_ratio) of a square tile grid."""
    cut = frame_max * P.TILE_FRACTION
    sharp = F.aggregate(tiles, F.lit(0), lambda n, row: n + F.size(F.filter(row, lambda v: v >= cut)))
    cells = F.aggregate(tiles, F.lit(0), lambda n, row: n + F.size(row))
    coverage = sharp / F.nullif(cells, F.lit(0))
    ends = [F.lit(1), F.lit(2), F.lit(-2), F.lit(-1)]
    corners = [F.try_element_at(F.try_element_at(tiles, y), x) for y in ends for x in ends]
    total = corners[0]
    for corner in corners[1:]:
        total = total + corner
    return coverage, total / 16 / F.nullif(frame_max, F.lit(0.0))


def with_focus_plane(rows: DataFrame) -> DataFrame:
    """Add `coverage` and `corner_ratio` as columns of their own, so that the
    curve over them does not walk the tiles again for every branch."""
    coverage, corner_ratio = focus_plane(F.col("sharpness_tiles"), F.col("sharpness_max"))
    return rows.withColumns({"coverage": coverage, "corner_ratio": corner_ratio})


def landscape_sharpness(frame_max: Column, frame_mean: Column) -> Column:
    """Share of the frame in focus; soft corners cap the value."""
    coverage, corner_ratio = F.col("coverage"), F.col("corner_ratio")
    value = piecewise(coverage, P.FOCUS_COVERAGE_CURVE)
    capped = F.when(corner_ratio < P.SOFT_CORNER_RATIO,
                    F.least(value, F.lit(P.SOFT_CORNER_CAP))).otherwise(value)
    return (F.when(coverage.isNull() | frame_max.isNull(), sharpness(frame_max, frame_mean))
            .when(frame_max < P.MIN_FRAME_SHARPNESS, F.lit(0.0)).otherwise(capped))


def composition(flags: Column) -> Column:
    """1 minus the penalty of every flag, not below 0; unknown flags cost nothing."""
    penalty = F.lit(0.0)
    for name, cost in P.FLAG_PENALTIES.items():
        found = F.filter(flags, partial(_is_flag, name))
        penalty = penalty + F.size(found) * cost
    return F.greatest(F.lit(0.0), 1.0 - penalty)


def _is_flag(name: str, flag: Column) -> Column:
    return F.substring_index(flag, ":", 1) == name


def exposure(hi: Column, lo: Column, in_bracket: Column) -> Column:
    """NULL inside a bracket, where dark frames are meant to be dark."""
    value = F.greatest(F.lit(0.0), 1.0 - 10.0 * hi - 5.0 * lo)
    return F.when(in_bracket | hi.isNull() | lo.isNull(), F.lit(None).cast("double")).otherwise(value)


# --- combination ------------------------------------------------------------

def profile_weight(profile: Column, metric: str, n_faces: Column) -> Column:
    """Weight of a metric, NULL where the profile does not use it."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, weights in P.PROFILE_WEIGHTS.items():
        if metric not in weights:
            continue
        value = F.lit(weights[metric])
        if metric == "composition" and name != "landscape":
            value = F.when(n_faces >= P.GROUP_SHOT_FACES,
                           F.lit(weights[metric] + P.GROUP_SHOT_BONUS)).otherwise(value)
        out = out.when(profile == name, value)
    return out


def profile_hint(profile: Column, n_faces: Column) -> Column:
    faced = profile != "landscape"
    return (F.when(faced & (n_faces == 0), "no_faces_detail_shot")
            .when(faced & (n_faces >= P.GROUP_SHOT_FACES), "group_shot"))


def _canonical(value) -> str:
    """Fixed values as text: mappings by key, numbers by their shortest form."""
    if isinstance(value, dict):
        return "{" + ";".join(f"{k}={_canonical(value[k])}" for k in sorted(value, key=str)) + "}"
    if isinstance(value, (list, tuple)):
        return "(" + ",".join(map(_canonical, value)) + ")"
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def weights_hash(profile: str) -> str:
    """Identifies everything fixed that a score of this profile was made with."""
    text = "\n".join([profile, _canonical(P.PROFILE_WEIGHTS[profile]),
                      *(f"{name} {_canonical(getattr(P, name))}" for name in P.SCORE_VALUES)])
    return f"ev1-{zlib.crc32(text.encode()):08x}"


def weights_hash_column(profile: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in P.PROFILE_WEIGHTS:
        out = out.when(profile == name, F.lit(weights_hash(name)))
    return out


def stale_scores(scores: DataFrame, profile: str = "profile") -> DataFrame:
    """Scores made with other weights than the current ones."""
    return scores.where(~F.col("weights_hash").eqNullSafe(weights_hash_column(F.col(profile))))


def score(photos: DataFrame, faces: DataFrame, *, key: str = "photo_id",
          profile: Column | None = None, brackets: DataFrame | None = None) -> DataFrame:
    """Score every photo.

    photos: key, saliency, sharpness_max, sharpness_mean, clipped_hi,
    clipped_lo, horizon_angle and, unless given, profile; optionally
    sharpness_tiles. faces: key and FACE_FIELDS. brackets: keys of frames in
    exposure brackets.
    """
    rows = with_subject(photos, faces, key)
    if brackets is None:
        rows = rows.withColumn("in_bracket", F.lit(False))
    else:
        marks = brackets.select(key).distinct().withColumn("in_bracket", F.lit(True))
        rows = rows.join(marks, key, "left").fillna(False, ["in_bracket"])
    rows = add_flags(rows)
    return score_columns(rows, F.col("profile") if profile is None else profile, key)


def _facts(**columns) -> Column:
    """Non-NULL facts as a map of strings."""
    pairs = [part for name, value in columns.items() for part in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def evidence(rows: DataFrame) -> dict[str, Column]:
    """What each metric was derived from, or why it abstained."""
    face, frame_max = F.col("primary"), F.col("sharpness_max")
    soft = F.when(frame_max < P.MIN_FRAME_SHARPNESS, "motion_blur_or_shake")
    unmeasured = F.lit("not_measured")
    better = F.when(F.col("focus_reason").isNull(), F.when(
        F.coalesce(face["sharp_r"] > face["sharp_l"], face["sharp_l"].isNull()), "right").otherwise("left"))
    sharp = {"sharpness_max": frame_max, "sharpness_mean": F.col("sharpness_mean"), "diagnosis": soft,
             "reason": F.when(F.col("sharpness_mean").isNull() | frame_max.isNull(), unmeasured)}
    if "sharpness_tiles" in rows.columns:
        plane = (F.col("profile") == "landscape") & (frame_max >= P.MIN_FRAME_SHARPNESS)
        sharp["focus_plane_coverage"] = F.when(plane, F.round("coverage", 3))
        sharp["corner_ratio"] = F.when(plane, F.round("corner_ratio", 3))
    costly = F.filter("flags", lambda f: F.substring_index(f, ":", 1).isin(*P.FLAG_PENALTIES))
    return {
        "eye_focus": _facts(reason=F.col("focus_reason"), eye=better, sharp_l=face["sharp_l"],
                            sharp_r=face["sharp_r"], yaw=face["yaw"], frame_sharpness_max=frame_max),
        "eyes_open": _facts(reason=F.col("open_reason"), open_l=face["open_l"], open_r=face["open_r"],
                            eye_source=face["eye_source"], yaw=face["yaw"]),
        "sharpness": _facts(**sharp),
        "composition": _facts(penalties=F.array_join(costly, ",")),
        "face_quality": _facts(reason=F.when(face["capture_quality"].isNull(), "no_face_or_not_measured"),
                               capture_quality=face["capture_quality"]),
        "exposure": _facts(reason=F.when(F.col("in_bracket"), "suppressed_in_bracket").when(
            F.col("exposure").isNull(), unmeasured), clipped_hi=F.col("clipped_hi"),
            clipped_lo=F.col("clipped_lo")),
    }


def known_profile(profile: Column) -> Column:
    """The profile, or an error naming one that has no weights."""
    message = F.concat(F.lit("unknown profile: "), F.coalesce(profile, F.lit("NULL")))
    return F.when(profile.isin(*P.PROFILE_WEIGHTS), profile).otherwise(F.raise_error(message).cast("string"))


def profile_errors(rows: DataFrame, key: str, profile: str = "profile") -> DataFrame:
    """(key, profile, error): the rows that `score` and `select_frames` refuse, since nothing
    is known of their profile's weights and rates."""
    return rows.where(~F.coalesce(F.col(profile).isin(*P.PROFILE_WEIGHTS), F.lit(False))).select(
        key, F.col(profile).alias("profile"), F.lit("unknown_profile").alias("error"))


def component_rows(scores: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, metric, value, weight, contrib, evidence): the components of scores in long
    form; a metric without a weight in the profile has no row."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"components.{m}").alias("c")) for m in P.METRICS]))
    return scores.select(key, each.alias("m")).where("m.c IS NOT NULL").select(key, "m.metric", "m.c.*")


def score_columns(rows: DataFrame, profile: Column, key: str) -> DataFrame:
    rows = rows.withColumn("profile", known_profile(profile))
    profile = F.col("profile")
    face, frame_max, n_faces = F.col("primary"), F.col("sharpness_max"), F.col("n_faces")
    focus, focus_reason = eye_focus(face, frame_max)
    opened, open_reason = eyes_open(face)
    sharp = sharpness(frame_max, F.col("sharpness_mean"))
    if "sharpness_tiles" in rows.columns:
        rows = with_focus_plane(rows)
        sharp = F.when(profile == "landscape", landscape_sharpness(
            frame_max, F.col("sharpness_mean"))).otherwise(sharp)
    values = {
        "eye_focus": focus, "eyes_open": opened, "sharpness": sharp,
        "composition": composition(F.col("flags")),
        "face_quality": face["capture_quality"],
        "exposure": exposure(F.col("clipped_hi"), F.col("clipped_lo"), F.col("in_bracket")),
    }
    weights = {m: profile_weight(profile, m, n_faces) for m in P.METRICS}
    rows = rows.withColumns({
        "hint": profile_hint(profile, n_faces),
        "focus_reason": focus_reason, "open_reason": open_reason,
        **{f"w_{m}": w for m, w in weights.items()}})
    rows = rows.withColumns({
        m: F.when(F.col(f"w_{m}").isNotNull(), v) for m, v in values.items()})
    live = sum((F.when(F.col(m).isNotNull(), F.col(f"w_{m}")).otherwise(0.0)
                for m in P.METRICS[1:]),
               F.when(F.col(P.METRICS[0]).isNotNull(), F.col(f"w_{P.METRICS[0]}")).otherwise(0.0))
    rows = rows.withColumn("live_weight", live)
    shares = {m: F.when(F.col(m).isNotNull() & (F.col("live_weight") > 0),
                        F.col(f"w_{m}") / F.col("live_weight")) for m in P.METRICS}
    contributions = [F.coalesce(F.col(m) * shares[m], F.lit(0.0)) for m in P.METRICS]
    total = contributions[0]
    for part in contributions[1:]:
        total = total + part
    proof = evidence(rows)
    components = F.struct(*[
        F.when(F.col(f"w_{m}").isNotNull(), F.struct(
            F.round(m, 4).alias("value"),
            F.round(F.coalesce(shares[m], F.col(f"w_{m}")), 4).alias("weight"),
            F.round(F.col(m) * shares[m], 4).alias("contrib"),
            proof[m].alias("evidence"))).alias(m) for m in P.METRICS])
    flags = F.array_compact(F.concat(F.col("flags"), F.array(
        F.when(F.col("other_blinking") > 0,
               F.concat(F.lit("other_subject_blinking:"), F.col("other_blinking"))),
        F.when(F.col("hint").isNotNull(), F.concat(F.lit("profile_hint:"), F.col("hint"))))))
    return rows.select(
        key, "profile", F.round(total, 4).alias("total"), components.alias("components"),
        *P.METRICS, "live_weight", "focus_reason", "open_reason", flags.alias("flags"),
        "hint", "why", F.col("primary.idx").alias("primary_idx"), "n_faces", "other_blinking",
        weights_hash_column(F.col("profile")).alias("weights_hash"))


def score_all_profiles(photos: DataFrame, faces: DataFrame, *, key: str = "photo_id",
                       brackets: DataFrame | None = None) -> DataFrame:
    """One score row per photo and profile; the four profiles are constants."""
    names = F.explode(F.array(*[F.lit(p) for p in P.PROFILE_WEIGHTS]))
    rows = with_subject(photos.drop("profile"), faces, key)
    if brackets is None:
        rows = rows.withColumn("in_bracket", F.lit(False))
    else:
        marks = brackets.select(key).distinct().withColumn("in_bracket", F.lit(True))
        rows = rows.join(marks, key, "left").fillna(False, ["in_bracket"])
    return score_columns(add_flags(rows).withColumn("profile", names), F.col("profile"), key)
