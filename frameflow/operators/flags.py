"""Composition flags: facts about boxes and angles, as columns and strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P


def clipped(box: Column) -> Column:
    """The box touches a frame edge."""
    far = 1.0 - P.EDGE_EPS
    return ((box["x"] < P.EDGE_EPS) | (box["y"] < P.EDGE_EPS)
            | (box["x"] + box["w"] > far) | (box["y"] + box["h"] > far))


def edge_distance(box: Column) -> Column:
    cx, cy = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    return F.least(cx, cy, 1.0 - cx, 1.0 - cy)


def thirds_distance(box: Column) -> Column:
    """Distance of the centre to the nearest rule-of-thirds point."""
    cx, cy = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    dx = F.least(F.abs(cx - 1 / 3), F.abs(cx - 2 / 3))
    dy = F.least(F.abs(cy - 1 / 3), F.abs(cy - 2 / 3))
    return F.sqrt(dx * dx + dy * dy)


def flag_columns(rows: DataFrame) -> DataFrame:
    """Add one column per fact; the subject is the primary face, else saliency."""
    face = F.col("primary.bbox")
    subject = F.coalesce(face, F.col("saliency"))
    yaw = F.col("primary.yaw")
    cx = face["x"] + face["w"] / 2
    inverted = (F.abs(yaw) > P.LEAD_ROOM_YAW) & (((yaw > 0) & (cx > 0.5)) | ((yaw <= 0) & (cx < 0.5)))
    tilt = F.abs(F.col("horizon_angle")) > P.HORIZON_TILT_DEG
    return rows.withColumns({
        "edge_distance": edge_distance(subject),
        "thirds_distance": thirds_distance(subject),
        "no_headroom": F.coalesce(face["y"] + face["h"] > 1.0 - P.HEADROOM, F.lit(False)),
        "lead_room_inverted": F.coalesce(inverted, F.lit(False)),
        "horizon_tilt": F.coalesce(tilt, F.lit(False)),
    }).withColumn("subject_near_edge", F.coalesce(F.col("edge_distance") < P.NEAR_EDGE, F.lit(False)))


def add_flags(rows: DataFrame) -> DataFrame:
    """Add `flags`, the list of strings; soft flags carry their number."""
    rows = flag_columns(rows)
    names = F.array(
        F.when(F.col("any_clipped"), "face_clipped"),
        F.when(F.col("subject_near_edge"),
               F.format_string("subject_near_edge:%.2f", "edge_distance")),
        F.when(F.col("thirds_distance").isNotNull(),
               F.format_string("thirds_distance:%.2f", "thirds_distance")),
        F.when(F.col("no_headroom"), "no_headroom"),
        F.when(F.col("lead_room_inverted"), "lead_room_inverted"),
        F.when(F.col("horizon_tilt"), F.format_string("horizon_tilt:%.1f", "horizon_angle")))
    return rows.withColumn("flags", F.array_compact(names))
