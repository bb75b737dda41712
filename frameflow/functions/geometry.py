"""Box, contour and rotation arithmetic on plain numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def _box(box: Column | str):
    box = F.col(box) if isinstance(box, str) else box
    return box["x"], box["y"], box["w"], box["h"]


def make_box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two x/y/w/h structs; 0 for empty unions."""
    ax, ay, aw, ah = _box(a)
    bx, by, bw, bh = _box(b)
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = wide * high
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def pixel_box_to_unit(box: Column | str, width: Column, height: Column) -> Column:
    """Top-left pixel box to a 0..1 box with the origin at the bottom left."""
    x, y, w, h = _box(box)
    return make_box(x / width, 1.0 - (y + h) / height, w / width, h / height)


def flip_box(box: Column | str) -> Column:
    x, y, w, h = _box(box)
    return make_box(x, 1.0 - (y + h), w, h)


def clamp_box(box: Column | str) -> Column:
    """Keep a 0..1 box inside the frame."""
    x, y, w, h = _box(box)
    one, zero = F.lit(1.0), F.lit(0.0)
    cx, cy = F.least(one, F.greatest(zero, x)), F.least(one, F.greatest(zero, y))
    return make_box(cx, cy, F.least(one - cx, F.greatest(zero, w)),
                    F.least(one - cy, F.greatest(zero, h)))


def eye_box(box: Column | str, side: Column) -> Column:
    """Crop box of one eye; `side` is the subject's left or right."""
    x, y, w, h = _box(box)
    half = w * P.EYE_HALF_WIDTH
    left_edge = F.when(side == "left", x + w - half).otherwise(x)
    return make_box(
        F.greatest(F.lit(0.0), left_edge - w * P.EYE_MARGIN),
        F.greatest(F.lit(0.0), y + h * P.EYE_BAND_FROM),
        F.least(F.lit(1.0), half + w * (2 * P.EYE_MARGIN)),
        F.least(F.lit(1.0), h * P.EYE_BAND_HEIGHT))


def ear_openness(xs: Column | str, ys: Column | str) -> Column:
    """Eye openness 0..1 from a contour; NULL under 4 points or zero width."""
    xs, ys = (F.col(c) if isinstance(c, str) else c for c in (xs, ys))
    wide = F.array_max(xs) - F.array_min(xs)
    high = F.array_max(ys) - F.array_min(ys)
    scaled = (high / wide - P.EAR_CLOSED) / (P.EAR_OPEN - P.EAR_CLOSED)
    return F.when((F.size(xs) >= 4) & (wide > 0),
                  F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def euler_angles(m) -> dict[str, Column]:
    """Yaw, roll, pitch in radians from m[row][col] columns of a rotation matrix."""
    return {
        "yaw": F.atan2(-m[2][0], F.hypot(m[0][0], m[1][0])),
        "roll": F.atan2(m[1][0], m[0][0]),
        "pitch": F.atan2(m[2][1], m[2][2]),
    }


def eye_sharp_ratio(energy: Column, frame_max: Column, roi_w: Column, roi_h: Column) -> Column:
    """Eye energy relative to the sharpest tile, capped; NULL for tiny regions."""
    measured = (roi_w > 8) & (roi_h > 8) & (frame_max > 0)
    return F.when(measured, F.round(F.least(F.lit(P.EYE_SHARP_CAP), energy / frame_max), 4))
