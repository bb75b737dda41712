"""Scores, flags and measurements: one rule per case."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow import params as P
from frameflow.functions import geometry
from frameflow.functions.curves import piecewise
from frameflow.operators import measure, scoring

PHOTO = ("photo_id long, profile string, saliency struct<x:double,y:double,w:double,h:double>, sharpness_max double, "
         "sharpness_mean double, clipped_hi double, clipped_lo double, horizon_angle double")
FACE = ("photo_id long, idx int, bbox struct<x:double,y:double,w:double,h:double>, yaw double, capture_quality double, "
        "sharp_l double, sharp_r double, open_l double, open_r double, eye_source string")


def face(idx=0, bbox=(.4, .4, .2, .25), yaw=0.0, quality=.8, sharp=(.8, .7), opened=(.9, .9), source=None):
    return (1, idx, bbox, yaw, quality, *sharp, *opened, source)


def score_one(spark, faces=(), profile="portrait", saliency=None, frame=(.3, .1, .001, .001, None), bracket=False,
              tiles=None):
    photos = spark.createDataFrame([(1, profile, saliency, *frame)], PHOTO)
    if tiles is not None:
        photos = photos.withColumn("sharpness_tiles", F.lit(tiles).cast("array<array<double>>"))
    marks = photos.select("photo_id") if bracket else None
    return scoring.score(photos, spark.createDataFrame(list(faces), FACE), brackets=marks).first()


def test_no_face_is_null_and_redistributed(spark):
    r = score_one(spark)
    c = r.components
    assert r.eye_focus is None and r.eyes_open is None and c.eye_focus.contrib is None
    live = [m for m in P.METRICS if c[m] is not None and c[m].value is not None]
    assert sum(c[m].weight for m in live) == pytest.approx(1, abs=1e-3)
    assert r.hint == "no_faces_detail_shot" and c.eye_focus.evidence["reason"] == "no_face"


def test_landscape_without_faces_scores_well(spark):
    r = score_one(spark, profile="landscape")
    assert r.total > .5 and r.components.eye_focus is None and r.hint is None


def test_turned_face_abstains(spark):
    r = score_one(spark, [face(yaw=1.2)])
    assert r.eyes_open is None and r.open_reason == "abstained_extreme_yaw"
    assert r.components.eyes_open.evidence["yaw"] == "1.2"


def test_closed_eyes_are_measured(spark):
    assert 0 <= score_one(spark, [face(opened=(.1, .1))]).eyes_open < .1


def test_better_eye_focus_worse_eye_open(spark):
    r = score_one(spark, [face(sharp=(.85, .2), opened=(.95, .2))])
    assert r.eye_focus == 1.0 and r.eyes_open < .1 and r.components.eye_focus.evidence["eye"] == "left"
    assert score_one(spark, [face(sharp=(None, .7))]).components.eye_focus.evidence["eye"] == "right"


def test_open_curve_depends_on_source(spark):
    value = {s: score_one(spark, [face(opened=(.55, .55), source=s)]).eyes_open
             for s in ("mediapipe_blendshapes", "ear_landmarks", None)}
    assert value["mediapipe_blendshapes"] < .4 < value["ear_landmarks"]
    assert value[None] == pytest.approx(.1 + .3 * .2 / .25)


def test_soft_frame_is_blur_not_a_focus_miss(spark):
    r = score_one(spark, [face(sharp=(.1, .1))], frame=(.002, .001, 0.0, 0.0, None))
    assert r.eye_focus is None and r.focus_reason == "frame_soft_motion_blur" and r.sharpness == 0.0
    assert r.components.sharpness.evidence["diagnosis"] == "motion_blur_or_shake"


def test_bracket_suppresses_exposure(spark):
    assert score_one(spark, profile="landscape", bracket=True).exposure is None
    assert score_one(spark, profile="landscape").exposure == pytest.approx(.985)


def test_primary_face(spark):
    small, big = face(0, (.45, .4, .10, .12)), face(1, (.05, .05, .2, .25))
    near = score_one(spark, [small, big], "event", saliency=(.4, .35, .2, .2))
    assert (near.primary_idx, near.why) == (0, "largest_face_near_saliency_peak")
    assert score_one(spark, [small, big], "event").why == "largest_face"
    tie = score_one(spark, [face(2), face(1)], "event")
    assert tie.primary_idx == 1


def test_blinking_others_and_group_shot(spark):
    crowd = [face(0, (.4, .4, .3, .3))] + [face(i, opened=(.2, .9)) for i in range(1, 8)]
    r = score_one(spark, crowd, "event")
    assert r.other_blinking == 7 and r.hint == "group_shot"
    assert "other_subject_blinking:7" in r.flags and "profile_hint:group_shot" in r.flags


def test_unknown_profile_fails(spark):
    with pytest.raises(Exception, match="unknown profile"):
        score_one(spark, profile="wedding")


def test_hash_names_the_weights():
    assert len({scoring.weights_hash(p) for p in P.PROFILE_WEIGHTS}) == 4
    assert all(scoring.weights_hash(p).startswith("ev1-") for p in P.PROFILE_WEIGHTS)


def flags_of(spark, **kwargs):
    return {f.split(":")[0] for f in score_one(spark, **kwargs).flags if not f.startswith("profile_hint")}


@pytest.mark.parametrize("kwargs, wanted", [
    (dict(faces=[face(bbox=(.4, .4, .2, .2))]), {"thirds_distance"}),
    (dict(faces=[face(bbox=(0.0, .4, .2, .2))]), {"face_clipped", "thirds_distance"}),
    (dict(faces=[face(bbox=(.01, .4, .06, .2))]), {"subject_near_edge", "thirds_distance"}),
    (dict(faces=[face(bbox=(.4, .795, .2, .198))]), {"no_headroom", "thirds_distance"}),
    (dict(faces=[face(bbox=(.6, .4, .2, .2), yaw=.4)]), {"lead_room_inverted", "thirds_distance"}),
    (dict(faces=[face(bbox=(.2, .4, .2, .2), yaw=.4)]), {"thirds_distance"}),
    (dict(saliency=(.01, .4, .06, .2)), {"subject_near_edge", "thirds_distance"}),
    (dict(frame=(.3, .1, .0, .0, 2.5)), {"horizon_tilt"}),
    (dict(frame=(.3, .1, .0, .0, .5)), set()),
])
def test_flags(spark, kwargs, wanted):
    assert flags_of(spark, **kwargs) == wanted


def test_flags_cost_composition(spark):
    r = score_one(spark, [face(bbox=(0.0, .4, .2, .2))], frame=(.3, .1, 0.0, 0.0, 3.0))
    assert r.composition == pytest.approx(1 - .5 - .2)
    assert "face_clipped" in r.components.composition.evidence["penalties"]


def tiles(kind):
    grid = np.full((16, 16), .001)
    if kind == "full":
        grid[:] = .05
    elif kind == "band":
        grid[6:10] = .05
    elif kind == "center":
        grid[7:9, 7:9] = .05
    return grid.tolist()


def test_focus_plane(spark):
    value = {k: score_one(spark, profile="landscape", frame=(.05, .02, 0.0, 0.0, None), tiles=tiles(k))
             for k in ("full", "band", "center")}
    assert value["full"].sharpness == 1.0 > value["band"].sharpness > value["center"].sharpness
    assert value["band"].components.sharpness.evidence["focus_plane_coverage"] == "0.25"


def test_piecewise_clamps_and_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (.25,), (.35,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(piecewise("x", P.EYE_FOCUS_CURVE)).collect()]
    assert got[:2] == [0, .2] and got[2] == pytest.approx(.4) and got[3:] == [1, None]


def test_eye_contours(spark):
    def contour(h):
        return [0.0, 10.0, 20.0, 30.0, 20.0, 10.0], [5.0, 5 + h / 2, 5 + h / 2, 5.0, 5 - h / 2, 5 - h / 2]
    cases = [contour(10), contour(2), contour(6), ([], []), ([5.0] * 4, [0.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(cases, "xs array<double>, ys array<double>")
    got = [r[0] for r in df.select(geometry.ear_openness("xs", "ys")).collect()]
    assert got[0] > .9 and got[1] < .1 and .2 < got[2] < .8 and got[3:] == [None, None]


def checkers(size, n=64):
    y, x = np.mgrid[0:n, 0:n]
    return (((x // size + y // size) % 2) * 255).astype(np.uint8)


def test_gradient_orderings():
    flat = np.full((64, 64), 128, np.uint8)
    edge = np.where(np.arange(64) < 32, 0, 255)[None, :].repeat(64, 0).astype(np.uint8)
    ramp = (np.arange(64) * 255 // 63)[None, :].repeat(64, 0).astype(np.uint8)
    assert measure.tenengrad(flat) == 0 and measure.tenengrad(np.array([[1, 2]], np.uint8)) == 0
    assert measure.tenengrad(edge) > 2 * measure.tenengrad(ramp)
    assert measure.tenengrad(checkers(2)) > measure.tenengrad(checkers(16))


def test_gradient_equals_loop():
    p = np.random.default_rng(0).integers(0, 256, (9, 12)).astype(float)
    total = 0.0
    for y in range(1, 8):
        for x in range(1, 11):
            w = p[y - 1:y + 2, x - 1:x + 2]
            gx = (w[:, 2] - w[:, 0]) @ [1, 2, 1]
            gy = (w[2] - w[0]) @ [1, 2, 1]
            total += gx * gx + gy * gy
    assert measure.tenengrad(p) == pytest.approx(total / 70 / (4 * 255 * 255))


def test_measure_frames(spark):
    plane = np.full((256, 256), 128, np.uint8)
    plane[:64, :64] = checkers(2)
    rgb = np.zeros((64, 64, 3), np.uint8)
    rgb[..., 1] = 255
    df = spark.createDataFrame([(1, 256, 256, bytearray(plane.tobytes())), (2, 256, 256, bytearray(b"\xff" * 65536)),
                                (3, 64, 64, bytearray(rgb.tobytes()))], "photo_id long, width int, height int, pixels binary")
    rows = {r.photo_id: r for r in measure.measure_frames(df).collect()}
    sharp = np.array(rows[1].tiles)
    assert rows[1].sharpness_mean < rows[1].sharpness_max / 4
    assert (sharp[4:] <= sharp.max() / 2).all() and (sharp[:, 4:] <= sharp.max() / 2).all()
    assert rows[2].sharpness_max == 0 and rows[2].clipped_hi == 1.0 and rows[2].clipped_lo == 0.0
    assert rows[3].clipped_hi == 0.0
    assert measure.luminance(rgb)[0, 0] == 149
    tinted = np.full((4, 4, 3), (100, 200, 50), np.uint8)
    df = df.union(spark.createDataFrame([(4, 4, 4, bytearray(tinted.tobytes()))], df.schema))
    gains = {r.photo_id: r.gains for r in measure.channel_gains(df).collect()}
    assert gains[1] is None and gains[3][1] == pytest.approx(1 / 3)
    assert np.array(gains[4]) * (100, 200, 50) == pytest.approx([350 / 3] * 3, rel=1e-6)


def test_planes_of_any_size_in_little_memory():
    rnd = np.random.default_rng(1)
    planes = [rnd.integers(0, 256, shape).astype(np.uint8) for shape in [(33, 50)] * 5 + [(700, 900), (64, 64, 3), (0, 7), (700, 900)]]
    for plane, (tiles, top, mean, high, low) in zip(planes, measure.measure_planes(planes)):
        flat = measure.grey(plane)
        h, w = flat.shape[0] // 16, flat.shape[1] // 16
        want = [[measure.tenengrad(flat[y * h:(y + 1) * h, x * w:(x + 1) * w]) if min(h, w) > 2 else 0.0 for x in range(16)] for y in range(16)]
        assert np.allclose(tiles, want, rtol=1e-12, atol=0) and top == np.max(tiles) and mean == pytest.approx(np.mean(want))
        assert high == (pytest.approx((flat >= 254).mean()) if flat.size else None)
    plane = rnd.integers(0, 256, (6000, 8000)).astype(np.uint8)
    tracemalloc.start()
    measure.measure_planes([plane])
    assert tracemalloc.get_traced_memory()[1] < 120_000_000  # a plane of 48 MB, by bands of tiles
    tracemalloc.stop()


def test_planes_that_are_unknown(spark):
    df = spark.createDataFrame([(1, 4, None, bytearray(b"abcd")), (2, 2, 2, None), (3, 2, 2, bytearray(b"\xff\xff\x00\x80"))],
                               "photo_id long, width int, height int, pixels binary")
    got = {r.photo_id: (r.sharpness_max, r.clipped_hi) for r in measure.measure_frames(df).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (0.0, .5)}


def test_tiles_leave_the_worker_as_numbers(spark, monkeypatch):
    """Tiles of many planes are no lists of Python numbers, at so many planes a time; planes
    without pixels keep their places."""
    monkeypatch.setattr(measure, "AT_ONCE", 7)
    monkeypatch.setattr(measure, "measure_planes", None)
    rnd = np.random.default_rng(3)
    planes = [rnd.integers(0, 256, (48 + 16 * (i % 3), 64), dtype=np.uint8) for i in range(40)]
    rows = [(i, 64, p.shape[0], None if i % 6 == 5 else p.tobytes()) for i, p in enumerate(planes)] + [(40, 0, 0, b"")]
    df = spark.createDataFrame(rows, "photo_id long, width int, height int, pixels binary").coalesce(1)
    got = {r.photo_id: r for r in measure.measure_frames(df).collect()}
    assert len(got) == 41 and (got[40].sharpness_max, got[40].clipped_hi) == (0.0, None)
    for i, plane in enumerate(planes):
        if i % 6 == 5:
            assert got[i].tiles is None and got[i].sharpness_mean is None and got[i].clipped_lo is None
            continue
        tiles = measure.tile_maps([plane])[0]
        assert got[i].tiles == tiles.tolist() and got[i].sharpness_mean == tiles.mean() and got[i].sharpness_max == tiles.max()
        assert got[i].clipped_hi == (plane >= measure.CLIP_HIGH).mean()
