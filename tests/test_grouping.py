"""Scenes, brackets, shots, pins: small cases and a plain sequential walk."""

import math
import bisect
import random

import pytest
from pyspark.sql import functions as F

from frameflow import params as P
from frameflow.operators import clusters, corrections, segments, shots

A, A2, B, SHIFTED = (1.0, 0.0, 0.0), (0.999, 0.04, 0.0), (0.0, 1.0, 0.0), (0.85, 0.53, 0.0)
SCHEMA = ("shoot_id long, photo_id long, t_ms long, vec array<float>, bias double, face_count long, "
          "profile string, faceprint array<float>, pose array<float>")


def photo(pid, seconds, emb=A, bias=0.0, faces=0, profile="event", faceprint=None, pose=None, shoot=1):
    return (shoot, pid, round(seconds * 1000), emb, bias, faces, profile, faceprint, pose)


def frame(spark, rows):
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in r) for r in rows], SCHEMA)


def shots_of(spark, rows, **kwargs):
    got = shots.group_shots(frame(spark, rows), faceprint="faceprint", pose="pose", **kwargs).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.t_ms, r.photo_id)):
        groups.setdefault(r.shot_id, []).append(r.photo_id)
    return list(groups.values()), {r.shot_id for r in got if r.is_bracket}


def brackets_of(spark, rows):
    steps = segments.capture_steps(frame(spark, rows), extra=("bias",))
    return [r.n for r in segments.bracket_stats(segments.bracket_runs(steps)).where("valid").collect()]


@pytest.mark.parametrize("rows, sizes", [
    ([photo(1, 0, bias=-2.0), photo(2, .5), photo(3, 1, bias=2.0)], [3]),
    ([photo(i, i * .2) for i in range(1, 6)], []),
    ([photo(1, 0, bias=-2.0), photo(2, 10), photo(3, 20, bias=2.0)], []),
    ([photo(1, 0, bias=-2.0), photo(2, .5, emb=B), photo(3, 1, bias=2.0)], []),
    ([photo(1, 0), photo(2, .5, bias=1.0), photo(3, 1, bias=2.0)], []),
    ([photo(i + 1, i * .4, bias=float(b)) for i, b in enumerate((-2, -1, 0, 1, 2))], [5]),
    # a neutral frame right before the run joins it and spoils it
    ([photo(1, 0), photo(2, .5, bias=-2.0), photo(3, 1), photo(4, 1.5, bias=2.0)], []),
    # a gap of exactly two seconds still links
    ([photo(1, 0, bias=-2.0), photo(2, 2), photo(3, 4, bias=2.0)], [3]),
])
def test_brackets(spark, rows, sizes):
    assert brackets_of(spark, rows) == sizes


@pytest.mark.parametrize("rows, count", [
    ([photo(1, 0), photo(2, 60), photo(3, 600)], 2),
    ([photo(1, 0), photo(2, 120, emb=A2)], 1),
    ([photo(1, 0), photo(2, 120, emb=B)], 2),
    ([photo(1, 0), photo(2, 180, emb=A2)], 1),
])
def test_scenes(spark, rows, count):
    steps = segments.capture_steps(frame(spark, rows))
    assert segments.group_scenes(steps).result().select("scene").distinct().count() == count


DRIFT = [(1, 0, 0), (.99, .14, 0), (.96, .28, 0), (.92, .39, 0), (.87, .49, 0), (.81, .59, 0), (.74, .67, 0),
         (.66, .75, 0)]


@pytest.mark.parametrize("rows, groups", [
    ([photo(i, i * .2, faces=1) for i in range(1, 10)], [list(range(1, 10))]),
    ([photo(1, 0), photo(2, .5), photo(3, 30)], [[1, 2], [3]]),
    ([photo(1, 0), photo(2, .5, emb=B)], [[1], [2]]),
    ([photo(1, 0, faces=2), photo(2, .5, faces=3, emb=SHIFTED)], [[1], [2]]),
    ([photo(1, 0, faces=2), photo(2, .5, faces=3)], [[1, 2]]),
    ([photo(1, 0), photo(2, 3.6, emb=A2)], [[1, 2]]),
    ([photo(i + 1, i * .3, emb=tuple(map(float, e))) for i, e in enumerate(DRIFT)], [[1, 2, 3, 4, 5, 6], [7, 8]]),
    ([photo(1, 0, faces=1, faceprint=A), photo(2, .5, faces=1, faceprint=B)], [[1], [2]]),
    ([photo(1, 0, pose=A, profile="portrait"), photo(2, .5, pose=B, profile="portrait")], [[1], [2]]),
    ([photo(1, 0, pose=A), photo(2, .5, pose=B)], [[1, 2]]),
    ([photo(2, 1.5), photo(1, 1.1), photo(3, 1.9)], [[1, 2, 3]]),
    ([photo(1, 0, emb=None), photo(2, .5, emb=None)], [[1], [2]]),
])
def test_shots(spark, rows, groups):
    assert shots_of(spark, rows)[0] == groups


def test_bracket_is_its_own_shot(spark):
    rows = [photo(1, 0), photo(2, .4), photo(3, 3, bias=-2.0), photo(4, 3.5), photo(5, 4, bias=2.0),
            photo(6, 7), photo(7, 7.4)]
    groups, sealed = shots_of(spark, rows)
    assert groups == [[1, 2], [3, 4, 5], [6, 7]] and sealed == {3}


def test_shoots_do_not_mix(spark):
    rows = [photo(1, 0), photo(2, .2), photo(3, .1, shoot=2), photo(4, .3, shoot=2)]
    assert sorted(shots_of(spark, rows)[0]) == [[1, 2], [3, 4]]


def _dist(a, b):
    if a is None or b is None or len(a) != len(b):
        return 1.0
    dot = sum(x * y for x, y in zip(a, b))
    return 1.0 - dot / (math.hypot(*a) * math.hypot(*b))


def walk(rows):
    """Shots of one shoot, one frame after the other."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    runs = []
    for r in rows:
        p = runs[-1][-1] if runs else None
        if p and r[2] - p[2] <= 2000 and _dist(p[3], r[3]) <= .1 and r[4] != p[4]:
            runs[-1].append(r)
        else:
            runs.append([r])
    sealed = {}
    for i, run in enumerate(runs):
        b = [r[4] for r in run]
        if len(b) >= 3 and len(set(b)) == len(b) and min(b) < 0 < max(b) and abs(min(b) + max(b)) <= .5:
            sealed.update({r[1]: i for r in run})
    out, prev, anchor, last = {}, None, None, None
    for r in rows:
        mark = sealed.get(r[1])
        if mark is not None:
            new = mark != last
        elif last is not None or prev is None:
            new = True
        else:
            d = _dist(prev[3], r[3])
            new = (r[2] - prev[2] > P.SHOT_GAP_MS.get(r[6], 3000) or d > .2 or (r[5] != prev[5] and d > .1)
                   or (anchor is not prev and _dist(anchor[3], r[3]) > .25))
        if new:
            anchor = r
        out[r[1]] = (anchor[1], mark is not None)
        prev, last = r, mark
    return out


def random_shoot(rnd, shoot, n, base):
    rows, t, angle = [], 0.0, 0.0
    for i in range(n):
        t += rnd.choice([.3, .5, 1, 1.9, 2.5, 9])
        angle += rnd.choice([0, 0, .05, .12, .3, -.2, .6])
        emb = (math.cos(angle), math.sin(angle), 0.0)[:2 if rnd.random() < .2 else 3]
        emb = None if rnd.random() < .03 else emb
        rows.append(photo(base + i, t, emb=emb, bias=float(rnd.choice([-2, 0, 0, 2, 1])), faces=rnd.choice([1, 1, 2]),
                          profile=["event", "street", "landscape"][shoot % 3], shoot=shoot))
    return rows


@pytest.mark.parametrize("max_rows", [None, 30])
def test_shots_equal_sequential_walk(spark, max_rows):
    rnd = random.Random(11)
    shoots = [random_shoot(rnd, s, 220, 1000 * s) for s in (1, 2)]
    wanted = {}
    for rows in shoots:
        wanted.update(walk(rows))
    df = frame(spark, [r for rows in shoots for r in rows])
    got = {r.photo_id: (r.shot_id, r.is_bracket) for r in shots.group_shots(df, max_rows=max_rows).collect()}
    assert got == wanted


def test_one_long_segment_over_many_ranges(spark):
    rows = [photo(i, i * .5, emb=(math.cos(i * .04), math.sin(i * .04), 0.0)) for i in range(200)]
    got = {r.photo_id: r.shot_id for r in shots.group_shots(frame(spark, rows), max_rows=20).collect()}
    assert got == {k: v[0] for k, v in walk(rows).items()}


def test_still_scene_over_many_ranges(spark):
    rows = [photo(i, i * .5) for i in range(120)]
    assert {r.shot_id for r in shots.group_shots(frame(spark, rows), max_rows=20).collect()} == {0}


# --- pins ------------------------------------------------------------------------------

def replay(groups, pins):
    """groups: list of (members, sealed)."""
    groups = [(list(m), s) for m, s in groups]
    for pid, kind in pins:
        i = next(i for i, (m, _) in enumerate(groups) if pid in m)
        members, sealed = groups[i]
        at = members.index(pid)
        if kind == "split_before" and not sealed and at:
            groups[i:i + 1] = [(members[:at], False), (members[at:], False)]
        if kind == "merge_with_prev" and i and not sealed and not groups[i - 1][1]:
            groups[i - 1:i + 1] = [(groups[i - 1][0] + members, False)]
    return [m for m, _ in groups]


def pinned(spark, groups, pins, max_rows=None):
    rows = [(1, m, m, g[0], s) for g, s in groups for m in g]
    df = spark.createDataFrame(rows, "shoot_id long, photo_id long, t_ms long, shot_id long, is_bracket boolean")
    pin_df = spark.createDataFrame([(1, p, i, k) for i, (p, k) in enumerate(pins)],
                                   "shoot_id long, photo_id long, pin_order long, kind string")
    got = {}
    for r in sorted(corrections.apply_pins(df, pin_df, max_rows=max_rows).collect(), key=lambda r: r.t_ms):
        got.setdefault(r.shot_id, []).append(r.photo_id)
    return list(got.values())


@pytest.mark.parametrize("groups, pins", [
    ([([1, 2, 3, 4], False)], [(3, "split_before")]),
    ([([1, 2], False), ([3], False)], [(3, "merge_with_prev")]),
    ([([1, 2, 3], True), ([4], False)], [(2, "split_before"), (4, "merge_with_prev")]),
    ([([1, 2], False), ([3], False), ([4, 5], False)], [(4, "merge_with_prev"), (4, "merge_with_prev"), (5, "split_before")]),
])
def test_pins(spark, groups, pins):
    assert pinned(spark, groups, pins) == replay(groups, pins)


@pytest.mark.parametrize("max_rows", [None, 15])
def test_random_pins_equal_replay(spark, max_rows):
    rnd = random.Random(5)
    groups, pid = [], 0
    while pid < 120:
        n = rnd.randint(1, 5)
        groups.append((list(range(pid, pid + n)), rnd.random() < .15))
        pid += n
    pins = [(rnd.randrange(pid), rnd.choice(["split_before", "merge_with_prev"])) for _ in range(60)]
    assert pinned(spark, groups, pins, max_rows) == replay(groups, pins)


def test_a_hundred_thousand_pins_in_one_shoot(spark):
    n = 300_000
    rows = spark.range(n).selectExpr("1L AS shoot_id", "id AS photo_id", "id AS t_ms", "id div 3 * 3 AS shot_id", "false AS is_bracket")
    pins = spark.range(100_000).selectExpr("1L AS shoot_id", "id * 7919 % 300000 AS photo_id", "id AS pin_order",
                                           "CASE WHEN id % 4 = 1 THEN 'split_before' ELSE 'merge_with_prev' END AS kind")
    found = [r.shot_id for r in corrections.apply_pins(rows, pins).orderBy("photo_id").select("shot_id").collect()]
    starts = set(range(0, n, 3))
    left = sorted(starts)
    for i in range(100_000):
        x = i * 7919 % n
        if i % 4 == 1:
            if x not in starts:
                starts.add(x)
                bisect.insort(left, x)
        elif (at := bisect.bisect_right(left, x) - 1) > 0:
            starts.discard(left.pop(at))
    expected, head = [], None
    for i in range(n):
        head = i if i in starts else head
        expected.append(head)
    assert found == expected


def test_pieces_of_pins_stay_apart(spark):
    starts = spark.createDataFrame([(1, g, 10 * g, g == 4, 10 * g, m) for g, m in enumerate([0, 0, 2, 0, 0, 0, 1, 0, 0, 3])],
                                   "shoot_id long, _group_no long, _pos long, is_bracket boolean, photo_id long, _m long")
    pieces = corrections._pieces(starts, "shoot_id", None).orderBy("_group_no").collect()
    assert [r._piece for r in pieces] == [1, 1, 1, 2, 3, 4, 4, 4, 4, 4]


def test_ordered_set():
    rnd, size = random.Random(3), 70_000
    members = set(rnd.sample(range(size), 300))
    kept = corrections.OrderedSet(size, members)
    for _ in range(3000):
        x = rnd.randrange(size)
        assert kept.at_or_below(x) == max((m for m in members if m <= x), default=-1) and (x in kept) == (x in members)
        if rnd.random() < .5 and members:
            y = rnd.choice(sorted(members)) if rnd.random() < .05 else max((m for m in members if m <= x), default=None)
            if y is not None:
                members.discard(y)
                kept.remove(y)
        else:
            members.add(x)
            kept.add(x)


# --- poses and persons -------------------------------------------------------------------

def members(rows, group):
    out = {}
    for r in rows:
        out.setdefault(r[group], set()).add(r.photo_id)
    return sorted(sorted(m) for m in out.values())


def test_poses(spark):
    df = spark.createDataFrame([(1, 0, list(A), .9), (2, 1, list(A2), .9), (3, 2, list(B), .9), (4, 3, list(A), .2)],
                               "photo_id long, t long, pose array<double>, pose_confidence double")
    got = clusters.group_poses(df.withColumn("s", F.lit(1)), ["s"], ["t"], "photo_id").collect()
    assert members(got, "cluster") == [[1, 2], [3]]


def test_persons(spark):
    near = [.6, .8, 0.0]
    df = spark.createDataFrame([(1, 10, list(A)), (1, 11, list(B)), (2, 20, list(A2)), (3, 30, near)],
                               "photo_id long, face_id long, faceprint array<double>").withColumn("s", F.lit(1))
    got = clusters.group_persons(df, ["s"], ["face_id"], "photo_id", "face_id").collect()
    assert members(got, "person") == [[1, 2], [1, 3]]
