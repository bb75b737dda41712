"""Neighbours, clusters and detections against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.functions.vectors import cosine_distance, cosine_distance_arrow, cosine_similarity
from frameflow.operators import clusters, detections, neighbors, style


def vectors(spark, n=60, dim=5, seed=2, groups=2):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, dim))
    data = centers[rnd.integers(0, 6, n)] + rnd.normal(scale=.35, size=(n, dim))
    rows = [(i, i % groups, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id long, g long, vec array<double>"), data


def cos_dist(a, b):
    return 1 - a @ b / np.sqrt((a @ a) * (b @ b))


def test_unknown_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(cosine_distance("a", "b"), cosine_similarity("a", "b"), cosine_distance_arrow("a", "b")).collect()
    assert [tuple(round(v, 9) for v in r) for r in got] == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (1, 0, 1)]


@pytest.mark.parametrize("tile_rows", [1000, 7])
def test_knn(spark, tile_rows):
    df, data = vectors(spark)
    got = {}
    for r in neighbors.knn(df, "id", "vec", 4, part=["g"], tile_rows=tile_rows).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))
    for i in range(len(data)):
        order = sorted((cos_dist(data[i], data[j]), j) for j in range(len(data)) if j != i and j % 2 == i % 2)
        assert [n for _, n in sorted(got[i])] == [j for _, j in order[:4]]


def greedy(data, ids, limit):
    found = []
    for i in ids:
        best, best_d = None, limit
        for c in found:
            d = min(cos_dist(data[i], data[j]) for j in c)
            if d <= best_d:
                best, best_d = c, d
        if best is None:
            found.append([i])
        else:
            best.append(i)
    return {i: c[0] for c in found for i in c}


@pytest.mark.parametrize("tile_rows", [1000, 9])
def test_greedy_clusters(spark, tile_rows):
    df, data = vectors(spark, n=70)
    got = {r.id: r.cluster for r in clusters.cluster_greedy(df, ["g"], ["id"], "id", "vec", .12,
                                                            tile_rows=tile_rows).collect()}
    wanted = {**greedy(data, range(0, 70, 2), .12), **greedy(data, range(1, 70, 2), .12)}
    assert got == wanted and len(set(wanted.values())) > 3


@pytest.mark.parametrize("tile_rows", [1000, 9])
def test_components(spark, tile_rows):
    df, data = vectors(spark, n=70)
    label = list(range(70))
    for _ in range(70):
        for i in range(70):
            for j in range(70):
                if i % 2 == j % 2 and cos_dist(data[i], data[j]) <= .05:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r.component for r in clusters.cluster_components(df, "id", "vec", .05, part=["g"],
                                                                  tile_rows=tile_rows).collect()}
    assert got == dict(enumerate(label))


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = spark.range(n)
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = clusters.connected_components(nodes, "id", edges)
    assert got.where("component <> 0").count() == 0 and got.count() == n


def test_neighbor_jaccard(spark):
    df, _ = vectors(spark)
    same = neighbors.neighbor_jaccard(df, "id", "vec", "vec", 5).first()
    assert same.jaccard == 1.0 and same.n == 60
    assert neighbors.neighbor_jaccard(df.where("id < 6"), "id", "vec", "vec", 5).first().jaccard is None


# --- boxes -----------------------------------------------------------------------------

def boxes(seed, n, images=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(images), i, (rnd.random() * .6, rnd.random() * .6, .1 + rnd.random() * .3,
                                        .1 + rnd.random() * .3), rnd.randrange(50) / 50) for i in range(n)]


def box_frame(spark, rows):
    return spark.createDataFrame(rows, "img long, id long, bbox struct<x:double,y:double,w:double,h:double>, score double")


def iou(a, b):
    wide = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    high = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, wide) * max(0.0, high)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


@pytest.mark.parametrize("max_rows", [None, 20])
def test_nms(spark, max_rows):
    rows = boxes(1, 150)
    kept = []
    for img, i, box, score in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(k[0] != img or iou(box, k[2]) < .4 for k in kept):
            kept.append((img, i, box))
    got = detections.nms(box_frame(spark, rows), ["img"], "id", cap=None, max_rows=max_rows, buffer=8).collect()
    assert {(r.img, r.id) for r in got} == {(k[0], k[1]) for k in kept}


@pytest.mark.parametrize("max_rows", [None, 1])
def test_nms_on_the_limit(spark, max_rows):
    """The rounded quotient is just under 0.4, the intersection isn't under 0.4 of the union."""
    rows = [(0, 0, (.17, .43, .18, .28), .9), (0, 1, (.14, .35, .27, .28), .8), (0, 2, (.8, .8, .1, .1), .7)]
    got = detections.nms(box_frame(spark, rows), ["img"], "id", max_rows=max_rows, buffer=1).collect()
    assert {r.id for r in got} == {0, 2}


def test_nms_cap(spark):
    rows = [(0, i, (i / 20, .1, .01, .1), i / 20) for i in range(20)]
    got = detections.nms(box_frame(spark, rows), ["img"], "id", cap=16).collect()
    assert {r.id for r in got} == set(range(4, 20))
    assert detections.nms(box_frame(spark, rows), ["img"], "id").count() == 20


@pytest.mark.parametrize("max_rows", [None, 20])
def test_match(spark, max_rows):
    a, b = boxes(1, 80), boxes(9, 90)
    used, wanted = set(), set()
    for img, i, box, _ in sorted(a, key=lambda r: r[1]):
        hit = next((r for r in sorted(b, key=lambda r: r[1]) if r[0] == img and (img, r[1]) not in used
                    and iou(box, r[2]) >= .3), None)
        if hit:
            used.add((img, hit[1]))
        wanted.add((img, i, hit[1] if hit else None))
    wanted |= {(r[0], None, r[1]) for r in b if (r[0], r[1]) not in used}
    got = detections.match_detections(box_frame(spark, a), box_frame(spark, b), ["img"], "id", max_rows=max_rows,
                                      buffer=4).collect()
    assert {(r.img, r.key_a, r.key_b) for r in got} == wanted and len(got) == len(wanted)


def test_iou_pairs(spark):
    a, b = boxes(1, 60), boxes(9, 60)
    got = {(r.img, r.key_a, r.key_b) for r in detections.iou_pairs(
        box_frame(spark, a), box_frame(spark, b), ["img"], "id").collect()}
    assert got == {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and iou(x[2], y[2]) >= .3}


def test_pose_is_centred_and_scaled(spark):
    joints = [(0.0, 0.0, True), (2.0, 0.0, True), (0.0, 4.0, True), (2.0, 4.0, True), (9.0, 9.0, False)]
    df = spark.createDataFrame([(joints,)], "j array<struct<x:double,y:double,visible:boolean>>")
    got = df.select(clusters.normalize_pose(F.col("j"), 0, 1, 2, 3)).first()[0]
    assert [tuple(p) if p else None for p in got] == [(-.25, 0), (.25, 0), (-.25, 1), (.25, 1), None]


def test_style_loses_no_rows(spark):
    rows = spark.createDataFrame([(i, f, [1.0, float(i)], d) for i, f, d in ((1, "a", 0.1), (2, "a", None), (3, "b", 0.3), (4, None, 0.4), (5, None, 0.5))],
                                 "k long, f string, v array<double>, d double")
    blended = {r.k: r for r in style.knn_blend(rows, "k", "v", "f", ["d"], k=2).collect()}
    assert set(blended) == {1, 2, 3, 4, 5} and blended[3].n_neighbors == 0 and blended[3].pred_d is None
    assert blended[4].n_neighbors == 1 and blended[4].pred_d == pytest.approx(0.5)
    history = rows.where("f IS NULL OR f = 'a'").select("f", "d")
    clamped = style.clamp_to_family(rows.select("k", "f", F.lit(9.0).alias("pred_d")), history, "f", ["d"]).collect()
    assert {r.k: r.pred_d for r in clamped} == {1: 0.1, 2: 0.1, 3: None, 4: 0.5, 5: 0.5}
    wide = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 7), float(i % 5)) for i in range(40)], "k long, a double, b double")
    found = style.look_families(wide, ["a", "b"], 3).collect()
    assert len(found) == 40 and {r.k for r in found if r.family is None} == {i for i in range(40) if i % 4 == 0}


def test_boxes_without_a_score_and_null_images(spark):
    box = {"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2}
    far = [{"x": 0.01 * i, "y": 0.9, "w": 0.005, "h": 0.005} for i in range(30)]
    rows = [(None, 1, None, box), (None, 2, 0.5, box), (1, 3, None, box), (1, 4, None, far[0])] + [(2, 100 + i, 0.1 * i, b) for i, b in enumerate(far)]
    df = spark.createDataFrame(rows, "image int, k long, score double, bbox struct<x: double, y: double, w: double, h: double>")
    for limit in (None, 1):
        got = {(r.image, r.k) for r in detections.nms(df, ["image"], "k", max_rows=limit).collect()}
        assert got == {(None, 2), (1, 3), (1, 4)} | {(2, 100 + i) for i in range(30)}


def scaled_boxes(rnd, n, scale, images=4):
    """Boxes of very different sizes, many near copies of others, some without area."""
    out = []
    for i in range(n):
        if out and rnd.random() < .6:
            x, y, w, h = out[rnd.randrange(len(out))][2:]
            out.append((i, i % images, x + w * rnd.uniform(-.3, .3), y + h * rnd.uniform(-.3, .3), w * rnd.uniform(.7, 1.4), h * rnd.uniform(.7, 1.4)))
        else:
            w, h = (scale * 10 ** rnd.uniform(-3, 0) for _ in range(2))
            out.append((i, i % images, rnd.uniform(-.2, 1) * scale, rnd.uniform(-.2, 1) * scale, w if i % 17 else 0.0, h))
    return [(i, g, (x, y, w, h)) for i, g, x, y, w, h in out]


@pytest.mark.parametrize("scale,limit", [(1.0, .3), (4000.0, .3), (4000.0, .05), (4000.0, .75), (1e-6, .95)])
def test_iou_pairs_in_any_unit(spark, scale, limit):
    rnd = random.Random(8)
    one, two = scaled_boxes(rnd, 160, scale), scaled_boxes(rnd, 40, scale)
    two = [(500 + i, g, b) for i, g, b in two] + [(1000 + i, g, b) for i, g, b in one[::3]]
    schema = "id long, g long, bbox struct<x double, y double, w double, h double>"
    got = detections.iou_pairs(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["g"], "id", limit=limit).collect()
    flat = {i: np.array([b]) for i, _, b in one + two}
    expected = {(i, j) for i, g, _ in one for j, k, _ in two if g == k and detections.overlap(flat[i], flat[j])[0, 0] >= limit - 1e-12}
    assert len(got) == len({(r.key_a, r.key_b) for r in got}) and {(r.key_a, r.key_b) for r in got} == expected and expected


def test_boxes_take_few_cells(spark):
    rnd = random.Random(9)
    rows = [(i, 0, (rnd.uniform(0, 4000), rnd.uniform(0, 3000), 10 ** rnd.uniform(0, 3.3), 10 ** rnd.uniform(0, 3.3))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g long, bbox struct<x double, y double, w double, h double>")
    assert detections.on_grid(df, "bbox", .3).count() <= 4 * len(rows)


def clustered(spark, n, centers, dim=8, seed=4):
    rnd = np.random.default_rng(seed)
    heads = rnd.normal(size=(centers, dim))
    data = heads[rnd.integers(0, centers, n)] + rnd.normal(scale=.03, size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>"), data


def test_far_tiles_never_meet(spark):
    df, data = clustered(spark, 3000, 25)
    placed, _ = neighbors.tiled(df.select("id", F.col("vec").alias("_vec")), [], "id", "_vec", 64)
    tiles = placed.select(*neighbors.TILE).distinct().count()
    pairs = neighbors.close_tiles(neighbors.tile_bounds(placed, [], neighbors.angle_limit(.01)), []).select("_pair").distinct().count()
    assert tiles >= 40 and pairs < .5 * tiles * (tiles + 1) / 2
    units = data / np.linalg.norm(data, axis=1)[:, None]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, j in zip(*np.nonzero(1 - units @ units.T <= .01)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in clusters.cluster_components(df, "id", "vec", .01, tile_rows=64).collect()}
    assert got == {i: find(i) for i in range(len(data))}


@pytest.mark.parametrize("tile_rows", [50, 200])
def test_knn_over_tiles_with_odd_vectors(spark, tile_rows):
    df, data = clustered(spark, 700, 9)
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0]), (1003, [2.0, 4.1]), (1004, [])]
    rows = df.unionByName(spark.createDataFrame(odd, df.schema))
    every = {i: v for i, v in enumerate(data)} | {i: None if not v or not any(v) else np.array(v) for i, v in odd}
    got = {}
    for r in neighbors.knn(rows, "id", "vec", 3, tile_rows=tile_rows).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))

    def dist(a, b):
        return 1.0 if a is None or b is None or len(a) != len(b) else 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    for i in [*range(0, 700, 7), *(i for i, _ in odd)]:
        near = sorted((round(dist(every[i], every[j]), 12), j) for j in every if j != i)[:3]
        assert [n for _, n in sorted(got[i])] == [j for _, j in near]


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(clusters, "HOT_DEGREE", 50)
    star = [(0, i) for i in range(1, 400)] + [(400 + i, 700) for i in range(300)] + [(399, 701), (700, 702)]
    chain = [(i, i + 1) for i in range(800, 830)]
    nodes = spark.range(840).withColumnRenamed("id", "k")
    got = {r.k: r.component for r in clusters.connected_components(nodes, "k", spark.createDataFrame(star + chain, "src long, dst long")).collect()}
    assert {got[i] for i in [*range(400), 701]} == {0} and {got[i] for i in [*range(400, 701), 702]} == {400}
    assert {got[i] for i in range(800, 831)} == {800} and got[835] == 835


def test_knn_takes_larger_tiles_for_more_rows(spark, monkeypatch):
    """Copies of a row follow the tiles, which don't follow the rows."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbors, "SEARCH_TILES", 4)
    monkeypatch.setattr(neighbors, "SEARCH_BLOCK", 7)
    asked, tiled = [], neighbors.tiled
    monkeypatch.setattr(neighbors, "tiled", lambda *a: asked.append(a[-1]) or tiled(*a))
    df, data = clustered(spark, 300, 6)
    got = {}
    for r in neighbors.knn(df, "id", "vec", 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))
    assert asked == [75]
    for i in range(0, 300, 17):
        order = sorted((cos_dist(data[i], data[j]), j) for j in range(300) if j != i)
        assert [n for _, n in sorted(got[i])] == [j for _, j in order[:3]]


def test_knn_takes_from_other_tiles_only_what_is_nearer(spark, monkeypatch):
    """Among them ties of equal vectors, and vectors that are unknown, of length zero or short."""
    made, map_groups = [], neighbors.map_groups
    monkeypatch.setattr(neighbors, "map_groups", lambda *a: made.append(map_groups(*a)) or made[-1])
    monkeypatch.setattr(neighbors, "SEARCH_BLOCK", 7)
    _, data = clustered(spark, 240, 6)
    vecs = [[float(x) for x in v] for v in data] + [[float(x) for x in data[3]]] * 9 + [None, [0.0] * len(data[0]), [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), "id long, vec array<double>")
    got = {}
    for r in neighbors.knn(df, "id", "vec", 3, tile_rows=16).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))

    def dist(a, b):
        known = a is not None and b is not None and len(a) == len(b) and any(a) and any(b)
        return round(cos_dist(np.array(a), np.array(b)), 12) if known else 1.0
    for i, v in enumerate(vecs):
        order = sorted((dist(v, w), j) for j, w in enumerate(vecs) if j != i)
        assert [n for _, n in sorted(got[i])] == [j for _, j in order[:3]], i
    first, more = made[0].collect(), made[-1].collect()
    kth, sizes = {}, {}
    for r in first:
        kth[r.id], sizes[r.id] = max(r.distance, kth.get(r.id, -1.0)), sizes.get(r.id, 0) + 1
    assert more and all(r.distance <= kth[r.id] for r in more if sizes.get(r.id) == 3)


@pytest.mark.parametrize("part", [[], ["g"]])
def test_components_beside_the_largest_meet_all_rows(spark, part):
    """A dense pile, pairs far from it and from each other, and odd vectors."""
    rnd = np.random.default_rng(8)
    pile = rnd.normal(size=16) + rnd.normal(scale=.05, size=(500, 16))
    pairs = np.repeat(rnd.normal(size=(40, 16)), 2, axis=0) + rnd.normal(scale=.01, size=(80, 16))
    data = np.concatenate([pile, pairs])[rnd.permutation(580)]
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(1000, 0, None), (1001, 1, [0.0] * 16), (1002, 0, [1.0, 2.0]), (1003, 0, [2.0, 4.0]), (1004, 1, [])]
    df = spark.createDataFrame(rows + odd, "id long, g long, vec array<double>")
    units = data / np.linalg.norm(data, axis=1)[:, None]
    near = 1 - units @ units.T <= .02
    label = np.arange(580)
    for _ in range(20):
        for i in range(580):
            close = near[i] & ((np.arange(580) % 2 == i % 2) if part else True)
            label[close] = label[close].min()
    got = {r.id: r.component for r in clusters.cluster_components(df, "id", "vec", .02, part=part, tile_rows=16).collect()}
    assert got == {i: int(x) for i, x in enumerate(label)} | {i: i for i, *_ in odd} | {1003: 1002}


def test_tiles_of_one_component_meet_once(spark, monkeypatch):
    """What a sample of the rows joins is not compared pair by pair of tiles."""
    df, data = vectors(spark, n=400, dim=3, groups=1)
    met = []
    monkeypatch.setattr(clusters, "close_tiles", lambda *a: met.append(a))
    got = clusters.cluster_components(df, "id", "vec", 1.2, tile_rows=32).collect()
    assert {r.component for r in got} == {0} and len(got) == 400 and not met
