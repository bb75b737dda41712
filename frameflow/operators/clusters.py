"""Clustering by vector distance: connected components and first-come greedy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..runtime import BROADCAST_ROWS, checkpoint, forget, join_same
from .local import each, map_groups, stack
from .neighbors import (SEARCH_BLOCK, SEARCH_TILE_ROWS, SEARCH_TILES, TILE, TILE_ROWS, all_paired, angle_limit, close_tiles, distances,
                        paired, sides, tile_bounds, tiled)
from .ordered import row_numbers


#: Rows of the sample that every tile meets first, or a tile's if those are fewer.
HUB_ROWS = 4096
#: Nodes with more neighbours than this meet their smallest one by a broadcast.
HOT_DEGREE = 50_000


def tile_groups(rows: DataFrame, part, key: str, limit: float, tile_rows: int) -> DataFrame:
    """rows (part, key, _vec, ...) once for every pair of tiles that may hold a pair within
    `limit`; a vector that is unknown is at distance 1 from all."""
    if limit < 1.0:
        rows = rows.where(F.size("_vec") > 0)
    placed, angled = tiled(rows, part, key, "_vec", tile_rows)
    if not angled:
        return all_paired(placed)
    reach = angle_limit(limit) if limit < 1.0 else np.pi
    return paired(placed, part, close_tiles(tile_bounds(placed, part, reach), part))


def _links(names: np.ndarray, units: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> pd.DataFrame:
    """Edges between names that connect what close pairs of a left and a right row connect;
    rows of one name are connected already. A block of left rows is compared at a time."""
    known, at = np.unique(names, return_inverse=True)
    group, edges = np.arange(len(known)), []
    there = at[right]
    for block in np.split(left, range(SEARCH_BLOCK, len(left), SEARCH_BLOCK)):
        for i, close in zip(block, distances(units[block], units[right]) <= limit):
            met = group[there[close]]
            met = met[met != group[at[i]]]
            if not len(met):
                continue
            both = np.unique(np.append(met, group[at[i]]))
            edges += [(known[both[0]], known[x]) for x in both[1:]]
            group[np.isin(group, both)] = both[0]
    return pd.DataFrame(edges, columns=["src", "dst"])


def spanning_edges(df: DataFrame, key: str, vec: str, limit: float, *, part=(),
                   tile_rows: int | None = None) -> DataFrame:
    """Edges (src < dst) that connect the same rows as all pairs within `limit`.

    Up to FEW_TILES tiles all pairs of tiles meet. Of more, each first meets itself and a
    sample of its part only, which joins most rows of a dense table; then the rows outside
    the largest component of their part meet all rows, as its own rows needn't meet each
    other again. A pair of tiles returns a forest, fewer edges than rows, however dense the
    pile. Tiles grow with the rows as in a search, unless `tile_rows` is given.
    """
    part = list(part)
    rows = df.select(*part, key, F.col(vec).alias("_vec"))
    if limit < 1.0:
        rows = rows.where(F.size("_vec") > 0)
    kind = dict(rows.dtypes)[key]
    if tile_rows is None:
        of_part = rows.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
        tile_rows = min(SEARCH_TILE_ROWS, max(TILE_ROWS, math.ceil(of_part / SEARCH_TILES)))

    def forests(pairs: DataFrame, name: str) -> DataFrame:
        def forest(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = (np.flatnonzero(side) for side in sides(pdf)[0])
            return _links(pdf[name].to_numpy(), stack(pdf["_vec"].tolist()), left, right, limit)
        return map_groups(pairs.select(*part, name, "_vec", "_pair", "_tile"), [*part, "_pair"], [name], each(forest),
                          f"src {kind}, dst {kind}")
    placed, angled = tiled(rows, part, key, "_vec", tile_rows)
    if not angled:
        return forests(all_paired(placed), key)

    # every tile and the sample, which is called "hubs" in the place of a tile
    tile = F.concat_ws("/", *TILE)
    own = placed.select(*part, key, "_vec", tile.alias("_tile"))
    sizes = own.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / min(HUB_ROWS, tile_rows)).alias("_share"))
    hubs = join_same(rows, sizes, part).where(F.pmod(F.xxhash64(key, F.lit(2)), F.col("_share")) == 0).drop("_share")
    tiles = own.select(*part, F.concat("_tile", F.lit(" "), "_tile").alias("_pair"), "_tile").distinct()
    met = tiles.select(*part, F.concat("_tile", F.lit(" hubs")).alias("_pair"))
    pairs = (join_same(own, tiles, [*part, "_tile"])
             .unionByName(own.withColumn("_pair", F.concat("_tile", F.lit(" hubs"))))
             .unionByName(join_same(met, hubs, part).withColumn("_tile", F.lit("hubs"))))
    named = checkpoint(connected_components(rows, key, forests(pairs, key)))

    of = join_same(rows, named, [key])
    top = of.groupBy(*part, "component").agg(F.count(F.lit(1)).alias("_n")).groupBy(*part).agg(
        F.max_by("component", F.struct("_n", "component")).alias("_top"))
    rest = checkpoint(join_same(of, top, part).withColumn("_rest", F.col("component") != F.col("_top")).drop("_top"))
    stars = named.where(F.col("component") != F.col(key)).select(F.col("component").alias("src"), F.col(key).alias("dst"))
    if rest.where("_rest").isEmpty():
        return stars
    placed, _ = tiled(rest, [*part, "_rest"], key, "_vec", tile_rows)
    placed = checkpoint(placed.withColumn("_sub", F.col("_sub") * 2 + F.col("_rest").cast("int")))
    looks = F.when(F.bool_or("_rest"), F.lit(angle_limit(limit) if limit < 1.0 else np.pi)).otherwise(F.lit(-1.0))
    near = close_tiles(tile_bounds(placed, part, placed.groupBy(*part, *TILE).agg(looks.alias("_reach"))), part)
    return stars.unionByName(forests(paired(placed, part, near), "component"))


def _with_lowest(rows: DataFrame, lowest: DataFrame, node: str, degree: str, edges: int) -> DataFrame:
    """Join what each node knows. Nodes with very many rows are few (edges / HOT_DEGREE at
    most) and meet them by a broadcast, so that their rows stay where they are."""
    if edges <= HOT_DEGREE:
        return rows.join(lowest, node)
    hot = lowest.where(F.col(degree) > HOT_DEGREE)
    hot = F.broadcast(hot) if edges // HOT_DEGREE <= BROADCAST_ROWS else hot
    cold = rows.join(hot.select(node), node, "left_anti").join(lowest.where(F.col(degree) <= HOT_DEGREE), node)
    return rows.join(hot, node).unionByName(cold)


def connected_components(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, component), a component being named by its smallest key.

    Alternates two rewrites until nothing changes: every node hands its larger
    neighbours to the smallest node it knows, then its smaller ones. Each is one
    aggregation and one join over the edges.
    """
    current = checkpoint(edges.select("src", "dst").distinct())
    before = None
    while True:
        size = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count(F.lit(1)).alias("degree"))
        large = (_with_lowest(both, low, "src", "degree", 2 * size[0]).where("dst > src")
                 .select(F.col("low").alias("src"), "dst").where("src <> dst").distinct())
        down = large.select(F.col("dst").alias("node"), F.col("src").alias("to"))
        least = down.groupBy("node").agg(F.min("to").alias("low"), F.count(F.lit(1)).alias("degree"))
        small = (_with_lowest(down, least, "node", "degree", size[0]).where("to <> low")
                 .select(F.col("low").alias("src"), F.col("to").alias("dst"))
                 .unionByName(least.select(F.col("low").alias("src"), F.col("node").alias("dst"))))
        after = checkpoint(small.select(F.least("src", "dst").alias("src"),
                                        F.greatest("src", "dst").alias("dst")).distinct())
        forget(current)
        current = after
    labels = current.groupBy(F.col("dst").alias(key)).agg(F.min("src").alias("component"))
    return nodes.select(key).join(labels, key, "left").withColumn(
        "component", F.coalesce("component", key))


def cluster_components(df: DataFrame, key: str, vec: str, limit: float = P.CLUSTER_DIST, *,
                       part=(), tile_rows: int | None = None) -> DataFrame:
    """Single linkage at `limit`: rows joined by any chain of close pairs."""
    edges = spanning_edges(df, key, vec, limit, part=part, tile_rows=tile_rows)
    return connected_components(df, key, edges)


def cluster_greedy(df: DataFrame, part, order, key: str, vec: str,
                   limit: float = P.CLUSTER_DIST, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """First-come clustering: a row joins the cluster with the nearest earlier
    row if that is within `limit`, else it starts one; clusters never merge.

    The cluster with the smallest distance is the one of the nearest earlier
    row, so each row has one parent and the clusters are the trees. Equally near
    rows: the latest one. Result: part, key, cluster (key of the first member; NULL
    for a row without a vector).
    """
    part = list(part)
    known = df.where(F.col(vec).isNotNull())
    rows = checkpoint(row_numbers(known.select(*dict.fromkeys([*part, *order, key, vec])),
                                  part, list(order), "_pos"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in part) + (", " if part else "") + (
        "_pos bigint, _parent bigint, _dist double")
    slim = rows.select(*part, "_pos", F.col(vec).alias("_vec"))
    pairs = tile_groups(slim, part, "_pos", limit, tile_rows).select(*part, "_pos", "_vec", "_pair", "_tile")

    def nearest_earlier(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, units = pdf["_pos"].to_numpy(), stack(pdf["_vec"].tolist())
        found = []
        for late, early in sides(pdf):
            order = np.argsort(pos[early])
            dist = distances(units[late], units[early][order])
            dist[pos[late][:, None] <= pos[early][order][None, :]] = np.inf
            # the last column with the smallest distance is the latest such row
            at = dist.shape[1] - 1 - np.argmin(dist[:, ::-1], axis=1)
            best = dist[np.arange(len(at)), at]
            hit = best <= limit
            found.append(pd.DataFrame({"_pos": pos[late][hit], "_parent": pos[early][order][at[hit]], "_dist": best[hit]}))
        out = pd.concat(found, ignore_index=True)
        for column in reversed(part):
            out.insert(0, column, pdf[column].iloc[0])
        return out
    found = map_groups(pairs, [*part, "_pair"], ["_pos"], each(nearest_earlier), schema)
    parents = found.groupBy(*part, "_pos").agg(
        F.min_by("_parent", F.struct("_dist", (-F.col("_parent")).alias("p"))).alias("_parent"))
    links = join_same(rows.select(*part, "_pos"), parents, [*part, "_pos"], "left").withColumn(
        "_root", F.coalesce("_parent", "_pos")).drop("_parent")
    links = halved = checkpoint(links)
    while True:  # each round halves the way to the root
        up = links.select(*part, F.col("_pos").alias("_root"), F.col("_root").alias("_up"))
        joined = checkpoint(join_same(links, up, [*part, "_root"]))
        if joined.where("_root <> _up").isEmpty():
            forget(joined)
            break
        forget(halved)
        halved = joined
        links = joined.select(*part, "_pos", F.col("_up").alias("_root"))
    roots = rows.select(*part, F.col("_pos").alias("_root"), F.col(key).alias("cluster"))
    named = join_same(join_same(links, rows.select(*part, "_pos", key), [*part, "_pos"]), roots, [*part, "_root"])
    unknown = df.where(F.col(vec).isNull()).select(*part, key, F.lit(None).cast(types[key]).alias("cluster"))
    return named.select(*part, key, "cluster").unionByName(unknown)


def group_poses(photos: DataFrame, part, order, key: str, pose: str = "pose",
                confidence: str = "pose_confidence", limit: float = P.CLUSTER_DIST) -> DataFrame:
    """Pose clusters of the confident poses; the others stay unassigned."""
    sure = photos.where(F.col(pose).isNotNull() & (F.col(confidence) >= P.MIN_POSE_CONFIDENCE))
    return cluster_greedy(sure, part, order, key, pose, limit)


def group_persons(faces: DataFrame, part, order, key: str, face_key: str,
                  faceprint: str = "faceprint", limit: float = P.CLUSTER_DIST) -> DataFrame:
    """Person clusters and their photos; a photo may belong to several persons."""
    clusters = cluster_greedy(faces, part, order, face_key, faceprint, limit)
    return (clusters.join(faces.select(face_key, key), face_key)
            .select(*part, F.col("cluster").alias("person"), key).distinct())


def normalize_pose(joints, left_hip: int, right_hip: int, left_shoulder: int, right_shoulder: int):
    """Joints (array of x/y/visible structs) centred on the hips, in torso
    lengths; joints not visible become NULL."""
    def mid(a, b, axis):
        return (joints[a][axis] + joints[b][axis]) / 2
    hx, hy = mid(left_hip, right_hip, "x"), mid(left_hip, right_hip, "y")
    torso = F.hypot(mid(left_shoulder, right_shoulder, "x") - hx,
                    mid(left_shoulder, right_shoulder, "y") - hy)
    return F.when(torso > 0, F.transform(joints, lambda j: F.when(j["visible"], F.struct(
        ((j["x"] - hx) / torso).alias("x"), ((j["y"] - hy) / torso).alias("y")))))
