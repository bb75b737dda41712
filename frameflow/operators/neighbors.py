"""Exact nearest neighbours on vectors.

Rows of a key are laid into tiles of about `tile_rows`: by the nearest of a few pivots,
then by the angle to it. Angles obey the triangle inequality, so the angles of a tile's
rows to all pivots bound the angle between any two rows of two tiles from below, and pairs
of tiles that can't hold a wanted pair are never formed. A pair of tiles that is formed is
one small matrix product in one task, which returns only the best k per row; pairs of
rows never leave a task. Vectors without clusters leave little to prune: then the work is
that of the exact definition, quadratic per key, so give `part` whenever neighbours are
wanted within a group only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint, join_same, shuffle_partitions
from .local import each, map_groups, stack

TILE_ROWS = 1024
#: A row is copied once per tile that its own one meets, so a search over many rows takes
#: larger tiles; a task compares so many rows of one with the other at a time.
SEARCH_TILES, SEARCH_TILE_ROWS, SEARCH_BLOCK = 32, 8192, 512
#: A search for nearest rows, which looks at few numbers of its products, takes tiles of up to
#: so many bytes of vectors and rows.
NEAREST_TILE_BYTES, NEAREST_TILE_ROWS = 16 << 20, 32768
#: Up to so many tiles are compared without a look at the angles.
FEW_TILES = 8
PIVOTS = 16
BINS = 1024
#: Angles are compared with this much room for rounding.
SLACK = 1e-6


def unit_rows(vectors, size: int) -> np.ndarray:
    """Unit rows of the vectors of `size` numbers; all others are NaN."""
    out = np.full((len(vectors), size), np.nan)
    fit = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
    if fit:
        rows = np.array([vectors[i] for i in fit], dtype=np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        out[fit] = rows / np.where(norms > 0, norms, np.nan)
    return out


def angle_limit(distance: float) -> float:
    return math.acos(min(1.0, max(-1.0, 1.0 - distance)))


def tiled(rows: DataFrame, part, key: str, vec: str, tile_rows: int) -> tuple[DataFrame, bool]:
    """(rows, whether angles were taken): rows with `_cell`, `_bin` and `_sub`, the names of its tile within `part`, and `_angles`,
    to each pivot. Vectors that are unknown, zero or not of the usual length have no angles
    and tiles of their own (cell -1), which meet all others.

    The pivots are the PIVOTS known vectors with the smallest hash of the key; they and
    the number of rows are all that comes to the driver. A few tiles need none: rows are
    dealt by key then, to `_sub` of `_subs` tiles.
    """
    part = list(part)
    sizes = rows.where(F.size(vec) > 0).groupBy(F.size(vec).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("size"), F.sum("n").alias("n")).first()
    size, n = usual["size"] or 1, usual["n"] or 0
    drawn = []
    if n > FEW_TILES * tile_rows:
        drawn = rows.where(F.size(vec) == size).orderBy(F.xxhash64(key)).limit(PIVOTS).select(vec).collect()
    if not drawn:
        of_part = F.count(F.lit(1)).over(W.partitionBy(*part)) if part else F.lit(n)
        subs = F.greatest(F.ceil(of_part / tile_rows), F.lit(1)).cast("int")
        return rows.withColumn("_subs", subs).withColumn("_sub", F.pmod(F.xxhash64(key, F.lit(1)), F.col("_subs")).cast("int")), False
    units = unit_rows([r[0] for r in drawn], size)
    pivots = units[~np.isnan(units[:, 0])] if len(drawn) else np.zeros((0, size))

    def place(batches):
        for batch in batches:
            own = unit_rows(batch[vec].tolist(), size)
            known = ~np.isnan(own[:, 0])
            angles = np.arccos(np.clip(own @ pivots.T, -1.0, 1.0))
            cell, band = np.where(known, 0, -1), np.zeros(len(batch), np.int64)
            if len(pivots):
                near = np.where(known, np.argmin(np.nan_to_num(angles, nan=np.inf), axis=1), -1)
                nearest = angles[np.arange(len(batch)), np.maximum(near, 0)]
                cell, band = near, np.where(known, np.minimum(np.nan_to_num(nearest) / np.pi * BINS, BINS - 1), 0).astype(np.int64)
            yield batch.assign(_cell=cell.astype(np.int32), _band=band.astype(np.int32), _angles=[a if k else None for a, k in zip(angles.tolist(), known)])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = checkpoint(rows.mapInPandas(place, kind + ", _cell int, _band int, _angles array<double>"))
    # bands of angles are laid together up to a tile; one that is more than a tile is dealt by key
    bands = placed.groupBy(*part, "_cell", "_band").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*part, "_cell").orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
    bands = bands.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    bands = bands.select(*part, "_cell", "_band", F.floor(F.col("_before") / tile_rows).cast("int").alias("_bin"),
                         F.ceil(F.col("_n") / tile_rows).cast("int").alias("_subs"))
    named = join_same(placed, bands, [*part, "_cell", "_band"])
    return named.withColumn("_sub", F.pmod(F.xxhash64(key, F.lit(1)), F.col("_subs")).cast("int")).drop("_band", "_subs"), True


TILE = ["_cell", "_bin", "_sub"]


def tile_bounds(placed: DataFrame, part, reach: DataFrame | float) -> DataFrame:
    """One row per tile: the least and largest angle of its rows to each pivot, and how far
    away (as an angle) its rows look for others: `reach`, or the column `_reach` of a
    table by tile (null or none: to the end)."""
    part = list(part)
    low = F.array(*[F.min(F.col("_angles")[m]) for m in range(PIVOTS)])
    high = F.array(*[F.max(F.col("_angles")[m]) for m in range(PIVOTS)])
    # without ANSI mode and with it, an angle past the pivots at hand is null
    safe = placed.withColumn("_angles", F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda m: F.get("_angles", m)))
    tiles = safe.groupBy(*part, *TILE).agg(low.alias("_low"), high.alias("_high"))
    if isinstance(reach, DataFrame):
        return join_same(tiles, reach, [*part, *TILE], "left").withColumn("_reach", F.coalesce("_reach", F.lit(math.pi)))
    return tiles.withColumn("_reach", F.lit(float(reach)))


def close_tiles(tiles: DataFrame, part, own: bool = True) -> DataFrame:
    """(part, _cell, _bin, _sub, _pair): the pairs of tiles whose rows may be as near as one of
    them looks, each pair once for either tile; with `own`, also every tile with itself.

    Tiles are compared in blocks: each block of a part meets all tiles of the part.
    """
    part = list(part)
    blocks = shuffle_partitions(tiles.sparkSession)
    tiles = tiles.withColumn("_name", F.concat_ws("/", *TILE)).withColumn("_own", F.pmod(F.xxhash64("_name"), F.lit(blocks)).cast("int"))
    copies = tiles.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.array([[np.nan if x is None else x for x in v] for v in pdf[c]], dtype=np.float64) for c in ("_low", "_high"))
        names, reach = pdf["_name"].to_numpy(), pdf["_reach"].to_numpy()
        odd = pdf["_cell"].to_numpy() < 0
        left, right = [], []
        for i in np.flatnonzero(pdf["_own"].to_numpy() == pdf["_block"].to_numpy()):
            gap = np.fmax.reduce(np.concatenate([np.zeros((len(pdf), 1)), low[i] - high, low - high[i]], axis=1), axis=1)
            may = (gap <= np.maximum(reach, reach[i]) + SLACK) | odd | odd[i]
            may &= (names > names[i]) if not own else (names >= names[i])
            left += [i] * int(may.sum())
            right += np.flatnonzero(may).tolist()
        pair = [f"{names[a]} {names[b]}" for a, b in zip(left, right)]
        both = [(a, p) for a, p in zip(left, pair)] + [(b, p) for a, b, p in zip(left, right, pair) if a != b]
        out = pdf[[*part, *TILE]].iloc[[i for i, _ in both]].reset_index(drop=True)
        return out.assign(_pair=pd.Series([p for _, p in both], dtype=object))
    types = dict(tiles.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*part, *TILE]) + ", _pair string"
    return map_groups(copies, [*part, "_block"], ["_name"], each(compare), schema)


def paired(placed: DataFrame, part, pairs: DataFrame) -> DataFrame:
    """Each row once for every pair of tiles that its tile is in; `_pair` names the pair,
    `_tile` the row's own tile."""
    rows = join_same(placed.drop("_angles"), pairs, [*part, *TILE])
    return rows.withColumn("_tile", F.concat_ws("/", *TILE)).drop(*TILE)


def all_paired(placed: DataFrame) -> DataFrame:
    """The same for rows dealt to few tiles, all of which meet."""
    rows = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)))
    pair = F.concat_ws(" ", F.least("_sub", "_other"), F.greatest("_sub", "_other"))
    return rows.withColumns({"_pair": pair, "_tile": F.col("_sub").cast("string")}).drop("_sub", "_subs", "_other")


def sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a pair of tiles look for others among which: either way, or within."""
    tile = pdf["_tile"].to_numpy()
    a, b = pdf["_pair"].iloc[0].split(" ")
    return [(tile == a, tile == b)] + ([(tile == b, tile == a)] if a != b else [])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows; unknown vectors are at distance 1."""
    return 1.0 - np.nan_to_num(a @ b.T, nan=0.0)


def knn(df: DataFrame, key: str, vec: str, k: int, *, part=(), tile_rows: int | None = None) -> DataFrame:
    """(part, key, neighbor, distance, rank): the k nearest by (distance, key).

    Tiles have `tile_rows` rows, by default TILE_ROWS up to SEARCH_TILES tiles of a part, then
    more, up to NEAREST_TILE_BYTES and NEAREST_TILE_ROWS.

    Every tile is searched by itself first; how far its rows then still look is the
    farthest of their k-th best, and a row takes from other tiles only what is as near as its
    own k-th best. Products of half the digits tell which rows may be, with room for their
    rounding; distances are computed anew for those.
    """
    part = list(part)
    rows = df.select(*part, key, F.col(vec).alias("_vec"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*part, key]) + (
        f", neighbor {types[key]}, distance double")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, units = pdf[key].to_numpy(), np.nan_to_num(stack(pdf["_vec"].tolist()), nan=0.0)
        far = pdf["_far"].to_numpy(np.float64) if "_far" in pdf else np.full(len(pdf), np.inf)
        short, room = units.astype(np.float32), (units.shape[1] + 8) * 2.0 ** -23
        block = max(1, min(SEARCH_BLOCK, SEARCH_BLOCK * SEARCH_TILE_ROWS // max(len(pdf), 1)))
        out = [_take(ids[:0], ids[:0], np.zeros((0, 2), np.int64), np.zeros(0))]
        for left, right in sides(pdf):
            there, others = np.flatnonzero(right), ids[right]
            near = short[there].T
            for at in np.split(np.flatnonzero(left), range(block, int(left.sum()), block)):
                close = short[at] @ near
                if np.isfinite(far[at]).all():
                    least = (1.0 - far[at] - 2 * room)[:, None]
                else:
                    close[ids[at][:, None] == others[None, :]] = -np.inf
                    least = np.full((len(at), 1), -2.0)
                    if close.shape[1] > k:
                        least = np.partition(close, close.shape[1] - k, axis=1)[:, -k, None].astype(np.float64) - 2 * room
                row, col = np.divmod(np.flatnonzero(close >= np.maximum(least, -2.0).astype(np.float32)), max(close.shape[1], 1))
                pairs = np.stack([row, col], 1)[ids[at][row] != others[col]]
                dist = np.concatenate([1.0 - (units[at[p[:, 0]]] * units[there[p[:, 1]]]).sum(axis=1)
                                       for p in np.split(pairs, range(NEAREST_TILE_ROWS, len(pairs), NEAREST_TILE_ROWS))])
                reach = dist <= far[at][pairs[:, 0]]
                out.append(_take(ids[at], others, pairs[reach], dist[reach]))
        found = pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)
        for column in part:
            found.insert(0, column, pdf[column].iloc[0])
        return found[[*part, key, "neighbor", "distance"]]

    def _take(own, others, pairs, dist):
        row, col = pairs.T
        order = np.lexsort((others[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        return pd.DataFrame({key: own[row], "neighbor": others[col], "distance": dist[first]})
    if tile_rows is None:
        sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("size")).agg(F.max("n"), F.max("size")).first()
        most = min(NEAREST_TILE_ROWS, max(TILE_ROWS, NEAREST_TILE_BYTES // (8 * max(sizes[1] or 1, 1))))
        tile_rows = min(most, max(TILE_ROWS, math.ceil((sizes[0] or 0) / SEARCH_TILES)))
    placed, angled = tiled(rows, part, key, "_vec", tile_rows)
    order = W.partitionBy(*part, key).orderBy("distance", "neighbor")

    def nearest(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not angled:
        return nearest(map_groups(all_paired(placed).select(*part, key, "_vec", "_pair", "_tile"), [*part, "_pair"], [key], each(best), schema))
    alone = placed.withColumn("_pair", F.concat(F.concat_ws("/", *TILE), F.lit(" "), F.concat_ws("/", *TILE)))
    alone = alone.withColumn("_tile", F.concat_ws("/", *TILE))
    first = checkpoint(map_groups(alone.select(*part, key, "_vec", "_pair", "_tile"), [*part, "_pair"], [key], each(best), schema))
    kth = first.groupBy(*part, key).agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_found"))
    known = F.coalesce(F.col("_found"), F.lit(0)) >= k
    placed = join_same(placed, kth, [*part, key], "left").withColumn("_far", F.when(known, F.col("_far")).otherwise(F.lit(float("inf")))).drop("_found")
    placed = checkpoint(placed)
    far = F.when(F.col("_far") < 2.0, F.acos(F.greatest(F.lit(-1.0), 1 - F.col("_far")))).otherwise(math.pi)
    reach = placed.groupBy(*part, *TILE).agg(F.max(far).alias("_reach"))
    pairs = close_tiles(tile_bounds(placed, part, reach), part, own=False)
    more = map_groups(paired(placed, part, pairs).select(*part, key, "_vec", "_far", "_pair", "_tile"), [*part, "_pair"], [key], each(best), schema)
    return nearest(first.unionByName(more))


def neighbor_jaccard(df: DataFrame, key: str, vec_a: str, vec_b: str, k: int = 5, *,
                     part=(), tile_rows: int | None = None) -> DataFrame:
    """Mean Jaccard overlap of each row's k nearest under two embeddings.

    Only rows with both vectors take part; NULL when fewer than k + 2.
    """
    both = df.where(F.col(vec_a).isNotNull() & F.col(vec_b).isNotNull())
    keys = [*part, key]
    a = knn(both, key, vec_a, k, part=part, tile_rows=tile_rows).select(*keys, "neighbor")
    b = knn(both, key, vec_b, k, part=part, tile_rows=tile_rows).select(*keys, "neighbor")
    common = join_same(a, b, [*keys, "neighbor"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    share = F.coalesce("_c", F.lit(0)) / (2 * k - F.coalesce("_c", F.lit(0)))
    per_row = join_same(both.select(*keys), common, keys, "left")
    return per_row.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= k + 2, F.avg(share)).alias("jaccard"))
