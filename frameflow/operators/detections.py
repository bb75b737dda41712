"""Greedy box decisions per image: suppression and matching of detectors.

Images are processed inside tasks while they have few boxes. An image with more
than `max_rows` goes through rounds: the next `buffer` boxes in order are
decided in one task, their effect is applied to the rest of the image on all
tasks, and so on. Order and result are the same.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.geometry import iou
from ..runtime import checkpoint, forget, join_same, shuffle_partitions
from .local import known, map_groups, oversized

LOCAL_BOXES = 2048
# Boxes decided per round of a crowded image; Spark cuts a group to up to 1000
# first rows before the shuffle.
ROUND_BOXES = 512
_BOX = ["_x", "_y", "_w", "_h"]


def _areas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection and union of every box of a with every box of b (rows are x, y, w, h)."""
    ax, ay, aw, ah = (a[:, i, None] for i in range(4))
    bx, by, bw, bh = (b[None, :, i] for i in range(4))
    wide = np.maximum(0.0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx))
    high = np.maximum(0.0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
    inter = wide * high
    return inter, aw * ah + bw * bh - inter


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b."""
    inter, union = _areas(a, b)
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def suppressed(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Whether the intersection is at least `limit` of the union, without a division, whose
    rounding would decide pairs that lie on the limit."""
    inter, union = _areas(a, b)
    return (union > 0) & (inter >= limit * union)


def _flat(df: DataFrame, part, key, box, *extra) -> DataFrame:
    return df.select(*part, F.col(key).alias("_key"),
                     *[F.col(f"{box}.{c}").alias(f"_{c}") for c in "xywh"], *extra)


def _schema(df: DataFrame, columns) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _suppress(columns, limit: float):
    """Keep the best boxes of each group; rows come best first."""
    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        boxes = pdf[_BOX].to_numpy(dtype=np.float64)
        keep = np.ones(len(pdf), dtype=bool)
        for a, b in zip(bounds, bounds[1:]):
            if b - a == 1:
                continue
            hits = suppressed(boxes[a:b], boxes[a:b], limit)
            for i in range(b - a):
                if keep[a + i]:
                    keep[a + i + 1:b] &= ~hits[i, i + 1:]
        return pdf.loc[keep, columns]
    return run


def nms(df: DataFrame, part, key: str, *, box: str = "bbox", score: str = "score",
        limit: float = P.NMS_IOU, cap: int | None = None,
        max_rows: int | None = None, buffer: int = ROUND_BOXES) -> DataFrame:
    """Kept boxes (part, key, score): best score first, an unknown one last, a box
    overlapping a kept one by `limit` or more is dropped; with `cap`, only the best so
    many of each image stay."""
    part = list(part)
    rows = _flat(df, part, key, box, F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))).alias("_neg"))
    big = oversized(rows, part, max_rows or LOCAL_BOXES)
    columns = [*part, "_key", "_neg", *_BOX]
    schema = _schema(rows, columns)
    kept = map_groups(rows if big is None else join_same(rows, big, part, "left_anti"),
                      part, ["_neg", "_key"], _suppress(columns, limit), schema)
    if big is not None:
        kept = kept.unionByName(
            _nms_rounds(join_same(rows, big, part, "left_semi"), part, columns, schema, limit, buffer))
    kept = kept.select(*part, F.col("_key").alias(key),
                       F.when(F.col("_neg") != float("inf"), -F.col("_neg")).alias(score))
    if cap is None:
        return kept
    best = W.partitionBy(*part).orderBy(F.desc_nulls_last(score), F.asc(key))
    return kept.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= cap).drop("_rn")


def _nms_rounds(rows, part, columns, schema, limit, buffer):
    left = checkpoint(rows.select(*columns))
    order = W.partitionBy(*part).orderBy("_neg", "_key")
    kept = None
    while not left.isEmpty():
        head = checkpoint(left.withColumn("_rn", F.row_number().over(order))
                          .where(F.col("_rn") <= buffer).drop("_rn"))
        won = checkpoint(map_groups(head, part, ["_neg", "_key"], _suppress(columns, limit), schema))
        kept = won if kept is None else kept.unionByName(won)
        rest = join_same(left, head.select(*part, "_key"), [*part, "_key"], "left_anti")
        after = checkpoint(_drop_overlapping(rest, won, part, columns, schema, limit))
        forget(left, head)
        left = after
    return kept


def _drop_overlapping(rest, won, part, columns, schema, limit):
    """Remove boxes overlapping a winner; rows are salted, winners are copied."""
    salts = shuffle_partitions(rest.sparkSession)
    rows = rest.withColumns({"_salt": F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"),
                             "_is_row": F.lit(True)})
    copies = won.withColumns({"_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))),
                              "_is_row": F.lit(False)})
    keys = [*part, "_salt"]
    placed = (rows.unionByName(copies).repartition(*keys)
              .sortWithinPartitions(*keys, "_is_row"))

    def run(batches):
        group, winners = None, []
        for batch in batches:
            for values, pdf in batch.groupby(keys, sort=False, dropna=False):
                if known(values) != group:
                    group, winners = known(values), []
                is_row = pdf["_is_row"].to_numpy()
                winners.extend(pdf.loc[~is_row, _BOX].to_numpy(dtype=np.float64))
                out = pdf[is_row]
                if len(out) and winners:
                    hit = suppressed(out[_BOX].to_numpy(dtype=np.float64), np.array(winners), limit).any(axis=1)
                    out = out[~hit]
                yield out[columns]
    return placed.mapInPandas(run, schema)


def iou_pairs(a: DataFrame, b: DataFrame, part, key: str, *, box: str = "bbox",
              limit: float = P.MATCH_IOU) -> DataFrame:
    """All pairs of one image whose boxes overlap by `limit` or more, in any unit of length.

    The longest sides of such a pair are within a factor 1 / limit of each other. So each
    box lies on the grid of its size (a cell is as long as its longest side at least, and
    shorter than that over `limit`) and on the next larger one; a pair shares a cell of
    the larger box's grid, and is reported from the one with the intersection's corner. A
    box takes four cells of each grid at most, whatever the frame. Boxes without area
    overlap nothing.
    """
    if not 0 < limit <= 1:
        raise ValueError("limit must be above 0 and at most 1")
    part = list(part)
    left = a.select(*part, F.col(key).alias("key_a"), F.col(box).alias("_a"))
    right = b.select(*part, F.col(key).alias("key_b"), F.col(box).alias("_b"))
    pairs = on_grid(left, "_a", limit).join(on_grid(right, "_b", limit).withColumnRenamed("_own", "_own_b"),
                                            [*part, "_level", "_cx", "_cy"])
    corner_x, corner_y = (F.floor(F.greatest(F.col(f"_a.{c}"), F.col(f"_b.{c}")) / _side(limit)) for c in "xy")
    score = iou(F.col("_a"), F.col("_b"))
    return (pairs.where((F.col("_level") == F.greatest("_own", "_own_b")) & (F.col("_cx") == corner_x) & (F.col("_cy") == corner_y))
            .select(*part, "key_a", "key_b", score.alias("iou")).where(F.col("iou") >= limit))


def _factor(limit: float) -> float:
    """Between the cells of one grid and the next."""
    return min(1 / limit, 16.0) if limit < 0.5 else 2.0


def _side(limit: float):
    return F.pow(F.lit(_factor(limit)), F.col("_level") + 1)


def on_grid(rows: DataFrame, box: str, limit: float) -> DataFrame:
    """rows once per cell that its box covers, on the grid of its own size (`_own`) and on
    those of all larger boxes that may overlap it by `limit`."""
    x, y, w, h = (F.col(f"{box}.{c}") for c in "xywh")
    step = math.log(_factor(limit))
    # boxes within 1 / limit of each other are so many grids apart at most
    apart = math.ceil(math.log(1 / limit) / step - 1e-9) if limit < 1 else 1
    own = F.floor(F.log(F.greatest(w, h)) / step).cast("int")
    placed = rows.where((w > 0) & (h > 0)).withColumn("_own", own)
    placed = placed.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.col("_own") + apart)))

    def cells(low, high):
        return F.sequence(F.floor(low / _side(limit)), F.floor(high / _side(limit)))
    return placed.withColumn("_cx", F.explode(cells(x, x + w))).withColumn("_cy", F.explode(cells(y, y + h)))


def match_detections(a: DataFrame, b: DataFrame, part, key: str, *, box: str = "bbox",
                     limit: float = P.MATCH_IOU, max_rows: int | None = None,
                     buffer: int = ROUND_BOXES) -> DataFrame:
    """(part, key_a, key_b): each a-box in key order takes the first unused
    b-box it overlaps enough. Unmatched boxes come with NULL on the other side."""
    part = list(part)
    rows = (_flat(a, part, key, box, F.lit(0).alias("_side"))
            .unionByName(_flat(b, part, key, box, F.lit(1).alias("_side"))))
    big = oversized(rows, part, max_rows or LOCAL_BOXES)
    kind = dict(rows.dtypes)["_key"]
    schema = _schema(rows, part) + f", key_a {kind}, key_b {kind}"

    matched = map_groups(rows if big is None else join_same(rows, big, part, "left_anti"), part,
                         ["_side", "_key"], _match_groups(part, limit), schema)
    if big is not None:
        matched = matched.unionByName(_match_rounds(
            join_same(rows, big, part, "left_semi"), part, schema, limit, buffer))
    return matched


def union_detections(a: DataFrame, b: DataFrame, part, key: str, *, box: str = "bbox",
                     limit: float = P.MATCH_IOU, max_rows: int | None = None) -> DataFrame:
    """(part, key, box, source): all boxes of a, and those of b that match none."""
    part = list(part)
    matched = match_detections(a, b, part, key, box=box, limit=limit, max_rows=max_rows)
    free = matched.where("key_a IS NULL").select(*part, F.col("key_b").alias(key))
    extra = join_same(b, free, [*part, key], "left_semi")
    return (a.select(*part, key, box, F.lit("a").alias("source"))
            .unionByName(extra.select(*part, key, box, F.lit("b").alias("source"))))


def _match_groups(part, limit: float, keep_free: bool = True):
    """First free partner for each a-box; a-boxes come first in each group."""
    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        boxes = pdf[_BOX].to_numpy(dtype=np.float64)
        side, ids = pdf["_side"].to_numpy(), pdf["_key"].to_numpy()
        rows, key_a, key_b = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            cut = a + int((side[a:b] == 0).sum())
            match = _first_free(boxes[a:cut], boxes[cut:b], limit)
            free = np.ones(b - cut, dtype=bool)
            free[match[match >= 0]] = False
            rows += [a] * (cut - a)
            key_a += list(ids[a:cut])
            key_b += [ids[cut + m] if m >= 0 else None for m in match]
            if keep_free:
                left = ids[cut:b][free]
                rows += [a] * len(left)
                key_a += [None] * len(left)
                key_b += list(left)
        out = pdf[part].iloc[rows].reset_index(drop=True)
        return out.assign(key_a=pd.Series(key_a, dtype=object), key_b=pd.Series(key_b, dtype=object))
    return run


def _first_free(one: np.ndarray, two: np.ndarray, limit: float) -> np.ndarray:
    """Index into two for each box of one, -1 for none."""
    out = np.full(len(one), -1)
    if not len(one) or not len(two):
        return out
    hits = overlap(one, two) >= limit
    for i in range(len(one)):
        usable = np.flatnonzero(hits[i])
        if len(usable):
            out[i] = usable[0]
            hits[:, usable[0]] = False
    return out


def _match_rounds(rows, part, schema, limit, buffer):
    """Decide `buffer` a-boxes per round. Each needs only its first `buffer`
    free partners, since the others of the round use at most one each."""
    one = checkpoint(rows.where("_side = 0").drop("_side"))
    two = checkpoint(rows.where("_side = 1").drop("_side"))
    order = W.partitionBy(*part).orderBy("_key")
    done = None
    while not one.isEmpty():
        head = checkpoint(one.withColumn("_rn", F.row_number().over(order))
                          .where(F.col("_rn") <= buffer).drop("_rn"))
        options = _first_partners(two, head, part, limit, buffer)
        near = join_same(two, options, [*part, "_key"], "left_semi")
        both = head.withColumn("_side", F.lit(0)).unionByName(near.withColumn("_side", F.lit(1)))
        pairs = checkpoint(map_groups(both, part, ["_side", "_key"],
                                      _match_groups(part, limit, keep_free=False), schema))
        done = pairs if done is None else done.unionByName(pairs)
        rest = checkpoint(join_same(one, head.select(*part, "_key"), [*part, "_key"], "left_anti"))
        used = pairs.where("key_b IS NOT NULL").select(*part, F.col("key_b").alias("_key"))
        free = checkpoint(join_same(two, used, [*part, "_key"], "left_anti"))
        forget(one, two, head)
        one, two = rest, free
    only_b = two.select(*part, F.lit(None).cast(dict(two.dtypes)["_key"]).alias("key_a"),
                        F.col("_key").alias("key_b"))
    return only_b if done is None else done.unionByName(only_b)


def _first_partners(two, head, part, limit, buffer):
    """(part, key) of the first `buffer` b-boxes overlapping each a-box of head."""
    salts = shuffle_partitions(two.sparkSession)
    rows = two.withColumns({"_salt": F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"),
                            "_is_row": F.lit(True)})
    copies = head.withColumns({"_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))),
                               "_is_row": F.lit(False)})
    keys = [*part, "_salt"]
    placed = (rows.unionByName(copies).repartition(*keys)
              .sortWithinPartitions(*keys, "_is_row", "_key"))
    schema = _schema(two, [*part, "_key"]) + ", _a bigint"

    def run(batches):
        group, heads, taken = None, [], None
        for batch in batches:
            for values, pdf in batch.groupby(keys, sort=False, dropna=False):
                if known(values) != group:
                    group, heads, taken = known(values), [], None
                is_row = pdf["_is_row"].to_numpy()
                heads.extend(pdf.loc[~is_row, _BOX].to_numpy(dtype=np.float64))
                out = pdf[is_row]
                if not len(out) or not heads:
                    continue
                taken = np.zeros(len(heads), dtype=int) if taken is None else taken
                hits = overlap(out[_BOX].to_numpy(dtype=np.float64), np.array(heads)) >= limit
                hits &= np.cumsum(hits, axis=0) + taken <= buffer
                taken = taken + hits.sum(axis=0)
                row, a = np.nonzero(hits)
                yield out[[*part, "_key"]].iloc[row].assign(_a=a.astype(np.int64))
    found = placed.mapInPandas(run, schema)
    first = W.partitionBy(*part, "_a").orderBy("_key")
    return (found.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= buffer)
            .select(*part, "_key").distinct())
