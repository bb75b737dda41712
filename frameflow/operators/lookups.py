"""Read queries over the capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import join_same
from .ordered import row_numbers


def keyset_page(rows: DataFrame, key: str, after, limit: int, where: Column | None = None) -> DataFrame:
    """The next `limit` rows after a key, with `next_cursor` when the page is full."""
    page = rows.where(F.col(key) > after)
    page = (page if where is None else page.where(where)).orderBy(key).limit(limit)
    full = page.agg(F.when(F.count(F.lit(1)) == limit, F.max(key)).alias("next_cursor"))
    return page.join(F.broadcast(full))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in `done`."""
    return rows.join(done, key, "left_anti")


def count_per_key(rows: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Number of children per row, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, key, "left").fillna(0, [name])


def cascade_delete(deleted: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children that survive when the parents in `deleted` go."""
    return children.join(deleted.select(key), key, "left_anti")


def deletion_report(deleted: DataFrame, selections: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """What goes with the parents in `deleted`: their number, and how many of them are in
    a selection that was exported."""
    exported = entries.join(selections.where("exported_at IS NOT NULL").select("selection_id"), "selection_id", "left_semi")
    marked = deleted.select(key).distinct().join(exported.select(key).distinct().withColumn("_out", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("deleted"), F.count("_out").alias("exported"))


def shoot_rollup(shoots: DataFrame, photos: DataFrame, analysis: DataFrame, jobs: DataFrame,
                 selections: DataFrame, part: str = "shoot_id") -> DataFrame:
    """Per shoot: photos, analyzed photos, newest selection, newest running job, and why
    the newest stopped job stopped.

    photos: photo_id, part. analysis: photo_id. jobs: job_id, part, state, reason.
    selections: selection_id, part. Every table is aggregated before it is joined.
    """
    done = analysis.select("photo_id", F.lit(1).alias("_done")).distinct()
    counts = photos.select(part, "photo_id").join(done, "photo_id", "left").groupBy(part).agg(
        F.count(F.lit(1)).alias("photo_count"), F.count("_done").alias("analyzed_count"))
    newest = selections.groupBy(part).agg(F.max("selection_id").alias("latest_selection_id"))
    stopped = F.when(F.col("state") == "stopped", F.col("job_id"))
    states = jobs.groupBy(part).agg(F.max(F.when(F.col("state") == "running", F.col("job_id"))).alias("busy_job_id"),
                                    F.max_by("reason", stopped).alias("stopped_reason"))
    rows = shoots.select(part)
    for side in (counts, newest, states):
        rows = rows.join(side, part, "left")
    return rows.fillna(0, ["photo_count", "analyzed_count"])


def tile_lookup(photos: DataFrame, key: str, tiles: str = "tiles") -> DataFrame:
    """(key, row, col, value, tile_max, tile_mean): a photo's tile map in long form with
    its largest and mean value; photos without a map have no rows."""
    flat = photos.select(key, tiles, F.flatten(tiles).alias("_flat")).select(
        key, tiles, F.array_max("_flat").alias("tile_max"),
        (F.aggregate("_flat", F.lit(0.0), lambda a, v: a + v) / F.size("_flat")).alias("tile_mean"))
    # the summary goes along with the cells; a join would meet 256 rows per photo
    # outer: else Spark tests the size of the map, made for that test alone, before all else
    rows = flat.select(key, "tile_max", "tile_mean", F.posexplode_outer(tiles).alias("row", "_line"))
    cells = rows.select(key, "tile_max", "tile_mean", "row", F.posexplode_outer("_line").alias("col", "value"))
    return cells.where("col IS NOT NULL").select(key, "row", "col", "value", "tile_max", "tile_mean")


def capture_detail(photos: DataFrame, faces: DataFrame, scores: DataFrame, members: DataFrame,
                   entries: DataFrame, selections: DataFrame, key: str = "photo_id") -> DataFrame:
    """One row per photo: face count, score under the photo's current profile,
    shot size, state in the newest selection; NULL where there is none.

    photos: key, profile. scores: key, profile, total. members: group_id, key,
    is_bracket. entries: selection_id, key, state. selections: selection_id,
    created_at.
    """
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("shot_size"))
    groups = members.select(key, "group_id", "is_bracket").join(sizes, "group_id")
    newest = entries.join(selections, "selection_id").groupBy(key).agg(
        F.max_by("state", F.struct("created_at", "selection_id")).alias("state"))
    rows = count_per_key(photos, faces, key, "n_faces")
    return (rows.join(scores.select(key, "profile", "total"), [key, "profile"], "left")
            .join(groups, key, "left").join(newest, key, "left"))


#: Faces of one photo that a detail may list; detectors keep far fewer.
MOST_FACES = 1000


def capture_payload(photos: DataFrame, analysis: DataFrame, faces: DataFrame, scores: DataFrame, members: DataFrame,
                    entries: DataFrame, selections: DataFrame, key: str = "photo_id") -> DataFrame:
    """All that is known of each photo, one row with nested columns; NULL where there is none.

    photos: key, profile and any other columns. analysis: key, engine_version, decode_mode,
    frame (its tile map is dropped). faces: key, idx, bbox, yaw, capture_quality, sharp_l,
    sharp_r, open_l, open_r, eye_source. scores: key, profile, total, components, flags,
    weights_hash; the row of the photo's current profile is taken. members: group_id, key,
    is_bracket. entries: selection_id, key, state, rank, reason, user_override; the one of
    the newest selection is taken. selections: selection_id, created_at.

    Adds analysis, faces (in idx order, eyes as left and right), score, group (with its
    size) and selection. Faces are gathered per photo, which is refused beyond MOST_FACES.
    """
    frame = analysis.schema["frame"].dataType
    measured = F.struct(*[F.col(f"frame.{f.name}") for f in frame.fields if f.name != "sharpness_tiles"])
    analysed = analysis.select(key, F.struct("decode_mode", "engine_version", measured.alias("frame")).alias("analysis"))
    eyes = F.struct(*[F.struct(F.col(f"sharp_{s}").alias("sharp_norm"), F.col(f"open_{s}").alias("open")).alias(name)
                      for s, name in (("l", "left"), ("r", "right"))])
    face = F.struct("idx", "bbox", "yaw", "capture_quality", eyes.alias("eyes"), "eye_source")
    listed = faces.select(key, face.alias("_face")).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.collect_list("_face").alias("faces"))
    by_idx = F.array_sort("faces", lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))
    listed = listed.select(key, F.when(F.col("_n") <= MOST_FACES, by_idx).otherwise(
        F.raise_error(F.concat(F.lit("too many faces in one photo: "), F.col("_n"))).cast(listed.schema["faces"].dataType)).alias("faces"))
    scored = scores.select(key, "profile", F.struct("profile", "total", "components", "flags", "weights_hash").alias("score"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    groups = members.select(key, "group_id", "is_bracket").join(sizes, "group_id").select(
        key, F.struct(F.col("group_id").alias("shot_id"), "size", "is_bracket").alias("group"))
    newest = entries.join(selections.select("selection_id", "created_at"), "selection_id").groupBy(key).agg(
        F.max_by(F.struct("state", "rank", "reason", "user_override"), F.struct("created_at", "selection_id")).alias("selection"))
    rows = photos.join(analysed, key, "left").join(listed, key, "left").join(scored, [key, "profile"], "left")
    rows = rows.join(groups, key, "left").join(newest, key, "left")
    return rows.withColumn("faces", F.coalesce("faces", F.array().cast(listed.schema["faces"].dataType)))


def shared_keys(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The known keys that both tables have, each once."""
    return one.select(key).where(F.col(key).isNotNull()).join(two.select(key), key, "left_semi").distinct()


def ordered_members(members: DataFrame, group: str, time: str, key: str,
                    part: str | None = None) -> DataFrame:
    """Members numbered in capture order inside groups, and groups numbered by
    their earliest member. Long form: no group is gathered into one value."""
    scope = [part] if part else []
    pos = row_numbers(members, [*scope, group], [time, key], "pos")
    heads = members.groupBy(*scope, group).agg(F.min(F.struct(time, key)).alias("_head"))
    order = row_numbers(heads, scope, ["_head", group], "group_order").drop("_head")
    return join_same(pos, order, [*scope, group])


def compare_set(entries: DataFrame, part, current: Column, key: str, rank: str = "rank",
                others: int = 3) -> DataFrame:
    """Per group the current frame and the best-ranked others, those without a rank last."""
    part = list(part)
    spec = W.partitionBy(*part).orderBy(F.asc_nulls_last(rank), key)
    chosen = entries.where(current).withColumn("slot", F.lit(0))
    best = (entries.where(~current).withColumn("slot", F.row_number().over(spec))
            .where(F.col("slot") <= others))
    return chosen.unionByName(best)


def match_coverage(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """How many rows of each side find the other by exact key."""
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, keys, "full_outer").agg(
        F.coalesce(F.sum(F.when(both, F.col("_a"))), F.lit(0)).alias("left_matched"),
        F.coalesce(F.sum(F.when(~both, F.col("_a"))), F.lit(0)).alias("left_unmatched"),
        F.coalesce(F.sum(F.when(both, F.col("_b"))), F.lit(0)).alias("right_matched"),
        F.coalesce(F.sum(F.when(~both, F.col("_b"))), F.lit(0)).alias("right_unmatched"))
