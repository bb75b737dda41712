"""Manual corrections of groups: pins re-applied after regrouping, and edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint, join_same
from .local import each, map_groups
from .ordered import ordered_rows


class OrderedSet:
    """A set of integers below `size` with insertion, removal and search of the largest
    member at or below a place: a tree of bitmaps, one level per 256 places."""

    BITS = 256

    def __init__(self, size: int, members) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = -(-size // self.BITS)
            self.levels.append([0] * max(size, 1))
            if size <= 1:
                break
        for x in members:
            self.add(x)

    def __contains__(self, x: int) -> bool:
        return bool(self.levels[0][x // self.BITS] >> (x % self.BITS) & 1)

    def add(self, x: int) -> None:
        for level in self.levels:
            x, bit = divmod(x, self.BITS)
            level[x] |= 1 << bit

    def remove(self, x: int) -> None:
        for level in self.levels:
            x, bit = divmod(x, self.BITS)
            level[x] &= ~(1 << bit)
            if level[x]:
                return

    def at_or_below(self, x: int) -> int:
        """The largest member that isn't larger than x; -1 without one."""
        for depth, level in enumerate(self.levels):
            if x < 0:
                return -1
            at, bit = divmod(x, self.BITS)
            found = level[at] & ((2 << bit) - 1)
            if found:
                at = at * self.BITS + found.bit_length() - 1
                for below in reversed(self.levels[:depth]):
                    at = at * self.BITS + below[at].bit_length() - 1
                return at
            x = at - 1
        return -1


def apply_pins(shots: DataFrame, pins: DataFrame, *, part: str = "shoot_id", time: str = "t_ms",
               key: str = "photo_id", group: str = "shot_id", max_rows=None) -> DataFrame:
    """Re-apply split_before / merge_with_prev pins in their order.

    shots: part, time, key, group (named by its first key), is_bracket.
    pins: part, key, pin_order, kind. A pin only ever sees group starts: a split adds
    the start of its frame, a merge clears the start of the group its frame is in at that
    moment. A group's start can only be cleared if so many merges lie behind it that the
    starts between are cleared, too; starts that can't be cleared, brackets and the
    groups after brackets divide a shoot into pieces that don't affect each other. Pieces
    with pins are replayed each on its own, with an ordered set of starts.
    """
    shots = checkpoint(shots.select(part, time, key, group, "is_bracket"))
    numbered = ordered_rows(shots, (part,), (time, key), max_rows)
    first = F.col(group) == F.col(key)
    rows = numbered.row_number("_pos").running_sum("_group_no", first.cast("long")).result()
    asked = pins.select(part, key, "pin_order", "kind").join(
        rows.select(part, key, "_pos", "_group_no", "is_bracket"), [part, key])
    asked = asked.where("NOT is_bracket").drop("is_bracket")
    starts = rows.where(first).select(part, "_group_no", "_pos", "is_bracket", key)
    merges = asked.where("kind = 'merge_with_prev'").groupBy(part, "_group_no").agg(F.count(F.lit(1)).alias("_m"))
    starts = join_same(starts, merges, [part, "_group_no"], "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    pieces = checkpoint(_pieces(starts, part, max_rows))
    found = join_same(asked, pieces.select(part, "_group_no", "_piece"), [part, "_group_no"])
    touched = found.select(part, "_piece").distinct()
    near = join_same(pieces, touched, [part, "_piece"], "left_semi").select(
        part, "_piece", "_pos", key, F.lit(None).cast("long").alias("pin_order"),
        F.when(F.col("is_bracket"), "bracket").otherwise("start").alias("kind"))
    todo = near.unionByName(found.select(part, "_piece", "_pos", key, F.col("pin_order").cast("long"), "kind"))
    kind = dict(rows.dtypes)
    changed = map_groups(todo, [part, "_piece"], ["_pos"], each(_replay(part, key)),
                         f"`{part}` {kind[part]}, `{key}` {kind[key]}, _start boolean")
    flagged = join_same(rows, changed, [part, key], "left").withColumn("_start", F.coalesce("_start", first))
    flagged = checkpoint(flagged.select(part, time, key, "is_bracket", "_start"))
    regrouped = ordered_rows(flagged, (part,), (time, key), max_rows).running_last(
        "_named", F.when(F.col("_start"), F.col(key))).result()
    return regrouped.select(part, time, key, F.col("_named").alias(group), "is_bracket")


def _pieces(starts: DataFrame, part: str, max_rows) -> DataFrame:
    """starts with `_piece`: groups whose replays may affect each other share one.

    With a(i) merges in group i, the start of j can be cleared only if for some k >= j the
    groups j to k hold more than k - j of them: if the largest sum of a(i) - 1 over j to k
    is not negative. Sums and their maxima are running ones, from the front and back.
    """
    rows = ordered_rows(starts, (part,), ("_group_no",), max_rows)
    rows = rows.running_sum("_zone", F.col("is_bracket").cast("long")).lag("_before", "is_bracket")
    rows = rows.running_sum("_sum", F.col("_m") - 1).with_columns({"_back": -F.col("_group_no")})
    behind = ordered_rows(rows.result(), (part, "_zone"), ("_back",), max_rows).running_max("_most", F.col("_sum")).result()
    stays = (F.col("is_bracket") | F.col("_before").isNull() | F.col("_before.is_bracket")
             | (F.col("_most") - (F.col("_sum") - F.col("_m") + 1) < 0))
    return ordered_rows(behind.withColumn("_cut", stays.cast("long")), (part,), ("_group_no",), max_rows).running_sum(
        "_piece", F.col("_cut")).result().select(part, "_group_no", "_pos", "is_bracket", starts.columns[4], "_piece")


def _replay(part, key):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place, at = np.unique(pdf["_pos"].to_numpy(), return_inverse=True)
        keys = np.empty(len(place), dtype=object)
        keys[at] = pdf[key].to_numpy()
        order, kind = pdf["pin_order"].to_numpy(dtype=float), pdf["kind"].to_numpy()
        given = np.isnan(order)
        # a piece begins with a start that stays; a bracket is a piece of its own
        before = set(at[given].tolist())
        starts, lowest = OrderedSet(len(place), before), min(before, default=0)
        pins = np.flatnonzero(~given)
        for i in pins[np.argsort(order[pins], kind="stable")]:
            x = int(at[i])
            if kind[i] == "split_before":
                starts.add(x)
                continue
            head = starts.at_or_below(x)
            if head > lowest:
                starts.remove(head)
        touched = [x for x in range(len(place)) if (x in starts) != (x in before)]
        return pd.DataFrame({part: pd.Series([pdf[part].iloc[0]] * len(touched), dtype=pdf[part].dtype),
                             key: pd.Series([keys[x] for x in touched], dtype=pdf[key].dtype),
                             "_start": [x in starts for x in touched]})
    return run


def split_groups(members: DataFrame, edits: DataFrame, *, group: str = "group_id", time: str = "t_ms",
                 key: str = "photo_id", new_group: str = "new_group_id") -> DataFrame:
    """Move the tail of a group, from the named member on, to a new group.

    members: group, time, key, is_bracket. edits: group, at_key, new_group.
    Nothing happens for brackets, foreign members and first members; see
    `check_splits` for the reasons.
    """
    valid = check_splits(members, edits, group=group, time=time, key=key).where("status = 'ok'")
    cut = valid.select(group, "_at", F.col(new_group).alias("_new"))
    rows = members.join(cut, group, "left")
    tail = F.struct(time, key) >= F.col("_at")
    return rows.withColumn(group, F.when(F.col("_new").isNotNull() & tail, F.col("_new"))
                           .otherwise(F.col(group))).drop("_at", "_new")


def check_splits(members: DataFrame, edits: DataFrame, *, group="group_id", time="t_ms",
                 key="photo_id") -> DataFrame:
    info = members.groupBy(group).agg(F.max("is_bracket").alias("_sealed"),
                                      F.min(F.struct(time, key)).alias("_first"))
    at = members.select(F.col(group).alias("_g"), F.col(key).alias("_k"),
                        F.struct(time, key).alias("_at"))
    rows = edits.join(info, group, "left").join(
        at, (F.col(group) == F.col("_g")) & (F.col("at_key") == F.col("_k")), "left")
    status = (F.when(F.col("_first").isNull(), "group_not_found")
              .when(F.col("_sealed"), "bracket_immutable")
              .when(F.col("_at").isNull(), "not_in_group")
              .when(F.col("_at") == F.col("_first"), "no_change").otherwise("ok"))
    return rows.withColumn("status", status).drop("_sealed", "_first", "_g", "_k")


def merge_groups(members: DataFrame, edits: DataFrame, *, group: str = "group_id") -> DataFrame:
    """Put all members of `group` into `target`; brackets are left alone.

    edits: group, target. Targets may not be merged themselves in one call.
    """
    sealed = members.where("is_bracket").select(group).distinct()
    usable = (edits.join(sealed, group, "left_anti")
              .join(sealed.select(F.col(group).alias("target")), "target", "left_anti")
              .join(members.select(F.col(group).alias("target")).distinct(), "target", "left_semi"))
    rows = members.join(usable.select(group, F.col("target").alias("_to")), group, "left")
    return rows.withColumn(group, F.coalesce("_to", group)).drop("_to")


def move_members(members: DataFrame, edits: DataFrame, *, group: str = "group_id",
                 key: str = "photo_id") -> DataFrame:
    """Move single members to another group; a group left empty disappears.

    edits: group, key, target. Moves from or to brackets, of foreign members or
    to unknown groups are ignored.
    """
    sealed = members.where("is_bracket").select(group).distinct()
    usable = (edits.join(sealed.select(F.col(group).alias("target")), "target", "left_anti")
              .join(members.select(F.col(group).alias("target")).distinct(), "target", "left_semi"))
    rows = members.join(usable.select(group, key, F.col("target").alias("_to")), [group, key], "left")
    target = F.when(~F.col("is_bracket"), F.col("_to"))
    return rows.withColumn(group, F.coalesce(target, F.col(group))).drop("_to")
