"""Shot groups: a new group at any boundary between neighbours, or when a frame
has drifted too far from the first frame of its group.

Everything but the drift rule depends on the previous frame only and is a
window expression. It cuts the sequence into segments; the drift rule can only
split further inside a segment, which is one ordered pass over unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.vectors import cosine_distance
from ..runtime import checkpoint, join_same, small
from .local import stack
from .ordered import OrderedRows, ordered_rows
from .segments import capture_steps, mark_brackets


def shot_gap(profile: Column) -> Column:
    out = F.when(profile.isNull(), F.lit(P.SHOT_GAP_MS_OTHER))
    for name, gap in P.SHOT_GAP_MS.items():
        out = out.when(profile == name, F.lit(gap))
    return out.otherwise(F.lit(P.SHOT_GAP_MS_OTHER))


def neighbour_boundary(profile: Column, limits: P.ShotThresholds, *, faces="face_count",
                       faceprint: str | None = None, pose: str | None = None,
                       distance=cosine_distance) -> Column:
    """All boundary rules that look at the previous frame only."""
    rule = ((F.col("gap_ms") > shot_gap(profile)) | (F.col("step_dist") > limits.step)
            | ((F.col(faces) != F.col(f"prev.{faces}"))
               & (F.col("step_dist") > limits.corroboration)))
    if faceprint:
        rule |= _moved(faceprint, limits.face, distance)
    if pose:
        rule |= (profile == "portrait") & _moved(pose, limits.pose, distance)
    return F.coalesce(rule, F.lit(False))


def _moved(column: str, limit: float, distance) -> Column:
    before, now = F.col(f"prev.{column}"), F.col(column)
    return before.isNotNull() & now.isNotNull() & (distance(before, now) > limit)


def shot_segments(df: DataFrame, *, part="shoot_id", time="t_ms", key="photo_id", vec="vec",
                  bias="bias", faces="face_count", profile: Column | None = None,
                  faceprint=None, pose=None, limits=P.DEFAULT_SHOT,
                  distance=cosine_distance, context: str | None = None,
                  max_rows=None) -> OrderedRows:
    """Neighbour boundaries and bracket edges; adds `run`, `bracket`, `boundary`.

    `context` names a column that marks rows known from earlier work: "anchor"
    starts a shot, "inside" continues it, "sealed" was in a bracket; NULL for
    all other rows.
    """
    return _segments(df, {"boundary": limits}, part=part, time=time, key=key, vec=vec, bias=bias, faces=faces,
                     profile=profile, faceprint=faceprint, pose=pose, distance=distance, context=context, max_rows=max_rows)


def _segments(df: DataFrame, sets: dict[str, P.ShotThresholds], *, part, time, key, vec, bias="bias", faces="face_count",
              profile=None, faceprint=None, pose=None, distance=cosine_distance, context=None, max_rows=None) -> OrderedRows:
    """`run`, `bracket` and a boundary column by the name of each threshold set; steps and
    brackets are the same for all of them."""
    profile = F.col("profile") if profile is None else profile
    extra = [bias, faces, *[c for c in (faceprint, pose) if c]]
    steps = capture_steps(df, part=part, time=time, key=key, vec=vec, extra=extra,
                          distance=distance, max_rows=max_rows)
    rules = {f"_rule_{name}": neighbour_boundary(profile, limits, faces=faces, faceprint=faceprint, pose=pose, distance=distance)
             for name, limits in sets.items()}
    marked = mark_brackets(steps.with_columns(rules), part=part, time=time,
                           key=key, bias=bias)
    if context:
        marked = marked.with_columns({"bracket": F.when(F.col(context) == "sealed", F.lit(-1))
                                      .when(F.col(context).isNull(), F.col("bracket"))})
    marked = marked.lag("_before", "bracket")
    sealed = F.col("bracket").isNotNull()
    edge = ~F.col("bracket").eqNullSafe(F.col("_before.bracket"))
    boundaries = {name: F.col("_before").isNull() | edge | (~sealed & F.col(f"_rule_{name}")) for name in sets}
    if context:
        boundaries = {name: F.when(F.col(context) == "inside", False).when(F.col(context).isNotNull(), True).otherwise(boundary)
                      for name, boundary in boundaries.items()}
    return marked.with_columns(boundaries)


def group_shots(df: DataFrame, *, part="shoot_id", time="t_ms", key="photo_id", vec="vec",
                limits=P.DEFAULT_SHOT, max_rows=None, **kwargs) -> DataFrame:
    """(part, key, time, is_bracket, shot_id); a shot is named by its first key."""
    rows = shot_segments(df, part=part, time=time, key=key, vec=vec, limits=limits,
                         max_rows=max_rows, **kwargs)
    rows = rows.select(part, time, key, vec, "boundary",
                       F.col("bracket").isNotNull().alias("is_bracket"))
    return fold_drift(rows, part=part, time=time, key=key, vec=vec, limit=limits.anchor)


def fold_drift(rows: OrderedRows, *, part, time, key, vec, limit: float) -> DataFrame:
    """Apply the drift rule inside the segments marked by `boundary`."""
    fold = _DriftFold(rows.keys, key, vec, limit)
    fields = {f.name: f for f in rows.df.schema.fields}
    kept = [*dict.fromkeys([*rows.keys, key, time])]
    schema = T.StructType([*[fields[c] for c in kept],
                           T.StructField("is_bracket", T.BooleanType()),
                           T.StructField("shot_id", fields[key].dataType)])
    order = [*rows.keys, time, key]
    if not rows.chunks:
        # The window before has placed each key in one partition already.
        return rows.df.sortWithinPartitions(*order).mapInPandas(fold, schema)
    return _fold_chunks(rows, fold, schema, order, part, time, key, vec)


def _fold_chunks(rows, fold, schema, order, part, time, key, vec) -> DataFrame:
    """The fold when a key spans several ranges.

    A range is folded from its first boundary on; rows before it belong to a
    segment that began earlier and come out with no shot. They are folded once
    the last row of the range before has its shot, starting from that one: at
    once, unless a range has no boundary at all.
    """
    keys = list(rows.keys)
    source = checkpoint(rows.df)
    vectors = source.select(part, F.col(key).alias("_anchor_id"), F.col(vec).alias("_anchor"))
    folded = checkpoint(source.repartition(*keys).sortWithinPartitions(*order)
                        .mapInPandas(fold, schema))
    done = folded.where("shot_id IS NOT NULL")
    waiting = folded.where("shot_id IS NULL").select(part, "_chunk", key)
    while not waiting.isEmpty():
        open_chunks = waiting.select(part, "_chunk").distinct()
        ends = done.groupBy(part, "_chunk").agg(
            F.max_by("shot_id", F.struct(time, key)).alias("_anchor_id"),
            F.max_by(key, F.struct(time, key)).alias("_last_id"))
        ready = (ends.withColumn("_chunk", F.col("_chunk") + 1)
                 .join(open_chunks, [part, "_chunk"])
                 .withColumn("_fresh", F.col("_anchor_id") == F.col("_last_id")).drop("_last_id"))
        ready = checkpoint(ready)  # at most one row per range
        ready = checkpoint(vectors.join(small(ready, rows.chunks), [part, "_anchor_id"]))
        todo = (source.join(waiting, [part, "_chunk", key], "left_semi")
                .join(small(ready, rows.chunks), [part, "_chunk"]))
        solved = checkpoint(todo.repartition(*keys).sortWithinPartitions(*order)
                            .mapInPandas(fold, schema))
        done = done.unionByName(solved)
        waiting = checkpoint(waiting.join(ready.select(part, "_chunk"),
                                          [part, "_chunk"], "left_anti"))
    return done.drop("_chunk")


class _DriftFold:
    """Streams sorted batches; keeps only the anchor between batches."""

    def __init__(self, keys, key, vec, limit):
        self.keys, self.key, self.vec, self.limit = list(keys), key, vec, limit

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = anchor_id = raw = None
        fresh = False  # the next row directly follows the anchor
        for batch in batches:
            if batch.empty:
                continue
            vectors = batch[self.vec].tolist()
            given = "_anchor_id" in batch
            # the anchor of the batch before, the rows, and anchors handed in
            units = stack([raw, *vectors, *(batch["_anchor"].tolist() if given else [])])
            anchor, units, handed = units[0], units[1:len(batch) + 1], units[len(batch) + 1:]
            ids = batch[self.key].to_numpy()
            sealed = batch["is_bracket"].to_numpy()
            starts = batch["boundary"].to_numpy()
            group_keys = list(zip(*[batch[k] for k in self.keys]))
            shots = np.empty(len(batch), dtype=object)
            for i in range(len(batch)):
                if group_keys[i] != group:
                    group, anchor_id = group_keys[i], None
                    if not starts[i] and given:
                        anchor_id, anchor = batch["_anchor_id"].iat[i], handed[i]
                        raw, fresh = batch["_anchor"].iat[i], bool(batch["_fresh"].iat[i])
                if starts[i] or (anchor_id is not None and not sealed[i] and not fresh
                                 and _drifted(anchor, units[i], self.limit)):
                    anchor_id, anchor, raw, fresh = ids[i], units[i], vectors[i], True
                else:
                    fresh = False
                shots[i] = anchor_id
            kept = {k: batch[k] for k in [*self.keys, self.key]}
            out = batch[[c for c in batch.columns
                         if c not in (self.vec, "boundary", "_anchor", "_anchor_id", "_fresh")]]
            yield out.assign(**kept, shot_id=pd.Series(shots, index=batch.index))

def sweep_boundaries(df: DataFrame, sets: dict[str, P.ShotThresholds], reference: str, *,
                     profile: Column | None = None, faces="face_count", max_rows=None,
                     **columns) -> DataFrame:
    """Neighbour boundaries under several threshold sets in one pass.

    Per set: segments and agreement with the boundaries of `reference`.
    Each set is one boolean per row, so rows are not multiplied by the sets.
    """
    profile = F.col("profile") if profile is None else profile
    steps = capture_steps(df, extra=[faces], max_rows=max_rows, **columns)
    marks = {name: F.col("prev").isNull() | neighbour_boundary(profile, limits, faces=faces)
             for name, limits in sets.items()}
    rows = steps.df.select(*[mark.alias(name) for name, mark in marks.items()])
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(s).cast("long")).alias(f"{s}_segments") for s in sets],
        *[F.sum((F.col(s) == F.col(reference)).cast("long")).alias(f"{s}_same") for s in sets])
    per_set = F.array(*[F.struct(
        F.lit(s).alias("param_id"), F.col(f"{s}_segments").alias("segments"),
        F.round(F.col(f"{s}_same") / F.col("n"), 6).alias("agreement")) for s in sets])
    return sums.select(F.inline(per_set))


def shot_sweep(df: DataFrame, sets: dict[str, P.ShotThresholds], reference: str,
               *, part="shoot_id", key="photo_id", time="t_ms", vec="vec", max_rows=None, **kwargs) -> DataFrame:
    """Full shot grouping per threshold set: groups, singletons, agreement.

    One pass for all sets: steps and brackets are shared, and the ordered walk keeps an
    anchor per set. A row carries its starts as one boolean per set.
    """
    rows = _segments(df, {f"_b_{name}": limits for name, limits in sets.items()}, part=part, time=time, key=key, vec=vec, max_rows=max_rows, **kwargs)
    names = list(sets)
    rows = rows.select(part, time, key, vec, *[f"_b_{name}" for name in names], F.col("bracket").isNotNull().alias("is_bracket"))
    if rows.chunks:
        starts = _sweep_ranges(rows, sets, part=part, time=time, key=key, vec=vec)
    else:
        fields = {f.name: f for f in rows.df.schema.fields}
        schema = T.StructType([fields[part], *[T.StructField(f"_s_{name}", T.BooleanType()) for name in names]])
        fold = _SweepFold(part, vec, {name: limits.anchor for name, limits in sets.items()})
        # the window before has placed each key in one partition already
        starts = rows.df.sortWithinPartitions(part, time, key).mapInPandas(fold, schema)
    return _sweep_report(checkpoint(_sizes(starts, part, names, reference)), names)


def _sweep_ranges(rows: OrderedRows, sets, *, part, time, key, vec) -> DataFrame:
    """The starts where a key spans several ranges: a walk per set over the rows written once."""
    rows = OrderedRows(checkpoint(rows.df), rows.part, rows.order, rows.chunks)
    starts = rows.df.select(part, key, time)
    for name, limits in sets.items():
        one = rows.select(part, time, key, vec, F.col(f"_b_{name}").alias("boundary"), "is_bracket")
        shots = fold_drift(one, part=part, time=time, key=key, vec=vec, limit=limits.anchor)
        starts = join_same(starts, shots.select(part, key, (F.col("shot_id") == F.col(key)).alias(f"_s_{name}")), [part, key])
    order = ordered_rows(starts, (part,), (time, key))
    for name in sets:
        order = order.running_sum(f"_g_{name}", F.col(f"_s_{name}").cast("long"))
    return order.result()


def _sizes(starts: DataFrame, part: str, names, reference: str) -> DataFrame:
    """(name, part, group, n, same) of every group of every set; `same` counts its rows that
    agree with the reference on being a start or not."""
    numbered = starts if f"_g_{names[0]}" in starts.columns else None
    if numbered is None:
        # one partition holds all of a key in order, so a running count needs no sort
        fields = {f.name: f for f in starts.schema.fields}
        schema = T.StructType([*starts.schema.fields, *[T.StructField(f"_g_{name}", T.LongType()) for name in names]])

        def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before, last = dict.fromkeys(names, 0), None
            for batch in batches:
                for name in names:
                    batch[f"_g_{name}"] = before[name] + batch[f"_s_{name}"].astype("int64").cumsum()
                    if len(batch):
                        before[name] = int(batch[f"_g_{name}"].iloc[-1])
                yield batch
        numbered = starts.mapInPandas(number, schema).withColumn("_task", F.spark_partition_id())
    else:
        numbered = numbered.withColumn("_task", F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_g_{name}").alias("group"),
                                        (F.col(f"_s_{name}") == F.col(f"_s_{reference}")).cast("long").alias("same")) for name in names]))
    rows = numbered.select(part, "_task", each.alias("e"))
    return rows.groupBy("e.name", part, "_task", "e.group").agg(F.count(F.lit(1)).alias("n"), F.sum("e.same").alias("same"))


def _sweep_report(groups: DataFrame, names) -> DataFrame:
    return groups.groupBy(F.col("name").alias("param_id")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"),
        F.round(F.sum("same") / F.sum("n"), 6).alias("agreement"))


class _SweepFold:
    """Streams sorted batches; keeps one anchor per threshold set between batches."""

    def __init__(self, part: str, vec: str, limits: dict[str, float]):
        self.part, self.vec, self.limits = part, vec, limits

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(self.limits)
        raw: dict = dict.fromkeys(names)
        fresh = dict.fromkeys(names, False)
        for batch in batches:
            if batch.empty:
                continue
            units = stack([*(raw[n] for n in names), *batch[self.vec].tolist()])
            anchors, units = dict(zip(names, units)), units[len(names):]
            sealed = batch["is_bracket"].to_numpy()
            vectors = batch[self.vec].tolist()
            out = {self.part: batch[self.part]}
            # a row without a row before it in its key starts a group by its boundary already
            for name in names:
                starts, limit = batch[f"_b_{name}"].to_numpy(), self.limits[name]
                begun = np.zeros(len(batch), dtype=bool)
                anchor, near, kept = anchors[name], fresh[name], raw[name]
                for i in range(len(batch)):
                    if starts[i] or (not sealed[i] and not near and _drifted(anchor, units[i], limit)):
                        begun[i], anchor, kept, near = True, units[i], vectors[i], True
                    else:
                        near = False
                raw[name], fresh[name] = kept, near
                out[f"_s_{name}"] = begun
            yield pd.DataFrame(out)


def _drifted(anchor, unit, limit: float) -> bool:
    cosine = float(anchor @ unit)
    return (1.0 if np.isnan(cosine) else 1.0 - cosine) > limit
