"""Shot groups on a stream of captures, with state per shoot.

Rows of the last run of a shoot can still become a bracket, so they wait until a later
frame closes the run or repeats a bias, which no bracket does; everything before is
final. A shoot's state is the waiting run, the frame before it and the first frame of
that frame's shot. Event time closes shoots that have ended and drops their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from .keyed import in_order, plain, use_state_store

ROW_SCHEMA = T.StructType([
    T.StructField("shoot_id", T.LongType()), T.StructField("photo_id", T.LongType()),
    T.StructField("t_ms", T.LongType()), T.StructField("profile", T.StringType()),
    T.StructField("bias", T.DoubleType()), T.StructField("face_count", T.LongType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
    T.StructField("faceprint", T.ArrayType(T.FloatType())), T.StructField("pose", T.ArrayType(T.FloatType()))])
FRAME = T.StructType(ROW_SCHEMA.fields[1:])
OPEN = T.StructType([T.StructField("sealed", T.BooleanType()), T.StructField("broken", T.BooleanType()),
                     T.StructField("anchor_id", T.LongType()), T.StructField("anchor", T.ArrayType(T.FloatType())),
                     T.StructField("timer", T.LongType()), *FRAME.fields])
OUT = T.StructType([T.StructField("shoot_id", T.LongType()), T.StructField("photo_id", T.LongType()),
                    T.StructField("t_ms", T.LongType()), T.StructField("is_bracket", T.BooleanType()),
                    T.StructField("shot_id", T.LongType()), T.StructField("late", T.BooleanType())])
NAMES = FRAME.fieldNames()
#: A shoot without a frame for so long has ended; longer than any gap within a shot.
IDLE_MS = 60_000


def distance(a, b) -> float:
    """1 - cosine; an unknown vector is maximally distant."""
    if a is None or b is None or len(a) != len(b):
        return 1.0
    x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return 1.0 - float(x @ y) / norm if norm > 0 else 1.0


class Shoot:
    """One shoot's walk through its frames in order: what the batch rules say, frame by frame.

    before: the last frame whose shot is known; sealed: it was in a bracket; anchor_id and
    anchor: the first frame of its shot; run: frames that may still form a bracket with
    the next one; broken: the open run can't, as a bias came twice.
    """

    def __init__(self, limits: P.ShotThresholds) -> None:
        self.limits = limits
        self.before: dict | None = None
        self.sealed = self.broken = False
        self.anchor_id = self.anchor = None
        self.run: list[dict] = []

    def last(self) -> dict | None:
        return self.run[-1] if self.run else self.before

    def add(self, frame: dict) -> Iterator[tuple]:
        """Take the next frame; gives (photo_id, t_ms, is_bracket, shot_id) of all that are final."""
        last = self.last()
        linked = (last is not None and None not in (frame["bias"], last["bias"]) and frame["bias"] != last["bias"]
                  and frame["t_ms"] - last["t_ms"] <= P.BRACKET_GAP_MS and distance(last["vec"], frame["vec"]) <= P.BRACKET_DIST)
        if not linked:
            yield from self.settle()
        if linked and (self.broken or any(f["bias"] == frame["bias"] for f in self.run)):
            yield from self.walk(self.run)
            self.broken, self.run = True, []
            yield from self.walk([frame])
        else:
            self.run.append(frame)

    def settle(self) -> Iterator[tuple]:
        """Decide the open run."""
        bias = [f["bias"] for f in self.run]
        if len(bias) >= P.BRACKET_MIN_FRAMES and min(bias) < 0 < max(bias) and abs(min(bias) + max(bias)) <= P.BRACKET_SYMMETRY:
            for frame in self.run:
                yield frame["photo_id"], frame["t_ms"], True, self.run[0]["photo_id"]
            self.before, self.sealed, self.anchor_id, self.anchor = self.run[-1], True, None, None
        else:
            yield from self.walk(self.run)
        self.broken, self.run = False, []

    def walk(self, frames: list[dict]) -> Iterator[tuple]:
        for frame in frames:
            if self.before is None or self.sealed or self.starts(frame):
                self.anchor_id, self.anchor = frame["photo_id"], frame["vec"]
            self.before, self.sealed = frame, False
            yield frame["photo_id"], frame["t_ms"], False, self.anchor_id

    def starts(self, frame: dict) -> bool:
        """A boundary between neighbours, or drift from the first frame of the shot."""
        before, limits = self.before, self.limits
        step = distance(before["vec"], frame["vec"])
        if frame["t_ms"] - before["t_ms"] > P.SHOT_GAP_MS.get(frame["profile"], P.SHOT_GAP_MS_OTHER) or step > limits.step:
            return True
        if self.anchor_id != before["photo_id"] and distance(self.anchor, frame["vec"]) > limits.anchor:
            return True
        if None not in (before["face_count"], frame["face_count"]) and before["face_count"] != frame["face_count"] and step > limits.corroboration:
            return True

        def moved(name: str, limit: float) -> bool:
            return before[name] is not None and frame[name] is not None and distance(before[name], frame[name]) > limit
        return moved("faceprint", limits.face) or (frame["profile"] == "portrait" and moved("pose", limits.pose))


class ShotProcessor(StatefulProcessor):
    """Keeps a `Shoot` per key in the state store, and a timer for its end."""

    def __init__(self, limits: P.ShotThresholds, idle_ms: int) -> None:
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.run = handle.getListState("run", FRAME)

    def _load(self) -> Shoot:
        shoot = Shoot(self.limits)
        if self.open.exists():
            kept = dict(zip(OPEN.fieldNames(), self.open.get(), strict=True))
            shoot.sealed, shoot.broken, shoot.anchor_id, shoot.anchor = (kept[c] for c in ("sealed", "broken", "anchor_id", "anchor"))
            self.timer = kept["timer"]
            shoot.before = {c: plain(kept[c]) for c in NAMES} if kept["photo_id"] is not None else None
            shoot.run = [dict(zip(NAMES, map(plain, row), strict=True)) for row in self.run.get()]
        else:
            self.timer = None
        return shoot

    def _keep(self, shoot: Shoot) -> None:
        last = shoot.last()
        if last is None:
            return
        ends = last["t_ms"] + self.idle_ms
        if ends != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(ends)
        before = shoot.before or dict.fromkeys(NAMES)
        self.open.update((shoot.sealed, shoot.broken, shoot.anchor_id, shoot.anchor, ends, *[before[c] for c in NAMES]))
        if shoot.run:
            self.run.put([tuple(f[c] for c in NAMES) for f in shoot.run])
        else:
            self.run.clear()

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        types = ["Int64", "Int64", "boolean", "Int64", "boolean"]
        out = {n: pd.array(c, dtype=t) for n, c, t in zip(OUT.fieldNames()[1:], columns, types, strict=True)}
        return pd.DataFrame({"shoot_id": pd.array([plain(key[0])] * len(found), dtype="Int64"), **out})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shoot, found = self._load(), []
        ended = timerValues.getCurrentWatermarkInMs()
        frames = in_order(rows, ["t_ms", "photo_id"])
        for values in zip(*(frames[c] for c in NAMES), strict=True) if len(frames) else ():
            frame = dict(zip(NAMES, map(plain, values), strict=True))
            frame["photo_id"], frame["t_ms"] = int(frame["photo_id"]), int(frame["t_ms"])
            last = shoot.last()
            late = (frame["t_ms"], frame["photo_id"]) <= (last["t_ms"], last["photo_id"]) if last else frame["t_ms"] < ended
            if late:
                found.append((frame["photo_id"], frame["t_ms"], None, None, True))
            else:
                found += [(*final, False) for final in shoot.add(frame)]
        self._keep(shoot)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(*final, False) for final in self._load().settle()]
        self.open.clear()
        self.run.clear()
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def stream_shots(frames: DataFrame, *, limits: P.ShotThresholds = P.DEFAULT_SHOT, late: str = "10 seconds",
                 idle_ms: int = IDLE_MS) -> DataFrame:
    """shoot_id, photo_id, t_ms, is_bracket, shot_id, late: frames (ROW_SCHEMA) as soon as
    their shot is known, equal to the batch grouping with the same rules.

    A frame not newer than one of its shoot that came in an earlier micro-batch is given
    as `late`, without a shot; within a micro-batch frames are put in order. `late` is the
    watermark's delay. When it has passed a shoot's last frame by `idle_ms` (longer than
    any gap inside a shot), the open run is decided and the shoot's state dropped; frames
    of a dropped shoot older than the watermark are late, newer ones begin a new shot as
    in batch. A row without photo_id only moves the event time on; rows without t_ms are
    left out. The state of a shoot is bounded: a run waits while its biases differ.
    """
    if idle_ms <= max(P.SHOT_GAP_MS.values()):
        raise ValueError("idle_ms must be longer than the gaps inside shots")
    use_state_store(frames.sparkSession)
    names = ROW_SCHEMA.fieldNames()
    given = frames.select(*[(F.col(c) if c in frames.columns else F.lit(None)).cast(ROW_SCHEMA[c].dataType).alias(c) for c in names])
    # the event time itself isn't handed on, as Spark would drop late rows unseen
    timed = given.where("t_ms IS NOT NULL").withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", late).select(*names)
    return timed.groupBy("shoot_id").transformWithStateInPandas(ShotProcessor(limits, idle_ms), OUT, "Append", "EventTime")
