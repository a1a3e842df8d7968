"""Track lifecycle with an overlap veto, in batches and as a stateful stream (L3).

With the veto a strong box is no birth while it overlaps a living track, so what a slot becomes depends on all
slots of the scene in order; without it ``jobs.track_lifecycle`` needs running counts only.  Either way here a scene is
read in the order of its frames and only its living tracks are held: a batch streams sorted rows through
each task, and the stream keeps the same few numbers as state of the scene.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.functions.geom import PI

BIRTH, WEAK, TOLERANCE = 0.5, 0.4, 5
OUT = "scene_token string, slot long, frame_idx long, track_id long, misses long, late boolean"
RESULT = ["scene_token", "slot", "frame_idx", "track_id", "misses", "late"]
#: Of a group of scenes: one entry of each array is a scene.
_STATE = ("groups long, scenes array<string>, until array<long>, born array<long>, last array<long>, "
          "slots array<array<long>>, ids array<array<long>>, misses array<array<long>>")


def axis_sides(x: Column, y: Column, length: Column, width: Column, yaw: Column) -> list[Column]:
    """x0, x1, y0, y1 of the box turned to its nearest axis."""
    turn = F.abs(yaw - F.floor(yaw / PI + 0.5) * PI)
    across = turn > PI / 4
    dx, dy = F.when(across, width).otherwise(length) / 2, F.when(across, length).otherwise(width) / 2
    return [(x - dx).alias("x0"), (x + dx).alias("x1"), (y - dy).alias("y0"), (y + dy).alias("y1")]


def with_sides(detections: DataFrame) -> DataFrame:
    """scene_token, frame_idx, slot, score and the four sides of every box."""
    d = detections
    return d.select("scene_token", "frame_idx", F.col("det_pos").alias("slot"), "score",
                    *axis_sides(d["x"], d["y"], d["l"], d["w"], d["yaw"]))


def overlap(a, b) -> float:
    """IoU of two boxes given as x0, x1, y0, y1."""
    wide, high = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
    if not (wide > 0 and high > 0):
        return 0.0
    inter = wide * high
    whole = (a[1] - a[0]) * (a[3] - a[2]) + (b[1] - b[0]) * (b[3] - b[2]) - inter
    return inter / whole if whole > 0 else 0.0


@dataclass
class Tracks:
    """Living tracks of one scene: slot -> [id, misses]."""

    limit: float | None
    birth: float = BIRTH
    weak: float = WEAK
    tolerance: int = TOLERANCE
    living: dict = field(default_factory=dict)
    born: int = 0
    last: int = -1

    def frame(self, number: int, rows: list[tuple]) -> Iterator[tuple]:
        """(slot, track_id, misses, late) of the rows (slot, score, x0, x1, y0, y1) that belong to a track.

        A frame at or before the last one read comes too late: its rows are given back without a track.
        """
        if number <= self.last:
            yield from ((r[0], None, None, True) for r in rows)
            return
        self.last = number
        rows, boxes = sorted(rows), None
        for row in rows:
            slot, score = row[:2]
            track = self.living.get(slot)
            if track is None:
                if score < self.birth:
                    continue
                boxes = boxes or {r[0]: r[2:] for r in rows}
                if self.vetoed(slot, row[2:], boxes):
                    continue
                track = self.living[slot] = [self.born, 0]
                self.born += 1
            elif score >= self.birth:
                track[1] = 0
            elif score < self.weak:
                track[1] += 1
                if track[1] >= self.tolerance:
                    del self.living[slot]
                    continue
            yield slot, track[0], track[1], False

    def vetoed(self, slot: int, box, boxes: dict) -> bool:
        """Whether a living track that has a box in this frame overlaps by more than the limit."""
        return self.limit is not None and any(s in self.living and s != slot and overlap(box, other) > self.limit for s, other in boxes.items())


def _frames(rows: Iterable[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal (scene, frame) in sorted rows."""
    key, held = None, []
    for scene, number, *rest in rows:
        if (scene, number) != key:
            if held:
                yield key, held
            key, held = (scene, number), []
        held.append(tuple(rest))
    if held:
        yield key, held


COLUMNS = ["scene_token", "frame_idx", "slot", "score", "x0", "x1", "y0", "y1"]


def tracked(boxes: DataFrame, limit: float | None, **how) -> DataFrame:
    """Rows of living tracks in a finished table of ``with_sides`` rows; ``limit``: IoU above which a birth is vetoed.

    A scene is one sequence; its rows pass through one task in order, which holds one frame and the living tracks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in COLUMNS])

        scene, tracks, out = None, None, []
        for (name, number), held in _frames(rows()):
            if name != scene:
                scene, tracks = name, Tracks(limit, **how)
            out += [(name, slot, number, track, misses, late) for slot, track, misses, late in tracks.frame(number, held)]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ordered = boxes.select(*COLUMNS).repartition("scene_token").sortWithinPartitions("scene_token", "frame_idx", "slot")
    return ordered.mapInArrow(run, OUT).drop("late")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RESULT)


class GroupTracker:
    """Keeps the living tracks of a group of scenes between micro-batches and forgets scenes that have been silent.

    Calling Python, frames of pandas and state cost about as much for one scene as for a hundred, so scenes share them.
    """

    def __init__(self, limit: float | None, silence_ms: int, groups: int, how: dict):
        self.limit, self.silence_ms, self.groups, self.how = limit, silence_ms, groups, how

    def __call__(self, key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = self.restored(state)
        given = {} if state.hasTimedOut else self.by_scene(pieces)
        out = []
        for scene, (at, rows) in given.items():
            tracks = kept[scene][1] if scene in kept else Tracks(self.limit, **self.how)
            for number, held in groupby(sorted(rows), itemgetter(0)):
                out += [(scene, slot, number, track, misses, late) for slot, track, misses, late in tracks.frame(number, [r[1:] for r in held])]
            kept[scene] = int(at) + self.silence_ms, tracks
        # only now: a scene that comes again goes on, as its time was not up at the last micro-batch
        now = state.getCurrentWatermarkMs()
        self.store({scene: v for scene, v in kept.items() if v[0] >= now}, state)
        if out:
            columns = dict(zip(RESULT, zip(*out)))
            if any(columns["late"]):  # such a row has no track
                columns |= {c: pd.array(columns[c], "Int64") for c in ("track_id", "misses")}
            yield pd.DataFrame(columns)

    def by_scene(self, pieces: Iterator[pd.DataFrame]) -> dict:
        """scene -> [last event time in ms, rows (frame_idx, slot, score, sides)]."""
        scenes: dict = {}
        for piece in pieces:
            rows = zip(*[piece[c].tolist() for c in COLUMNS[1:]])
            for scene, at, row in zip(piece["scene_token"].tolist(), piece["at_ms"].tolist(), rows):
                held = scenes.get(scene) or scenes.setdefault(scene, [float("-inf"), []])
                held[0] = max(held[0], at)
                held[1].append(row)
        return scenes

    def restored(self, state: GroupState) -> dict:
        """scene -> (time in ms when it is forgotten, its tracks)."""
        if not state.exists:
            return {}
        groups, *scenes = state.get
        if groups != self.groups:
            raise ValueError(f"the checkpoint holds {groups} groups of scenes, not {self.groups}")
        return {name: (until, Tracks(self.limit, **self.how, born=born, last=last, living={s: [i, m] for s, i, m in zip(slots, ids, misses)}))
                for name, until, born, last, slots, ids, misses in zip(*scenes)}

    def store(self, kept: dict, state: GroupState) -> None:
        if not kept:
            state.remove()
            return
        columns = zip(*[(name, until, t.born, t.last, list(t.living), [v[0] for v in t.living.values()], [v[1] for v in t.living.values()])
                        for name, (until, t) in kept.items()])
        state.update((self.groups, *map(list, columns)))
        state.setTimeoutTimestamp(min(until for until, _ in kept.values()))


def track_stream(stream: DataFrame, limit: float | None, late: str = "1 hour", silence_ms: int = 86_400_000, groups: int = 1024, **how) -> DataFrame:
    """The lifecycle over a stream of ``with_sides`` rows with their event time ``at``.

    A frame arrives whole and after the frames before it; one that does not is given back with ``late`` true and without a
    track.  A scene that is silent for ``silence_ms`` of event time is forgotten: the next frame starts it anew.
    Scenes are dealt by hash to ``groups`` groups, which keep their tracks together: a task holds the new rows of one
    group, so some 50 to 100 living scenes for each group are a good number.  It stays as it is for a checkpoint.
    """
    spaced = stream.withColumns({"at_ms": F.unix_millis("at"), "scenes": F.pmod(F.xxhash64("scene_token"), F.lit(groups))}).withWatermark("at", late)
    step = GroupTracker(limit, silence_ms, groups, how)
    return spaced.groupBy("scenes").applyInPandasWithState(
        lambda key, pieces, state: step(key, pieces, state), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_tracker(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is available to Parquet; the state, kept in RocksDB, and the output go on from the checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start(out).awaitTermination())
    finally:
        spark.conf.set(key, before)
