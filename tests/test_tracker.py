"""Overlap veto of the track lifecycle: batch and stream against a plain loop over frames."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kerbside.streaming import jobs, tracker

SCHEMA = "scene_token string, frame_idx long, slot long, score double, x0 double, x1 double, y0 double, y1 double"


def given(seed, frames=30):
    rng = random.Random(seed)
    rows = []
    for s in range(4):
        for f in range(frames):
            for slot in range(6):
                if rng.random() < 0.8:
                    x, y = rng.choice([0, 1, 3]) + slot % 2, rng.choice([0, 1, 2])
                    rows.append((f"s{s}", f, slot, rng.choice([0.1, 0.39, 0.4, 0.45, 0.5, 0.9]), float(x), x + 2.0, float(y), y + 2.0))
    rng.shuffle(rows)
    return rows


def plain(rows, limit):
    """All boxes of a frame at once, with id -1 for no track, as an online tracker keeps them."""
    out = []
    for scene in {r[0] for r in rows}:
        ids, misses, born = {}, {}, 0
        for f in sorted({r[1] for r in rows if r[0] == scene}):
            now = sorted(r[2:] for r in rows if r[:2] == (scene, f))
            for slot, score, *_ in now:
                if score >= 0.5:
                    misses[slot] = 0
            for slot, score, x0, x1, y0, y1 in now:
                if ids.get(slot, -1) < 0 and score >= 0.5:
                    worst = 0
                    for other, _, a0, a1, b0, b1 in now:
                        if ids.get(other, -1) >= 0:
                            inter = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0))
                            worst = max(worst, inter / ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - inter))
                    if limit is None or worst <= limit:
                        ids[slot], born = born, born + 1
                elif ids.get(slot, -1) >= 0 and score < 0.4:
                    misses[slot] += 1
                    if misses[slot] >= 5:
                        ids[slot] = -1
            out += [(scene, slot, f, ids[slot], misses[slot]) for slot, *_ in now if ids.get(slot, -1) >= 0]
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 0.0, 0.2, 0.5])
def test_batch_equals_plain_loop(spark, limit):
    rows = given(7)
    got = tracker.tracked(spark.createDataFrame(rows, SCHEMA).repartition(3), limit).collect()
    assert sorted((r.scene_token, r.slot, r.frame_idx, r.track_id, r.misses) for r in got) == plain(rows, limit)


def test_without_veto_the_running_counts_agree(spark):
    boxes = spark.createDataFrame(given(8), SCHEMA)
    counts = jobs.track_lifecycle(boxes.select("scene_token", "slot", "frame_idx", "score"), chunk=4)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, tracker.tracked(boxes, None).collect()))


def test_stream_goes_on_after_restarts_and_marks_late_frames(spark, tmp_path):
    rows = given(9)
    boxes = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("frame_idx")))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for n, (low, high) in enumerate([(0, 9), (10, 10), (11, 24), (25, 29)]):
        boxes.where(F.col("frame_idx").between(low, high)).write.parquet(f"{tmp_path}/in/{n}")
        for _ in range(2 if n == 1 else 1):  # a start without new rows changes nothing
            stream = tracker.track_stream(jobs.read_stream(spark, f"{tmp_path}/in", boxes.schema), 0.2)
            tracker.run_tracker(spark, stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out")
    assert sorted((r.scene_token, r.slot, r.frame_idx, r.track_id, r.misses) for r in got.where("not late").collect()) == plain(rows, 0.2)
    # a frame that comes again, or too late, is named and moves no track
    boxes.where("frame_idx = 3").write.parquet(f"{tmp_path}/in/late")
    tracker.run_tracker(spark, tracker.track_stream(jobs.read_stream(spark, f"{tmp_path}/in", boxes.schema), 0.2), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    late = spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out").where("late").collect()
    assert len(late) == sum(r[1] == 3 for r in rows) and all(r.track_id is None for r in late)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_scene_is_forgotten_after_silence(spark, tmp_path):
    day = 86_400
    rows = [("s", 0, 1, 0.9, 0.0, 1.0, 0.0, 1.0, 0), ("t", 0, 1, 0.9, 0.0, 1.0, 0.0, 1.0, 10 * day), ("t", 1, 1, 0.9, 0.0, 1.0, 0.0, 1.0, 20 * day),
            ("s", 0, 2, 0.9, 0.0, 1.0, 0.0, 1.0, 21 * day)]
    for n, row in enumerate(rows):
        df = spark.createDataFrame([row], SCHEMA + ", s long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("s"))).drop("s")
        df.write.parquet(f"{tmp_path}/in/{n}")
        stream = tracker.track_stream(jobs.read_stream(spark, f"{tmp_path}/in", df.schema), 0.2)
        tracker.run_tracker(spark, stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.scene_token, r.slot, r.frame_idx, r.track_id, r.late) for r in spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out").collect())
    # the second frame 0 of s is no late one: the scene began anew
    assert got == [("s", 1, 0, 0, False), ("s", 2, 0, 0, False), ("t", 1, 0, 0, False), ("t", 1, 1, 0, False)]


def start(spark, tmp_path, schema, **how):
    stream = tracker.track_stream(jobs.read_stream(spark, f"{tmp_path}/in", schema), 0.2, **how)
    tracker.run_tracker(spark, stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")


def test_scenes_share_calls_and_state_of_their_group(spark, tmp_path):
    rows = [(f"{name}-{n}", *row) for n in range(8) for name, *row in given(20 + n, frames=12)]
    boxes = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("frame_idx")))
    for n, part in enumerate(["frame_idx < 5", "frame_idx between 5 and 8 and scene_token < 's2'", "frame_idx >= 5 and (scene_token >= 's2' or frame_idx > 8)"]):
        boxes.where(part).write.parquet(f"{tmp_path}/in/{n}")
        start(spark, tmp_path, boxes.schema, groups=3)
    got = spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out")
    assert sorted((r.scene_token, r.slot, r.frame_idx, r.track_id, r.misses) for r in got.where("not late").collect()) == plain(rows, 0.2)
    assert got.where("late").isEmpty()
    # 32 scenes, of which some had no new rows in a micro-batch, are three entries of state
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() <= 3
    boxes.where("frame_idx = 11").withColumn("frame_idx", F.lit(12)).write.parquet(f"{tmp_path}/in/last")
    with pytest.raises(StreamingQueryException):  # scenes would not meet their tracks
        start(spark, tmp_path, boxes.schema, groups=4)


def test_silent_scene_of_a_living_group_is_forgotten(spark, tmp_path):
    day, box = 86_400, (0.9, 0.0, 1.0, 0.0, 1.0)
    # t comes every half day, so the group itself is never silent; u comes again in time
    times = [("s", 0, 0.0), ("u", 0, 0.0), *[("t", n, n / 2) for n in range(6)], ("u", 1, 0.9), ("s", 0, 3.0), ("u", 0, 3.0)]
    df = spark.createDataFrame([(s, f, 1, *box, int(d * day)) for s, f, d in times], SCHEMA + ", s long").withColumn(
        "at", F.timestamp_seconds(1_700_000_000 + F.col("s")))
    for n, when in enumerate(sorted({int(d * day) for *_, d in times})):
        df.where(F.col("s") == when).drop("s").write.parquet(f"{tmp_path}/in/{n}")
        start(spark, tmp_path, df.drop("s").schema, groups=1)
    got = sorted((r.scene_token, r.frame_idx, r.track_id, r.late) for r in spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out").collect())
    assert got == sorted([("s", 0, 0, False), ("s", 0, 0, False), ("u", 0, 0, False), ("u", 1, 0, False), ("u", 0, 0, False), *[("t", n, 0, False) for n in range(6)]])


def test_scene_whose_time_is_up_when_it_comes_is_tracked_and_forgotten(spark, tmp_path):
    df = spark.createDataFrame([(s, 0, 1, 0.9, 0.0, 1.0, 0.0, 1.0, d) for s, d in (("t", 10), ("s", 3), ("t", 11))], SCHEMA + ", d long").withColumn(
        "at", F.timestamp_seconds(1_700_000_000 + 86_400 * F.col("d")))
    for n, d in enumerate((10, 3, 11)):
        df.where(F.col("d") == d).drop("d").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = tracker.track_stream(jobs.read_stream(spark, f"{tmp_path}/in", df.drop("d").schema, files_per_batch=1), 0.2, silence_ms=43_200_000, groups=1)
    tracker.run_tracker(spark, stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(tracker.OUT).parquet(f"{tmp_path}/out").collect()
    assert ("s", 0, False) in {(r.scene_token, r.track_id, r.late) for r in got}
    assert all(r.scenes == ["t"] for r in spark.read.format("statestore").load(f"{tmp_path}/checkpoint").select("value.groupState.scenes").collect())
