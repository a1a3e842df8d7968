"""Shared folder, orders in two levels, line numbers, carried box sizes, closing batch of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside import session
from kerbside.operators import maps, sampling, windows
from kerbside.operators.ordered import ordinal, running_sums
from kerbside.streaming import jobs


def test_cluster_without_shared_folder_fails():
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(RuntimeError):
            session.scratch_folder(master, "app")
    assert session.scratch_folder("local[4]", "app-x") == session.scratch_folder("local[4]", "app-x")


def test_orders_over_many_scenes_with_one_prefix(spark):
    rng = random.Random(1)
    rows = [(f"episode_of_one_long_prefix_{s:05d}", i, rng.randint(0, 9)) for s in range(700) for i in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "scene_token string, frame_idx long, w long").repartition(7)
    want, total = {}, 0
    for pos, r in enumerate(sorted(rows)):
        total += r[2]
        want[r[:2]] = (pos, total)
    placed = sampling.with_position(df)
    got = running_sums(placed, sampling.SCENE_ORDER, {"sum": "w"}, bucket=sampling.frame_bucket(2))
    assert {(r.scene_token, r.frame_idx): (r.pos, r["sum"]) for r in got.collect()} == want
    dim = {r.scene_token: r.scene_pos for r in sampling.scene_dim(df).collect()}
    assert [dim[s] for s in sorted(dim)] == list(range(700))


def test_order_in_groups(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 2000).alias("v"))
    got = ordinal(df, ["v"], "pos", group=["g"], bucket=F.floor(F.col("v") / 10)).collect()
    for g in range(3):
        values = sorted((r.v, r.pos) for r in got if r.g == g)
        assert [p for _, p in values] == list(range(len(values)))


def test_pieces_do_not_meet_in_one_task(spark):
    df = spark.range(50_000).select(F.format_string("s%06d", "id").alias("scene_token"), F.lit(0).cast("long").alias("frame_idx"))
    plan = sampling.with_position(df)._jdf.queryExecution().optimizedPlan().toString()
    # the only unpartitioned window stands above totals of ranges
    for line in plan.split("\n"):
        if "Window" in line:
            assert "_range" in line or "_bucket" in line


def test_boxes_keep_their_own_size(spark):
    poses = spark.createDataFrame([(s, f"{s}{i}", i, 0.0, 0.0, 0.0) for s in "ab" for i in range(2)], "scene_token string, token string, frame_idx long, gx double, gy double, gyaw double")
    boxes = spark.createDataFrame([(f"{s}{i}", 7, 1.0, 2.0, 0.0, w) for s, w in (("a", 1.0), ("b", 3.0)) for i in range(2)],
                                  "token string, actor_id long, x double, y double, yaw double, w double")
    got = windows.reframe_boxes(boxes, poses, 1, keep=["w"]).collect()
    assert len(got) == 6 and all(r.w == (1.0 if r.ref_token[0] == "a" else 3.0) for r in got)


def test_lines_of_several_layers_keep_apart(spark):
    edges = [(layer, 0, i, float(i), float(y), float(i + 1), float(y)) for layer, y in (("parking_slots", 0), ("drivable_area", 1)) for i in range(5)]
    segs = spark.createDataFrame(edges, "layer string, record long, seg long, ax double, ay double, bx double, by double")
    poses = spark.createDataFrame([("t", 2.0, 0.0, 0.0)], "token string, gx double, gy double, gyaw double")
    parts = maps.clip_to_patch(poses, segs, 10.0)
    assert sorted(r.line for r in parts.collect()) == [0, 1]
    points = maps.resample(parts, 2.0).groupBy("line").count().collect()
    assert {r["count"] for r in points} == {3}  # 5 m in whole spacings of 2 m
    assert maps.line_raster(maps.resample(parts, 0.5), 0.5, 10.0, 1).select("line").distinct().count() == 2


def test_late_features_give_one_row_each(spark, tmp_path):
    base = 1_700_000_000_000_000
    c = spark.createDataFrame([(f"t{i}", base + i * 1_000_000) for i in range(20)], "token string, ts_us long")
    f = spark.createDataFrame([(f"t{i}", base + i * 1_000_000 + (60_000_000 if i % 5 == 0 else 0), f"p{i}") for i in range(20) if i % 7], "token string, ts_us long, path string")
    c.write.parquet(f"{tmp_path}/c")
    f.write.parquet(f"{tmp_path}/f")
    jobs.late_features_to_end(jobs.read_stream(spark, f"{tmp_path}/c", c.schema), jobs.read_stream(spark, f"{tmp_path}/f", f.schema), c, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.token: r.complete for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 20 and got == {f"t{i}": bool(i % 7) and i % 5 != 0 for i in range(20)}
