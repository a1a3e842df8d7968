"""Findings of round 3."""

import math
import random

from pyspark.sql import functions as F

from kerbside.functions import rig
from kerbside.operators import grid, maps, spans


def test_a_point_beside_a_camera_has_no_pixel(spark):
    points = spark.createDataFrame([(1.5, 3.0, 1.0), (9.0, 0.0, 1.5)], "x double, y double, z double")
    front = rig.extrinsics(rig.mounts(spark).filter("camera = 'CAM_FRONT'"))
    u, w, depth = rig.project(F.col("x"), F.col("y"), F.col("z"))
    got = points.crossJoin(front).select("x", u.alias("u"), rig.in_image(u, w, depth).alias("seen")).sort("x").collect()
    assert [(r.u, bool(r.seen)) for r in got] == [(None, False), (800.0, True)]


def test_lines_in_patch_send_the_map_and_not_the_frames(spark):
    points = spark.range(1000).select(F.col("id").cast("string").alias("token"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    # a local table has no size estimate, as a part of the map
    vs = spark.createDataFrame([("lanes", 1, 0, 1.0, 1.0), ("lanes", 1, 1, 9.0, 1.0), ("lanes", 2, 0, 2.0, 2.0)], "layer string, record long, vertex int, x double, y double")
    found = maps.lines_in_patch(maps.patches_around(points, 6.0), vs)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BuildRight") == 2 and "BuildLeft" not in plan
    assert found.groupBy("record", "within").count().sort("record").collect() == [(1, False, 1000), (2, True, 1000)]


def some_boxes(spark, n=40, sides=1):
    rng = random.Random(5)
    rows = [(i % 3, i % sides, i // 2, rng.uniform(-52, -38), rng.uniform(-52, -38), rng.uniform(-3.2, 3.2), rng.uniform(0.3, 3), rng.uniform(0.3, 7)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, side int, id int, x double, y double, yaw double, w double, l double")


def as_rows(df, *columns):
    return sorted((*[r[c] for c in columns], r.cy, x) for r in df.collect() for x in range(r.x0, r.x1 + 1))


def test_boxes_are_painted_and_no_cells_are_joined(spark):
    df = some_boxes(spark)
    fast = spans.painted_boxes(df, ["k"], "id")
    assert as_rows(fast, "k", "id") == as_rows(spans.painted(spans.box_spans(df, ["k"], "id"), ["k"], "id"), "k", "id")
    moved = spans.backward_flow(spans.centroids(fast.withColumn("step", F.lit(0)), "k", "step", "id", carry=True), "k", "step", "id")
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_quads_are_merged_in_one_step(spark):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        cx, cy, a, w, h = rng.uniform(-3, 27), rng.uniform(-3, 27), rng.uniform(0, 6.3), rng.uniform(0.2, 9), rng.uniform(0.2, 9)
        ring = [(cx + u * math.cos(a) - v * math.sin(a), cy + u * math.sin(a) + v * math.cos(a)) for u, v in ((w, h), (w, -h), (-w, -h), (-w, h))]
        rows.append((i % 2, *[c for p in ring for c in p]))
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"u{i} double, v{i} double" for i in range(4)))
    assert as_rows(spans.merged_quads(df, ["k"], 24), "k") == as_rows(spans.merged(spans.fill_quads(df, ["k"], 24), ["k"]), "k")


def test_overlaid_grids_equal_cells(spark):
    df = some_boxes(spark, sides=2)
    want = {}
    for r in df.collect():
        for cx in range(200):
            for cy in range(200):
                dx, dy = -50 + 0.5 * (cx + 0.5) - r.x, -50 + 0.5 * (cy + 0.5) - r.y
                if cx < 40 and cy < 40 and abs(dx * math.cos(r.yaw) + dy * math.sin(r.yaw)) <= r.l / 2 and abs(-dx * math.sin(r.yaw) + dy * math.cos(r.yaw)) <= r.w / 2:
                    cell = want.setdefault((r.k, cy, cx), [None, None])
                    cell[r.side] = max(r.id, -1 if cell[r.side] is None else cell[r.side])
    pieces = grid.overlaid(df, ["k"], "id").cache()
    got = {(r.k, r.cy, x): [r.p, r.t] for r in pieces.collect() for x in range(r.x0, r.x1 + 1)}
    assert got == want
    both = sum(None not in c for c in want.values())
    iou = grid.cell_iou(pieces, [50.0]).first()
    assert (iou.tp, iou.tp + iou.fp + iou.fn) == (both, len(want))
    pq = grid.panoptic(pieces.withColumn("step", F.lit(0)), "k", "step").first()
    assert pq.tp + pq.fp + pq.switches * 0 == len({(k, c[0]) for (k, _, _), c in want.items() if c[0] is not None})


def test_centre_totals_equal_the_map(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i % 20, 0, rng.uniform(-4, 203), rng.uniform(-4, 203)) for i in range(60)], "k int, step int, mx double, my double")
    m = {(r.k): (r.n, round(r.s, 9), round(r.t, 12)) for r in spans.centre_map(df, "k", "step").groupBy("k").agg(
        F.count("*").alias("n"), F.sum("centerness").alias("s"), F.max("centerness").alias("t")).collect()}
    assert m == {r.k: (r.cells, round(r.total, 9), round(r.top, 12)) for r in spans.centre_totals(df, "k", "step").collect()}
    points = df.filter("k = 3").collect()
    near = {(cx, cy) for r in points for cx in range(200) for cy in range(200) if abs(cx - r.mx) <= 8 and abs(cy - r.my) <= 8}
    assert m[3][0] == len(near)


def test_footprint_numbers_are_the_footprint(spark):
    df = spark.createDataFrame([(0.0, 0.0), (49.8, -51.0), (-3.3, 7.9)], "f double, l double")
    n, c = grid.footprint_numbers(F.col("f"), F.col("l")), F.transform(grid.footprint(F.col("f"), F.col("l")), lambda s: s["cx"] * grid.SIZE + s["cy"])
    assert df.filter(F.array_sort(n) == F.array_sort(c)).count() == 3


def test_frames_look_at_few_tiles(spark):
    poses = spark.createDataFrame([("f", 100.0, -50.0, 0.3)], "token string, gx double, gy double, gyaw double")
    segs = spark.createDataFrame([("lanes", 0, 0, 20.0, -50.0, 180.0, -50.0)], "layer string, record int, seg int, ax double, ay double, bx double, by double")
    part = maps.clip_to_patch(poses, segs, 51.2).collect()
    assert len(part) == 1 and abs(part[0].length - 102.4 / math.cos(0.3)) < 1e-9
