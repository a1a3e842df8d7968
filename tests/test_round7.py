"""Findings of round 4: map lines and masks drawn in one task, occupancy and matches that move less."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import maps, raster, spans

POSE = "token string, gx double, gy double, gyaw double"


def some_map(spark, n=14):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-90, 90), rng.uniform(-90, 90)
        a, w, h = rng.uniform(0, 6.3), rng.uniform(2, 20), rng.uniform(2, 30)
        layer = ("parking_slots", "drivable_area", "lanes", "crossings")[i % 4]
        ring = [(u, v) for u, v in ((w, h), (w, -h), (-w, -h), (-w, h))]
        if i % 5 == 4:
            ring.insert(1, (w * 0.2, 0.0))
        rows += [(layer, i, k, x + u * math.cos(a) - v * math.sin(a), y + u * math.sin(a) + v * math.cos(a)) for k, (u, v) in enumerate(ring)]
    return spark.createDataFrame(rows, "layer string, record long, vertex int, x double, y double")


def some_poses(spark, n=12):
    rng = random.Random(4)
    rows = [(f"t{i:02d}", rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(-3.2, 3.2)) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", None, 0.0, 0.0), ("far", 5000.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], POSE)


def some_segments(spark):
    vs = some_map(spark)
    return maps.segments(vs.filter("layer <> 'lanes'"), closed=True).unionByName(maps.segments(vs.filter("layer = 'lanes'"), closed=False))


def plain_clip(poses, segs, half):
    """Parts of each token and line, one segment after the other."""
    out = {}
    for p in poses:
        if p.gx is None:
            continue
        c, s = math.cos(p.gyaw), math.sin(p.gyaw)
        ego = lambda x, y: ((x - p.gx) * c + (y - p.gy) * s, -(x - p.gx) * s + (y - p.gy) * c)
        before, number = None, 0
        for g in sorted(segs, key=lambda g: (g.layer, g.record, g.seg)):
            (ax, ay), (bx, by) = ego(g.ax, g.ay), ego(g.bx, g.by)
            t0, t1, outside = 0.0, 1.0, False
            for d, q in ((ax - bx, ax + half), (bx - ax, half - ax), (ay - by, ay + half), (by - ay, half - ay)):
                if d < 0:
                    t0 = max(t0, q / d)
                elif d > 0:
                    t1 = min(t1, q / d)
                else:
                    outside |= q < 0
            if outside or t0 >= t1:
                continue
            line = (g.layer, g.record)
            number = 0 if before is None or before[0] != line else number
            joined = before is not None and before[:2] == (line, g.seg - 1) and before[2] == 1.0 and t0 == 0.0
            number += not joined
            key = (p.token, *line, number)
            out[key] = out.get(key, 0.0) + math.hypot(bx - ax, by - ay) * (t1 - t0)
            before = (line, g.seg, t1)
    return {k: round(v, 6) for k, v in out.items() if v >= 0.5}


def test_lines_are_clipped_without_windows_as_one_by_one(spark, monkeypatch):
    poses, segs = some_poses(spark), some_segments(spark)
    want = plain_clip(poses.collect(), segs.collect(), 30.0)
    few = maps.clip_to_patch(poses, segs, 30.0)
    monkeypatch.setattr(maps, "BROADCAST_ROWS", 3)
    many = maps.clip_to_patch(poses, segs, 30.0)
    for got in (few, many):
        rows = got.collect()
        assert {(r.token, r.layer, r.record, r.part): round(r.length, 6) for r in rows} == want and len(rows) == len(want)
        assert all(round(sum(p.len for p in r.pieces), 6) == round(r.length, 6) for r in rows)
        lines = {}
        for r in sorted(rows, key=lambda r: (str(r.token), r.layer, r.record, r.part)):
            assert r.line == lines.get(r.token, 0)
            lines[r.token] = r.line + 1
    assert "Window" not in plan_of(few)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def without_steps(df):
    """The same rows, of which no steps are known."""
    return df.select("*")


def test_lines_and_their_sums_stay_in_one_task(spark):
    parts = maps.clip_to_patch(some_poses(spark), some_segments(spark), spans.PATCH / 2)
    cls = maps.element_class(F.col("layer"))
    fast, slow = (spans.strokes(p, cls, ["ahead", "back", "wide"]) for p in (parts, without_steps(parts)))
    cells = lambda df: sorted((str(r.token), r.cls, r.way, r.cy, x, r.line, r.bin) for r in df.collect() for x in range(r.x0, r.x1 + 1))
    assert cells(fast) == cells(slow) and fast.count() > 100
    sums = {"cells": ("sum", "n"), "lines": ("distinct", "line"), "sum_line": ("sum", "line_n"), "x": ("sum", "x_n"), "y": ("sum", "y_n"), "low": ("min", "cy"), "spans": ("count", "cy")}
    for keys in (["token", "cls"], ["token", "cls", "way", "bin"]):
        got, want = (raster.grouped(spans.measured(s), keys, **sums) for s in (fast, without_steps(fast)))
        # frames go to Python once, and no spans are moved
        assert plan_of(got).count("MapInArrow") == 1 and plan_of(got).count("Exchange") == plan_of(maps.clip_to_patch(some_poses(spark), some_segments(spark), spans.PATCH / 2)).count("Exchange")
        assert rows_of(got) == rows_of(want)
    left = [spans.uncovered(s, ["line"]) for s in (fast, without_steps(fast))]
    cells = lambda df: sorted((str(r.token), r.cls, r.cy, x, r.line) for r in df.collect() for x in range(r.x0, r.x1 + 1))
    assert cells(left[0]) == cells(left[1]) and 0 < len(cells(left[0]))


def test_points_on_lines_stay_in_one_task(spark):
    parts = maps.clip_to_patch(some_poses(spark), some_segments(spark), 30.0)
    key = ["token", "layer", "record", "part", "line", "i"]
    per = raster.grouped(maps.resample(parts, 0.7), ["token", "layer", "record", "part"], length=("max", "length"), samples=("count", "i"))
    assert plan_of(per).count("Exchange") == plan_of(maps.clip_to_patch(some_poses(spark), some_segments(spark), 30.0)).count("Exchange")
    got, want = ({tuple(r[k] for k in key): (round(r.x, 6), round(r.y, 6), round(r.length, 6)) for r in maps.resample(p, 0.7).collect()} for p in (parts, without_steps(parts)))
    assert got == want and len(got) > 100
    assert per.agg(F.sum("samples")).first()[0] == len(got)


def test_masks_and_their_overlap_stay_in_one_task(spark, monkeypatch):
    poses, polygons = some_poses(spark), maps.assemble(some_map(spark).filter("layer <> 'lanes'"))
    parts = maps.clip_to_patch(poses, some_segments(spark), spans.PATCH / 2)
    masks = spans.patch_masks(poses, polygons, parts)
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 3)
    slow = spans.patch_masks(poses, polygons, without_steps(parts))
    cells = lambda df: sorted((str(r.token), r.layer, r.cy, x) for r in df.collect() for x in range(r.x0, r.x1 + 1))
    assert cells(masks) == cells(slow) and {r.layer for r in masks.select("layer").distinct().collect()} == {"parking_slots", "drivable_area", "crossings", "contour", "dividers"}
    got, want = (spans.sides_iou(spans.shifted_sides(m), ["token", "layer"]) for m in (masks, slow))
    assert rows_of(got) == rows_of(want)
    box = [spans.layer_box(poses.filter("token IS NOT NULL"), m, "drivable_area") for m in (masks, slow)]
    assert plan_of(box[0]).count("MapInArrow") == 1
    assert rows_of(box[0]) == rows_of(box[1])


@pytest.mark.parametrize("rows", [[], [(5000.0,)]])
def test_frames_without_a_map_near_them(spark, rows):
    poses = spark.createDataFrame([("a", x, 0.0, 0.0) for x, in rows], POSE)
    parts = maps.clip_to_patch(poses, some_segments(spark), 30.0)
    drawn = spans.strokes(parts, maps.element_class(F.col("layer")), ["ahead", "wide"])
    masks = spans.patch_masks(poses, maps.assemble(some_map(spark).filter("layer <> 'lanes'")), parts)
    for df in (parts, drawn, spans.uncovered(drawn, ["line"]), maps.resample(parts), masks, spans.shifted_sides(masks),
               raster.grouped(spans.measured(drawn), ["token", "cls"], cells=("sum", "n"), lines=("distinct", "line"), low=("min", "cy"))):
        assert df.count() == 0


def some_boxes(spark, n=160):
    rng = random.Random(9)
    rows = [(f"r{i % 5}" if i % 40 else None, rng.randrange(4), i % 9 if i % 31 else None, i % 2, rng.uniform(-52, -38), rng.uniform(-52, -38), rng.uniform(-3.2, 3.2), rng.uniform(0.3, 3), rng.uniform(0.3, 7))
            for i in range(n)]
    return spark.createDataFrame(rows, "ref string, k int, id long, side int, x double, y double, yaw double, w double, l double")


def test_steps_of_a_frame_are_painted_and_followed_in_one_task(spark):
    df = some_boxes(spark)
    fast = spans.painted_boxes(df, ["ref", "k"], "id")
    slow = without_steps(fast)
    plain = spans.painted(spans.box_spans(df, ["ref", "k"], "id"), ["ref", "k"], "id")
    cells = lambda d: sorted((str(r.ref), r.k, str(r.id), r.cy, x) for r in d.collect() for x in range(r.x0, r.x1 + 1))
    assert cells(fast) == cells(plain)
    r9 = lambda d: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in d.collect())
    assert r9(spans.summary(fast, ["ref", "k"], "id")) == r9(spans.summary(slow, ["ref", "k"], "id"))
    c = ["ref", "k", "id", "cells", "mx", "my", "flow_x", "flow_y", "from_x", "from_y"]
    got, want = (spans.centroids(s, "ref", "k", "id") for s in (fast, slow))
    assert plan_of(got).count("MapInArrow") == 1 and "Window" not in plan_of(got)
    assert r9(got.select(c)) == r9(want.select(c))
    assert r9(spans.centre_totals(got, "ref", "k")) == r9(spans.centre_totals(without_steps(want), "ref", "k"))
    got, want = (spans.centroids(s, "ref", "k", "id", carry=True) for s in (fast, slow))
    for step in (spans.offsets, spans.backward_flow):
        a, b = (step(d, "ref", "k", "id") for d in (got, want))
        assert "Window" not in plan_of(a)
        cells = lambda d: sorted((str(r.ref), r.k, r.id, r.cy, x, round(r.back_x, 9), round(r.back_y, 9)) for r in d.collect() for x in range(r.x0, r.x1 + 1))
        assert (r9(a.select(b.columns)) == r9(b)) if step is spans.offsets else (cells(a) == cells(b))


def test_segments_are_matched_where_the_grids_are(spark):
    from kerbside.operators import grid

    pieces = grid.overlaid(some_boxes(spark), ["ref", "k"], "id")
    got = grid.panoptic(pieces, "ref", "k")
    assert "Window" not in plan_of(got)
    want = grid.panoptic(without_steps(pieces), "ref", "k").first()
    assert [round(v, 9) for v in got.first()] == [round(v, 9) for v in want] and want.tp > 0 and want.switches >= 0
