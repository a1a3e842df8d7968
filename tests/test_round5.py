"""Findings of round 3 on time and shuffled bytes: work on arrays instead of folds in rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import boxes, detection as det, grid
from kerbside.plans import views

D = "token string, cls string, det_pos long, score double, event_id long, x double, y double, tag string"
G = "token string, cls string, actor_id long, x double, y double, tag string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_stage_table_is_not_made_again(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [views.Views(spark, "/no/such/folder").stage("test_once", make).count() for _ in range(2)] == [3, 3]
    assert len(made) == 1


def plain_matches(dets, gts, limit, inclusive, extra):
    out = {}
    for key in {d[:2] for d in dets}:
        free = [g[2:] for g in gts if g[:2] == key and None not in key and g[2] is not None]
        order = sorted((d for d in dets if d[:2] == key), key=lambda d: (-d[3], -d[2], d[4]))
        for _, _, pos, _, event, x, y, tag in order:
            if any(None in g[1:3] for g in free):
                out[event] = None
                continue
            near = min(((math.sqrt((gx - x) ** 2 + (gy - y) ** 2), p) for p, gx, gy, _ in free), default=None)
            hit = near is not None and (near[0] <= limit if inclusive else near[0] < limit) and (not extra or x < 4)
            out[event] = near[1] if hit else None
            if hit:
                free = [g for g in free if g[0] != near[1]]
    return out


@pytest.mark.parametrize(("inclusive", "extra"), [(False, None), (True, None), (False, lambda d, g: d["x"] < 4)])
def test_matches_of_odd_frames_equal_a_plain_sweep(spark, inclusive, extra):
    rng, n = random.Random(7), iter(range(10_000))
    dets, gts = [], []
    for t in range(60):
        token = None if t == 7 else f"t{t % 50}"
        cls = "car" if t % 4 else None
        for p in range(rng.randint(0, 8)):
            dets.append((token, cls, p, round(rng.random(), 1), next(n), float(rng.randint(0, 5)), float(rng.randint(0, 5)), "d"))
        for p in range(rng.randint(0, 7)):
            x = None if rng.random() < 0.03 else float(rng.randint(0, 5))
            gts.append((token, cls, None if rng.random() < 0.05 else p % 5, x, float(rng.randint(0, 5)), f"g{p}"))
    found = det.match_frames(spark.createDataFrame(dets, D), spark.createDataFrame(gts, G), [1.0, 2.0], inclusive=inclusive, extra=extra, payload=("tag",))
    # no fold over a frame's rows is left, whatever it costs for each threshold
    assert "aggregate(" not in plan_of(found) and "MapInArrow" in plan_of(found)
    rows = found.collect()
    assert len(rows) == 2 * len(dets)
    for limit in (1.0, 2.0):
        got = {r.event_id: r.gt_pos for r in rows if r.thr == limit}
        assert got == plain_matches(dets, gts, limit, inclusive, extra)
    assert all((r.dist is None) == (r.gt_pos is None) == (r.g_tag is None) and r.d_tag == "d" for r in rows)


def clipped(a, b):
    """Area of convex ring a inside convex ring b, both counter-clockwise."""
    for i in range(4):
        (px, py), (qx, qy) = b[i], b[(i + 1) % 4]
        side = lambda v: (qx - px) * (v[1] - py) - (qy - py) * (v[0] - px)
        out = []
        for u, v in zip(a, a[1:] + a[:1]):
            su, sv = side(u), side(v)
            if (su >= 0) != (sv >= 0):
                t = su / (su - sv)
                out.append((u[0] + (v[0] - u[0]) * t, u[1] + (v[1] - u[1]) * t))
            if sv >= 0:
                out.append(v)
        a = out
    return abs(sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(a, a[1:] + a[:1]))) / 2 if len(a) > 2 else 0.0


def ring(x, y, length, width, yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    return [(x + a * length / 2 * c - b * width / 2 * s, y + a * length / 2 * s + b * width / 2 * c) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))]


def test_footprints_are_clipped_for_all_pairs_at_once(spark):
    rng = random.Random(3)
    some = lambda: [(f"t{i % 9}", i, rng.uniform(-4, 4), rng.uniform(-4, 4), 0.0, rng.uniform(0.5, 3), rng.uniform(0.5, 6), 2.0, rng.uniform(-3.2, 3.2)) for i in range(90)]
    a, b = some(), some()
    box = "token string, {} long, x double, y double, z double, w double, l double, h double, yaw double"
    found = det.pair_iou(spark.createDataFrame(a, box.format("actor_id")), spark.createDataFrame(b, box.format("det_pos")))
    assert "aggregate(" not in plan_of(found)
    rows = found.collect()
    assert len(rows) > 300
    for r in rows:
        p, q = a[r.a_pos], b[r.b_pos]
        assert r.inter == pytest.approx(2 * clipped(ring(p[2], p[3], p[6], p[5], p[8]), ring(q[2], q[3], q[6], q[5], q[8])), abs=1e-9)


def test_paths_are_made_after_boxes_have_met_their_frame(spark):
    s = spark.createDataFrame([("a", 3, "car", 0.5, 1.0, 2.0, 0.4, -0.2), ("a", 1, "bus", 0.9, 0.0, 0.0, 1.0, 0.0)],
                              "token string, det_pos long, name string, score double, cx double, cy double, gvx double, gvy double")
    held = boxes.results_by_frame(s, spark.createDataFrame([("a",), ("b",)], "token string"), ["det_pos", "name", "cx", "cy", "gvx", "gvy"])
    got = {r.token: r.results for r in boxes.with_tracks(held, ["name"], [0.5, 1.0]).collect()}
    assert got["b"] == [] and [b.tracking_id for b in got["a"]] == ["1", "3"]
    path = got["a"][1].predicted[1]
    assert len(path) == 12 and (path[3].x, path[3].y) == pytest.approx((1.8, 1.6))


def test_gaps_of_modes_are_worked_out_once(spark):
    path = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([([[(0.0, 0.0), (3.0, 4.0)], [(1.0, 0.0), (1.0, 0.0)]], [(0.0, 0.0), (0.0, 0.0)]), ([[(1.0, 1.0)]], [])], f"modes array<{path}>, truth {path}")
    got = det.mode_errors(df)
    assert plan_of(got).count("arrays_zip") == 1
    assert [(r.min_ade, r.min_fde, r.miss) for r in got.sort(F.size("truth")).collect()] == [(None, None, None), (1.0, 1.0, 0.0)]


def test_footprints_meet_boxes_of_odd_steps(spark):
    rng = random.Random(11)
    paths = [(f"t{i % 7}" if i else None, i % 6 + 1, *(rng.uniform(-6, 6) for _ in range(4))) for i in range(40)] + [("far", 1, 80.0, 80.0, 0.0, 0.0)]
    given = [(f"t{i % 7}", i % 6 + 1, rng.uniform(-6, 6), rng.uniform(-6, 6), None if i == 5 else rng.uniform(-3, 3), 1.0, 2.5) for i in range(60)] + [("far", 1, 49.5, -49.5, 0.0, 2.0, 2.0)]
    p = spark.createDataFrame(paths, "token string, step int, pr double, pf double, gr double, gf double")
    b = spark.createDataFrame(given, "token string, step int, x double, y double, yaw double, w double, l double")
    found = grid.planning_collisions(p, b)
    assert "exists(" not in plan_of(found)

    def inside(px, py, box):
        x, y, yaw, w, length = box
        if yaw is None:
            return False
        dx, dy = px - x, py - y
        return abs(dx * math.cos(yaw) + dy * math.sin(yaw)) <= length / 2 and abs(-dx * math.sin(yaw) + dy * math.cos(yaw)) <= w / 2

    at = lambda i: -50 + 0.5 * (i + 0.5)
    clip = lambda v: max(0, min(199, math.trunc(v)))
    body = lambda r, f, box: any(inside(at(clip(f / 0.5 + i)), at(clip(-r / 0.5 + j)), box) for i, j in grid.footprint_cells())
    want = {}
    for key in {q[:2] for q in paths}:
        flags = [False, False, False]
        for q in (q for q in paths if q[:2] == key):
            for box in (g[2:] for g in given if g[:2] == key and key[0] is not None):
                ix, iy = math.trunc((q[3] + 49.75) / 0.5), math.trunc((-q[2] + 49.75) / 0.5)
                point = 0 <= ix < 200 and 0 <= iy < 200 and inside(at(ix), at(iy), box)
                flags = [flags[0] or body(q[4], q[5], box), flags[1] or point, flags[2] or body(q[2], q[3], box)]
        row = want.setdefault(key[1], [0, 0, 0, 0])
        for i, one in enumerate((True, flags[0], flags[1] and not flags[0], flags[2] and not flags[0])):
            row[i] += one
    assert {r.step: [r.frames, r.skipped, r.point_hits, r.body_hits] for r in found.collect()} == want


def test_facts_move_only_what_rules_and_texts_read(spark):
    v = views.Views(spark, "/no/such/folder", stored=False)
    point = "array<struct<r: double, f: double, h: double>>"
    rows = [(i, "s", f"s{i}", i, i == 1, 0.5, 0.1, 1.0, 6.0, 0.0, [(0.0, 1.0, 0.0)] * 6, 7.5) for i in range(3)]
    v.futures = spark.createDataFrame(rows, "event_id long, scene_token string, token string, frame_idx long, reverse boolean, speed_ms double, steer double, "
                                            f"slot_r double, slot_f double, slot_dh double, fut {point}, gx double")
    v.objects = spark.createDataFrame([("s0", "car", 0.0, 3.0, 1)], "token string, cls string, right double, forward double, obj_pos long")
    got = v.facts("gt")
    assert "gx" not in plan_of(got).split("LogicalRDD")[0] and "gx" not in got.columns
    assert [r.decision for r in got.sort("frame_idx").collect()] == ["approach", "shift_gear", "shift_gear"]
