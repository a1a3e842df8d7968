"""Operators on small literal tables, with the edge cases that decide semantics."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions import geom, phrases as ph, rig, turns
from kerbside.functions.fmt import fixed
from kerbside.operators import detection as det, grid, maps, relational as rel, rules, sampling, training, windows
from kerbside.operators.ordered import ordinal, over_scene, running_sums, sparse_neighbours
from kerbside.sources import episodes, predictions
from kerbside.streaming import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fixed_matches_correct_rounding(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 1.005, -0.001, 2.25, 0.05] + [rng.randint(-4000, 4000) / 200 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for x, two, single in rows(df.select("x", fixed(F.col("x"), 2), fixed(F.col("x"), 1))):
        assert two == f"{x:.2f}" and single == f"{x:.1f}"


def test_wrap_variants(spark):
    r = one(spark, a=geom.wrap(F.lit(math.pi)), b=geom.wrap_closed(F.lit(math.pi)), c=geom.wrap(F.lit(-4.0)))
    assert r.a == pytest.approx(-math.pi) and r.b == pytest.approx(math.pi) and r.c == pytest.approx(2 * math.pi - 4)


def test_camera_quaternion_equals_rotation(spark):
    for r in rig.rotation_quat(rig.extrinsics(rig.mounts(spark))).collect():
        w, x, y, z = r.qw, r.qx, r.qy, r.qz
        assert (1 - 2 * (y * y + z * z)) == pytest.approx(r.r00, abs=1e-9)
        assert 2 * (x * z + w * y) == pytest.approx(r.r02, abs=1e-9)
        assert 2 * (x * y + w * z) == pytest.approx(r.r10, abs=1e-9)
        assert 2 * (y * z + w * x) == pytest.approx(r.r21, abs=1e-9)


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_chunked_windows_equal_plain_ones(spark, chunk):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(3)], "scene_token string, frame_idx long")
    got = over_scene(df, 2, 3, lambda w: {
        "back": F.lag("frame_idx", 2).over(w), "ahead": F.lead("frame_idx", 3).over(w)}, chunk=chunk)
    sizes = {"a": 23, "b": 3}
    out = rows(got.select("scene_token", "frame_idx", "back", "ahead"))
    assert len(out) == 26
    for s, i, back, ahead in out:
        assert back == (i - 2 if i >= 2 else None)
        assert ahead == (i + 3 if i + 3 < sizes[s] else None)


def test_ordinal_running_sum_and_sparse_neighbours_under_skew(spark):
    # one group holds almost everything and one value repeats
    data = [("hot", i, i % 3) for i in range(200)] + [("cold", 1, 5)]
    df = spark.createDataFrame(data, "g string, t long, v long")
    pos = ordinal(df, ["t"], "pos", group=["g"], bucket=F.floor(F.col("t") / 16))
    assert sorted(p for g, _, _, p in rows(pos.select("g", "t", "v", "pos")) if g == "hot") == list(range(200))
    run = running_sums(df, ["t"], {"s": "v"}, group=["g"], bucket=F.floor(F.col("t") / 16)).filter("g = 'hot'").orderBy("t")
    total = 0
    for r in run.collect():
        total += r.v
        assert r.s == total
    gaps = df.filter("t % 40 = 7 AND g = 'hot'")
    out = {r.t: (r.p, r.n) for r in sparse_neighbours(gaps, ["g"], "t", "t", "p", "n", chunk=16).collect()}
    assert out == {7: (None, 47), 47: (7, 87), 87: (47, 127), 127: (87, 167), 167: (127, None)}


def test_bearing_and_canonical(spark):
    e = rules.factor("obstacle", F.lit("car"), r=F.lit(1.25), f=F.lit(-2.0), role="rear")
    s = rules.factor("slot", F.lit("free"))
    r = one(spark, a=rules.bearing(F.lit(1.0), F.lit(-1.0)), b=rules.bearing(F.lit(0.1), F.lit(0.1)),
            c=rules.canonical(e), d=rules.canonical(s))
    assert (r.a, r.b) == ("behind on my right", "right here")
    assert (r.c, r.d) == ("obstacle[car|rear]@(1.2,-2.0)", "slot(free)")


def test_mentions_and_guard(spark):
    allowed = F.array(F.lit("slot"))
    hall = lambda text, dec: ph.hallucinations(F.lit(text), F.lit(dec), allowed)
    r = one(spark, a=ph.entity_mentions(F.lit("A Truck near the parking space")), b=ph.decision_mentions(F.lit("feedback completely aligned gears")),
            c=hall("nicely aligned in the slot", "complete_park"), d=hall("I will abort", "reverse"), e=hall("a car", "reverse"))
    assert set(r.a) == {"obstacle", "obstacle:truck", "slot"}
    assert set(r.b) == {"align", "shift_gear"}
    assert r.c == [] and r.d == ["decision:abort"] and set(r.e) == {"entity:obstacle", "entity:obstacle:car"}


def test_turn_round_trip_and_malformed(spark):
    pts = F.array(*[F.struct(F.lit(float(i)).alias("r"), F.lit(-0.5 * i).alias("f"), F.lit(0.1).alias("h")) for i in range(6)])
    turn = ph.assistant_turn(F.lit("I am reversing."), ph.waypoints_text(pts))
    r = one(spark, t=turns.parse_turn(turn), a=turns.parse_turn(F.lit("free text")),
            b=turns.parse_turn(F.lit("<traj_start>[(1,2,3),(1,2,3)]<traj_end>")), c=ph.markers_in_order(turn))
    assert r.t.error is None and r.t.trace == "I am reversing." and len(r.t.points) == 6 and r.c
    assert r.a.error == "no trajectory block" and r.b.error == "expected 6 waypoints, parsed 2"


def test_repair_pads_cuts_and_gives_null(spark):
    fix = lambda s: turns.repair_points(F.lit(s))
    r = one(spark, a=fix("[(1.00,2.00,0.1),(1.5 2.5)]"), b=fix("nothing"), c=fix("".join(f"({i}.0,1.0)" for i in range(9))))
    assert [(p.r, p.f) for p in r.a] == [(1.0, 2.0)] + [(1.5, 2.5)] * 5
    assert r.b is None and [p.r for p in r.c] == [0, 1, 2, 3, 4, 5]


def test_predictions_reader_forms(spark, tmp_path):
    recs = [{"id": "t1_trajectory", "answer": ["old"]}, {"sample_id": "t2", "answer": "plain"},
            {"id": "t1_trajectory", "answer": ["new", "x"]}, {"id": "t3", "answer": []}]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    for name in ("a.json", "b.jsonl"):
        got = {r.token: r.answer for r in predictions.read_predictions(spark, str(tmp_path / name)).collect()}
        assert got == {"t1": "new", "t2": "plain", "t3": ""}


def test_read_episodes(spark, tmp_path):
    pose = {"x_world": 1.0, "y_world": 2.0, "yaw_deg": 0.0, "speed_ms": 0.5}
    for name, meta in (("episode_0001", True), ("episode_0002", False)):
        d = tmp_path / name
        d.mkdir()
        (d / "poses.json").write_text(json.dumps([pose, {**pose, "reverse": True}]))
        if meta:
            (d / "meta.json").write_text(json.dumps({"episode_id": "1", "collection_config": {"split": "train", "slot_idx": 3}}))
            (d / "actors.json").write_text(json.dumps([{"frame_idx": 1, "actors": [{"id": 5, "category": "car"}]}]))
    got = episodes.read_episodes(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.token, r.reverse, r.actors is None) for r in got] == [
        ("episode_0001_f0000", False, True), ("episode_0001_f0001", True, False)]


def brute_match(dets, gts, thr):
    taken, out = set(), {}
    for pos, score, x, y in sorted(dets, key=lambda d: (-d[1], -d[0])):
        best = min(((math.hypot(gx - x, gy - y), p) for p, gx, gy in gts if p not in taken), default=None)
        hit = best is not None and best[0] < thr
        out[pos] = best[1] if hit else None
        if hit:
            taken.add(best[1])
    return out


def test_confidence_match_against_brute_force(spark):
    rng = random.Random(4)
    dets, gts = [], []
    for t in range(12):
        for p in range(rng.randint(0, 7)):
            dets.append((f"t{t}", "car", p, round(rng.random(), 1), t, rng.uniform(0, 5), rng.uniform(0, 5)))
        for p in range(rng.randint(0, 6)):
            gts.append((f"t{t}", "car", p, rng.uniform(0, 5), rng.uniform(0, 5)))
    d = spark.createDataFrame(dets, "token string, cls string, det_pos long, score double, event_id long, x double, y double")
    g = spark.createDataFrame(gts, "token string, cls string, actor_id long, x double, y double")
    extra = {c: F.lit(1.0) for c in ("w", "l", "h", "yaw", "vx", "vy")}
    got = {(r.token, r.det_pos): r.gt_pos for r in det.match_frames(d.withColumns(extra), g.withColumns(extra), [1.5]).collect()}
    for t in range(12):
        want = brute_match([(p, s, x, y) for k, _, p, s, _, x, y in dets if k == f"t{t}"],
                           [(p, x, y) for k, _, p, x, y in gts if k == f"t{t}"], 1.5)
        assert {p: v for (k, p), v in got.items() if k == f"t{t}"} == want


def test_pair_iou_known_overlap(spark):
    box = "token string, {} long, x double, y double, z double, w double, l double, h double, yaw double"
    a = spark.createDataFrame([("t", 1, 0.0, 0.0, 0.0, 2.0, 4.0, 2.0, 0.0)], box.format("actor_id"))
    b = spark.createDataFrame([("t", 1, 1.0, 0.0, 0.0, 2.0, 4.0, 2.0, 0.0), ("t", 2, 0.0, 0.0, 0.0, 2.0, 4.0, 2.0, math.pi / 2),
                               ("t", 3, 0.0, 0.0, 9.0, 2.0, 4.0, 2.0, 0.0)], box.format("det_pos"))
    got = {r.b_pos: (r.inter, r.iou) for r in det.pair_iou(a, b).collect()}
    assert got[1][0] == pytest.approx(12.0) and got[1][1] == pytest.approx(12 / 20)
    assert got[2][0] == pytest.approx(8.0) and got[3][1] == 0.0


def test_track_lifecycle_against_state_machine(spark):
    rng = random.Random(9)
    data = [("s", slot, i, rng.choice([0.1, 0.3, 0.45, 0.6])) for slot in range(3) for i in range(60) if rng.random() < 0.9]
    df = spark.createDataFrame(data, "scene_token string, slot long, frame_idx long, score double")
    got = {(r.slot, r.frame_idx): (r.track_id, r.misses) for r in jobs.track_lifecycle(df, chunk=8).collect()}
    state, want, born = {}, {}, 0
    for _, slot, i, score in sorted(data, key=lambda r: (r[2], r[1])):
        cur = state.get(slot)
        if score >= 0.5:
            if cur is None:
                cur, born = [born, 0], born + 1
            cur[1] = 0
        elif cur is not None and score < 0.4:
            cur[1] += 1
            if cur[1] >= 5:
                cur = None
        state[slot] = cur
        if cur is not None:
            want[(slot, i)] = tuple(cur)
    assert got == want


def test_balanced_shard_equals_greedy(spark):
    rng = random.Random(2)
    lengths = {f"ep_{i:04d}": rng.randint(1, 6) for i in range(40)}
    df = spark.createDataFrame([(s, i) for s, n in lengths.items() for i in range(n)], "scene_token string, frame_idx long")
    got = {r.scene_token: r.shard for r in sampling.balanced_shard(df, 3).select("scene_token", "shard").distinct().collect()}
    loads, want = [0, 0, 0], {}
    for s in sorted(lengths, key=lambda s: (-lengths[s], s)):
        k = min(range(3), key=lambda j: (loads[j], j))
        want[s], loads[k] = k, loads[k] + lengths[s]
    assert got == want


def test_random_sample_is_repeatable_and_sized(spark):
    df = spark.createDataFrame([(f"t{i}", "s", i) for i in range(101)], "token string, scene_token string, frame_idx long")
    a = {r.token for r in sampling.sample(df, "random:7%", 3).collect()}
    assert len(a) == 8 and a == {r.token for r in sampling.sample(df, "random:7%", 3).collect()}


def test_insert_only_merge_is_idempotent_and_guards(spark):
    base = spark.createDataFrame([("a", "x")], "qa_id string, feature_path string")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "qa_id string, feature_path string")
    once = training.merge_conversations(base, new)
    assert sorted(rows(once)) == sorted(rows(training.merge_conversations(once, new))) == [("a", "x"), ("b", "z")]
    with pytest.raises(Exception, match="no feature path"):
        training.merge_conversations(base, spark.createDataFrame([("c", None)], new.schema)).collect()


def test_swap_strings_reaches_nested_values(spark):
    df = spark.sql("select 'raw/a' p, array(named_struct('q', 'raw/b', 'n', 1)) c, map('k', 'raw/c') m")
    r = rel.swap_strings(df, "raw", "new").first()
    assert r.p == "new/a" and r.c[0].q == "new/b" and r.c[0].n == 1 and r.m == {"k": "new/c"}


def test_even_odd_contains(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    r = one(spark, a=maps.contains(ring, F.lit(1.0), F.lit(1.0)), b=maps.contains(ring, F.lit(5.0), F.lit(1.0)))
    assert r.a and not r.b


def test_footprint_has_32_cells():
    cells = grid.footprint_cells()
    assert len(cells) == 32 and min(cells) == (97, 98) and max(cells) == (104, 101)


def test_future_of_last_frame_is_zero(spark):
    df = spark.createDataFrame([("s", "a", 0, 0.0, 0.0, 0.0), ("s", "b", 1, 1.0, 0.0, 0.0)],
                               "scene_token string, token string, frame_idx long, gx double, gy double, gyaw double")
    got = {r.token: [(p.r, p.f) for p in r.fut] for r in windows.future_local(df, 3).collect()}
    assert got["b"] == [(0.0, 0.0)] * 3 and [f for _, f in got["a"]] == [1.0] * 3
