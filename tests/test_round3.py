"""Five-error detection score, filters, lane sampling, next roads and unknown lanes."""

import math

import pytest
from pyspark.sql import functions as F

from kerbside.operators import detection as det, maps

D = "token string, cls string, det_pos long, event_id long, score double, x double, y double, w double, l double, h double, yaw double, vx double, vy double, attr string"
G = "token string, cls string, actor_id long, x double, y double, w double, l double, h double, yaw double, vx double, vy double, attr string"
BOX = (2.0, 4.0, 1.5, 0.0, 0.0, 0.0)


def test_attribute_error_is_a_running_mean_over_pairs_that_have_one(spark):
    attrs = ["", "a", "a", "", "a", "a", None, "a"]
    found = [(f"t{i}", "car", 0, i, 0.9 - i / 10, 0.0, 0.0, *BOX, "a" if i % 2 else "b") for i in range(8)]
    truth = [(f"t{i}", "car", 0, 0.0, 0.0, *BOX, a) for i, a in enumerate(attrs)]
    truth += [("t0", "barrier", 5, 9.0, 9.0, *BOX, "")]
    found += [("t0", "barrier", 5, 0, 0.5, 9.0, 9.0, *BOX, "")]
    t = spark.createDataFrame(truth, G)
    keep = ("w", "l", "h", "yaw", "vx", "vy", "attr")
    ranked = det.ranked_hits(det.match_frames(spark.createDataFrame(found, D), t, [2.0], payload=keep))
    curve = det.pr_curve(ranked, t)
    errors = det.tp_error_curve(ranked, curve, det.FIVE_ERRORS)
    got = {(r.cls, r.k): r for r in errors.collect()}
    seen, means = [], []
    for i, a in enumerate(attrs):
        if a:
            seen.append(0.0 if i % 2 else 1.0)
        means.append(sum(seen) / len(seen) if seen else 0.0)
    for n in range(2, 9):  # at a recall of n hits the value is the mean after them
        k = next((k for k in range(101) if abs(k / 100 - n / 8) < 1e-9), None)
        if k is not None:
            assert got["car", k].attr_err == pytest.approx(means[n - 1])
    assert {r.attr_err for r in got.values() if r.cls == "barrier"} == {1.0}
    whole = det.detection_score(det.average_precision(curve), det.tp_scores(errors, names=det.FIVE_ERRORS), names=det.FIVE_ERRORS).first()
    gain = sum(1 - min(1, whole[n]) for n in det.FIVE_ERRORS)
    assert whole.score == pytest.approx((5 * whole.map + gain) / 10)
    # a barrier has no attribute error, so only the car's counts
    assert whole.attr_err == pytest.approx(det.tp_scores(errors, names=det.FIVE_ERRORS).where("cls = 'car'").first().attr_err)


def test_filters_of_range_and_ids(spark):
    rows = [("t", "car", 1, 49.0, 0.0), ("t", "car", 2, 50.0, 0.0), ("t", "pedestrian", 3, 0.0, 41.0), ("t", "pedestrian", 4, 0.0, -39.0)]
    df = spark.createDataFrame(rows, "token string, cls string, actor_id long, x double, y double")
    assert sorted(r.actor_id for r in det.in_class_range(df).collect()) == [1, 4]
    named = df.withColumn("annotation", F.concat_ws("_", "token", "actor_id"))
    wanted = spark.createDataFrame([("t_1",), ("t_1",), ("t_3",), ("u_9",)], "annotation string")
    assert sorted(r.actor_id for r in det.of_annotations(named, wanted).collect()) == [1, 3]


def test_lane_points_run_on_over_corners_and_hold_the_end(spark):
    line = [(0.0, 0.0), (0.7, 0.0), (0.7, 0.0), (0.7, 1.0), (2.05, 1.0)]
    vs = spark.createDataFrame([("lanes", 1, i, x, y) for i, (x, y) in enumerate(line)], "layer string, record long, vertex int, x double, y double")
    pts = sorted(maps.discretise(maps.segments(vs, closed=False)).collect(), key=lambda r: r.s)
    assert [round(r.s, 9) for r in pts] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.05]
    for r in pts:
        x, y = (r.s, 0.0) if r.s <= 0.7 else (0.7, r.s - 0.7) if r.s <= 1.7 else (r.s - 1.0, 1.0)
        assert math.hypot(r.x - x, r.y - y) < 1e-9


def test_next_roads_need_any_or_all_nodes(spark):
    nodes = [("road_segment", 0, "abcd"), ("road_block", 0, "abef"), ("road_block", 1, "efgh"), ("lane", 0, "aijb"), ("lane", 1, "ijkl"), ("lane", 2, "iqrs"), ("road_segment", 7, "dxyz")]
    df = spark.createDataFrame([(layer, r, n) for layer, r, ns in nodes for n in ns], "layer string, record long, node string")
    ends = spark.createDataFrame([("road_block", 0, "e"), ("road_block", 0, "f"), ("lane", 0, "i"), ("lane", 0, "j"), ("lane", 1, "k"), ("lane", 1, "l")],
                                 "layer string, record long, node string")
    on = spark.createDataFrame([("p", "road_segment", 0), ("p", "road_block", 0), ("p", "lane", 0), ("q", "road_segment", 0), ("q", "road_block", 0), ("r", "road_segment", 0), ("s", "walkway", 3)],
                               "token string, layer string, record long")
    got = {(r.token, r.next_layer, r.next_record) for r in maps.finest_roads(on, df, ends, ["road_segment", "road_block", "lane"]).collect()}
    assert got == {("p", "lane", 1), ("q", "road_block", 1), ("r", "road_block", 0), ("r", "lane", 0), ("r", "road_segment", 7)}


def test_unknown_lane_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    known = spark.createDataFrame([(1,), (2,)], "lane long")
    lanes = spark.createDataFrame([("t", 1)], "token string, lane long")
    assert [(r.lane, r.way, r.other) for r in maps.connected_lanes(lanes, edges, known).collect()] == [(1, "outgoing", 2)]
    with pytest.raises(Exception, match="7 is not a known lane"):
        maps.connected_lanes(lanes.union(spark.createDataFrame([("u", 7)], lanes.schema)), edges, known).collect()


def test_grouped_partition_pads_every_group_and_deals_whole_batches(spark):
    from kerbside.operators import sampling

    rows = [(f"a{i}", "a") for i in range(2)] + [(f"b{i}", "b") for i in range(13)] + [(f"n{i}", None) for i in range(6)]
    out = sampling.grouped_partition(spark.createDataFrame(rows, "token string, split string"), "split", 2, 3, seed=1).collect()
    assert len(out) == 6 + 18 + 6 and sorted(r.slot for r in out) == list(range(30))
    for b in range(10):
        assert len({r.split for r in out if r.slot // 3 == b}) == 1
    assert all(sum(r.worker == w for r in out) == 15 for w in (0, 1)) and all(r.worker == r.slot // 15 for r in out)
    times = {}
    for r in out:
        times[r.token] = times.get(r.token, 0) + 1
    assert {t for k, t in times.items() if k[0] == "a"} == {3} and {t for k, t in times.items() if k[0] == "n"} == {1}
    assert sorted(t for k, t in times.items() if k[0] == "b") == [1] * 8 + [2] * 5
    again = sampling.grouped_partition(spark.createDataFrame(rows[::-1], "token string, split string").repartition(3), "split", 2, 3, seed=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_lines_need_a_node_strictly_inside(spark):
    nodes = [("lanes", 1, 0, 0.0, 0.0), ("lanes", 1, 1, 20.0, 0.0), ("lanes", 2, 0, 5.0, 5.0), ("lanes", 2, 1, -4.0, 1.0), ("lanes", 3, 0, -9.0, 0.0), ("lanes", 3, 1, 9.0, 0.0), ("lanes", 4, 0, 6.0, 0.0)]
    vs = spark.createDataFrame(nodes, "layer string, record long, vertex int, x double, y double")
    points = spark.createDataFrame([("t", 0.0, 0.0)], "token string, px double, py double")
    got = {(r.record, r.within) for r in maps.lines_in_patch(maps.patches_around(points, 6.0), vs).collect()}
    # line 3 crosses the patch without a node in it, line 4 has one on its border
    assert got == {(1, False), (2, True)}


def test_sources_come_by_number_and_none_is_an_error(spark, tmp_path):
    from kerbside.sources import episodes

    for name in ("dagger_r10.json", "dagger_r2.json", "base.json", "other.json"):
        (tmp_path / name).write_text('[{"a": "' + name + '"}]')
    rows = episodes.read_sources(spark, str(tmp_path), "base.json", "a string").collect()
    assert sorted((r.source_pos, r.a) for r in rows) == [(0, "base.json"), (1, "dagger_r2.json"), (2, "dagger_r10.json")]
    assert [r["round"] for r in episodes.source_manifest(spark, str(tmp_path), "base.json").collect()] == [-1, 2, 10]
    with pytest.raises(FileNotFoundError):
        episodes.source_manifest(spark, str(tmp_path), "missing.json", r"round_(\d+)")


def test_matrices_project_like_the_columns(spark):
    from kerbside.functions import rig

    u, v, depth = rig.project(F.lit(7.0), F.lit(-2.0), F.lit(0.5))
    cams = rig.extrinsics(rig.mounts(spark)).select("camera", rig.lidar_to_image().alias("m"), u.alias("u"), v.alias("v"), depth.alias("d")).collect()
    assert len(cams) == 6
    for r in cams:
        x, y, z, one = (sum(a * b for a, b in zip(row, (7.0, -2.0, 0.5, 1.0))) for row in r.m)
        assert one == 1.0 and z == pytest.approx(r.d) and (x / z, y / z) == pytest.approx((r.u, r.v))
    turn, at = rig.lidar_to_global(F.lit(3.0), F.lit(4.0), F.lit(math.pi / 2))
    m, t = spark.range(1).select(turn, at).first()
    world = [sum(p * m[i][j] for i, p in enumerate((1.0, 0.0, 2.0))) + t[j] for j in range(3)]
    assert world == pytest.approx([3.0, 5.0, 2.0])


def test_chat_styles(spark):
    from kerbside.functions import turns

    talk = spark.createDataFrame([([("U", "a"), ("B", "b"), ("U", "c"), ("B", None)],), ([],)], "t array<struct<role: string, text: string>>")
    said = lambda style, *seps: [r[0] for r in talk.select(turns.styled_chat(style, "S", F.col("t"), *seps)).collect()]
    assert said("single", "#") == ["S#U: a#B: b#U: c#B:", "S#"]
    assert said("two", " ", "|") == ["S U: a B: b|U: c B:", "S "]
    assert said("mpt", "#") == ["S#Ua#Bb#Uc#B", "S#"]
    assert said("gemma", "#") == ["Ua#Bb#Uc#B", ""]
    assert said("plain", "~", "^") == ["Sa~b^c~", "S"]
    assert said("llama_2", "<s>", "</s>") == ["[INST] <<SYS>>\nS\n<</SYS>>\n\na [/INST] b </s><s>[INST] c [/INST]", ""]
    with pytest.raises(ValueError):
        turns.styled_chat("nonesuch", "S", F.col("t"), "#")


def test_guard_of_boxes_stops_a_frame_that_is_too_full(spark):
    from kerbside.operators import boxes

    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "token string, n int")
    assert boxes.guard_max_boxes(df, 5).count() == 6
    with pytest.raises(Exception, match="more than 4 boxes"):
        boxes.guard_max_boxes(df, 4).collect()


def test_rank_files_of_lines_and_arrays(spark, tmp_path):
    from kerbside.sources import predictions

    (tmp_path / "out_rank0.json").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    (tmp_path / "out_rank12.json").write_text('[{"id": "c"}, {"id": "d"}]\n')
    rows = predictions.read_rank_outputs(spark, str(tmp_path)).orderBy("rank", "pos").collect()
    assert [(r["rank"], r.value.replace(" ", "")) for r in rows] == [(0, '{"id":"a"}'), (0, '{"id":"b"}'), (12, '{"id":"c"}'), (12, '{"id":"d"}')]
