"""Queries for scalar geometry (B) and filters (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import geom, rig
from kerbside.functions.fmt import fixed
from kerbside.operators import boxes, ego, objects, rules, windows
from kerbside.plans.oracle_views import forward_of, hyp, r6 as s6, register, right_of, wrap
from kerbside.plans.registry import query, r6


@query("b1_dataset_pose", f"""
SELECT token, {s6("x_world")} AS x, {s6("-y_world")} AS y, {s6("-radians(yaw_deg)")} AS yaw,
  {s6("cos(-radians(yaw_deg)/2)")} AS qw, {s6("sin(-radians(yaw_deg)/2)")} AS qz FROM raw_frames""")
def b1(v):
    xy = geom.dataset_xy(F.col("x_world"), F.col("y_world"))
    yaw = geom.dataset_yaw(F.col("yaw_deg"))
    q = geom.yaw_quat(yaw)
    return v.raw_frames.select("token", r6(xy.x).alias("x"), r6(xy.y).alias("y"), r6(yaw).alias("yaw"),
                               r6(q.w).alias("qw"), r6(q.z).alias("qz"))


@query("b2_ego_velocity", "SELECT token, reverse, ego_fwd_v, ego_right_v FROM frames")
def b2(v):
    return v.frames.select("token", "reverse", "ego_fwd_v", "ego_right_v")


RIG_SQL = ("(VALUES " + ", ".join(
    f"('{n}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE, {yaw}::DOUBLE)" for n, x, y, z, yaw in rig.MOUNTS)
    + ") m(camera, mx, my, mz, myaw)")
register("rig", f"""SELECT camera, mx AS tx, -my AS ty, mz AS tz,
  sin(-radians(myaw)) AS s, cos(-radians(myaw)) AS c, myaw FROM {RIG_SQL}""")


@query("b3_camera_calibration", f"""
SELECT token, camera, {s6("gx + tx*cos(gyaw) - ty*sin(gyaw)")} AS cam_x,
  {s6("gy + tx*sin(gyaw) + ty*cos(gyaw)")} AS cam_y, tz AS cam_z, {s6("s")} AS r00, {s6("c")} AS r02,
  {s6("-c")} AS r10, {s6("s")} AS r12,
  {s6(str(rig.FOCAL))} AS focal, {s6("0.5*abs(cos(-radians(myaw)/2) + sin(-radians(myaw)/2))")} AS qw
FROM frames CROSS JOIN rig""")
def b3(v):
    cams = F.broadcast(rig.rotation_quat(rig.extrinsics(rig.mounts(v.spark))))
    at = geom.rotate(F.col("tx"), F.col("ty"), F.col("gyaw"))
    return v.frames.crossJoin(cams).select(
        "token", "camera", r6(F.col("gx") + at.x).alias("cam_x"), r6(F.col("gy") + at.y).alias("cam_y"),
        F.col("tz").alias("cam_z"), r6("r00").alias("r00"), r6("r02").alias("r02"),
        r6("r10").alias("r10"), r6("r12").alias("r12"),
        r6(F.lit(rig.FOCAL)).alias("focal"), r6("qw").alias("qw"))


@query("b4_actor_boxes", """
SELECT token, instance_token, category, x, y, z, w, l, h, yaw, vx, vy FROM all_boxes""")
def b4(v):
    return v.all_boxes.select("token", "instance_token", "category", "x", "y", "z", "w", "l", "h",
                              "yaw", "vx", "vy")


@query("b5_angle_variants", f"""
SELECT token, {s6(wrap("radians(yaw_deg*3 + 0.25::DOUBLE)"))} AS half_open,
  {s6("abs(" + wrap("radians(yaw_deg*3 + 0.25::DOUBLE) - gyaw") + ")")} AS folded,
  {s6(wrap("radians(yaw_deg*3 + 0.25::DOUBLE)"))} AS closed FROM frames""")
def b5(v):
    a = F.radians(F.col("yaw_deg") * 3 + 0.25)
    return v.frames.select("token", r6(geom.wrap(a)).alias("half_open"),
                           r6(geom.yaw_gap(a, F.col("gyaw"))).alias("folded"),
                           r6(geom.wrap_closed(a)).alias("closed"))


@query("b6_quaternion_yaw", f"""SELECT token, {s6(wrap("gyaw + 0.001::DOUBLE"))} AS yaw FROM frames""")
def b6(v):
    q = geom.yaw_quat(F.col("gyaw") + 0.001)
    return v.frames.select("token", r6(geom.quat_yaw(q)).alias("yaw"))


@query("b7_global_local", f"""
SELECT token, {s6(right_of("100.0", "-50.0", "gx", "gy", "gyaw"))} AS r,
  {s6(forward_of("100.0", "-50.0", "gx", "gy", "gyaw"))} AS f,
  100.0::DOUBLE AS back_x, -50.0::DOUBLE AS back_y FROM frames""")
def b7(v):
    rf = geom.to_local(F.lit(100.0), F.lit(-50.0), F.col("gx"), F.col("gy"), F.col("gyaw"))
    back = geom.to_global(rf.right, rf.forward, F.col("gx"), F.col("gy"), F.col("gyaw"))
    return v.frames.select("token", r6(rf.right).alias("r"), r6(rf.forward).alias("f"),
                           r6(back.x).alias("back_x"), r6(back.y).alias("back_y"))


@query("b8_slot_local", "SELECT token, slot_r, slot_f, slot_dh FROM slot_frames")
def b8(v):
    return v.slot_frames.select("token", "slot_r", "slot_f", "slot_dh")


_CORNERS = "(VALUES (0, 0.5, 0.5), (1, 0.5, -0.5), (2, -0.5, -0.5), (3, -0.5, 0.5)) k(corner, sl, sw)"


@query("b9_slot_polygon", f"""
SELECT scene_token, corner,
  {s6("slot_x + 5.5::DOUBLE*sl*cos(slot_yaw) - 3.0::DOUBLE*sw*sin(slot_yaw)")} AS x,
  {s6("slot_y + 5.5::DOUBLE*sl*sin(slot_yaw) + 3.0::DOUBLE*sw*cos(slot_yaw)")} AS y
FROM scenes CROSS JOIN {_CORNERS}""")
def b9(v):
    p = ego.slot_polygon(v.scenes)
    return p.select("scene_token", "corner", r6("x").alias("x"), r6("y").alias("y"))


@query("b10_maneuver_labels", """
SELECT scene_token, maneuver_type, side, slot_x::DOUBLE AS slot_x, slot_y::DOUBLE AS slot_y, slot_yaw::DOUBLE AS slot_yaw FROM scenes""")
def b10(v):
    return v.scenes


@query("b11_slot_distance", f"""
SELECT token, {s6(hyp("slot_r", "slot_f"))} AS dist_to_slot, abs(slot_dh) AS align_err FROM slot_frames""")
def b11(v):
    return v.slot_frames.select("token", r6(ego.dist_to_slot()).alias("dist_to_slot"),
                                ego.align_err().alias("align_err"))


@query("b12_box_to_global", f"""
SELECT token, actor_id, {s6("gx + x*cos(gyaw) - y*sin(gyaw)")} AS cx, {s6("gy + x*sin(gyaw) + y*cos(gyaw)")} AS cy,
  z AS cz, w, l, h, {s6("cos(yaw/2)*cos(gyaw/2) - sin(yaw/2)*sin(gyaw/2)")} AS qw,
  {s6("sin(yaw/2)*cos(gyaw/2) + cos(yaw/2)*sin(gyaw/2)")} AS qz
FROM gt_boxes JOIN (SELECT token, gx, gy, gyaw FROM frames) USING (token)""")
def b12(v):
    g = boxes.to_global(v.gt_boxes, v.poses)
    return g.select("token", "actor_id", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("cz").alias("cz"),
                    "w", "l", "h", r6("qw").alias("qw"), r6("qz").alias("qz"))


# depth, u and v of every box centre in every camera
register("box_pixels", f"""
SELECT token, actor_id, category, camera, depth,
  {rig.FOCAL}::DOUBLE*(s*dx - c*dy)/depth + 800 AS u, {rig.FOCAL}::DOUBLE*(-dz)/depth + 450 AS v
FROM (SELECT *, c*dx + s*dy AS depth FROM (
  SELECT b.token, b.actor_id, b.category, m.camera, m.s, m.c, b.x - m.tx AS dx, b.y - m.ty AS dy, b.z - m.tz AS dz
  FROM gt_boxes b CROSS JOIN rig m))
""")


def _pixels(v):
    cams = F.broadcast(rig.extrinsics(rig.mounts(v.spark)))
    u, w, d = rig.project(F.col("x"), F.col("y"), F.col("z"))
    return v.gt_boxes.crossJoin(cams).select(
        "token", "actor_id", "category", "camera", u.alias("u"), w.alias("v"), d.alias("depth"))


@query("b13_lidar_to_image", f"""
SELECT token, actor_id, camera, {s6("depth")} AS depth, round(u, 3) + 0.0 AS u, round(v, 3) + 0.0 AS v
FROM box_pixels WHERE depth > 1.0""")
def b13(v):
    return _pixels(v).filter("depth > 1.0").select(
        "token", "actor_id", "camera", r6("depth").alias("depth"),
        F.round("u", 3).alias("u"), F.round("v", 3).alias("v"))


_F, _Z = f"{rig.FOCAL}::DOUBLE", "(c*tx + s*ty)"
_M = {"p00": f"{_F}*s + 800*c", "p01": f"{_F}*(-c) + 800*s", "p02": "0.0::DOUBLE", "p03": f"-({_F}*(s*tx - c*ty) + 800*{_Z})",
      "p10": "450*c", "p11": "450*s", "p12": f"-{_F}", "p13": f"{_F}*tz - 450*{_Z}", "p20": "c", "p21": "s", "p22": "0.0::DOUBLE", "p23": f"-{_Z}"}


@query("b13_matrices", f"""
SELECT token, camera, {", ".join(f"{s6(e)} AS {n}" for n, e in _M.items())}, {s6("cos(gyaw)")} AS l00, {s6("sin(gyaw)")} AS l01, {s6("-sin(gyaw)")} AS l10, {s6("cos(gyaw)")} AS l11,
  {s6("gx")} AS lx, {s6("gy")} AS ly FROM frames CROSS JOIN rig""")
def b13_matrices(v):
    cams = F.broadcast(rig.extrinsics(rig.mounts(v.spark)).select("camera", rig.lidar_to_image().alias("p")))
    turn, at = rig.lidar_to_global(F.col("gx"), F.col("gy"), F.col("gyaw"))
    both = v.frames.select("token", turn.alias("l"), at.alias("t")).crossJoin(cams)
    cell = lambda m, i, j, n: (F.round(F.col(m)[i][j], 6) + 0.0).alias(f"{n}{i}{j}")
    return both.select("token", "camera", *[cell("p", i, j, "p") for i in range(3) for j in range(4)], *[cell("l", i, j, "l") for i in range(2) for j in range(2)],
                       (F.round(F.col("t")[0], 6) + 0.0).alias("lx"), (F.round(F.col("t")[1], 6) + 0.0).alias("ly"))


@query("b14_can_bus", f"""
SELECT token, 18 AS n, gx AS c0, gy AS c1, {s6("cos(gyaw/2)")} AS c3, {s6("sin(gyaw/2)")} AS c6, speed_ms AS c13,
  {s6("radians(degrees(gyaw) - 360*floor(degrees(gyaw)/360))")} AS c16,
  {s6("degrees(gyaw) - 360*floor(degrees(gyaw)/360)")} AS c17 FROM frames""")
def b14(v):
    cb = v.frames.select("token", ego.can_bus().alias("cb"))
    at = lambda i: F.get("cb", F.lit(i))
    return cb.select("token", F.size("cb").alias("n"), at(0).alias("c0"), at(1).alias("c1"),
                     *[r6(at(i)).alias(f"c{i}") for i in (3, 6)], at(13).alias("c13"),
                     *[r6(at(i)).alias(f"c{i}") for i in (16, 17)])


register("frame_deg", "SELECT *, degrees(gyaw) - 360*floor(degrees(gyaw)/360) AS deg FROM frames")


@query("b15_queue_deltas", f"""
SELECT f.token, k AS slot, g.frame_idx AS "at",
  {s6("CASE WHEN k = 0 THEN 0 ELSE g.gx - p.gx END")} AS d_gx, {s6("CASE WHEN k = 0 THEN 0 ELSE g.gy - p.gy END")} AS d_gy,
  {s6("CASE WHEN k = 0 THEN 0 ELSE g.deg - p.deg END")} AS d_deg
FROM frame_deg f CROSS JOIN range(0, 4) t(k)
JOIN frame_deg g ON g.scene_token = f.scene_token AND g.frame_idx = f.frame_idx - 3 + k
LEFT JOIN frame_deg p ON p.scene_token = f.scene_token AND p.frame_idx = f.frame_idx - 4 + k
WHERE f.frame_idx >= 3""")
def b15(v):
    d = windows.queue_deltas(v.frames)
    return d.select("token", "slot", "at", *[r6(n).alias(n) for n in ("d_gx", "d_gy", "d_deg")])


register("submission", f"""
SELECT *, sqrt(gvx*gvx + gvy*gvy) AS speed FROM (
SELECT token, scene_token, frame_idx, det_pos, name, score, w, l, h, byaw, gyaw,
  gx + x*cos(gyaw) - y*sin(gyaw) AS cx, gy + x*sin(gyaw) + y*cos(gyaw) AS cy, z AS cz,
  vx*cos(gyaw) - vy*sin(gyaw) AS gvx, vx*sin(gyaw) + vy*cos(gyaw) AS gvy
FROM (SELECT *, CASE label WHEN 0 THEN 'car' WHEN 1 THEN 'truck' ELSE 'pedestrian' END AS name,
        -yaw - pi()/2 AS byaw FROM detections)
JOIN (SELECT token, gx, gy, gyaw FROM frames) USING (token)
WHERE sqrt(x*x + y*y) <= CASE name WHEN 'pedestrian' THEN 40 ELSE 50 END)
""")


@query("b16_prediction_boxes", f"""
SELECT token, det_pos, name, score, {s6("cx")} AS cx, {s6("cy")} AS cy, {s6("cz")} AS cz,
  {s6("cos(byaw/2)*cos(gyaw/2) - sin(byaw/2)*sin(gyaw/2)")} AS qw,
  {s6("sin(byaw/2)*cos(gyaw/2) + cos(byaw/2)*sin(gyaw/2)")} AS qz, {s6("gvx")} AS gvx, {s6("gvy")} AS gvy
FROM submission""")
def b16(v):
    s = boxes.to_submission(v.detections, v.poses)
    return s.select("token", "det_pos", "name", "score",
                    *[r6(n).alias(n) for n in ("cx", "cy", "cz", "qw", "qz", "gvx", "gvy")])


@query("b17_encode_decode", f"""
SELECT token, actor_id, {s6("ln(w)")} AS log_w, {s6("ln(l)")} AS log_l, {s6("ln(h)")} AS log_h,
  {s6("sin(yaw)")} AS sin_yaw, {s6("cos(yaw)")} AS cos_yaw, w AS w_back, l AS l_back, h AS h_back,
  yaw AS yaw_back FROM gt_boxes""")
def b17(v):
    code = boxes.encode(v.gt_boxes)
    return code.select(
        "token", "actor_id", r6("c2").alias("log_w"), r6("c3").alias("log_l"), r6("c5").alias("log_h"),
        r6("c6").alias("sin_yaw"), r6("c7").alias("cos_yaw"),
        *[r6(c).alias(f"{n}_back") for n, c in boxes.decoded().items() if n in ("w", "l", "h", "yaw")])


@query("b18_box_corners", f"""
SELECT token, actor_id, corner, {s6("-(y + l*sl*sin(yaw) + w*sw*cos(yaw))")} AS corner_r,
  {s6("x + l*sl*cos(yaw) - w*sw*sin(yaw)")} AS corner_f FROM gt_boxes CROSS JOIN {_CORNERS}""")
def b18(v):
    c = boxes.bev_corners_rf(v.gt_boxes)
    return c.select("token", "actor_id", "corner", r6("corner_r").alias("corner_r"),
                    r6("corner_f").alias("corner_f"))


@query("b18_box_corners_3d", f"""
SELECT token, actor_id, corner + 4*top AS corner, {s6("x + l*sl*cos(yaw) - w*sw*sin(yaw)")} AS x,
  {s6("y + l*sl*sin(yaw) + w*sw*cos(yaw)")} AS y, {s6("z + h*(top - 0.5::DOUBLE)")} AS z
FROM gt_boxes CROSS JOIN {_CORNERS} CROSS JOIN (VALUES (0), (1)) t(top)""")
def b18_3d(v):
    c = boxes.corners_3d(v.gt_boxes)
    return c.select("token", "actor_id", "corner", *[r6(n).alias(n) for n in ("x", "y", "z")])


@query("b19_detected_objects", """
SELECT token, obj_pos, cls, "right", forward, yaw, v_right, v_forward, score FROM det_objects""")
def b19(v):
    return objects.from_detections(v.detections).select(
        "token", "obj_pos", "cls", "right", "forward", "yaw", "v_right", "v_forward", "score")


@query("b19_gt_objects", """
SELECT token, obj_pos, cls, "right", forward, yaw, v_right, v_forward FROM objects""")
def b19_gt(v):
    return v.objects.select("token", "obj_pos", "cls", "right", "forward", "yaw", "v_right", "v_forward")


def bearing_sql(r: str, f: str) -> str:
    lon = f"CASE WHEN {f} > 0.7 THEN 'ahead' WHEN {f} < -0.7 THEN 'behind' END"
    lat = f"CASE WHEN {r} > 0.7 THEN 'on my right' WHEN {r} < -0.7 THEN 'on my left' END"
    return f"coalesce(nullif(concat_ws(' ', {lon}, {lat}), ''), 'right here')"


@query("b20_bearing", f"""SELECT token, obj_pos, {bearing_sql('"right"', "forward")} AS bearing FROM objects""")
def b20(v):
    return v.objects.select("token", "obj_pos", rules.bearing(F.col("right"), F.col("forward")).alias("bearing"))


@query("b21_canonical", """
SELECT token, obj_pos, 'obstacle[' || cls || printf(']@(%.1f,%.1f)', "right", forward) AS obstacle,
  printf('clearance=%.1f', sqrt("right"*"right" + forward*forward)) AS metric FROM objects""")
def b21(v):
    o = rules.factor("obstacle", F.col("cls"), r=F.col("right"), f=F.col("forward"))
    m = rules.factor("metric", F.lit("clearance"), value=geom.hypot(F.col("right"), F.col("forward")))
    return v.objects.select("token", "obj_pos", rules.canonical(o).alias("obstacle"),
                            rules.canonical(m).alias("metric"))


@query("b22_category_mapping", """
SELECT token, actor_id, 'cat_' || substr(md5(category), 1, 28) AS category_token,
  CASE category WHEN 'car' THEN 0 WHEN 'truck' THEN 1 ELSE 8 END AS label,
  CASE category WHEN 'pedestrian' THEN 'pedestrian' ELSE 'car' END AS motion FROM gt_boxes""")
def b22(v):
    c = F.col("category")
    return v.gt_boxes.select("token", "actor_id", boxes.category_token(c).alias("category_token"),
                             boxes.label_index(c).alias("label"), boxes.motion_group(c).alias("motion"))


ATTRIBUTE_SQL = """CASE WHEN speed > 0.2 THEN CASE WHEN name IN ('car', 'truck') THEN 'vehicle.moving' ELSE 'pedestrian.moving' END
  ELSE CASE WHEN name = 'pedestrian' THEN 'pedestrian.standing' ELSE 'vehicle.parked' END END"""


@query("b23_attribute_by_speed", f"SELECT token, det_pos, {ATTRIBUTE_SQL} AS attribute FROM submission")
def b23(v):
    return boxes.to_submission(v.detections, v.poses).select("token", "det_pos", "attribute")


@query("b26_lcf_and_command", """
SELECT p.token, 9 AS n, f.ego_fwd_v AS fwd_v, f.ego_right_v AS right_v, f.yaw_rate, f.speed_ms AS speed, f.steer,
  CASE WHEN p.reverse THEN 'reverse' WHEN rs[6] >= 2 THEN 'right' WHEN rs[6] <= -2 THEN 'left' ELSE 'forward' END AS command
FROM paths p JOIN frames f USING (token)""")
def b26(v):
    lcf = v.futures.select("token", "reverse", "fut", ego.lcf_feature().alias("lcf"))
    at = lambda i: F.get("lcf", F.lit(i))
    return lcf.select(
        "token", F.size("lcf").alias("n"), at(0).alias("fwd_v"), at(1).alias("right_v"),
        at(4).alias("yaw_rate"), at(7).alias("speed"), at(8).alias("steer"),
        ego.future_command(F.col("reverse"), F.element_at("fut", -1).r).alias("command"))


# ---- filters ----------------------------------------------------------------

@query("c1_range_filter", """
SELECT token, count(*) AS n FROM all_boxes WHERE abs(x) <= 32 AND abs(y) <= 32 GROUP BY token""")
def c1(v):
    return boxes.within_range(v.all_boxes, 32.0).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_FLAGGED = """SELECT *, actor_id % 6 <> 0 AS valid_flag, actor_id % 3 * 5 AS num_pts FROM gt_boxes"""


@query("c2_valid_objects", f"""
SELECT token, actor_id, CASE WHEN actor_id % 11 = 4 THEN 0 ELSE vx END AS vx,
  CASE WHEN actor_id % 11 = 4 THEN 0 ELSE vy END AS vy FROM ({_FLAGGED}) WHERE valid_flag OR num_pts > 0""")
def c2(v):
    a = F.col("actor_id")
    flagged = v.gt_boxes.withColumns({
        "valid_flag": a % 6 != 0, "num_pts": a % 3 * 5,
        "vx": F.when(a % 11 == 4, F.lit(float("nan"))).otherwise(F.col("vx"))})
    return boxes.valid_objects(flagged).select("token", "actor_id", "vx", "vy")


@query("c3_range_name_filter", f"""
SELECT token, actor_id, category, x, y, {s6(wrap("yaw"))} AS yaw FROM gt_boxes
WHERE x > -15 AND x < 15 AND y > -15 AND y < 15 AND category IN ('car', 'pedestrian')""")
def c3(v):
    near = boxes.of_classes(boxes.bev_range(v.gt_boxes, -15, -15, 15, 15), ["car", "pedestrian"])
    return near.select("token", "actor_id", "category", "x", "y", r6("yaw").alias("yaw"))


@query("c4_eval_filters", """
SELECT token, actor_id FROM gt_boxes
WHERE token IN (SELECT token FROM frames WHERE split = 'test') AND actor_id % 4 + 1 IN (3, 4)""")
def c4(v):
    wanted = v.frames.filter("split = 'test'").select("token")
    visible = v.gt_boxes.withColumn("visibility", F.col("actor_id") % 4 + 1)
    return visible.filter(F.col("visibility").isin(3, 4)).join(wanted, "token", "left_semi").select(
        "token", "actor_id")


_INSIDE = "u > 0 AND u < 1600 AND v > 0 AND v < 900 AND depth > 1"


@query("c5_camera_overlap", f"""
SELECT token, actor_id, count(*) AS cameras FROM box_pixels WHERE {_INSIDE}
GROUP BY token, actor_id HAVING count(*) > 1""")
def c5(v):
    seen = _pixels(v).filter(rig.in_image(F.col("u"), F.col("v"), F.col("depth")))
    return seen.groupBy("token", "actor_id").agg(F.count(F.lit(1)).alias("cameras")).filter("cameras > 1")


register("corner_pixels", f"""
SELECT token, actor_id, camera, depth, {rig.FOCAL}::DOUBLE*(s*dx - c*dy)/depth + 800 AS u,
  {rig.FOCAL}::DOUBLE*(-dz)/depth + 450 AS v
FROM (SELECT *, c*dx + s*dy AS depth FROM (
  SELECT b.token, b.actor_id, m.camera, m.s, m.c, b.x + b.l*sl*cos(b.yaw) - b.w*sw*sin(b.yaw) - m.tx AS dx,
    b.y + b.l*sl*sin(b.yaw) + b.w*sw*cos(b.yaw) - m.ty AS dy, b.z + b.h*(top - 0.5::DOUBLE) - m.tz AS dz
  FROM gt_boxes b CROSS JOIN {_CORNERS} CROSS JOIN (VALUES (0), (1)) t(top) CROSS JOIN rig m))
""")


@query("c6_partly_visible", f"""
SELECT token, actor_id, camera, count(*) FILTER (WHERE {_INSIDE}) AS corners_in FROM corner_pixels
GROUP BY token, actor_id, camera
HAVING count(*) FILTER (WHERE {_INSIDE}) BETWEEN 1 AND 7""")
def c6(v):
    seen = boxes.corners_seen(v.gt_boxes, rig.extrinsics(rig.mounts(v.spark)))
    return seen.groupBy("token", "actor_id", "camera").agg(
        F.sum("corners_in").alias("corners_in")).filter("corners_in BETWEEN 1 AND 7")


@query("c7_split_selection", """
SELECT token, CASE WHEN user_id % 6 = 0 THEN 'test' WHEN user_id % 5 = 0 THEN 'unknown' ELSE 'train' END AS split
FROM frames""")
def c7(v):
    users = v.table("events").select("user_id").distinct()
    named = users.filter("user_id % 6 = 0 OR user_id % 5 <> 0").select(
        F.format_string("ep_%04d", "user_id").alias("scene_token"),
        F.when(F.col("user_id") % 6 == 0, "test").otherwise("train").alias("split"))
    return v.frames.drop("split").join(named, "scene_token", "left").select(
        "token", F.coalesce("split", F.lit("unknown")).alias("split"))


@query("c10_max_boxes_guard", "SELECT count(*) AS boxes FROM gt_boxes")
def c10(v):
    return boxes.guard_max_boxes(v.gt_boxes, 500).agg(F.count(F.lit(1)).alias("boxes"))
