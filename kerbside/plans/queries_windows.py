"""Queries for window operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.operators import boxes, windows
from kerbside.plans.oracle_views import forward_of, r6 as s6, register, right_of, wrap
from kerbside.plans.registry import query, r6

_BY = "PARTITION BY scene_token ORDER BY frame_idx"


@query("e1_token_chain", f"""
SELECT token, coalesce(lag(token) OVER ({_BY}), '') AS prev, coalesce(lead(token) OVER ({_BY}), '') AS next FROM frames""")
def e1(v):
    return windows.token_chain(v.frames.select("scene_token", "token", "frame_idx")).select("token", "prev", "next")


@query("e2_annotation_chain", """
SELECT ann, coalesce(lag(ann) OVER w, '') AS prev, coalesce(lead(ann) OVER w, '') AS next
FROM (SELECT *, token || '_' || instance_token AS ann FROM gt_boxes)
WINDOW w AS (PARTITION BY scene_token, actor_id ORDER BY frame_idx)""")
def e2(v):
    b = v.gt_boxes.select("scene_token", "token", "frame_idx", "actor_id", "instance_token")
    return windows.annotation_chain(b).select("ann", "prev", "next")


register("history", f"""
SELECT f.token, f.scene_token, f.frame_idx, k AS pos,
  CASE WHEN g.token IS NULL THEN 0 ELSE {s6(right_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} END AS r,
  CASE WHEN g.token IS NULL THEN 0 ELSE {s6(forward_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} END AS f,
  f.frame_idx - 4 + k >= 0 AS real
FROM frames f CROSS JOIN range(0, 5) t(k)
LEFT JOIN frames g ON g.scene_token = f.scene_token AND g.frame_idx = greatest(f.frame_idx - 4 + k, 0)
""")


@query("e3_history_local", "SELECT token, pos, r, f FROM history")
def e3(v):
    h = windows.history_local(v.frames, 4)
    return h.select("token", F.posexplode("his").alias("pos", "p")).select(
        "token", "pos", r6("p.r").alias("r"), r6("p.f").alias("f"))


@query("e4_history_unpadded", """
SELECT token, pos - (4 - least(frame_idx, 4)) AS pos, r, f FROM history WHERE real""")
def e4(v):
    h = windows.history_local(v.frames, 4, pad=False)
    return h.select("token", F.posexplode("his").alias("pos", "p")).select(
        "token", "pos", r6("p.r").alias("r"), r6("p.f").alias("f"))


@query("e5_future_local", "SELECT token, step, r, f, h FROM future")
def e5(v):
    return v.futures.select("token", F.posexplode("fut").alias("i", "p")).select(
        "token", (F.col("i") + 1).alias("step"), "p.r", "p.f", "p.h")


@query("e6_gt_waypoints", "SELECT token, step, r AS x, f AS y FROM future WHERE step IN (2, 4, 6)")
def e6(v):
    return v.futures.select("token", F.posexplode("fut").alias("i", "p")).filter("i IN (1, 3, 5)").select(
        "token", (F.col("i") + 1).alias("step"), F.col("p.r").alias("x"), F.col("p.f").alias("y"))


register("motion", f"""
SELECT token, {s6("(rs[5]-rs[4]) - (rs[4]-rs[3])")} AS acc_r, {s6("(fs[5]-fs[4]) - (fs[4]-fs[3])")} AS acc_f,
  {s6("rs[5]-rs[4]")} AS last_r, {s6("fs[5]-fs[4]")} AS last_f, rs, fs
FROM (SELECT token, list(r ORDER BY pos) AS rs, list(f ORDER BY pos) AS fs FROM history GROUP BY token)
""")


def rounded_history(v):
    h = windows.history_local(v.slot_frames, 4)
    return h.withColumn("his", F.transform("his", lambda p: F.struct(
        F.round(p.r, 6).alias("r"), F.round(p.f, 6).alias("f"))))


@query("e7_history_motion", "SELECT token, acc_r, acc_f, last_r, last_f FROM motion")
def e7(v):
    m = windows.history_motion(rounded_history(v))
    last = F.element_at("his_diff", -1)
    return m.select("token", r6("acc_r").alias("acc_r"), r6("acc_f").alias("acc_f"),
                    r6(last.r).alias("last_r"), r6(last.f).alias("last_f"))


@query("e8_prev_reverse", f"SELECT token, reverse, lag(reverse) OVER ({_BY}) AS prev_reverse FROM frames")
def e8(v):
    return windows.prev_reverse(v.frames.select("scene_token", "token", "frame_idx", "reverse")).select(
        "token", "reverse", "prev_reverse")


@query("e9_sdc_velocity", f"""
SELECT token, coalesce(vx, lag(vx) OVER ({_BY}), 0) AS sdc_vx, coalesce(vy, lag(vy) OVER ({_BY}), 0) AS sdc_vy FROM (
  SELECT token, scene_token, frame_idx, {s6("2*dx*cos(gyaw) + 2*dy*sin(gyaw)")} AS vx, {s6("-2*dx*sin(gyaw) + 2*dy*cos(gyaw)")} AS vy
  FROM (SELECT *, lead(gx) OVER ({_BY}) - gx AS dx, lead(gy) OVER ({_BY}) - gy AS dy FROM frames))""")
def e9(v):
    return windows.sdc_velocity(v.poses).select("token", r6("sdc_vx").alias("sdc_vx"), r6("sdc_vy").alias("sdc_vy"))


register("annotations", f"""
SELECT token, scene_token, frame_idx, ts_us, actor_id,
  {s6("gx + x*cos(gyaw) - y*sin(gyaw)")} AS cx, {s6("gy + x*sin(gyaw) + y*cos(gyaw)")} AS cy,
  {s6(wrap("yaw + gyaw"))} AS gheading
FROM gt_boxes JOIN (SELECT token, gx, gy, gyaw FROM frames) USING (token)
""")


def annotations(v):
    g = boxes.to_global(v.gt_boxes, v.poses).join(
        v.poses.select("token", F.col("gyaw").alias("ego_yaw")), "token")
    return g.select("token", "scene_token", "frame_idx", "ts_us", "actor_id", r6("cx").alias("cx"),
                    r6("cy").alias("cy"), r6(geom.wrap(F.col("yaw") + F.col("ego_yaw"))).alias("gheading"))


def _agent_sql(lo: str, hi: str, order: str) -> str:
    return f"""
SELECT a.token, a.actor_id, row_number() OVER (PARTITION BY a.token, a.actor_id ORDER BY b.ts_us {order}) AS step,
  {s6(forward_of("b.cx", "b.cy", "a.cx", "a.cy", "a.gheading"))} AS x,
  {s6("-" + right_of("b.cx", "b.cy", "a.cx", "a.cy", "a.gheading"))} AS y
FROM annotations a JOIN annotations b USING (scene_token, actor_id)
WHERE b.ts_us BETWEEN a.ts_us + {lo} AND a.ts_us + {hi}"""


@query("e10_agent_trajectories", f"""
SELECT 'future' AS part, * FROM ({_agent_sql("1", "6000000", "ASC")}) WHERE step <= 12
UNION ALL SELECT 'past', * FROM ({_agent_sql("-2000000", "-1", "DESC")}) WHERE step <= 4""")
def e10(v):
    t = windows.agent_trajectories(annotations(v))
    parts = [
        t.select(F.lit(part).alias("part"), "token", "actor_id", F.posexplode(col).alias("i", "p"))
        for part, col in (("future", "agent_future"), ("past", "agent_past"))]
    return parts[0].unionByName(parts[1]).select(
        "part", "token", "actor_id", (F.col("i") + 1).alias("step"), r6("p.x").alias("x"), r6("p.y").alias("y"))


register("plan_steps", f"""
SELECT f.token, f.scene_token, f.frame_idx, f.event_id, k AS step, {s6(forward_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} AS x,
  {s6("-" + right_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} AS y, {s6(wrap("g.gyaw - f.gyaw"))} AS yaw
FROM frames f CROSS JOIN range(1, 7) t(k)
JOIN frames g ON g.scene_token = f.scene_token AND g.frame_idx = f.frame_idx + k
""")


def plan_steps(v):
    s = windows.future_masked(v.frames, 6)
    return s.select("token", "scene_token", "frame_idx", "event_id", F.explode("steps").alias("p")).select(
        "token", "scene_token", "frame_idx", "event_id", "p.step", r6("p.x").alias("x"), r6("p.y").alias("y"),
        r6("p.yaw").alias("yaw"))


@query("e11_planning_labels", """
SELECT token, step, x, y, yaw, CASE WHEN lx >= 2 THEN 0 WHEN lx <= -2 THEN 1 ELSE 2 END AS command
FROM (SELECT *, last_value(x) OVER (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx FROM plan_steps)""")
def e11(v):
    s = windows.future_masked(v.frames, 6).withColumn("steps", F.transform("steps", lambda p: F.struct(
        p.step.alias("step"), F.round(p.x, 6).alias("x"), F.round(p.y, 6).alias("y"), F.round(p.yaw, 6).alias("yaw"))))
    last = F.try_element_at("steps", F.lit(-1))
    return s.select("token", F.explode("steps").alias("p"), windows.sdc_command(last.x).alias("command")).select(
        "token", "p.step", "p.x", "p.y", "p.yaw", "command")


@query("e12_temporal_indices", f"""
SELECT token, array_to_string(idx, ',') AS indices, list_contains(idx[1:7], -1) AS has_invalid FROM (
 SELECT token, [coalesce(lag(frame_idx, 2) OVER w, -1), coalesce(lag(frame_idx, 1) OVER w, -1), frame_idx,
  coalesce(lead(frame_idx, 1) OVER w, -1), coalesce(lead(frame_idx, 2) OVER w, -1),
  coalesce(lead(frame_idx, 3) OVER w, -1), coalesce(lead(frame_idx, 4) OVER w, -1)] AS idx
 FROM frames WINDOW w AS ({_BY}))""")
def e12(v):
    t = windows.temporal_indices(v.poses)
    return t.select("token", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"),
                    "has_invalid")


@query("e13_queue_eligible", f"""
SELECT token FROM frames WHERE frame_idx >= 4 - 1""")
def e13(v):
    reach = windows.over_scene(v.poses, 3, 0, lambda w: {"_back": F.lag("token", 3).over(w)})
    return reach.filter(F.col("_back").isNotNull()).select("token")


@query("e14_frame_ordinal", "SELECT token, frame_idx + 1 AS ordinal FROM frames WHERE frame_idx + 1 = 10")
def e14(v):
    return v.poses.select("token", (F.col("frame_idx") + 1).alias("ordinal")).filter("ordinal = 10")


@query("e15_scene_summary", """
SELECT scene_token, count(*) AS nbr_samples, arg_min(token, frame_idx) AS first_token,
  arg_max(token, frame_idx) AS last_token FROM frames GROUP BY scene_token""")
def e15(v):
    return windows.scene_summary(v.frames)


@query("e15_instance_summary", """
SELECT scene_token, instance_token, count(*) AS nbr_annotations, arg_min(token, frame_idx) AS first_token,
  arg_max(token, frame_idx) AS last_token FROM gt_boxes GROUP BY scene_token, instance_token""")
def e15_instance(v):
    return windows.instance_summary(v.gt_boxes)


register("reframed", f"""
SELECT r.token AS ref_token, k, b.actor_id,
  {s6(forward_of("wx", "wy", "r.gx", "r.gy", "r.gyaw"))} AS x,
  {s6("-" + right_of("wx", "wy", "r.gx", "r.gy", "r.gyaw"))} AS y,
  {s6(wrap("b.yaw + g.gyaw - r.gyaw"))} AS yaw, b.w, b.l, b.category
FROM frames r CROSS JOIN range(0, 5) t(k)
JOIN frames g ON g.scene_token = r.scene_token AND g.frame_idx = r.frame_idx + k
JOIN (SELECT b.*, gx + x*cos(gyaw) - y*sin(gyaw) AS wx, gy + x*sin(gyaw) + y*cos(gyaw) AS wy
      FROM gt_boxes b JOIN (SELECT token, gx, gy, gyaw FROM frames) USING (token)) b ON b.token = g.token
""")


@query("e16_reframe_boxes", "SELECT ref_token, k, actor_id, x, y, yaw FROM reframed")
def e16(v):
    b = windows.reframe_boxes(v.gt_boxes, v.poses, 4)
    return b.select("ref_token", "k", "actor_id", *[r6(n).alias(n) for n in ("x", "y", "yaw")])
