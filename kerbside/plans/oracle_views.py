"""The derived views again, as plain SQL text for the check engine.

``sql(body)`` puts the common table expressions a query names in front of it.
"""

from __future__ import annotations

import re


def r6(expr: str) -> str:
    """Six decimals; adding zero turns minus zero into zero."""
    return f"(round({expr}, 6) + 0.0)"


def wrap(expr: str) -> str:
    """[-pi, pi)"""
    return f"(({expr}) - 2*pi()*floor((({expr}) + pi()) / (2*pi())))"


def hyp(a: str, b: str) -> str:
    return f"sqrt(({a})*({a}) + ({b})*({b}))"


def right_of(px, py, ox, oy, oyaw):
    return f"((({px})-({ox}))*sin({oyaw}) - (({py})-({oy}))*cos({oyaw}))"


def forward_of(px, py, ox, oy, oyaw):
    return f"((({px})-({ox}))*cos({oyaw}) + (({py})-({oy}))*sin({oyaw}))"


CTES: dict[str, str] = {}

CTES["raw_frames"] = f"""
SELECT *,
  {r6("100 + 0.8*tri*cos(yaw0)")} AS x_world, {r6("50 + 0.8*tri*sin(yaw0)")} AS y_world,
  {r6("degrees(yaw0) + 3*tri")} AS yaw_deg,
  {r6("(CASE WHEN reverse THEN -1 ELSE 1 END)*speed_ms*cos(radians(round(degrees(yaw0)+3*tri,6)))")} AS vx_world,
  {r6("(CASE WHEN reverse THEN -1 ELSE 1 END)*speed_ms*sin(radians(round(degrees(yaw0)+3*tri,6)))")} AS vy_world
FROM (
  SELECT *,
    CASE WHEN frame_idx % 16 < 8 THEN frame_idx % 16 ELSE 16 - frame_idx % 16 END AS tri,
    radians((user_id*37) % 360 - 180) AS yaw0,
    printf('ep_%04d', user_id) AS scene_token,
    printf('ep_%04d', user_id) || printf('_f%04d', frame_idx) AS token,
    frame_idx*500000 AS ts_us,
    (frame_idx // 8) % 2 = 1 AS reverse,
    CASE WHEN event_id % 9 = 0 THEN 0.03::DOUBLE ELSE ((event_id*37) % 160)/100::DOUBLE END AS speed_ms,
    (((event_id*31) % 201) - 100)/100::DOUBLE AS steer,
    (((event_id*17) % 101) - 50)/100::DOUBLE AS yaw_rate,
    CASE WHEN user_id % 6 = 0 THEN 'test' ELSE 'train' END AS split,
    user_id % 7 + CASE WHEN user_id % 6 = 0 THEN 10 ELSE 0 END AS slot_idx,
    user_id % 11 <> 3 AS has_meta
  FROM (SELECT event_id, user_id,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
        FROM events))
"""

CTES["frames"] = f"""
SELECT *, x_world AS gx, 0 - y_world AS gy,
  {r6("-radians(yaw_deg)")} AS gyaw,
  {r6("cos(-radians(yaw_deg))*vx_world - sin(-radians(yaw_deg))*vy_world")} AS ego_fwd_v,
  {r6("sin(-radians(yaw_deg))*vx_world + cos(-radians(yaw_deg))*vy_world")} AS ego_right_v
FROM raw_frames
"""

CTES["scenes"] = f"""
SELECT scene_token,
  CASE WHEN user_id % 3 = 0 THEN 'reverse_parallel' ELSE 'reverse_perpendicular' END AS maneuver_type,
  CASE WHEN user_id % 3 = 0 THEN 'left'
       WHEN {right_of("lx", "ly", "fx", "fy", "fyaw")} > 0 THEN 'right' ELSE 'left' END AS side,
  CASE WHEN user_id % 3 = 0 THEN 101.0 ELSE lx END AS slot_x,
  CASE WHEN user_id % 3 = 0 THEN -51.0 ELSE ly END AS slot_y,
  CASE WHEN user_id % 3 = 0 THEN 0.3 ELSE lyaw END AS slot_yaw
FROM (SELECT scene_token, any_value(user_id) AS user_id,
        arg_min(gx, frame_idx) AS fx, arg_min(gy, frame_idx) AS fy, arg_min(gyaw, frame_idx) AS fyaw,
        arg_max(gx, frame_idx) AS lx, arg_max(gy, frame_idx) AS ly, arg_max(gyaw, frame_idx) AS lyaw
      FROM frames GROUP BY scene_token)
"""

CTES["slot_frames"] = f"""
SELECT f.*, s.maneuver_type, s.side, s.slot_x, s.slot_y, s.slot_yaw,
  {r6(right_of("slot_x", "slot_y", "gx", "gy", "gyaw"))} AS slot_r,
  {r6(forward_of("slot_x", "slot_y", "gx", "gy", "gyaw"))} AS slot_f,
  {r6(wrap("slot_yaw - gyaw"))} AS slot_dh
FROM frames f JOIN scenes s USING (scene_token)
"""

CTES["actors"] = f"""
SELECT f.event_id, f.user_id, f.scene_token, f.token, f.frame_idx, f.ts_us, f.gx, f.gy, f.gyaw, actor_id,
  CASE actor_id % 5 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'truck' ELSE 'car' END AS category,
  {r6("100 + ((actor_id*53 + user_id*7) % 240)/10::DOUBLE - 12 + CASE WHEN actor_id % 10 = 9 THEN 40.0::DOUBLE ELSE 0 END + ((actor_id % 3)*0.1::DOUBLE)*tri")} AS ax_world,
  {r6("50 + ((actor_id*29 + user_id*11) % 240)/10::DOUBLE - 12")} AS ay_world,
  (actor_id*13) % 360 + 0.5::DOUBLE AS ayaw_deg,
  {r6("(actor_id % 3)*0.1::DOUBLE")} AS avx_world, 0.0::DOUBLE AS avy_world
FROM frames f JOIN (
  SELECT DISTINCT l_orderkey % (SELECT max(event_id) + 1 FROM events) AS event_id, l_suppkey % 40 AS actor_id
  FROM lineitem) USING (event_id)
UNION ALL
SELECT f.event_id, f.user_id, f.scene_token, f.token, f.frame_idx, f.ts_us, f.gx, f.gy, f.gyaw,
  CASE WHEN across > 0 THEN 40 ELSE 41 END AS actor_id, 'car' AS category,
  {r6("slot_x + 3.1::DOUBLE*across*sin(slot_yaw)")} AS ax_world,
  {r6("-(slot_y - 3.1::DOUBLE*across*cos(slot_yaw))")} AS ay_world,
  90.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
FROM frames f JOIN scenes s USING (scene_token)
JOIN (VALUES (0, 1), (1, -1), (2, 1), (2, -1)) v(m, across) ON f.user_id % 4 = v.m
"""

_SIZE = """CASE category WHEN 'truck' THEN {t}::DOUBLE WHEN 'pedestrian' THEN {p}::DOUBLE ELSE {c}::DOUBLE END"""

CTES["all_boxes"] = f"""
SELECT event_id, user_id, scene_token, token, frame_idx, ts_us, actor_id, category,
  {r6(forward_of("ax_world", "-ay_world", "gx", "gy", "gyaw"))} AS x,
  {r6("-" + right_of("ax_world", "-ay_world", "gx", "gy", "gyaw"))} AS y,
  {_SIZE.format(t=3.0, p=1.8, c=1.6)} / 2 AS z,
  {_SIZE.format(t=2.5, p=0.6, c=2.0)} AS w, {_SIZE.format(t=7.0, p=0.6, c=4.5)} AS l,
  {_SIZE.format(t=3.0, p=1.8, c=1.6)} AS h,
  {r6(wrap("-radians(ayaw_deg) - gyaw"))} AS yaw,
  {r6("avx_world*cos(gyaw) - avy_world*sin(gyaw)")} AS vx,
  {r6("-avx_world*sin(gyaw) - avy_world*cos(gyaw)")} AS vy,
  printf('%08d', actor_id) AS instance_token
FROM actors
"""

CTES["gt_boxes"] = "SELECT * FROM all_boxes WHERE abs(x) <= 32 AND abs(y) <= 32"

CTES["objects"] = """
SELECT event_id, scene_token, frame_idx, token, actor_id AS obj_pos, category AS cls,
  0 - y AS "right", x AS forward, yaw, 0 - vy AS v_right, vx AS v_forward
FROM gt_boxes
"""

CTES["detections"] = f"""
SELECT event_id, scene_token, token, frame_idx, actor_id AS det_pos,
  {r6("x + ((event_id + actor_id) % 5 - 2)*0.3::DOUBLE")} AS x, {r6("y + 0.1::DOUBLE")} AS y, z,
  w, l, h, yaw, vx, vy, ((event_id*13 + actor_id*29) % 100)/100::DOUBLE AS score,
  CASE category WHEN 'car' THEN 0 WHEN 'truck' THEN 1 ELSE 8 END AS label
FROM gt_boxes WHERE (event_id + actor_id) % 7 <> 0 AND event_id % 50 <> 0
UNION ALL
SELECT event_id, scene_token, token, frame_idx, 99,
  {r6("((event_id*7) % 40)/2::DOUBLE - 10.2::DOUBLE")}, {r6("((event_id*11) % 40)/2::DOUBLE - 10.3::DOUBLE")}, 0.8::DOUBLE,
  2.0::DOUBLE, 4.5::DOUBLE, 1.6::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, ((event_id*17) % 100)/100::DOUBLE, 0
FROM frames WHERE event_id % 4 = 0 AND event_id % 50 <> 0
"""

_NAMES = ("['car','truck','construction_vehicle','bus','trailer','barrier','motorcycle',"
          "'bicycle','pedestrian','traffic_cone']")

CTES["det_objects"] = f"""
SELECT event_id, scene_token, frame_idx, token, det_pos AS obj_pos,
  {_NAMES}[label + 1] AS cls, 0 - y AS "right", x AS forward, yaw, 0 - vy AS v_right, vx AS v_forward, score
FROM detections WHERE score >= 0.3
"""

# six future steps per frame; past the end the last existing pose repeats
CTES["future"] = f"""
SELECT f.token, f.scene_token, f.frame_idx, f.event_id, f.reverse, k AS step,
  {r6(right_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} AS r,
  {r6(forward_of("g.gx", "g.gy", "f.gx", "f.gy", "f.gyaw"))} AS f,
  {r6(wrap("g.gyaw - f.gyaw"))} AS h
FROM (SELECT *, max(frame_idx) OVER (PARTITION BY scene_token) AS last_idx FROM frames) f
CROSS JOIN range(1, 7) t(k)
JOIN frames g ON g.scene_token = f.scene_token AND g.frame_idx = least(f.frame_idx + k, f.last_idx)
"""

CTES["paths"] = """
SELECT token, any_value(event_id) AS event_id, any_value(reverse) AS reverse,
  any_value(scene_token) AS scene_token, any_value(frame_idx) AS frame_idx,
  list(r ORDER BY step) AS rs, list(f ORDER BY step) AS fs, list(h ORDER BY step) AS hs,
  '[' || string_agg(printf('(%.2f,%.2f,%.2f)', r, f, h), ',' ORDER BY step) || ']' AS traj_str
FROM future GROUP BY token
"""


def register(name: str, text: str) -> None:
    CTES[name] = text


def _visit(text: str, seen: set[str], order: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            seen.add(name)
            _visit(CTES[name], seen, order)
            order.append(name)


def sql(body: str) -> str:
    """``body`` preceded by every view it depends on, in dependency order."""
    order: list[str] = []
    _visit(body, set(), order)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"
