"""Queries for detection, motion and tracking scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.operators import boxes, detection as det, tracking, windows
from kerbside.plans.oracle_views import CTES, hyp, r6 as s6, register, wrap
from kerbside.plans.queries_geometry import ATTRIBUTE_SQL
from kerbside.plans.queries_windows import annotations
from kerbside.plans.registry import query, r6

THRESHOLDS = [0.5, 1.0, 2.0, 4.0]


def truth(v):
    return v.gt_boxes.withColumn("cls", F.col("category"))


def detected(v, min_score: float = 0.0):
    return v.detections.withColumn("cls", boxes.class_name(F.col("label"))).filter(F.col("score") >= min_score)


register("ranked_det", """
SELECT *, row_number() OVER (PARTITION BY token, cls ORDER BY score DESC, det_pos DESC) AS rk,
  row_number() OVER (PARTITION BY token, cls ORDER BY score DESC, det_pos) AS rk_old
FROM (SELECT *, CASE label WHEN 0 THEN 'car' WHEN 1 THEN 'truck' ELSE 'pedestrian' END AS cls FROM detections)
""")
register("truth_ends", "SELECT ref_token AS token, actor_id, x AS fx, y AS fy FROM reframed WHERE k = 4")
register("truth_lists", """
SELECT token, category AS cls, list({'pos': actor_id, 'x': x, 'y': y, 'w': w, 'l': l, 'h': h, 'yaw': yaw, 'vx': vx, 'vy': vy,
  'fx': coalesce(fx, x), 'fy': coalesce(fy, y)} ORDER BY actor_id) AS gts
FROM gt_boxes LEFT JOIN truth_ends USING (token, actor_id) GROUP BY token, category
""")


def match_sql(thresholds: list[float], op: str, rank: str, where: str = "true", extra: str = "true") -> str:
    """Greedy matching as a recursion over the rank of a detection in its frame and class."""
    source = f"(SELECT *, row_number() OVER (PARTITION BY token, cls ORDER BY {rank}) AS k FROM ranked_det WHERE {where})"
    return f"""
SELECT token, cls, thr, det_pos, score, event_id, gt_pos, dist, d, g FROM (
WITH RECURSIVE ordered AS MATERIALIZED {source},
rec AS (
  SELECT DISTINCT token, cls, thr, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_pos, NULL::DOUBLE AS score,
    NULL::BIGINT AS event_id, NULL::BIGINT AS gt_pos, NULL::DOUBLE AS dist,
    NULL::STRUCT(w DOUBLE, l DOUBLE, h DOUBLE, yaw DOUBLE, vx DOUBLE, vy DOUBLE, x DOUBLE, y DOUBLE) AS d,
    NULL::STRUCT(pos BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, l DOUBLE, h DOUBLE, yaw DOUBLE, vx DOUBLE, vy DOUBLE, fx DOUBLE, fy DOUBLE) AS g
  FROM ordered CROSS JOIN (VALUES {", ".join(f"({t}::DOUBLE)" for t in thresholds)}) t(thr)
  UNION ALL
  SELECT token, cls, thr, k, CASE WHEN hit THEN list_append(taken, best.b.pos) ELSE taken END, det_pos, score, event_id,
    CASE WHEN hit THEN best.b.pos END, CASE WHEN hit THEN best.d END,
    {{'w': w, 'l': l, 'h': h, 'yaw': yaw, 'vx': vx, 'vy': vy, 'x': x, 'y': y}}, CASE WHEN hit THEN best.b END
  FROM (SELECT *, coalesce(best.d {op} thr, false) AND coalesce({extra}, false) AS hit FROM (
    SELECT r.token, r.cls, r.thr, o.k, r.taken, o.det_pos, o.score, o.event_id, o.w, o.l, o.h, o.yaw, o.vx, o.vy, o.x, o.y,
      list_sort(list_transform(list_filter(t.gts, lambda b: NOT list_contains(r.taken, b.pos)),
        lambda b: {{'d': sqrt((b.x - o.x)*(b.x - o.x) + (b.y - o.y)*(b.y - o.y)), 'p': b.pos, 'b': b}}))[1] AS best
    FROM rec r JOIN ordered o ON o.token = r.token AND o.cls = r.cls AND o.k = r.k + 1
    LEFT JOIN truth_lists t ON t.token = r.token AND t.cls = r.cls))
) SELECT * FROM rec WHERE k > 0)
"""


register("greedy", match_sql([2.0], "<=", "score DESC, det_pos", "score >= 0.3"))
register("conf_match", match_sql(THRESHOLDS, "<", "score DESC, det_pos DESC"))


def greedy(v):
    return det.match_frames(detected(v, 0.3), truth(v), [2.0], inclusive=True, newest_first=False)


def conf_match(v):
    """Matches by confidence at all distances, a stage table: every curve and score reads it."""
    return v.stage("conf_match", lambda: det.match_frames(detected(v), truth(v), THRESHOLDS))


@query("d16_greedy_match", f"SELECT token, cls, det_pos, gt_pos, {s6('dist')} AS dist FROM greedy")
def d16(v):
    return greedy(v).select("token", "cls", "det_pos", "gt_pos", r6("dist").alias("dist"))


@query("d17_confidence_match", f"SELECT token, cls, thr, det_pos, score, gt_pos, {s6('dist')} AS dist FROM conf_match")
def d17(v):
    return conf_match(v).select("token", "cls", "thr", "det_pos", "score", "gt_pos", r6("dist").alias("dist"))


register("errs", f"""
SELECT *, (abs(g.w - d.w) + abs(g.l - d.l) + abs(g.h - d.h))/3 AS size_err, abs({wrap("g.yaw - d.yaw")}) AS yaw_err FROM greedy
""")
_MEAN = "CASE WHEN sum(tp) > 0 THEN {e} / sum(tp) END"


@query("f9_detection_table", f"""
SELECT coalesce(cls, 'ALL') AS cls, sum(gt)::BIGINT AS gt, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, (sum(gt) - sum(tp))::BIGINT AS fn,
  {s6("CASE WHEN sum(gt) > 0 THEN sum(tp)/sum(gt)::DOUBLE ELSE 0 END")} AS recall,
  {s6("CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp)/(sum(tp) + sum(fp))::DOUBLE ELSE 0 END")} AS "precision",
  {s6(_MEAN.format(e="sum(c)"))} AS centre_err, {s6(_MEAN.format(e="sum(s)"))} AS size_err,
  {s6("degrees(" + _MEAN.format(e="sum(yy)") + ")")} AS yaw_err_deg
FROM (SELECT cls, coalesce(gt, 0) AS gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, c, s, yy
  FROM (SELECT category AS cls, count(*) AS gt FROM gt_boxes GROUP BY 1) FULL JOIN (
    SELECT cls, count(gt_pos) AS tp, count(*) - count(gt_pos) AS fp, sum(dist) AS c, sum(size_err) AS s, sum(yaw_err) AS yy
    FROM errs GROUP BY cls) USING (cls)) GROUP BY ROLLUP (cls)""")
def f9(v):
    t = det.detection_table(greedy(v), truth(v))
    return t.select("cls", "gt", "tp", "fp", "fn", *[r6(n).alias(n) for n in
                    ("recall", "precision", "centre_err", "size_err", "yaw_err_deg")])


register("curve_points", """
SELECT *, tp/(tp + fp)::DOUBLE AS prec, tp/npos::DOUBLE AS rec FROM (
SELECT cls, thr, score, rn, tp, rn - tp AS fp, npos, gt_pos, dist, d, g FROM (
  SELECT *, row_number() OVER w AS rn, count(gt_pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp
  FROM conf_match WINDOW w AS (PARTITION BY cls, thr ORDER BY score DESC, event_id DESC, det_pos DESC))
JOIN (SELECT category AS cls, count(*) AS npos FROM gt_boxes GROUP BY 1) USING (cls))
""")
register("curve", """
SELECT cls, thr, k, CASE WHEN lo IS NULL THEN hp WHEN hi IS NULL THEN CASE WHEN lr = x THEN lp ELSE 0 END
    ELSE lp + (hp - lp)*(x - lr)/(hr - lr) END AS prec,
  CASE WHEN lo IS NULL THEN hc WHEN hi IS NULL THEN CASE WHEN lr = x THEN lc ELSE 0 END
    ELSE lc + (hc - lc)*(x - lr)/(hr - lr) END AS conf
FROM (SELECT cls, thr, k, k*0.01::DOUBLE AS x,
  max(rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lo, min(rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hi,
  arg_max(prec, rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lp, arg_min(prec, rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hp,
  arg_max(rec, rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lr, arg_min(rec, rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hr,
  arg_max(score, rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lc, arg_min(score, rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hc
  FROM curve_points CROSS JOIN range(0, 101) t(k) GROUP BY cls, thr, k)
""")


def ranked(v):
    """Ranked matches, a stage table read by all curves."""
    return v.stage("ranked_hits", lambda: det.ranked_hits(conf_match(v)))


def curve(v):
    return v.stage("pr_curve", lambda: det.pr_curve(ranked(v), truth(v)))


@query("f10_pr_curve", f"SELECT cls, thr, k, {s6('prec')} AS prec, {s6('conf')} AS conf FROM curve")
def f10(v):
    return curve(v).select("cls", "thr", "k", r6("prec").alias("prec"), r6("conf").alias("conf"))


_INTER = "least(g.w, d.w)*least(g.l, d.l)*least(g.h, d.h)"
register("cum_errors", f"""
SELECT cls, thr, tp AS c, score, {", ".join(f"sum({e}) OVER (PARTITION BY cls, thr ORDER BY tp ROWS UNBOUNDED PRECEDING)/tp AS {n}" for n, e in (
    ("trans_err", "dist"), ("scale_err", f"1 - {_INTER}/(g.w*g.l*g.h + d.w*d.l*d.h - {_INTER})"),
    ("orient_err", "abs(" + wrap("g.yaw - d.yaw") + ")"), ("vel_err", "sqrt((g.vx-d.vx)*(g.vx-d.vx) + (g.vy-d.vy)*(g.vy-d.vy))")))}
FROM curve_points WHERE gt_pos IS NOT NULL
""")
_ERRS = list(det.ERRORS)
register("error_curve", f"""
SELECT p.cls, p.thr, k, conf, {", ".join(f"CASE WHEN above >= 1 AND above < total THEN lo.{n} + (hi.{n} - lo.{n})*(conf - lo.score)/(hi.score - lo.score) ELSE lo.{n} END AS {n}" for n in _ERRS)}
FROM (SELECT u.cls, u.thr, u.k, u.conf, count(m.c) FILTER (WHERE m.score > u.conf) AS above, count(m.c) AS total
      FROM curve u JOIN cum_errors m ON m.cls = u.cls AND m.thr = u.thr GROUP BY ALL) p
JOIN cum_errors lo ON lo.cls = p.cls AND lo.thr = p.thr AND lo.c = least(above + 1, total)
LEFT JOIN cum_errors hi ON hi.cls = p.cls AND hi.thr = p.thr AND hi.c = above
""")


def error_curve(v):
    return det.tp_error_curve(ranked(v), curve(v))


@query("f11_tp_error_curve", f"""SELECT cls, thr, k, {", ".join(f"{s6(n)} AS {n}" for n in _ERRS)} FROM error_curve""")
def f11(v):
    return error_curve(v).select("cls", "thr", "k", *[r6(n).alias(n) for n in _ERRS])


register("ap_rows", """
SELECT cls, thr, avg(greatest(0, prec - 0.1))/0.9 AS ap FROM curve WHERE k >= 11 GROUP BY cls, thr""")
register("tp_rows", f"""
SELECT cls, thr, {", ".join(f"coalesce(avg({n}) FILTER (WHERE k >= 11 AND k <= last_k), 1.0) AS {n}" for n in _ERRS)}
FROM (SELECT *, max(k) FILTER (WHERE conf <> 0) OVER (PARTITION BY cls, thr) AS last_k FROM error_curve) GROUP BY cls, thr""")


@query("f12_average_precision", f"SELECT cls, thr, {s6('ap')} AS ap FROM ap_rows")
def f12(v):
    return det.average_precision(curve(v)).select("cls", "thr", r6("ap").alias("ap"))


@query("f12_detection_score", f"""
SELECT {s6("map")} AS map, {", ".join(f"{s6(n)} AS {n}" for n in _ERRS)},
  {s6("(map*4 + " + " + ".join(f"1 - least(1, {n})" for n in _ERRS) + ")/8")} AS score
FROM (SELECT avg(ap) AS map FROM ap_rows) CROSS JOIN (SELECT {", ".join(f"avg({n}) AS {n}" for n in _ERRS)} FROM tp_rows WHERE thr = 2)""")
def f12_score(v):
    s = det.detection_score(det.average_precision(curve(v)), det.tp_scores(error_curve(v)))
    return s.select(*[r6(c).alias(c) for c in s.columns])


# ---- the score over five errors, on the boxes that are to be scored ---------------------------------

_WANTED = "(event_id + actor_id) % 5 <> 0"


def scored_truth(v):
    """Truth in the range of its class whose annotation is in a set of ids, with its attribute."""
    wanted = v.gt_boxes.filter(_WANTED).select(F.concat_ws("_", "token", "actor_id").alias("annotation"))
    named = truth(v).withColumn("annotation", F.concat_ws("_", "token", "actor_id"))
    speed = 3 * geom.hypot(F.col("vx"), F.col("vy"))
    return det.of_annotations(det.in_class_range(named), wanted).withColumn(
        "attr", F.when(F.col("actor_id") % 11 == 0, "").otherwise(boxes.attribute(F.col("cls"), speed)))


def scored_detections(v):
    """Detections in the range of their class; a detector believes in a speed as far as in its box."""
    speed = 3 * geom.hypot(F.col("vx"), F.col("vy")) * F.col("score")
    return det.in_class_range(detected(v)).withColumn("attr", boxes.attribute(F.col("cls"), speed))


def _attribute_sql(speed: str) -> str:
    return ATTRIBUTE_SQL.replace("speed", speed).replace("name", "cls")


_SPEED = "3*sqrt(vx*vx + vy*vy)"
register("scored_gt", f"""
SELECT *, CASE WHEN actor_id % 11 = 0 THEN '' ELSE {_attribute_sql(_SPEED)} END AS attr FROM (SELECT *, category AS cls FROM gt_boxes)
WHERE {_WANTED} AND sqrt(x*x + y*y) < CASE cls WHEN 'pedestrian' THEN {boxes.CLASS_RANGE['pedestrian']} ELSE {boxes.CLASS_RANGE['car']} END""")
register("scored_det", f"""
SELECT *, {_attribute_sql(_SPEED + "*score")} AS attr, row_number() OVER (PARTITION BY token, cls ORDER BY score DESC, det_pos DESC) AS rk FROM (
  SELECT *, CASE label WHEN 0 THEN 'car' WHEN 1 THEN 'truck' ELSE 'pedestrian' END AS cls FROM detections)
WHERE sqrt(x*x + y*y) < CASE cls WHEN 'pedestrian' THEN {boxes.CLASS_RANGE['pedestrian']} ELSE {boxes.CLASS_RANGE['car']} END""")
register("scored_lists", """
SELECT token, cls, list({'pos': actor_id, 'x': x, 'y': y, 'w': w, 'l': l, 'h': h, 'yaw': yaw, 'vx': vx, 'vy': vy, 'fx': x, 'fy': y} ORDER BY actor_id) AS gts
FROM scored_gt GROUP BY token, cls""")
register("scored_match", match_sql(THRESHOLDS, "<", "score DESC, det_pos DESC").replace("ranked_det", "scored_det").replace("truth_lists", "scored_lists"))


def _scored(name: str) -> str:
    """A view of the whole score, on the boxes that are to be scored."""
    text = CTES[name]
    for old, new in (("conf_match", "scored_match"), ("curve_points", "scored_points"), ("cum_errors", "scored_cum"), ("error_curve", "scored_errors"),
                     ("FROM curve CROSS", "FROM scored_curve CROSS"), ("FROM curve u", "FROM scored_curve u"), ("FROM curve WHERE", "FROM scored_curve WHERE"),
                     ("SELECT category AS cls, count(*) AS npos FROM gt_boxes", "SELECT cls, count(*) AS npos FROM scored_gt")):
        text = text.replace(old, new)
    return text


register("scored_points", _scored("curve_points").replace("npos, gt_pos, dist, d, g\n", "npos, gt_pos, dist, d, g, token, det_pos\n").replace("dist, d, g FROM", "dist, d, g, token, det_pos FROM"))
register("scored_curve", _scored("curve"))
register("scored_cum", f"""
SELECT c.*, CASE WHEN max(has) OVER (PARTITION BY c.cls, c.thr) = 0 THEN 1.0 ELSE coalesce(sum(attr) OVER w/nullif(sum(has) OVER w, 0), 0.0) END AS attr_err
FROM ({_scored("cum_errors")}) c JOIN (
  SELECT p.cls, p.thr, p.tp AS c, CASE WHEN g.attr = '' THEN 0 ELSE 1 END AS has, CASE WHEN g.attr <> '' AND g.attr <> d.attr THEN 1.0 ELSE 0.0 END AS attr
  FROM scored_points p JOIN scored_gt g ON g.token = p.token AND g.actor_id = p.gt_pos JOIN scored_det d ON d.token = p.token AND d.det_pos = p.det_pos AND d.cls = p.cls
  WHERE p.gt_pos IS NOT NULL) a ON a.cls = c.cls AND a.thr = c.thr AND a.c = c.c
WINDOW w AS (PARTITION BY c.cls, c.thr ORDER BY c.c ROWS UNBOUNDED PRECEDING)""")
_FIVE = list(det.FIVE_ERRORS)
register("scored_errors", _scored("error_curve").replace("FROM (SELECT u.cls", ", CASE WHEN above >= 1 AND above < total THEN lo.attr_err + (hi.attr_err - lo.attr_err)*(conf - lo.score)/(hi.score - lo.score) ELSE lo.attr_err END AS attr_err\nFROM (SELECT u.cls"))
register("scored_ap", _scored("ap_rows"))
register("scored_tp", f"""
SELECT cls, thr, {", ".join(f"coalesce(avg({n}) FILTER (WHERE k >= 11 AND k <= last_k), 1.0) AS {n}" for n in _FIVE)}
FROM (SELECT *, max(k) FILTER (WHERE conf <> 0) OVER (PARTITION BY cls, thr) AS last_k FROM scored_errors) GROUP BY cls, thr""")


@query("c4_annotation_ids", "SELECT token, actor_id, cls, attr FROM scored_gt")
def c4_ids(v):
    return scored_truth(v).select("token", "actor_id", "cls", "attr")


@query("f12_score_five_errors", f"""
SELECT {s6("map")} AS map, {", ".join(f"{s6(n)} AS {n}" for n in _FIVE)}, {s6("(map*5 + " + " + ".join(f"1 - least(1, {n})" for n in _FIVE) + ")/10")} AS score
FROM (SELECT avg(ap) AS map FROM scored_ap) CROSS JOIN (SELECT {", ".join(f"avg({n}) AS {n}" for n in _FIVE)} FROM scored_tp WHERE thr = 2)""")
def f12_five(v):
    t = scored_truth(v)
    keep = ("w", "l", "h", "yaw", "vx", "vy", "attr")
    matches = v.stage("scored_match", lambda: det.match_frames(scored_detections(v), t, THRESHOLDS, payload=keep))
    hits = v.stage("scored_ranked", lambda: det.ranked_hits(matches))
    points = v.stage("scored_curve", lambda: det.pr_curve(hits, t))
    errors = det.tp_error_curve(hits, points, det.FIVE_ERRORS)
    s = det.detection_score(det.average_precision(points), det.tp_scores(errors, names=det.FIVE_ERRORS), names=det.FIVE_ERRORS)
    return s.select(*[r6(c).alias(c) for c in s.columns])


# ---- motion: end point after two seconds, three speeds as modes ------------------------------

@query("d18_motion_match", f"""
SELECT token, cls, thr, det_pos, gt_pos FROM motion_match""")
def d18(v):
    return motion_match(v).select("token", "cls", "thr", "det_pos", "gt_pos")


def motion_truth(v):
    """Truth boxes with where the actor really is two seconds (four frames) later; one that left stays where it is."""
    ahead = windows.reframe_boxes(v.gt_boxes, v.poses, 4).filter("k = 4").select(
        F.col("ref_token").alias("token"), "actor_id", r6("x").alias("fx"), r6("y").alias("fy"))
    return truth(v).join(ahead, ["token", "actor_id"], "left").withColumns({"fx": F.coalesce("fx", "x"), "fy": F.coalesce("fy", "y")})


def motion_match(v):
    """Match at 1 and 2 m where the best mode also ends within 2 m of the truth's end."""
    def reaches(p, g):
        gaps = [(p["x"] + s * 2 * p["vx"] - g["fx"], p["y"] + s * 2 * p["vy"] - g["fy"]) for s in (0.5, 1.0, 1.5)]
        return np.fmin.reduce([np.sqrt(a * a + b * b) for a, b in gaps]) < 2.0

    def make():
        d = detected(v).withColumns({"fx": F.col("x") + 2 * F.col("vx"), "fy": F.col("y") + 2 * F.col("vy")})
        return det.match_frames(d, motion_truth(v), [1.0, 2.0], extra=reaches, payload=keep)

    keep = ("w", "l", "h", "yaw", "vx", "vy", "fx", "fy")
    return v.stage("motion_match", make)


_REACH = "least(" + ", ".join(
    f"sqrt(power(x + {s}*2*vx - best.b.fx, 2) + power(y + {s}*2*vy - best.b.fy, 2))"
    for s in ("0.5::DOUBLE", "1.0::DOUBLE", "1.5::DOUBLE")) + ") < 2"
register("motion_match", match_sql([1.0, 2.0], "<", "score DESC, det_pos DESC", extra=_REACH))


@query("f13_motion_map", f"""
SELECT cls, {s6("avg(greatest(0, prec - 0.1))/0.9")} AS ap FROM (
SELECT cls, k, CASE WHEN lo IS NULL THEN hp WHEN hi IS NULL THEN CASE WHEN lr = x THEN lp ELSE 0 END
    ELSE lp + (hp - lp)*(x - lr)/(hr - lr) END AS prec
FROM (SELECT cls, k, k*0.01::DOUBLE AS x,
  max(rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lo, min(rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hi,
  arg_max(prec, rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lp, arg_min(prec, rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hp,
  arg_max(rec, rn) FILTER (WHERE rec <= k*0.01::DOUBLE) AS lr, arg_min(rec, rn) FILTER (WHERE rec > k*0.01::DOUBLE) AS hr
  FROM (SELECT cls, rn, tp/rn::DOUBLE AS prec, tp/npos::DOUBLE AS rec FROM (
    SELECT cls, row_number() OVER w AS rn, count(gt_pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM motion_match WHERE thr = 1
    WINDOW w AS (PARTITION BY cls ORDER BY score DESC, event_id DESC, det_pos DESC))
    JOIN (SELECT category AS cls, count(*) AS npos FROM gt_boxes GROUP BY 1) USING (cls))
  CROSS JOIN range(0, 101) t(k) GROUP BY cls, k)) WHERE k >= 11 GROUP BY cls""")
def f13(v):
    m = motion_match(v).filter("thr = 1.0")
    return det.average_precision(det.pr_curve(det.ranked_hits(m), truth(v))).select("cls", r6("ap").alias("ap"))


@query("f14_epa", f"""
SELECT cls, gt, tp, fp, {s6("(tp - 0.5*fp)/(gt + 1e-5)")} AS epa FROM (
  SELECT category AS cls, count(*) AS gt FROM gt_boxes GROUP BY 1)
JOIN (SELECT cls, count(gt_pos) AS tp FROM motion_match WHERE thr = 2 GROUP BY 1) USING (cls)
JOIN (SELECT cls, count(*) - count(gt_pos) AS fp FROM conf_match WHERE thr = 2 GROUP BY 1) USING (cls)""")
def f14(v):
    e = det.epa(motion_match(v), conf_match(v), truth(v))
    return e.select("cls", "gt", "tp", "fp", r6("epa").alias("epa"))


register("mode_gaps", f"""
SELECT token, actor_id, s, b.frame_idx - a.frame_idx AS step,
  sqrt(power(a.cx + s*0.1::DOUBLE*(b.frame_idx - a.frame_idx) - b.cx, 2) + power(a.cy - b.cy, 2)) AS gap
FROM annotations a JOIN (SELECT scene_token, actor_id, frame_idx, cx, cy FROM annotations) b USING (scene_token, actor_id)
CROSS JOIN (VALUES (0), (1), (2)) m(s)
WHERE b.frame_idx BETWEEN a.frame_idx + 1 AND a.frame_idx + 12
""")


@query("f15_min_ade_fde", f"""
SELECT {s6("avg(a)")} AS min_ade, {s6("avg(f)")} AS min_fde, {s6("avg(CASE WHEN m > 2 THEN 1.0 ELSE 0.0 END)")} AS miss_rate, count(*) AS n
FROM (SELECT token, actor_id, min(ade) AS a, min(fde) AS f, min(far) AS m FROM (
  SELECT token, actor_id, s, avg(gap) AS ade, arg_max(gap, step) AS fde, max(gap) AS far FROM mode_gaps GROUP BY ALL) GROUP BY ALL)""")
def f15(v):
    a = annotations(v)
    ahead = windows.over_scene(a, 0, 12, lambda w: {"_next": F.collect_list(F.struct("frame_idx", "cx", "cy")).over(
        w.rangeBetween(1, 12))}, group=("scene_token", "actor_id"))
    # three modes: standing, and drifting along x at 0.2 and 0.4 m/s, at the steps that exist
    modes = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda s: F.transform("_next", lambda p: F.struct(
        (F.col("cx") + s * 0.1 * (p["frame_idx"] - F.col("frame_idx"))).alias("x"), F.col("cy").alias("y"))))
    path = F.transform("_next", lambda p: F.struct(p["cx"].alias("x"), p["cy"].alias("y")))
    e = det.mode_errors(ahead.select("token", "actor_id", modes.alias("modes"), path.alias("truth")))
    return e.agg(r6(F.avg("min_ade")).alias("min_ade"), r6(F.avg("min_fde")).alias("min_fde"),
                 r6(F.avg("miss")).alias("miss_rate"), F.count("min_ade").alias("n"))


_TRIED = ", ".join(f"{0.3 * 0.9}::DOUBLE" + "*0.9::DOUBLE" * i for i in range(32) if 0.3 * 0.9 ** (i + 1) >= 0.01)


@query("c9_topk_decode", f"""
SELECT token, query, label, {s6("score")} AS score FROM (
 SELECT *, max(score) OVER (PARTITION BY token) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, query, label) AS rank FROM (
    SELECT token, det_pos AS query, c AS label, x, y, 1/(1 + exp(-((event_id*(7 + c*3) + det_pos*(11 + c)) % 97 - 88)/8.0::DOUBLE)) AS score
    FROM detections CROSS JOIN range(0, 3) t(c))) WHERE rank <= 300)
WHERE abs(x) <= 25 AND abs(y) <= 25 AND CASE WHEN best > 0.3 THEN score > 0.3
  ELSE score >= coalesce(list_max(list_filter([{_TRIED}], lambda t: t <= best)), -1) END""")
def c9(v):
    e, p = F.col("event_id"), F.col("det_pos")
    logits = v.detections.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "token", p.alias("query"), "label", "x", "y",
        (((e * (7 + F.col("label") * 3) + p * (11 + F.col("label"))) % 97 - 88) / 8.0).alias("logit"))
    return det.topk_decode(logits, 300, 0.3, 25.0).select("token", "query", "label", r6("score").alias("score"))


@query("f21_tracking_metrics", f"""
SELECT gt, tp, fp, gt - tp AS fn, ids, frag, mt, ml, {s6("motp")} AS motp, {s6("tid")} AS tid, {s6("fp/frames_n::DOUBLE")} AS faf,
  {s6("tp/gt::DOUBLE")} AS recall, {s6("greatest(0, 1 - (fp + gt - tp + ids)/gt::DOUBLE)")} AS mota
FROM (SELECT count(gt_pos) AS tp, count(*) - count(gt_pos) AS fp, avg(dist) AS motp, count(DISTINCT token) AS frames_n FROM greedy)
CROSS JOIN (SELECT count(*) AS ids FROM (SELECT det_pos, lag(det_pos) OVER (PARTITION BY scene_token, gt_pos ORDER BY frame_idx) AS p
  FROM greedy JOIN (SELECT token, scene_token, frame_idx FROM frames) USING (token) WHERE gt_pos IS NOT NULL) WHERE p <> det_pos)
CROSS JOIN (SELECT sum(n)::BIGINT AS gt, count(*) FILTER (WHERE h/n::DOUBLE >= 0.8) AS mt, count(*) FILTER (WHERE h/n::DOUBLE <= 0.2) AS ml,
    avg(first_hit - start)*0.5 AS tid
  FROM (SELECT scene_token, actor_id, count(*) AS n, sum(hit) AS h, min(frame_idx) AS start, min(frame_idx) FILTER (WHERE hit = 1) AS first_hit FROM covered GROUP BY ALL))
CROSS JOIN (SELECT count(*) AS frag FROM (SELECT hit, lag(hit) OVER (PARTITION BY scene_token, actor_id ORDER BY frame_idx) AS p FROM covered) WHERE hit = 0 AND p = 1)""")
def f21(v):
    keys = v.frames.select("token", "scene_token", "frame_idx")
    m = greedy(v).join(keys, "token")
    t = det.tracking_summary(m, truth(v))
    return t.select("gt", "tp", "fp", "fn", "ids", "frag", "mt", "ml",
                    *[r6(n).alias(n) for n in ("motp", "tid", "faf", "recall", "mota")])


register("covered", """
SELECT b.scene_token, b.actor_id, b.frame_idx, CASE WHEN m.gt_pos IS NULL THEN 0 ELSE 1 END AS hit
FROM gt_boxes b LEFT JOIN (SELECT token, gt_pos FROM greedy WHERE gt_pos IS NOT NULL) m ON m.token = b.token AND m.gt_pos = b.actor_id
""")


register("track_cuts", """
SELECT c.cls, c.npos, c.cut, lo.score + (hi.score - lo.score)*((c.at % 390)/390.0::DOUBLE) AS cut_score
FROM (SELECT cls, npos, cut, (39 + 9*cut)*npos AS at FROM (SELECT cls, npos, max(tp) AS top FROM curve_points WHERE thr = 2 GROUP BY cls, npos)
  CROSS JOIN range(0, 40) t(cut) WHERE (39 + 9*cut)*npos <= 390*top) c
JOIN curve_points lo ON lo.cls = c.cls AND lo.thr = 2 AND lo.gt_pos IS NOT NULL AND lo.tp = greatest(c.at // 390, 1)
JOIN curve_points hi ON hi.cls = c.cls AND hi.thr = 2 AND hi.gt_pos IS NOT NULL
  AND hi.tp = CASE WHEN c.at % 390 > 0 THEN c.at // 390 + 1 ELSE greatest(c.at // 390, 1) END
""")
register("track_hits", """
SELECT m.cls, c.cut, b.scene_token, b.actor_id, b.p, b.n, m.det_pos,
  lag(m.det_pos) OVER w AS before, lag(b.p) OVER w AS before_p
FROM conf_match m JOIN track_cuts c ON c.cls = m.cls AND m.score >= c.cut_score
JOIN (SELECT token, category, scene_token, actor_id, row_number() OVER (PARTITION BY scene_token, actor_id, category ORDER BY frame_idx) - 1 AS p,
  count(*) OVER (PARTITION BY scene_token, actor_id, category) AS n FROM gt_boxes) b ON b.token = m.token AND b.actor_id = m.gt_pos AND b.category = m.cls
WHERE m.thr = 2 WINDOW w AS (PARTITION BY m.cls, c.cut, b.scene_token, b.actor_id ORDER BY b.p)
""")
register("tracking_curve", """
SELECT *, gt - tp AS fn, greatest(0, 1 - (fp + gt - tp + ids)/gt::DOUBLE) AS mota, greatest(0, 1 - (fp + ids)/tp::DOUBLE) AS motar, tp/gt::DOUBLE AS recall,
  100*fp/(SELECT count(*) FROM frames)::DOUBLE AS faf
FROM (SELECT c.cls, c.cut, c.cut_score AS score, c.npos AS gt, count(m.gt_pos) AS tp, count(*) - count(m.gt_pos) AS fp, avg(m.dist) AS motp
  FROM track_cuts c JOIN conf_match m ON m.cls = c.cls AND m.thr = 2 AND m.score >= c.cut_score GROUP BY ALL)
JOIN (SELECT cls, cut, sum(ids)::BIGINT AS ids, sum(frag)::BIGINT AS frag, count(*) FILTER (WHERE h/n::DOUBLE >= 0.8) AS mt,
    any_value(tracks) - count(*) FILTER (WHERE h/n::DOUBLE > 0.2) AS ml, avg(start)*0.5 AS tid, avg(gap)*0.5 AS lgd
  FROM (SELECT cls, cut, scene_token, actor_id, n, count(*) AS h, count(*) FILTER (WHERE before <> det_pos) AS ids,
      count(*) FILTER (WHERE p - before_p > 1) AS frag, min(p) AS start, greatest(max(p - coalesce(before_p, -1) - 1), n - 1 - max(p)) AS gap
    FROM track_hits GROUP BY cls, cut, scene_token, actor_id, n)
  JOIN (SELECT category AS cls, count(*) AS tracks FROM (SELECT DISTINCT category, scene_token, actor_id FROM gt_boxes) GROUP BY 1) USING (cls)
  GROUP BY cls, cut) USING (cls, cut)
""")
_RATES = ", ".join(f"{s6(n)} AS {n}" for n in tracking.MEANS)


def track_curve(v):
    near = f"thr = {tracking.NEAR}"
    return tracking.tracking_curve(conf_match(v).filter(near), ranked(v).filter(near), truth(v), v.frames)


@query("f21_recall_curve", f"SELECT cls, cut, {s6('score')} AS score, {', '.join(tracking.SUMS)}, {_RATES} FROM tracking_curve")
def f21_curve(v):
    c = track_curve(v)
    return c.select("cls", "cut", r6("score").alias("score"), *tracking.SUMS, *[r6(n).alias(n) for n in tracking.MEANS])


@query("f21_amota", f"""
SELECT coalesce(cls, 'ALL') AS cls, {s6("avg(amota)")} AS amota, {s6("avg(amotp)")} AS amotp,
  {", ".join(f"sum({n})::BIGINT AS {n}" for n in tracking.SUMS)}, {", ".join(f"{s6(f'avg({n})')} AS {n}" for n in tracking.MEANS)}
FROM (SELECT t.cls, coalesce(a.amota, 0) AS amota, coalesce(a.amotp, 2) AS amotp, {", ".join(f"b.{n} AS {n}" for n in (*tracking.SUMS, *tracking.MEANS))}
  FROM (SELECT DISTINCT category AS cls FROM gt_boxes) t LEFT JOIN (
    SELECT cls, sum(motar)/40 AS amota, (sum(motp) + 2.0*(40 - count(*)))/40 AS amotp FROM tracking_curve GROUP BY cls) a ON a.cls = t.cls
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY mota DESC, cut) AS rk FROM tracking_curve) WHERE rk = 1) b ON b.cls = t.cls)
GROUP BY ROLLUP (cls)""")
def f21_amota(v):
    s = tracking.tracking_scores(track_curve(v), truth(v))
    return s.select("cls", r6("amota").alias("amota"), r6("amotp").alias("amotp"), *tracking.SUMS, *[r6(n).alias(n) for n in tracking.MEANS])


@query("f29_pair_iou")
def f29(v):
    return det.pair_iou(v.gt_boxes, v.detections).filter("iou > 0").select(
        "token", "a_pos", "b_pos", r6("inter").alias("inter"), r6("iou").alias("iou"))


@query("f30_volume_per_class", """
SELECT token, cls, coalesce(gt, 0) AS gt, coalesce(detected, 0) AS detected
FROM (SELECT token, category AS cls, count(*) AS gt FROM gt_boxes GROUP BY ALL) FULL JOIN
  (SELECT token, cls, count(*) AS detected FROM ranked_det WHERE score >= 0.3 GROUP BY ALL) USING (token, cls)""")
def f30(v):
    g = truth(v).groupBy("token", "cls").agg(F.count(F.lit(1)).alias("gt"))
    d = detected(v, 0.3).groupBy("token", "cls").agg(F.count(F.lit(1)).alias("detected"))
    return g.join(d, ["token", "cls"], "full").na.fill(0, ["gt", "detected"])


@query("a12_submission", f"""
SELECT f.token, count(s.det_pos) AS boxes, {s6("coalesce(sum(s.score), 0)")} AS score_sum,
  coalesce(string_agg(s.det_pos || ':' || s.name || ':' || {ATTRIBUTE_SQL}, ',' ORDER BY s.det_pos), '') AS rows
FROM frames f LEFT JOIN submission s ON s.token = f.token GROUP BY f.token""")
def a12(v):
    s = boxes.to_submission(v.detections, v.poses).filter(F.col("name").isin(boxes.TRACKED))
    per = s.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(
        "det_pos", "name", "attribute", "score", "cx", "cy", "cz", "w", "l", "h", "qw", "qx", "qy", "qz",
        "gvx", "gvy"))).alias("results"))
    full = v.frames.select("token").join(per, "token", "left")
    rows = F.transform("results", lambda r: F.concat_ws(":", r["det_pos"].cast("string"), r["name"], r["attribute"]))
    return full.select(
        "token", F.when(F.col("results").isNull(), 0).otherwise(F.size("results")).cast("long").alias("boxes"),
        r6(F.coalesce(F.aggregate("results", F.lit(0.0), lambda a, r: a + r["score"]), F.lit(0.0))).alias("score_sum"),
        F.coalesce(F.array_join(rows, ","), F.lit("")).alias("rows"))


_SHARES = [0.5, 1.0, 1.5]


@query("a12_tracked_results", f"""
SELECT f.token, count(s.det_pos) AS boxes, coalesce(string_agg(s.det_pos::VARCHAR, ',' ORDER BY s.score DESC, s.det_pos), '') AS ids,
  {s6("coalesce(sum(cx + gvx*9), 0)")} AS fast_x, {s6("coalesce(sum(cy + gvy*3), 0)")} AS slow_y FROM frames f LEFT JOIN submission s ON s.token = f.token GROUP BY f.token""")
def a12_tracked(v):
    """Movable classes with tracking ids and three predicted paths of six seconds."""
    fields = ["name", "attribute", "score", "cx", "cy", "cz"]
    held = boxes.results_by_frame(boxes.to_submission(v.detections, v.poses), v.frames, ["det_pos", *fields, "gvx", "gvy"], boxes.TRACKED)
    out = boxes.with_tracks(held, fields, _SHARES)
    end = lambda mode, axis: F.aggregate(F.transform("results", lambda r: F.element_at(r["predicted"][mode], -1)[axis]), F.lit(0.0), lambda a, b: a + b)
    return out.select("token", F.size("results").cast("long").alias("boxes"), F.array_join(F.transform("results", lambda r: r["tracking_id"]), ",").alias("ids"),
                      r6(end(2, "x")).alias("fast_x"), r6(end(0, "y")).alias("slow_y"))


@query("a12_detection_results", f"""
SELECT f.token, count(s.det_pos) AS boxes, coalesce(string_agg(s.name || ':' || {ATTRIBUTE_SQL}, ',' ORDER BY s.score DESC, s.det_pos), '') AS rows
FROM frames f LEFT JOIN submission s ON s.token = f.token GROUP BY f.token""")
def a12_detection(v):
    """The variant for detection alone: all classes, no tracks."""
    out = boxes.results_by_frame(boxes.to_submission(v.detections, v.poses), v.frames, ["name", "attribute", "score", "cx", "cy", "cz", "w", "l", "h", "gvx", "gvy"])
    return out.select("token", F.size("results").cast("long").alias("boxes"),
                      F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["name"], r["attribute"])), ",").alias("rows"))
