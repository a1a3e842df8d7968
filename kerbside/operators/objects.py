"""Perceived objects and the detectors that pick one of them per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.operators.boxes import class_name

VEHICLES = ["car", "truck"]


def from_boxes(boxes: DataFrame) -> DataFrame:
    """Ego boxes (x forward, y left) -> objects in (right, forward), position kept."""
    keep = [c for c in ("event_id", "scene_token", "frame_idx") if c in boxes.columns]
    return boxes.select(
        *keep, "token", F.col("actor_id").alias("obj_pos"), F.col("category").alias("cls"),
        (0.0 - F.col("y")).alias("right"), F.col("x").alias("forward"), "yaw",
        (0.0 - F.col("vy")).alias("v_right"), F.col("vx").alias("v_forward"),
    )


def from_detections(detections: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Detections below ``min_score`` dropped; missing score 1, missing label 0."""
    score = F.coalesce("score", F.lit(1.0))
    keep = [c for c in ("event_id", "scene_token", "frame_idx") if c in detections.columns]
    return detections.filter(score >= min_score).select(
        *keep, "token", F.col("det_pos").alias("obj_pos"),
        class_name(F.coalesce("label", F.lit(0))).alias("cls"),
        (0.0 - F.col("y")).alias("right"), F.col("x").alias("forward"), "yaw",
        (0.0 - F.col("vy")).alias("v_right"), F.col("vx").alias("v_forward"),
        score.alias("score"),
    )


def _pick_first(keep: Column, key: Column) -> Column:
    """Smallest key wins, the earlier object on a tie."""
    obj = F.struct("cls", "right", "forward", "obj_pos")
    return F.min_by(F.when(keep, obj), F.when(keep, F.struct(key, F.col("obj_pos"))))


def _pick_last(keep: Column, key: Column) -> Column:
    """Smallest key wins, the later object on a tie."""
    obj = F.struct("cls", "right", "forward", "obj_pos")
    return F.min_by(F.when(keep, obj), F.when(keep, F.struct(key, -F.col("obj_pos"))))


def scene_picks(frames: DataFrame, objects: DataFrame, th) -> DataFrame:
    """Every object pick of a frame in one aggregation over (frame, object) rows.

    Adds structs in_path, flank_left, flank_right, front, rear, swept (null when
    nothing qualifies) and the flag slot_occupied.  Frames carry slot_r, slot_f,
    slot_dh, reverse and, when known, ``fut`` for the swept arc.
    """
    has_path = "fut" in frames.columns
    needs = ["token", "slot_r", "slot_f", "slot_dh", "reverse"] + (["fut"] if has_path else [])
    joined = frames.select(*needs).join(
        objects.select("token", "cls", "right", "forward", "obj_pos"), "token")
    r, f = F.col("right"), F.col("forward")
    along = F.when(F.col("reverse"), -f).otherwise(f)
    off_r = th.bay_width * F.cos("slot_dh")
    off_f = th.bay_width * F.sin("slot_dh")
    d_right = geom.hypot(r - F.col("slot_r") - off_r, f - F.col("slot_f") - off_f)
    d_left = geom.hypot(r - F.col("slot_r") + off_r, f - F.col("slot_f") + off_f)
    vehicle = F.col("cls").isin(VEHICLES)
    picks = {
        "in_path": _pick_first(
            (along > 0) & (along <= th.corridor_len_stop) & (F.abs(r) <= th.corridor_half_width), along),
        "flank_left": _pick_last(vehicle & (d_left <= th.flank_radius), d_left),
        "flank_right": _pick_last(vehicle & (d_right <= th.flank_radius), d_right),
        "front": _pick_first((f > 0) & (f <= th.front_len) & (F.abs(r) <= th.front_half_width), f),
        "rear": _pick_first((-f > 0) & (-f <= th.rear_len) & (F.abs(r) <= th.rear_half_width), -f),
        "slot_occupied": F.coalesce(F.bool_or(
            geom.hypot(r - F.col("slot_r"), f - F.col("slot_f")) <= th.slot_occupied_radius), F.lit(False)),
    }
    if has_path:
        swept = F.array_min(F.transform("fut", lambda p: geom.hypot(p.r - r, p.f - f)))
        joined = joined.withColumn("_swept", swept).drop("fut")
        picks["swept"] = _pick_last(F.col("_swept") <= th.swept_radius, F.col("_swept"))
    got = joined.groupBy("token").agg(*[c.alias(n) for n, c in picks.items()])
    out = frames.join(got, "token", "left").withColumn(
        "slot_occupied", F.coalesce("slot_occupied", F.lit(False)))
    if not has_path:
        out = out.withColumn("swept", F.lit(None).cast(out.schema["front"].dataType))
    return out


def ungrounded(factors: DataFrame, objects: DataFrame, tolerance: float = 0.7) -> DataFrame:
    """Obstacle factors (token, r, f) with no object of the frame within tolerance."""
    o = objects.select(F.col("token").alias("o_token"), "right", "forward")
    near = (factors.token == o.o_token) & (
        geom.hypot(o.right - factors.r, o.forward - factors.f) <= tolerance)
    return factors.join(o, near, "left_anti")


def nearest_agents(objects: DataFrame, n: int = 5) -> DataFrame:
    """The n closest objects of every frame by bird's-eye distance."""
    from pyspark.sql import Window

    d = geom.hypot(F.col("right"), F.col("forward"))
    w = Window.partitionBy("token").orderBy("dist", "obj_pos")
    return (
        objects.withColumn("dist", d)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
    )
