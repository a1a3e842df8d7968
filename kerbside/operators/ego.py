"""Ego pose, velocity, maneuver labels and target slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom

BAY_WIDTH = 3.0
BAY_LENGTH = 5.5


def with_dataset_pose(raw: DataFrame) -> DataFrame:
    """Simulator-world rows -> dataset-world pose and signed ego velocity."""
    xy = geom.dataset_xy(F.col("x_world"), F.col("y_world"))
    vel = geom.ego_velocity(F.col("yaw_deg"), F.col("vx_world"), F.col("vy_world"))
    return raw.select(
        "*",
        xy.x.alias("gx"), xy.y.alias("gy"),
        geom.dataset_yaw(F.col("yaw_deg")).alias("gyaw"),
        vel.forward.alias("ego_fwd_v"), vel.right.alias("ego_right_v"),
    )


def maneuver_labels(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per scene: all three labels from metadata, or all three derived.

    Derived: reverse_perpendicular, slot = last pose, side = where the slot lies
    seen from the first pose.
    """
    ends = frames.groupBy("scene_token").agg(
        F.min_by(F.struct("gx", "gy", "gyaw"), "frame_idx").alias("first"),
        F.max_by(F.struct("gx", "gy", "gyaw"), "frame_idx").alias("last"),
    )
    left = -geom.to_local(
        F.col("last.gx"), F.col("last.gy"),
        F.col("first.gx"), F.col("first.gy"), F.col("first.gyaw")).right
    given = (F.col("m.maneuver_type").isNotNull() & F.col("m.side").isNotNull()
             & F.col("m.slot_x").isNotNull())

    def pick(name: str, derived: Column) -> Column:
        return F.when(given, F.col(f"m.{name}")).otherwise(derived).alias(name)

    return ends.join(meta.alias("m"), "scene_token", "left").select(
        "scene_token",
        pick("maneuver_type", F.lit("reverse_perpendicular")),
        pick("side", side_of(-left)),
        pick("slot_x", F.col("last.gx")),
        pick("slot_y", F.col("last.gy")),
        pick("slot_yaw", F.col("last.gyaw")),
    )


def side_of(right: Column) -> Column:
    """Which side a point at lateral offset ``right`` lies on; zero counts as left."""
    return F.when(right > 0, "right").otherwise("left")


def slot_to_local(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """Attach the scene's slot as (slot_r, slot_f, slot_dh); null without a slot."""
    joined = frames.join(scenes, "scene_token", "left")
    rf = geom.to_local(F.col("slot_x"), F.col("slot_y"), F.col("gx"), F.col("gy"), F.col("gyaw"))
    return joined.select(
        "*",
        rf.right.alias("slot_r"), rf.forward.alias("slot_f"),
        geom.wrap(F.col("slot_yaw") - F.col("gyaw")).alias("slot_dh"),
    )


def dist_to_slot() -> Column:
    return geom.hypot(F.col("slot_r"), F.col("slot_f"))


def align_err() -> Column:
    return F.abs(F.col("slot_dh"))


def slot_polygon(scenes: DataFrame, width: float = BAY_WIDTH, length: float = BAY_LENGTH) -> DataFrame:
    """Corners front-left, front-right, rear-right, rear-left of every target slot."""
    corners = geom.box_corners(
        F.col("slot_x"), F.col("slot_y"), F.lit(length), F.lit(width), F.col("slot_yaw"))
    return scenes.select(
        "scene_token",
        F.posexplode(F.array(*[F.struct(c.x.alias("x"), c.y.alias("y")) for c in corners]))
        .alias("corner", "p"),
    ).select("scene_token", "corner", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def can_bus() -> Column:
    """18 doubles; position first, speed at 13, patch angle in radians and degrees last."""
    q = geom.yaw_quat(F.col("gyaw"))
    deg = F.pmod(F.degrees("gyaw"), F.lit(360.0))
    zero = F.lit(0.0)
    return F.array(
        F.col("gx"), F.col("gy"), zero, q.w, q.x, q.y, q.z,
        zero, zero, zero, zero, zero, zero, F.col("speed_ms"),
        zero, zero, F.radians(deg), deg,
    )


# ego footprint shown to the model, fixed values
EGO_LENGTH = 4.5
EGO_WIDTH = 1.8


def lcf_feature() -> Column:
    """Nine measured ego values: forward and right speed, map x and y, yaw rate,
    length, width, speed, steer.  Nothing here looks at the future."""
    return F.array(
        F.col("ego_fwd_v"), F.col("ego_right_v"), F.col("gx"), F.col("gy"), F.col("yaw_rate"),
        F.lit(EGO_LENGTH), F.lit(EGO_WIDTH), F.col("speed_ms"), F.col("steer"),
    )


def future_command(reverse: Column, final_right: Column, threshold: float = 2.0) -> Column:
    """Name of the hot entry of the [right, left, forward, reverse] command."""
    return (
        F.when(reverse, "reverse")
        .when(final_right >= threshold, "right")
        .when(final_right <= -threshold, "left")
        .otherwise("forward")
    )
