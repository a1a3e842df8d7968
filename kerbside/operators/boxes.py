"""Box tables: one row per box, so every attribute stays aligned by construction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom, rig

# (length, width, height) by category, fixed values of the derived actor view
SIZES = {"car": (4.5, 2.0, 1.6), "truck": (7.0, 2.5, 3.0), "pedestrian": (0.6, 0.6, 1.8)}


def _size(category: Column, axis: int) -> Column:
    out = F.lit(SIZES["car"][axis])
    for name, dims in SIZES.items():
        if name != "car":
            out = F.when(category == name, dims[axis]).otherwise(out)
    return out


def actors_to_ego_boxes(actors: DataFrame) -> DataFrame:
    """World actors joined to their frame pose -> boxes in the ego frame.

    Size (l, w, h) becomes (w, l, h); velocity is the actor's own ground velocity
    rotated into the ego frame; the instance token is the id padded to 8 digits.
    """
    xy = geom.dataset_xy(F.col("ax_world"), F.col("ay_world"))
    at = geom.to_ego_xy(xy.x, xy.y, F.col("gx"), F.col("gy"), F.col("gyaw"))
    zero = F.lit(0.0)
    vel = geom.to_ego_xy(F.col("avx_world"), -F.col("avy_world"), zero, zero, F.col("gyaw"))
    cat = F.col("category")
    return actors.select(
        "event_id", "user_id", "scene_token", "token", "frame_idx", "ts_us", "actor_id", "category",
        at.x.alias("x"), at.y.alias("y"), (_size(cat, 2) / 2).alias("z"),
        _size(cat, 1).alias("w"), _size(cat, 0).alias("l"), _size(cat, 2).alias("h"),
        geom.wrap_closed(geom.dataset_yaw(F.col("ayaw_deg")) - F.col("gyaw")).alias("yaw"),
        vel.x.alias("vx"), vel.y.alias("vy"),
        F.format_string("%08d", "actor_id").alias("instance_token"),
    )


def within_range(df: DataFrame, limit: float) -> DataFrame:
    """Keep |x| and |y| within ``limit``; a limit of zero or less keeps everything."""
    if limit <= 0:
        return df
    return df.filter((F.abs("x") <= limit) & (F.abs("y") <= limit))


def to_global(df: DataFrame, poses: DataFrame) -> DataFrame:
    """Ego boxes -> dataset world through the rotation quaternion; size stays (w, l, h)."""
    q_ego = geom.yaw_quat(F.col("gyaw"))
    gx, gy, gz = geom.quat_rotate(q_ego, F.col("x"), F.col("y"), F.col("z"))
    q = geom.quat_mul(q_ego, geom.yaw_quat(F.col("yaw")))
    vx, vy, _ = geom.quat_rotate(q_ego, F.col("vx"), F.col("vy"), F.lit(0.0))
    return df.join(poses.select("token", "gx", "gy", "gyaw"), "token").select(
        *df.columns,
        (gx + F.col("gx")).alias("cx"), (gy + F.col("gy")).alias("cy"), gz.alias("cz"),
        q.w.alias("qw"), q.x.alias("qx"), q.y.alias("qy"), q.z.alias("qz"),
        vx.alias("gvx"), vy.alias("gvy"),
    )


def encode(df: DataFrame) -> DataFrame:
    """Regression code cx, cy, log w, log l, cz, log h, sin yaw, cos yaw, vx, vy."""
    return df.select(
        *[c for c in ("token", "actor_id", "det_pos") if c in df.columns],
        F.col("x").alias("c0"), F.col("y").alias("c1"), F.log("w").alias("c2"), F.log("l").alias("c3"),
        F.col("z").alias("c4"), F.log("h").alias("c5"), F.sin("yaw").alias("c6"), F.cos("yaw").alias("c7"),
        F.col("vx").alias("c8"), F.col("vy").alias("c9"),
    )


def decoded() -> dict[str, Column]:
    """Box columns from the code columns c0..c9, the inverse of :func:`encode`."""
    return {
        "x": F.col("c0"), "y": F.col("c1"), "z": F.col("c4"),
        "w": F.exp("c2"), "l": F.exp("c3"), "h": F.exp("c5"),
        "yaw": F.atan2("c6", "c7"), "vx": F.col("c8"), "vy": F.col("c9"),
    }


def decode(df: DataFrame) -> DataFrame:
    keys = [c for c in ("token", "actor_id", "det_pos") if c in df.columns]
    return df.select(*keys, *[c.alias(n) for n, c in decoded().items()])


def valid_objects(df: DataFrame) -> DataFrame:
    """Boxes flagged valid or with points; a NaN first velocity zeroes both components."""
    bad = F.isnan("vx")
    return df.filter(F.col("valid_flag") | (F.col("num_pts") > 0)).withColumns({
        "vx": F.when(bad, 0.0).otherwise(F.col("vx")),
        "vy": F.when(bad, 0.0).otherwise(F.col("vy")),
    })


def bev_range(df: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float) -> DataFrame:
    """Centres strictly inside a bird's-eye range, yaw wrapped to [-pi, pi)."""
    inside = (F.col("x") > x_min) & (F.col("x") < x_max) & (F.col("y") > y_min) & (F.col("y") < y_max)
    return df.filter(inside).withColumn("yaw", geom.wrap(F.col("yaw")))


def of_classes(df: DataFrame, names: list[str], column: str = "category") -> DataFrame:
    return df.filter(F.col(column).isin(names))


def guard_max_boxes(df: DataFrame, limit: int = 500, key: str = "token") -> DataFrame:
    """Fail the job if a frame holds more than ``limit`` boxes; rows pass unchanged."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = counts.withColumn(
        "_ok", F.assert_true(F.col("_n") <= limit, F.lit(f"a frame has more than {limit} boxes")))
    return df.join(checked.filter(F.col("_ok").isNull()).select(key), key, "left_semi")


# ---- corners ---------------------------------------------------------------

def bev_corners_rf(df: DataFrame) -> DataFrame:
    """Four footprint corners per box in (right, forward), exploded with their index."""
    corners = geom.box_corners(F.col("x"), F.col("y"), F.col("l"), F.col("w"), F.col("yaw"))
    packed = F.array(*[F.struct((-c.y).alias("r"), c.x.alias("f")) for c in corners])
    return df.select("*", F.posexplode(packed).alias("corner", "p")).select(
        *df.columns, "corner", F.col("p.r").alias("corner_r"), F.col("p.f").alias("corner_f"))


def corners_3d(df: DataFrame) -> DataFrame:
    """Eight corners per box: the four footprint corners at the bottom, then at the top."""
    flat = geom.box_corners(F.col("x"), F.col("y"), F.col("l"), F.col("w"), F.col("yaw"))
    packed = F.array(*[
        F.struct(c.x.alias("x"), c.y.alias("y"), (F.col("z") + F.col("h") * half).alias("z"))
        for half in (-0.5, 0.5) for c in flat
    ])
    keys = [c for c in ("token", "actor_id", "det_pos") if c in df.columns]
    return df.select(*keys, F.posexplode(packed).alias("corner", "p")).select(
        *keys, "corner", "p.x", "p.y", "p.z")


def corners_seen(df: DataFrame, cams: DataFrame) -> DataFrame:
    """token, actor_id, camera and how many of the eight ``corners_3d`` of a box its image shows, if any.

    ``cams`` has the few rows of ``rig.extrinsics``.  The corners of a batch of boxes are projected in numpy, so that
    neither a row for each corner and camera is made nor one for a camera that sees nothing of the box.
    """
    rigged = [c.asDict() for c in cams.select("camera", *rig.EXTRINSICS).collect()]
    flat = geom.box_corners(F.col("x"), F.col("y"), F.col("l"), F.col("w"), F.col("yaw"))
    parts = {**{f"x{i}": c.x for i, c in enumerate(flat)}, **{f"y{i}": c.y for i, c in enumerate(flat)},
             "z0": F.col("z") + F.col("h") * -0.5, "z1": F.col("z") + F.col("h") * 0.5}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = lambda axis, n: np.stack([b.column(f"{axis}{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)
            x, y, z = side("x", 4)[:, :, None], side("y", 4)[:, :, None], side("z", 2)[:, None, :]
            for cam in rigged:
                with np.errstate(invalid="ignore", over="ignore"):
                    seen = rig.in_image(*rig.project_arrays(x, y, z, cam)).sum(axis=(1, 2))
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [b.column("token").take(pa.array(at)), b.column("actor_id").take(pa.array(at)),
                     pa.array([cam["camera"]] * len(at), pa.string()), pa.array(seen[at], pa.int64())],
                    names=["token", "actor_id", "camera", "corners_in"])

    return df.select("token", "actor_id", *[c.alias(n) for n, c in parts.items()]).mapInArrow(
        run, "token string, actor_id long, camera string, corners_in long")


# ---- submission form -------------------------------------------------------

# detection classes in label order, fixed values
CLASS_NAMES = ["car", "truck", "construction_vehicle", "bus", "trailer",
               "barrier", "motorcycle", "bicycle", "pedestrian", "traffic_cone"]
# evaluation range in metres by class, fixed values
CLASS_RANGE = {"car": 50, "truck": 50, "bus": 50, "trailer": 50, "construction_vehicle": 50,
               "pedestrian": 40, "motorcycle": 40, "bicycle": 40, "traffic_cone": 30, "barrier": 30}
# classes kept in the tracking form, fixed values
TRACKED = ["car", "truck", "bus", "trailer", "motorcycle", "bicycle", "pedestrian"]


def class_name(label: Column) -> Column:
    """Class of a label index; an index out of range counts as car."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    inside = (label >= 0) & (label < len(CLASS_NAMES))
    return F.when(inside, F.element_at(names, (label + 1).cast("int"))).otherwise("car")


def class_range(name: Column) -> Column:
    pairs = [F.lit(x) for kv in CLASS_RANGE.items() for x in (kv[0], float(kv[1]))]
    return F.element_at(F.create_map(*pairs), name)


def detector_heading(df: DataFrame) -> DataFrame:
    """Detector yaw (measured clockwise from the y axis) -> box yaw -yaw - pi/2."""
    return df.withColumn("yaw", -F.col("yaw") - geom.PI / 2)


def to_submission(detections: DataFrame, poses: DataFrame) -> DataFrame:
    """Detections in the dataset world, boxes beyond their class range dropped."""
    named = detector_heading(detections).withColumn("name", class_name(F.col("label")))
    near = named.filter(geom.hypot(F.col("x"), F.col("y")) <= class_range(F.col("name")))
    return to_global(near, poses).withColumn(
        "attribute", attribute(F.col("name"), geom.hypot(F.col("gvx"), F.col("gvy"))))


def with_tracks(results: DataFrame, fields: list[str], speeds: list[float], steps: int = 12, period: float = 0.5) -> DataFrame:
    """``results_by_frame`` rows whose boxes hold ``fields``, ``tracking_id`` and ``predicted``: one path in the dataset world for each of ``speeds``, as a share of the box's own.

    Boxes come with det_pos, cx, cy, gvx and gvy; paths are many times wider and are made after the boxes have met their frame.
    """
    def path(box: Column, share: float) -> Column:
        return F.array(*[F.struct((box["cx"] + box["gvx"] * (share * period) * k).alias("x"),
                                  (box["cy"] + box["gvy"] * (share * period) * k).alias("y")) for k in range(1, steps + 1)])

    return results.withColumn("results", F.transform("results", lambda box: F.struct(
        box["det_pos"].cast("string").alias("tracking_id"), *[box[c].alias(c) for c in fields],
        F.array(*[path(box, s) for s in speeds]).alias("predicted"))))


def results_by_frame(submission: DataFrame, frames: DataFrame, fields: list[str], names: list[str] | None = None) -> DataFrame:
    """(token, results): the boxes of every frame as structs of ``fields``, best score first; a frame without boxes has an empty list.

    ``names`` keeps those classes only: the movable ones where tracks are given in, all for detection alone.
    """
    kept = submission if names is None else submission.filter(F.col("name").isin(names))
    row = F.struct((-F.col("score")).alias("_order"), F.col("det_pos").alias("_pos"), F.struct(*fields).alias("box"))
    per = kept.groupBy("token").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["box"]).alias("results"))
    empty = F.array().cast(per.schema["results"].dataType)
    return frames.select("token").join(per, "token", "left").select("token", F.coalesce("results", empty).alias("results"))


# attribute used when speed decides nothing, fixed values
DEFAULT_ATTRIBUTE = {
    "car": "vehicle.parked", "pedestrian": "pedestrian.moving", "trailer": "vehicle.parked",
    "truck": "vehicle.parked", "bus": "vehicle.moving", "motorcycle": "cycle.without_rider",
    "construction_vehicle": "vehicle.parked", "bicycle": "cycle.without_rider",
    "barrier": "", "traffic_cone": "",
}


def attribute(name: Column, speed: Column) -> Column:
    pairs = [F.lit(x) for kv in DEFAULT_ATTRIBUTE.items() for x in kv]
    default = F.element_at(F.create_map(*pairs), name)
    moving = (
        F.when(name.isin("car", "construction_vehicle", "bus", "truck", "trailer"), "vehicle.moving")
        .when(name.isin("bicycle", "motorcycle"), "cycle.with_rider")
        .otherwise(default)
    )
    resting = (
        F.when(name == "pedestrian", "pedestrian.standing")
        .when(name == "bus", "vehicle.stopped")
        .otherwise(default)
    )
    return F.when(speed > 0.2, moving).otherwise(resting)


# detection class -> motion group, fixed values
MOTION_GROUP = {
    "car": "car", "truck": "car", "construction_vehicle": "car", "bus": "car", "trailer": "car",
    "motorcycle": "car", "bicycle": "car", "pedestrian": "pedestrian",
    "traffic_cone": "barrier", "barrier": "barrier",
}


def category_token(name: Column) -> Column:
    """Stable token of a category; an unknown category is stored as car."""
    known = F.when(name.isin(CLASS_NAMES), name).otherwise("car")
    return F.concat(F.lit("cat_"), F.substring(F.md5(known), 1, 28))


def label_index(name: Column) -> Column:
    """Label of a class name, -1 when unknown."""
    pairs = [F.lit(x) for i, n in enumerate(CLASS_NAMES) for x in (n, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(-1))


def motion_group(name: Column) -> Column:
    pairs = [F.lit(x) for kv in MOTION_GROUP.items() for x in kv]
    return F.element_at(F.create_map(*pairs), name)
