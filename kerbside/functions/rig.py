"""The six-camera rig as a fixed table and its projection columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geom

IMAGE_WIDTH, IMAGE_HEIGHT = 1600, 900
FOV_DEG = 70.0
FOCAL = IMAGE_WIDTH / (2 * math.tan(math.radians(FOV_DEG / 2)))

# camera, mount x forward, y right, z up in metres, yaw clockwise in degrees; fixed values
MOUNTS = [
    ("CAM_FRONT", 1.5, 0.0, 1.5, 0.0),
    ("CAM_FRONT_LEFT", 1.0, -0.9, 1.5, -55.0),
    ("CAM_FRONT_RIGHT", 1.0, 0.9, 1.5, 55.0),
    ("CAM_BACK", -1.5, 0.0, 1.5, 180.0),
    ("CAM_BACK_LEFT", -1.0, -0.9, 1.5, -110.0),
    ("CAM_BACK_RIGHT", -1.0, 0.9, 1.5, 110.0),
]


def mounts(spark: SparkSession) -> DataFrame:
    """One row per camera: six rows by definition, safe to broadcast."""
    return spark.createDataFrame(MOUNTS, "camera string, mx double, my double, mz double, myaw double")


def extrinsics(df: DataFrame) -> DataFrame:
    """Camera axes in the ego frame: optical z looks along the mount yaw, x to its
    right, y down; position is (x, -y, z)."""
    a = -F.radians("myaw")
    zero = F.lit(0.0)
    return df.withColumns({
        "tx": F.col("mx"), "ty": -F.col("my"), "tz": F.col("mz"),
        # columns of the camera-to-ego rotation: x (right), y (down), z (ahead)
        "r00": F.sin(a), "r01": zero, "r02": F.cos(a),
        "r10": -F.cos(a), "r11": zero, "r12": F.sin(a),
        "r20": zero, "r21": F.lit(-1.0), "r22": zero,
    })


def rotation_quat(df: DataFrame) -> DataFrame:
    """Quaternion (w, x, y, z) of that rotation, w >= 0."""
    # R = Rz(a) * B with B turning the optical axes into ego axes, B = (.5,-.5,.5,-.5)
    half = -F.radians("myaw") / 2
    q = geom.quat_mul(
        geom.Quat(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)),
        geom.Quat(F.lit(0.5), F.lit(-0.5), F.lit(0.5), F.lit(-0.5)))
    flip = F.when(q.w < 0, -1.0).otherwise(1.0)
    return df.withColumns({"qw": q.w * flip, "qx": q.x * flip, "qy": q.y * flip, "qz": q.z * flip})


def _axes(x, y, z, cam):
    """Right, down and ahead of the camera ``cam`` (name -> number) for an ego point, as columns or as arrays."""
    dx, dy, dz = x - cam["tx"], y - cam["ty"], z - cam["tz"]
    return tuple(cam[f"r0{k}"] * dx + cam[f"r1{k}"] * dy + cam[f"r2{k}"] * dz for k in range(3))


EXTRINSICS = ["tx", "ty", "tz", *[f"r{i}{k}" for i in range(3) for k in range(3)]]


def project(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Ego point -> (u, v, depth) through the extrinsic columns of the row; beside the camera, at depth zero, it has no pixel (null)."""
    cx, cy, cz = _axes(x, y, z, {n: F.col(n) for n in EXTRINSICS})
    ahead = F.nullif(cz, F.lit(0.0))
    return FOCAL * cx / ahead + IMAGE_WIDTH / 2, FOCAL * cy / ahead + IMAGE_HEIGHT / 2, cz


def project_arrays(x: np.ndarray, y: np.ndarray, z: np.ndarray, cam: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``project`` for many points and one camera: the same numbers, NaN where a column is null."""
    cx, cy, cz = _axes(x, y, z, cam)
    ahead = np.where(cz == 0, np.nan, cz)
    return FOCAL * cx / ahead + IMAGE_WIDTH / 2, FOCAL * cy / ahead + IMAGE_HEIGHT / 2, cz


def matrix(rows: list[list]) -> Column:
    """array<array<double>> of columns and numbers."""
    cell = lambda c: (c if isinstance(c, Column) else F.lit(float(c))).cast("double")
    return F.array(*[F.array(*[cell(c) for c in row]) for row in rows])


def matmul(a: Column, b: Column) -> Column:
    """Product of two matrices."""
    columns = F.transform(F.get(b, F.lit(0)), lambda _, j: F.transform(b, lambda row: F.get(row, j)))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(a, lambda row: F.transform(columns, lambda column: dot(row, column)))


def lidar_to_camera() -> Column:
    """4 x 4 matrix from the ego frame, in which the lidar stands, to the camera of the row's extrinsic columns."""
    axes = [[F.col(f"r{i}{k}") for i in range(3)] for k in range(3)]
    turn = matrix([[*row, 0] for row in axes] + [[0, 0, 0, 1]])
    shift = matrix([[1, 0, 0, -F.col("tx")], [0, 1, 0, -F.col("ty")], [0, 0, 1, -F.col("tz")], [0, 0, 0, 1]])
    return matmul(turn, shift)


def lidar_to_image() -> Column:
    """4 x 4 matrix from the ego frame to pixels times depth: the intrinsics, padded to four rows, after the camera's pose."""
    padded = matrix([[FOCAL, 0, IMAGE_WIDTH / 2, 0], [0, FOCAL, IMAGE_HEIGHT / 2, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    return matmul(padded, lidar_to_camera())


def lidar_to_global(gx: Column, gy: Column, gyaw: Column) -> tuple[Column, Column]:
    """Rotation, transposed so that a row vector is multiplied from the left, and translation of the lidar in the world."""
    c, s = F.cos(gyaw), F.sin(gyaw)
    return matrix([[c, s, 0], [-s, c, 0], [0, 0, 1]]), F.array(gx, gy, F.lit(0.0))


def in_image(u: Column, v: Column, depth: Column) -> Column:
    """Whether a pixel lies in the image and ahead of the camera, for columns or arrays."""
    return (u > 0) & (u < IMAGE_WIDTH) & (v > 0) & (v < IMAGE_HEIGHT) & (depth > 1.0)
