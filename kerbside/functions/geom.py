"""Planar and rigid-body geometry as Column expressions (no Python in the row path).

Frames of reference:
  simulator world  left-handed, y to the right, yaw in degrees clockwise
  dataset world    right-handed, y = -y_world, yaw in radians = -radians(yaw_deg)
  ego / sensor     x forward, y left
  prompt           x right, y forward
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
TAU = 2.0 * math.pi


class RF(NamedTuple):
    right: Column
    forward: Column


class XY(NamedTuple):
    x: Column
    y: Column


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column


# ---- angles ---------------------------------------------------------------

def wrap(a: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(a + F.lit(PI), F.lit(TAU)) - F.lit(PI)


def wrap_closed(a: Column) -> Column:
    """Angle in [-pi, pi]: values already inside are left alone, +pi included."""
    return F.when((a >= -PI) & (a <= PI), a).otherwise(
        F.when(a > PI, PI - F.pmod(F.lit(PI) - a, F.lit(TAU))).otherwise(wrap(a))
    )


def yaw_gap(a: Column, b: Column) -> Column:
    """Absolute heading difference folded to [0, pi]."""
    return F.abs(wrap(a - b))


# ---- poses ----------------------------------------------------------------

def dataset_xy(x_world: Column, y_world: Column) -> XY:
    return XY(x_world, -y_world)


def dataset_yaw(yaw_deg: Column) -> Column:
    return -F.radians(yaw_deg)


def yaw_quat(yaw: Column) -> Quat:
    zero = F.lit(0.0)
    return Quat(F.cos(yaw / 2), zero, zero, F.sin(yaw / 2))


def quat_yaw(q: Quat) -> Column:
    return F.atan2(2 * (q.w * q.z + q.x * q.y), 1 - 2 * (q.y * q.y + q.z * q.z))


def quat_mul(a: Quat, b: Quat) -> Quat:
    return Quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def quat_rotate(q: Quat, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Rotate a vector by a unit quaternion."""
    tx = 2 * (q.y * z - q.z * y)
    ty = 2 * (q.z * x - q.x * z)
    tz = 2 * (q.x * y - q.y * x)
    return (
        x + q.w * tx + q.y * tz - q.z * ty,
        y + q.w * ty + q.z * tx - q.x * tz,
        z + q.w * tz + q.x * ty - q.y * tx,
    )


def ego_velocity(yaw_deg: Column, vx_world: Column, vy_world: Column) -> RF:
    """Signed (forward, right) speed in the ego frame; forward is negative in reverse."""
    th = -F.radians(yaw_deg)
    forward = F.cos(th) * vx_world - F.sin(th) * vy_world
    right = F.sin(th) * vx_world + F.cos(th) * vy_world
    return RF(right, forward)


def to_local(px: Column, py: Column, ox: Column, oy: Column, oyaw: Column) -> RF:
    """A dataset-world point seen from a pose, as (right, forward)."""
    dx, dy = px - ox, py - oy
    return RF(dx * F.sin(oyaw) - dy * F.cos(oyaw), dx * F.cos(oyaw) + dy * F.sin(oyaw))


def to_global(right: Column, forward: Column, ox: Column, oy: Column, oyaw: Column) -> XY:
    return XY(
        ox + forward * F.cos(oyaw) + right * F.sin(oyaw),
        oy + forward * F.sin(oyaw) - right * F.cos(oyaw),
    )


def to_ego_xy(px: Column, py: Column, ox: Column, oy: Column, oyaw: Column) -> XY:
    """A dataset-world point in the ego frame (x forward, y left)."""
    rf = to_local(px, py, ox, oy, oyaw)
    return XY(rf.forward, -rf.right)


def rotate(x: Column, y: Column, yaw: Column) -> XY:
    return XY(x * F.cos(yaw) - y * F.sin(yaw), x * F.sin(yaw) + y * F.cos(yaw))


# ---- boxes ----------------------------------------------------------------

def box_corners(x: Column, y: Column, length: Column, width: Column, yaw: Column) -> list[XY]:
    """Footprint corners in order front-left, front-right, rear-right, rear-left
    for a heading measured from the x axis (x forward, y left)."""
    out = []
    for sl, sw in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)):
        r = rotate(length * sl, width * sw, yaw)
        out.append(XY(x + r.x, y + r.y))
    return out


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)
