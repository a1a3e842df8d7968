"""Windows over frames of a scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.operators.ordered import over_scene, sparse_neighbours


def _rf(p: Column) -> geom.RF:
    return geom.to_local(p.gx, p.gy, F.col("gx"), F.col("gy"), F.col("gyaw"))


def token_chain(frames: DataFrame) -> DataFrame:
    """prev and next token of the scene, empty string at the ends."""
    return over_scene(frames, 1, 1, lambda w: {
        "prev": F.coalesce(F.lag("token").over(w), F.lit("")),
        "next": F.coalesce(F.lead("token").over(w), F.lit("")),
    })


def annotation_chain(boxes: DataFrame) -> DataFrame:
    """prev and next annotation of the same actor; frames without it are skipped."""
    anns = boxes.withColumn("ann", F.concat("token", F.lit("_"), "instance_token"))
    out = sparse_neighbours(anns, ["scene_token", "actor_id"], "frame_idx", "ann", "prev", "next")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("prev", "next")})


def _pad(points: Column, k: int, filler: Column, left: bool) -> Column:
    missing = F.array_repeat(filler, (F.lit(k) - F.size(points)).cast("int"))
    return F.concat(missing, points) if left else F.concat(points, missing)


def history_local(frames: DataFrame, k: int = 4, *, pad: bool = True) -> DataFrame:
    """``his``: past positions in the current frame, oldest first, current (0,0) last.

    Padded with the oldest point on the left, with zeros when there is no past.
    """
    pose = F.struct("gx", "gy")
    got = over_scene(frames, k, 0, lambda w: {
        "_past": F.collect_list(pose).over(w.rowsBetween(-k, -1))})
    zero = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("f"))

    def local(p: Column) -> Column:
        rf = _rf(p)
        return F.struct(rf.right.alias("r"), rf.forward.alias("f"))

    past = F.transform("_past", local)
    if pad:
        past = F.when(F.size("_past") == 0, F.array_repeat(zero, k)).otherwise(
            _pad(past, k, F.get(past, F.lit(0)), left=True))
    return got.withColumn("his", F.concat(past, F.array(zero))).drop("_past")


def future_local(frames: DataFrame, k: int = 6) -> DataFrame:
    """``fut``: k future (right, forward, dheading), last one repeated, zeros if none."""
    pose = F.struct("gx", "gy", "gyaw")
    got = over_scene(frames, 0, k, lambda w: {
        "_next": F.collect_list(pose).over(w.rowsBetween(1, k))})
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("r", "f", "h")])

    def local(p: Column) -> Column:
        rf = _rf(p)
        return F.struct(rf.right.alias("r"), rf.forward.alias("f"),
                        geom.wrap(p.gyaw - F.col("gyaw")).alias("h"))

    points = F.transform("_next", local)
    padded = F.when(F.size("_next") == 0, F.array_repeat(zero, k)).otherwise(
        _pad(points, k, F.element_at(points, -1), left=False))
    return got.withColumn("fut", padded).drop("_next")


def future_masked(frames: DataFrame, k: int = 6) -> DataFrame:
    """``steps``: only the existing future points with their 1-based step."""
    pose = F.struct("gx", "gy", "gyaw")
    got = over_scene(frames, 0, k, lambda w: {
        "_next": F.collect_list(pose).over(w.rowsBetween(1, k))})

    def local(p: Column, i: Column) -> Column:
        rf = _rf(p)
        return F.struct((i + 1).alias("step"), rf.forward.alias("x"), (-rf.right).alias("y"),
                        geom.wrap(p.gyaw - F.col("gyaw")).alias("yaw"))

    return got.withColumn("steps", F.transform("_next", local)).drop("_next")


def history_motion(with_history: DataFrame) -> DataFrame:
    """First differences of ``his`` and the last minus the previous difference."""
    diff = F.zip_with(
        F.slice("his", 2, 4), F.slice("his", 1, 4),
        lambda b, a: F.struct((b.r - a.r).alias("r"), (b.f - a.f).alias("f")))
    return with_history.withColumn("his_diff", diff).withColumns({
        "acc_r": F.element_at("his_diff", -1).r - F.element_at("his_diff", -2).r,
        "acc_f": F.element_at("his_diff", -1).f - F.element_at("his_diff", -2).f,
    })


def prev_reverse(frames: DataFrame) -> DataFrame:
    return over_scene(frames, 1, 0, lambda w: {"prev_reverse": F.lag("reverse").over(w)})


def sdc_velocity(frames: DataFrame, dt: float = 0.5) -> DataFrame:
    """Forward difference over ``dt`` in the ego frame (x forward, y left); the last
    frame copies the previous one and a lone frame gets zero."""
    def build(w):
        step = {}
        for name in ("gx", "gy"):
            step[f"_d{name}"] = (F.lead(name).over(w) - F.col(name)) / dt
        return step

    moved = over_scene(frames, 0, 1, build)
    v = geom.to_ego_xy(F.col("_dgx"), F.col("_dgy"), F.lit(0.0), F.lit(0.0), F.col("gyaw"))
    own = moved.withColumns({"_vx": v.x, "_vy": v.y}).drop("_dgx", "_dgy")
    done = over_scene(own, 1, 0, lambda w: {
        "sdc_vx": F.coalesce("_vx", F.lag("_vx").over(w), F.lit(0.0)),
        "sdc_vy": F.coalesce("_vy", F.lag("_vy").over(w), F.lit(0.0)),
    })
    return done.drop("_vx", "_vy")


def sdc_command(last_x: Column) -> Column:
    """0 right, 1 left, 2 straight from the first coordinate of the last valid step."""
    return F.when(last_x >= 2.0, 0).when(last_x <= -2.0, 1).otherwise(2)


def temporal_indices(frames: DataFrame, past: int = 3, future: int = 4) -> DataFrame:
    """Positions t-past+1..t+future as frame indices, -1 outside the scene, plus a
    flag that any of the first 7 is missing."""
    def build(w):
        idx = [F.coalesce(F.lag("frame_idx", k).over(w), F.lit(-1)) for k in range(past - 1, 0, -1)]
        idx.append(F.col("frame_idx"))
        idx += [F.coalesce(F.lead("frame_idx", k).over(w), F.lit(-1)) for k in range(1, future + 1)]
        return {"indices": F.array(*idx)}

    got = over_scene(frames, past, future, build)
    return got.withColumn(
        "has_invalid", F.exists(F.slice("indices", 1, 7), lambda i: i < 0))


def queue_deltas(frames: DataFrame, length: int = 4) -> DataFrame:
    """can_bus position and angle changes inside a queue ending at each frame.

    One row per (frame, queue slot); the first slot is zero, later slots are the
    difference to the slot before.  Frames without a full queue are left out.
    """
    state = F.struct("frame_idx", "gx", "gy", F.pmod(F.degrees("gyaw"), F.lit(360.0)).alias("deg"))
    got = over_scene(frames, length - 1, 0, lambda w: {
        "_q": F.collect_list(state).over(w.rowsBetween(-(length - 1), 0))})
    full = got.filter(F.size("_q") == length)
    deltas = F.transform("_q", lambda s, i: F.struct(
        s.frame_idx.alias("at"),
        *[F.when(i == 0, 0.0).otherwise(s[n] - F.get("_q", i - 1)[n]).alias(f"d_{n}")
          for n in ("gx", "gy", "deg")]))
    return full.select("token", F.posexplode(deltas).alias("slot", "d")).select(
        "token", "slot", "d.at", "d.d_gx", "d.d_gy", "d.d_deg")


def scene_summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("scene_token").agg(
        F.count(F.lit(1)).alias("nbr_samples"),
        F.min_by("token", "frame_idx").alias("first_token"),
        F.max_by("token", "frame_idx").alias("last_token"),
    )


def instance_summary(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("scene_token", "instance_token").agg(
        F.count(F.lit(1)).alias("nbr_annotations"),
        F.min_by("token", "frame_idx").alias("first_token"),
        F.max_by("token", "frame_idx").alias("last_token"),
    )


def frame_offsets(poses: DataFrame, offsets: range) -> DataFrame:
    """Pairs (reference frame, other frame of the scene at frame_idx + k) that exist."""
    ref = poses.select("scene_token", F.col("token").alias("ref_token"),
                       F.col("gx").alias("rx"), F.col("gy").alias("ry"), F.col("gyaw").alias("ryaw"),
                       "frame_idx").withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in offsets])))
    ref = ref.withColumn("frame_idx", F.col("frame_idx") + F.col("k"))
    other = poses.select("scene_token", "frame_idx", "token", "gx", "gy", "gyaw")
    return ref.join(other, ["scene_token", "frame_idx"])


def reframe_boxes(boxes: DataFrame, poses: DataFrame, future: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Boxes of frames t..t+future expressed in the ego frame of frame t, with the columns in ``keep``."""
    pairs = frame_offsets(poses, range(future + 1))
    joined = pairs.join(boxes.select("token", "actor_id", "x", "y", "yaw", *keep), "token")
    g = geom.rotate(F.col("x"), F.col("y"), F.col("gyaw"))
    at = geom.to_ego_xy(g.x + F.col("gx"), g.y + F.col("gy"), F.col("rx"), F.col("ry"), F.col("ryaw"))
    return joined.select(
        "ref_token", "k", "actor_id", at.x.alias("x"), at.y.alias("y"),
        geom.wrap(F.col("yaw") + F.col("gyaw") - F.col("ryaw")).alias("yaw"), *keep)


def agent_trajectories(anns: DataFrame, past_us: int = 2_000_000, future_us: int = 6_000_000,
                       past_steps: int = 4, future_steps: int = 12) -> DataFrame:
    """Future and past positions of an annotated actor in its own box frame.

    ``anns`` holds global centres (cx, cy), heading gheading and ts_us per (scene,
    actor).  The window is bounded by time, so gaps are skipped like in the chain.
    """
    # frames come every 0.5 s, so these reaches bound the positions a window can see
    reach_back = past_us // 500_000
    reach_ahead = future_us // 500_000
    point = F.struct("cx", "cy", "ts_us")

    def build(w):
        by_time = w.orderBy("ts_us")
        return {
            "_fut": F.collect_list(point).over(by_time.rangeBetween(1, future_us)),
            "_past": F.collect_list(point).over(by_time.rangeBetween(-past_us, -1)),
        }

    got = over_scene(anns, reach_back, reach_ahead, build, group=("scene_token", "actor_id"))

    def local(p: Column) -> Column:
        rf = geom.to_local(p.cx, p.cy, F.col("cx"), F.col("cy"), F.col("gheading"))
        return F.struct(rf.forward.alias("x"), (-rf.right).alias("y"))

    near_first = F.reverse(F.sort_array("_past_keyed"))
    keyed = got.withColumn("_past_keyed", F.transform("_past", lambda p: F.struct(
        p.ts_us.alias("t"), p.cx.alias("cx"), p.cy.alias("cy"))))
    return keyed.withColumns({
        "agent_future": F.slice(F.transform("_fut", local), 1, future_steps),
        "agent_past": F.slice(F.transform(near_first, local), 1, past_steps),
    }).drop("_fut", "_past", "_past_keyed")
