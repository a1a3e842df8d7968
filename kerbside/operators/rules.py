"""Decision rules: which maneuver a frame shows and what justifies it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.functions.fmt import fixed
from kerbside.operators.ego import align_err, dist_to_slot
from kerbside.operators.objects import scene_picks


@dataclass(frozen=True)
class Thresholds:
    """Metres, m/s, radians and normalised steer; fixed values."""

    speed_stop: float = 0.10
    creep_speed: float = 0.50
    align_speed: float = 0.60
    align_steer: float = 0.50
    near_slot_dist: float = 1.50
    align_err: float = 0.20
    corridor_half_width: float = 1.20
    corridor_len_stop: float = 5.00
    creep_clearance: float = 4.00
    slot_occupied_radius: float = 1.20
    bay_width: float = 3.00
    flank_radius: float = 2.00
    front_len: float = 8.00
    front_half_width: float = 2.50
    rear_len: float = 6.00
    rear_half_width: float = 2.00
    swept_radius: float = 2.50
    tight_steer: float = 0.60
    gentle_steer: float = 0.25
    setup_dist: float = 3.00


DEFAULTS = Thresholds()

# decisions a frame can be given, fixed values
DECISIONS = ["approach", "align", "creep", "reverse", "stop_yield", "shift_gear",
             "complete_park", "abort"]


def factor(kind: str, name: Column, *, r: Column | None = None, f: Column | None = None,
           value: Column | None = None, role: str | None = None) -> Column:
    """One cited entity; every factor has the same struct type."""
    def number(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast("double")

    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), number(r).alias("r"), number(f).alias("f"),
        number(value).alias("value"), F.lit(role).cast("string").alias("role"))


def obstacle(pick: str, role: str | None) -> Column:
    p = F.col(pick)
    return F.when(p.isNotNull(), factor(
        "obstacle", p["cls"], r=p["right"], f=p["forward"], role=role))


def canonical(e: Column) -> Column:
    """``obstacle[cls|role]@(r,f)``, ``slot(state)[@(r,f)]``, ``name=v``, ``manner(name)``."""
    at = F.concat(F.lit("@("), fixed(e["r"], 1), F.lit(","), fixed(e["f"], 1), F.lit(")"))
    tag = F.concat_ws("|", e["name"], e["role"])
    return (
        F.when(e["kind"] == "obstacle", F.concat(F.lit("obstacle["), tag, F.lit("]"), at))
        .when(e["kind"] == "slot", F.concat(F.lit("slot("), e["name"], F.lit(")"), F.coalesce(at, F.lit(""))))
        .when(e["kind"] == "metric", F.concat(e["name"], F.lit("="), fixed(e["value"], 1)))
        .when(e["kind"] == "manner", F.concat(F.lit("manner("), e["name"], F.lit(")")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown entity kind: "), e["kind"])))
    )


def bearing(right: Column, forward: Column, near: float = 0.7) -> Column:
    """Qualitative direction words, never a number."""
    lon = F.when(forward > near, "ahead").when(forward < -near, "behind")
    lat = F.when(right > near, "on my right").when(right < -near, "on my left")
    words = F.concat_ws(" ", lon, lat)
    return F.when(words == "", "right here").otherwise(words)


def drop_repeated_obstacles(refs: Column) -> Column:
    """An obstacle cited twice (same class and place at 1 decimal) keeps its first role."""
    def near(c: Column) -> Column:
        return fixed(c, 1).cast("double")

    def same(a: Column, b: Column) -> Column:
        return (a["name"] == b["name"]) & (near(a["r"]) == near(b["r"])) & (near(a["f"]) == near(b["f"]))

    def fresh(e: Column, i: Column) -> Column:
        earlier = F.slice(refs, F.lit(1), i.cast("int"))
        repeat = F.exists(earlier, lambda x: (x["kind"] == "obstacle") & same(x, e))
        return (e["kind"] != "obstacle") | ~repeat

    return F.filter(refs, fresh)


def _present(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def manners(steer: Column, th: Thresholds) -> dict[str, Column]:
    def said(name: Column) -> Column:
        return F.when(name.isNotNull(), factor("manner", name))

    size = F.abs(steer)
    left, right = F.col("flank_left"), F.col("flank_right")
    dl = geom.hypot(left["right"], left["forward"])
    dr = geom.hypot(right["right"], right["forward"])
    return {
        "steer": said(F.when(size > th.tight_steer, "tight_turn").when(size < th.gentle_steer, "gentle_turn")),
        "purpose": said(F.when(F.col("_dist").isNotNull(), F.when(
            F.col("_dist") > th.setup_dist, "setup_forward").otherwise("short_adjust"))),
        "closer": said(F.when(left.isNotNull() & right.isNotNull(),
                              F.when(dl <= dr, "closer_left").otherwise("closer_right"))),
    }


def decide(th: Thresholds = DEFAULTS) -> Column:
    """First rule that fits: gear change, yield, parked, reverse, creep, align, approach."""
    stopped = F.col("speed_ms") < th.speed_stop
    blocked = F.col("in_path").isNotNull()
    clear = geom.hypot(F.col("in_path")["right"], F.col("in_path")["forward"])
    return (
        F.when(F.col("prev_reverse").isNotNull() & (F.col("prev_reverse") != F.col("reverse")), "shift_gear")
        .when(stopped & blocked, "stop_yield")
        .when(stopped & (F.col("_dist") < th.near_slot_dist) & (F.col("_aerr") < th.align_err), "complete_park")
        .when(F.col("reverse"), "reverse")
        .when(blocked & (clear <= th.creep_clearance) & (F.col("speed_ms") < th.creep_speed), "creep")
        .when((F.abs("steer") > th.align_steer) & (F.col("speed_ms") < th.align_speed), "align")
        .otherwise("approach")
    )


def extract_facts(frames: DataFrame, objects: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``decision`` and the ordered ``factors`` of every frame.

    ``frames`` needs prev_reverse, reverse, speed_ms, steer and the local slot, and
    may carry ``fut``, which only selects among the objects perceived now.
    """
    seen = scene_picks(frames, objects, th).withColumns(
        {"_dist": dist_to_slot(), "_aerr": align_err()})
    has_slot = F.col("slot_r").isNotNull()
    slot = F.when(has_slot, factor(
        "slot", F.when(F.col("slot_occupied"), "occupied").otherwise("free"),
        r=F.col("slot_r"), f=F.col("slot_f")))
    dist = F.when(has_slot, factor("metric", F.lit("dist_to_slot"), value=F.col("_dist")))
    aerr = F.when(has_slot, factor("metric", F.lit("align_err"), value=F.col("_aerr")))
    gap = geom.hypot(F.col("in_path")["right"], F.col("in_path")["forward"])
    clearance = factor("metric", F.lit("clearance"), value=gap)
    front, rear, swept = obstacle("front", "front"), obstacle("rear", "rear"), obstacle("swept", "swept")
    in_path = obstacle("in_path", "in_path")
    flanks = (obstacle("flank_left", "flank_left"), obstacle("flank_right", "flank_right"))
    how = manners(F.col("steer"), th)
    # (cited with repeats dropped, appended as they are) per decision
    plan = {
        "shift_gear": ([front, slot, dist], [how["steer"]]),
        "stop_yield": ([in_path, clearance], []),
        "complete_park": ([*flanks, slot, dist, aerr], [how["closer"]]),
        "reverse": ([*flanks, rear, slot, dist, aerr], [how["closer"], how["steer"]]),
        "creep": ([in_path, clearance, swept], []),
        "align": ([swept, front, slot, dist, aerr], [how["steer"]]),
        "approach": ([front, swept, slot, dist], [how["purpose"]]),
    }
    decided = seen.withColumn("decision", decide(th))

    def choose(side: int) -> Column:
        out = None
        for name, parts in plan.items():
            refs = _present(*parts[side]) if parts[side] else None
            if refs is None:
                continue
            hit = F.col("decision") == name
            out = F.when(hit, refs) if out is None else out.when(hit, refs)
        return out

    cited = decided.withColumns({"_cited": choose(0), "_extra": choose(1)})
    factors = F.concat(
        drop_repeated_obstacles(F.col("_cited")),
        F.coalesce(F.col("_extra"), F.slice("_cited", 1, 0)))
    return cited.withColumn("factors", factors).drop("_cited", "_extra")
