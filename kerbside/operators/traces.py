"""Trace tables: verbalised facts, validators, counterfactual stops, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import phrases as ph
from kerbside.operators import objects as ob
from kerbside.operators.rules import Thresholds, canonical, factor

VALIDATORS = ["entity_fidelity", "action_fidelity", "causal_locality", "schema_conformance"]


def verbalised(facts: DataFrame) -> DataFrame:
    """Adds phrases, the template trace and the entities the fact allows."""
    return facts.withColumn("phrases", ph.factor_phrases(F.col("factors"))).withColumns({
        "trace": ph.template_trace(F.col("decision"), F.col("phrases")),
        "allowed": ph.mention_keys(F.col("factors")),
    })


def causal_locality(facts: DataFrame, objects: DataFrame) -> DataFrame:
    """Per token: 0 when some obstacle factor has no object of the frame near it."""
    cited = facts.select("token", F.explode("factors").alias("e")).filter("e.kind = 'obstacle'").select(
        "token", "e.r", "e.f")
    bad = ob.ungrounded(cited, objects).select("token").distinct().withColumn("_bad", F.lit(0.0))
    return facts.select("token").join(bad, "token", "left").select(
        "token", F.coalesce("_bad", F.lit(1.0)).alias("causal_locality"))


def trace_records(facts: DataFrame, objects: DataFrame, source: str, teacher: str = "mock",
                  reconciled: DataFrame | None = None) -> DataFrame:
    """One factual row per frame with trace, turn, trajectory text and validators."""
    said = verbalised(facts)
    traj = ph.waypoints_text(F.col("fut"))
    full = said.withColumn("traj_str", traj).withColumn(
        "assistant_turn", ph.assistant_turn(F.col("trace"), F.col("traj_str")))
    scored = full.withColumns({
        "entity_fidelity": ph.entity_fidelity(F.col("trace"), F.col("allowed")),
        "action_fidelity": ph.action_fidelity(F.col("decision"), F.col("fut")),
        "schema_conformance": ph.schema_conformance(
            F.col("decision"), F.col("factors"), F.col("fut"), F.col("assistant_turn")),
    }).join(causal_locality(facts, objects), "token")
    if reconciled is not None:
        scored = scored.join(reconciled.select("token", "reconcile"), "token")
    else:
        scored = scored.withColumn("reconcile", F.lit("ok"))
    return scored.withColumns({
        "role": F.lit("factual"), "pair_id": F.col("token"),
        "source": F.lit(source), "teacher": F.lit(teacher),
    })


def reconciled(perceived: DataFrame, truth: DataFrame) -> DataFrame:
    """Facts of two sources per token -> reconcile status."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("token", F.col("decision").alias(f"d{tag}"),
                         ph.mention_keys(F.col("factors")).alias(f"k{tag}"))

    return side(perceived, "p").join(side(truth, "g"), "token").select(
        "token", ph.reconcile(F.col("dp"), F.col("kp"), F.col("dg"), F.col("kg")).alias("reconcile"))


# ---- counterfactual stop ----------------------------------------------------

MIN_PATH = 0.8
KEEP = 2  # waypoints driven before the stop begins


def stop_injection(frames: DataFrame) -> DataFrame:
    """Counterfactual rows: two waypoints as driven, then a linear ramp to a stop.

    The injected pedestrian stands at the 4th waypoint; the new fact is stop_yield
    with the remaining clearance.  Frames that end within 0.8 m are left out.
    """
    def at(i: int) -> Column:
        return F.element_at("fut", i)

    moving = frames.filter(F.hypot(at(6)["r"], at(6)["f"]) >= MIN_PATH)
    dr, df_ = at(2)["r"] - at(1)["r"], at(2)["f"] - at(1)["f"]
    tail = 6 - KEEP
    # sum_{j<=i} (1 - j/n) of the last step, so speed falls linearly to zero
    ramp = [sum(1.0 - j / tail for j in range(1, i + 1)) for i in range(1, tail + 1)]
    tiny = F.hypot(dr, df_) <= 1e-6
    stopped = [
        F.struct((at(2)["r"] + F.when(tiny, 0.0).otherwise(dr * g)).alias("r"),
                 (at(2)["f"] + F.when(tiny, 0.0).otherwise(df_ * g)).alias("f"),
                 at(2)["h"].alias("h"))
        for g in ramp
    ]
    path = F.concat(F.slice("fut", 1, KEEP), F.array(*stopped))
    spot = at(4)
    withp = moving.withColumn("cf_fut", path)
    end = F.element_at("cf_fut", -1)
    gap = F.hypot(spot["r"] - end["r"], spot["f"] - end["f"])
    return withp.withColumns({
        "pair_id": F.concat("token", F.lit("::cf_stop")),
        "of_decision": F.col("decision"),
        "injected_r": spot["r"], "injected_f": spot["f"], "clearance": gap,
        "factors": F.array(
            factor("obstacle", F.lit("pedestrian"), r=spot["r"], f=spot["f"]),
            factor("metric", F.lit("clearance"), value=gap)),
    }).withColumn("decision", F.lit("stop_yield"))


def paired_records(facts: DataFrame) -> DataFrame:
    """Factual and counterfactual rows of every eligible frame under one pair_id."""
    cf = verbalised(stop_injection(facts))
    keys = ["token", "pair_id", "role", "decision", "trace", "traj_str"]
    real = verbalised(facts).select("token", F.lit("factual").alias("role"), "decision", "trace",
                                    ph.waypoints_text(F.col("fut")).alias("traj_str"))
    made = cf.select("token", "pair_id", F.lit("counterfactual").alias("role"), "decision", "trace",
                     ph.waypoints_text(F.col("cf_fut")).alias("traj_str"))
    return real.join(cf.select("token", "pair_id"), "token").select(*keys).unionByName(made.select(*keys))


# ---- aggregates -------------------------------------------------------------

def pass_rates(records: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Share of rows at or above the threshold per validator, 1.0 without rows."""
    return records.agg(*[
        F.coalesce(F.avg(F.when(F.col(n) >= threshold, 1.0).otherwise(0.0)), F.lit(1.0)).alias(n)
        for n in VALIDATORS])


def histogram(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def factor_strings(factors: Column) -> Column:
    return F.array_join(F.transform(factors, canonical), ";")


def first_reasons(reasons: DataFrame, most: int = 5) -> Column:
    """The reasons of the first frames that fell back, by scene and frame; only so many rows leave each task."""
    first = reasons.orderBy("scene_token", "frame_idx").limit(most).select(F.struct("scene_token", "frame_idx", "reason").alias("r"))
    return first.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["reason"])).scalar()


def manifest(records: DataFrame, th: Thresholds, missing_features: DataFrame | None = None, reasons: DataFrame | None = None) -> DataFrame:
    """One row: counts, fallbacks, histograms, rates, thresholds; with ``reasons`` (scene_token, frame_idx, reason) the first five of them.

    Histograms are aggregated per value first, so the final row sees a few dozen rows.
    """
    per = records.groupBy("decision", "reconcile", "teacher").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col(v) >= 1.0, 1).otherwise(0)).alias(v) for v in VALIDATORS])
    episodes = records.agg(F.count_distinct("scene_token")).scalar()
    fallback = F.col("teacher").endswith("_fallback_mock")

    def hist(column: str) -> Column:
        grouped = per.groupBy(column).agg(F.sum("n").alias("n"))
        return grouped.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n"))))).scalar()

    total = F.sum("n")
    row = per.agg(
        total.alias("frames"),
        F.coalesce(F.sum(F.when(fallback, F.col("n"))), F.lit(0)).alias("teacher_fallbacks"),
        *[F.coalesce(F.sum(v) / total, F.lit(1.0)).alias(v) for v in VALIDATORS])
    out = row.withColumns({
        "episodes": episodes,
        "decision_histogram": hist("decision"),
        "reconcile_histogram": hist("reconcile"),
        "thresholds": F.create_map(*[
            x for k, val in vars(th).items() for x in (F.lit(k), F.lit(float(val)))]),
    })
    if reasons is not None:
        out = out.withColumn("fallback_examples", first_reasons(reasons))
    if missing_features is not None:
        out = out.withColumn("missing_features", missing_features.agg(F.count(F.lit(1))).scalar())
    return out
