"""Queries for object picks (D9-D15), rules (J) and reasoning text (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import geom, phrases as ph
from kerbside.operators import objects as ob, rules, traces, windows
from kerbside.plans import oracle_rules as orl
from kerbside.plans.oracle_views import hyp, r6 as s6, register
from kerbside.plans.registry import query, r6

TH = rules.DEFAULTS


def facts(v, source: str = "gt"):
    return v.facts(source)


def _pick_query(name: str, pick: str):
    def run(v):
        got = ob.scene_picks(v.futures, v.objects, TH)
        return got.select("token", F.col(pick)["cls"].alias("cls"), F.col(pick)["right"].alias("r"),
                          F.col(pick)["forward"].alias("f"))

    oracle = f"SELECT token, {pick}.cls AS cls, {pick}.r AS r, {pick}.f AS f FROM rule_frames LEFT JOIN picks_gt USING (token)"
    run.__doc__ = f"The {pick} object of every frame."
    query(name, oracle)(run)


_pick_query("d9_nearest_in_path", "in_path")
_pick_query("d10_flank_left", "flank_left")
_pick_query("d10_flank_right", "flank_right")
_pick_query("d11_front_blocker", "front")
_pick_query("d12_rear_blocker", "rear")
_pick_query("d13_swept_path", "swept")


@query("d14_slot_occupied", """
SELECT token, coalesce(occupied, false) AS occupied FROM rule_frames LEFT JOIN picks_gt USING (token)""")
def d14(v):
    return ob.scene_picks(v.slot_frames, v.objects, TH).select("token", F.col("slot_occupied").alias("occupied"))


# obstacle factors of the perceived scene checked against ground-truth objects
register("cited_det", """
SELECT token, e.r AS r, e.f AS f FROM (SELECT token, unnest(factors) AS e FROM facts_det) WHERE e.kind = 'obstacle'
""")


@query("d15_ungrounded_factors", f"""
SELECT token, r, f FROM cited_det c WHERE NOT EXISTS (
  SELECT 1 FROM objects o WHERE o.token = c.token AND {hyp('o."right" - c.r', "o.forward - c.f")} <= 0.7)""")
def d15(v):
    cited = facts(v, "det").select("token", F.explode("factors").alias("e")).filter("e.kind = 'obstacle'").select(
        "token", "e.r", "e.f")
    return ob.ungrounded(cited, v.objects)


@query("j1_extract_fact", f"SELECT token, decision, {orl.joined(orl.CANON)} AS factors FROM facts_gt")
def j1(v):
    fresh = rules.extract_facts(windows.prev_reverse(v.futures), v.objects, TH)
    return fresh.select("token", "decision", traces.factor_strings(F.col("factors")).alias("factors"))


@query("j1_extract_fact_detected", f"SELECT token, decision, {orl.joined(orl.CANON)} AS factors FROM facts_det")
def j1_det(v):
    return facts(v, "det").select("token", "decision", traces.factor_strings(F.col("factors")).alias("factors"))


@query("j2_manner_share", """
SELECT decision, e.name AS manner, count(*) AS n FROM (SELECT decision, unnest(factors) AS e FROM facts_gt)
WHERE e.kind = 'manner' GROUP BY ALL""")
def j2(v):
    return facts(v).select("decision", F.explode("factors").alias("e")).filter("e.kind = 'manner'").groupBy(
        "decision", F.col("e.name").alias("manner")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_ordered_dedup", """
SELECT token, count(*) AS obstacles FROM (SELECT token, unnest(factors) AS e FROM facts_gt)
WHERE e.kind = 'obstacle' GROUP BY token""")
def s5(v):
    return facts(v).select("token", F.explode("factors").alias("e")).filter("e.kind = 'obstacle'").groupBy(
        "token").agg(F.count(F.lit(1)).alias("obstacles"))


register("moves", """
SELECT token, decision, rs, fs, hs, sqrt((rs[6]-rs[5])*(rs[6]-rs[5]) + (fs[6]-fs[5])*(fs[6]-fs[5])) AS last,
  sqrt(rs[6]*rs[6] + fs[6]*fs[6]) AS endd FROM facts_gt
""")


@query("j4_action_fidelity", f"SELECT token, decision, {orl.ACTION} AS action_fidelity FROM moves")
def j4(v):
    return facts(v).select("token", "decision", ph.action_fidelity(F.col("decision"), F.col("fut")).alias("action_fidelity"))


# student text: another frame's text on every 11th event, an extra clause on every 13th
register("student", f"""
SELECT token, decision, allowed, factors, event_id,
  CASE WHEN event_id % 11 = 0 THEN coalesce(other, trace)
       WHEN event_id % 13 = 0 THEN trace || ' There is also a truck, so I will stop.' ELSE trace END AS trace
FROM (SELECT *, lead(trace, 5) OVER (PARTITION BY scene_token ORDER BY frame_idx) AS other FROM said_gt)
""")


def student(v):
    said = traces.verbalised(facts(v))
    other = windows.over_scene(said, 0, 5, lambda w: {"_other": F.lead("trace", 5).over(w)})
    e = F.col("event_id")
    text = F.when(e % 11 == 0, F.coalesce("_other", "trace")).when(
        e % 13 == 0, F.concat("trace", F.lit(" There is also a truck, so I will stop."))).otherwise(F.col("trace"))
    return other.withColumn("trace", text).drop("_other")


@query("j3_entity_fidelity", f"""
SELECT token, CASE WHEN len(m) = 0 THEN 1.0 ELSE {s6("len(list_intersect(m, allowed))/len(m)::DOUBLE")} END::DOUBLE AS entity_fidelity
FROM (SELECT token, allowed, {orl.mentions('trace')} AS m FROM student)""")
def j3(v):
    return student(v).select("token", r6(ph.entity_fidelity(F.col("trace"), F.col("allowed"))).alias("entity_fidelity"))


@query("j5_schema_conformance", """
SELECT token, 1.0::DOUBLE AS schema_conformance FROM facts_gt""")
def j5(v):
    said = traces.verbalised(facts(v))
    turn = ph.assistant_turn(F.col("trace"), ph.waypoints_text(F.col("fut")))
    return said.select("token", ph.schema_conformance(
        F.col("decision"), F.col("factors"), F.col("fut"), turn).alias("schema_conformance"))


register("reconcile_rows", f"""
SELECT token, CASE WHEN len(list_filter(kp, lambda k: NOT list_contains(kg, k))) > 0
    OR (dp = 'stop_yield') <> (dg = 'stop_yield') THEN 'contradiction'
  WHEN len(list_filter(kg, lambda k: NOT list_contains(kp, k))) > 0 OR dp <> dg THEN 'perception_limited' ELSE 'ok' END AS reconcile
FROM (SELECT token, decision AS dp, {orl.ALLOWED} AS kp FROM facts_det)
JOIN (SELECT token, decision AS dg, {orl.ALLOWED} AS kg FROM facts_gt) USING (token)
""")


def reconciled(v):
    return traces.reconciled(facts(v, "det"), facts(v, "gt"))


@query("j6_reconcile", "SELECT token, reconcile FROM reconcile_rows")
def j6(v):
    return reconciled(v)


@query("s4_mention_sets", f"""
SELECT token, array_to_string(list_sort(list_filter(kp, lambda k: NOT list_contains(kg, k))), ',') AS perceived_only,
  array_to_string(list_sort(list_filter(kg, lambda k: NOT list_contains(kp, k))), ',') AS truth_only
FROM (SELECT token, {orl.ALLOWED} AS kp FROM facts_det) JOIN (SELECT token, {orl.ALLOWED} AS kg FROM facts_gt) USING (token)""")
def s4(v):
    def side(src, tag):
        return facts(v, src).select("token", ph.mention_keys(F.col("factors")).alias(tag))

    both = side("det", "kp").join(side("gt", "kg"), "token")
    show = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return both.select("token", show("kp", "kg").alias("perceived_only"), show("kg", "kp").alias("truth_only"))


_RAMP = [sum(1.0 - j / 4 for j in range(1, i + 1)) for i in range(1, 5)]


def _cf(axis: str, g: float) -> str:
    return f"{axis}[2] + CASE WHEN {hyp('rs[2]-rs[1]', 'fs[2]-fs[1]')} <= 1e-6 THEN 0 ELSE ({axis}[2]-{axis}[1])*{g}::DOUBLE END"


register("stops", f"""
SELECT *, {hyp('rs[4] - cr', 'fs[4] - cf')} AS clearance FROM (
SELECT token, decision, rs, fs, hs, {_cf('rs', _RAMP[-1])} AS cr, {_cf('fs', _RAMP[-1])} AS cf,
  '[' || printf('(%.2f,%.2f,%.2f),(%.2f,%.2f,%.2f)', rs[1], fs[1], hs[1], rs[2], fs[2], hs[2])
  {"".join(f" || printf(',(%.2f,%.2f,%.2f)', {_cf('rs', g)}, {_cf('fs', g)}, hs[2])" for g in _RAMP)} || ']' AS traj_str
FROM facts_gt WHERE {hyp('rs[6]', 'fs[6]')} >= 0.8)
""")


@query("j7_stop_injection", f"""
SELECT token, token || '::cf_stop' AS pair_id, decision AS of_decision, rs[4] AS injected_r, fs[4] AS injected_f,
  {s6("clearance")} AS clearance, traj_str FROM stops""")
def j7(v):
    cf = traces.stop_injection(facts(v))
    return cf.select("token", "pair_id", "of_decision", "injected_r", "injected_f",
                     r6("clearance").alias("clearance"), ph.waypoints_text(F.col("cf_fut")).alias("traj_str"))


register("locality_gt", """SELECT token, 1.0::DOUBLE AS causal_locality FROM facts_gt""")
register("records", f"""
SELECT s.token, s.scene_token, s.frame_idx, s.decision, s.trace, s.traj_str,
  '<reason_start>' || s.trace || '<reason_end><traj_start>' || s.traj_str || '<traj_end>' AS assistant_turn,
  1.0::DOUBLE AS entity_fidelity, {orl.ACTION} AS action_fidelity, 1.0::DOUBLE AS causal_locality,
  1.0::DOUBLE AS schema_conformance, reconcile
FROM (SELECT *, {hyp("rs[6]-rs[5]", "fs[6]-fs[5]")} AS last, {hyp("rs[6]", "fs[6]")} AS endd FROM said_det) s
JOIN reconcile_rows USING (token)
""")


def records(v):
    perceived = ob.from_detections(v.detections)
    det, gt = facts(v, "det"), facts(v, "gt")
    return traces.trace_records(det, perceived, "detections", reconciled=traces.reconciled(det, gt))


@query("j8_trace_records", """
SELECT token, scene_token, frame_idx, decision, trace, traj_str, assistant_turn, entity_fidelity, action_fidelity,
  causal_locality, schema_conformance, reconcile FROM records""")
def j8(v):
    return records(v).select("token", "scene_token", "frame_idx", "decision", "trace", "traj_str", "assistant_turn",
                             "entity_fidelity", "action_fidelity", "causal_locality", "schema_conformance", "reconcile")


@query("j8_counterfactual_pairs", f"""
SELECT token, token || '::cf_stop' AS pair_id, 'factual' AS role, s.decision, s.trace, s.traj_str
FROM said_gt s JOIN (SELECT token FROM stops) USING (token)
UNION ALL
SELECT token, token || '::cf_stop', 'counterfactual', 'stop_yield',
  'I am stopping to yield because a pedestrian ' || {orl.bearing('rs[4]', 'fs[4]')} || printf(' about %.1f m away, and there is about %.1f m of clearance.', abs(fs[4]), clearance),
  traj_str FROM stops""")
def j8_pairs(v):
    return traces.paired_records(facts(v))


@query("j11_perceivable_scene", """
SELECT f.token, f.ego_fwd_v, f.steer, f.reverse, f.slot_r, f.slot_f, h.n_history, coalesce(o.n_objects, 0) AS n_objects
FROM slot_frames f JOIN (SELECT token, count(*) AS n_history FROM history WHERE "real" GROUP BY token) h USING (token)
LEFT JOIN (SELECT token, count(*) AS n_objects FROM objects GROUP BY token) o USING (token)""")
def j11(v):
    scene = windows.history_local(v.slot_frames, 4, pad=False)
    per = v.objects.groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("obj_pos", "cls", "right", "forward", "yaw"))).alias("objects"))
    full = scene.join(per, "token", "left")
    return full.select("token", "ego_fwd_v", "steer", "reverse", "slot_r", "slot_f",
                       F.size("his").cast("long").alias("n_history"),
                       F.when(F.col("objects").isNull(), 0).otherwise(F.size("objects")).cast("long").alias("n_objects"))


# ---- aggregates over traces --------------------------------------------------

@query("f1_decision_histogram", "SELECT decision, reconcile, count(*) AS n FROM records GROUP BY ALL")
def f1(v):
    det, gt = facts(v, "det"), facts(v, "gt")
    both = det.select("token", "decision").join(traces.reconciled(det, gt), "token")
    return both.groupBy("decision", "reconcile").agg(F.count(F.lit(1)).alias("n"))


@query("f2_validator_pass_rates", f"""
SELECT 1.0::DOUBLE AS entity_fidelity, {s6("avg(action_fidelity)")} AS action_fidelity,
  1.0::DOUBLE AS causal_locality, 1.0::DOUBLE AS schema_conformance FROM records""")
def f2(v):
    rates = traces.pass_rates(records(v))
    return rates.select(*[r6(c).alias(c) for c in rates.columns])


@query("f3_run_manifest", f"""
SELECT count(*) AS frames, count(DISTINCT scene_token) AS episodes, 0::BIGINT AS teacher_fallbacks,
  {s6("avg(action_fidelity)")} AS action_fidelity,
  (SELECT string_agg(decision || '=' || n, ',' ORDER BY decision) FROM (SELECT decision, count(*) AS n FROM records GROUP BY 1)) AS decisions,
  (SELECT string_agg(reconcile || '=' || n, ',' ORDER BY reconcile) FROM (SELECT reconcile, count(*) AS n FROM records GROUP BY 1)) AS statuses,
  (SELECT count(*) FROM frames WHERE token NOT IN (SELECT token FROM detections)) AS missing_features
FROM records""")
def f3(v):
    missing = v.frames.select("token").join(v.detections.select("token"), "token", "left_anti")
    m = traces.manifest(records(v), TH, missing)
    show = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("frames", "episodes", "teacher_fallbacks", r6("action_fidelity").alias("action_fidelity"),
                    show("decision_histogram").alias("decisions"), show("reconcile_histogram").alias("statuses"),
                    "missing_features")


_LIMITS = ",".join(f"{k}={float(x)}" for k, x in sorted(vars(TH).items()))


@query("f3_fallback_examples", f"""
SELECT (SELECT count(*) FROM records) AS frames, '{_LIMITS}' AS thresholds,
  (SELECT string_agg(reason, '|' ORDER BY scene_token, frame_idx) FROM (SELECT scene_token, frame_idx, token || ': no clean candidate' AS reason FROM frames
    WHERE event_id % 97 = 3 ORDER BY scene_token, frame_idx LIMIT 5)) AS examples""")
def f3_examples(v):
    """The manifest with the first five frames whose teacher fell back."""
    fell = v.frames.filter("event_id % 97 = 3").select("scene_token", "frame_idx", F.concat("token", F.lit(": no clean candidate")).alias("reason"))
    m = traces.manifest(records(v), TH, reasons=fell)
    limits = F.transform(F.array_sort(F.map_entries("thresholds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("frames", F.array_join(limits, ",").alias("thresholds"), F.array_join("fallback_examples", "|").alias("examples"))


# ---- text ---------------------------------------------------------------------

@query("t1_format_trajectory", "SELECT token, traj_str FROM paths")
def t1(v):
    return v.futures.select("token", ph.waypoints_text(F.col("fut")).alias("traj_str"))


@query("t2_assistant_turn", """
SELECT token, '<reason_start>' || trace || '<reason_end><traj_start>' || traj_str || '<traj_end>' AS turn FROM said_gt""")
def t2(v):
    said = traces.verbalised(facts(v))
    return said.select("token", ph.assistant_turn(F.col("trace"), ph.waypoints_text(F.col("fut"))).alias("turn"))


@query("t7_entity_mentions", f"""
SELECT doc_id, array_to_string(list_sort(m), ',') AS mentions FROM (SELECT doc_id, {orl.mentions('text')} AS m FROM documents)
WHERE len(m) > 0
UNION ALL SELECT NULL, array_to_string(list_sort(m), ',') FROM (SELECT {orl.mentions('trace')} AS m FROM student)""")
def t7(v):
    m = ph.entity_mentions
    docs = v.table("documents").select("doc_id", m(F.col("text")).alias("m")).filter(F.size("m") > 0)
    said = student(v).select(F.lit(None).cast("long").alias("doc_id"), m(F.col("trace")).alias("m"))
    return docs.unionByName(said).select("doc_id", F.array_join(F.array_sort("m"), ",").alias("mentions"))


@query("t8_decision_mentions", f"SELECT token, array_to_string(list_sort({orl.claims('trace')}), ',') AS claims FROM student")
def t8(v):
    return student(v).select("token", F.array_join(F.array_sort(ph.decision_mentions(F.col("trace"))), ",").alias("claims"))


@query("t9_hallucinations", f"""
SELECT token, decision, array_to_string(list_sort({orl.problems('trace', 'decision', 'allowed')}), ',') AS problems FROM student""")
def t9(v):
    p = ph.hallucinations(F.col("trace"), F.col("decision"), F.col("allowed"))
    return student(v).select("token", "decision", F.array_join(F.array_sort(p), ",").alias("problems"))


@query("t10_template_trace", "SELECT token, decision, trace FROM said_gt")
def t10(v):
    return traces.verbalised(facts(v)).select("token", "decision", "trace")


_CLOSING = orl.quote("\n" + __import__("kerbside.functions.lexicon", fromlist=["x"]).TEACHER_CLOSING)


@query("t11_teacher_prompt", f"""
SELECT token, 'Decision: ' || decision || chr(10) || 'Grounding (use only these):' || chr(10) ||
  coalesce(nullif(array_to_string(list_transform(phrases, lambda p: '- ' || p), chr(10)), ''), '- (no extra grounding)') ||
  chr(10) || 'Entities you may name: ' || coalesce(nullif(array_to_string(list_sort(allowed), ', '), ''), '(no named entities)') ||
  {_CLOSING} AS prompt FROM said_gt""")
def t11(v):
    said = traces.verbalised(facts(v))
    return said.select("token", ph.teacher_prompt(F.col("decision"), F.col("phrases"), F.col("allowed")).alias("prompt"))
