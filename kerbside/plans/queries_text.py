"""Queries for model output, scores and training text (A4, D5-D8, F5-F8, F16, F28, T)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions import lexicon as lex, phrases as ph, turns
from kerbside.functions.fmt import fixed
from kerbside.operators import ego, scoring, training, traces, windows
from kerbside.plans import oracle_rules as orl
from kerbside.plans.oracle_views import hyp, r6 as s6, register, wrap
from kerbside.plans.queries_rules import facts, student
from kerbside.plans.queries_windows import rounded_history
from kerbside.plans.registry import query, r6
from kerbside.sources import predictions as src

# ---- model output derived from the frames ------------------------------------------


def _noisy(k: int) -> list[Column]:
    e, p = F.col("event_id"), F.element_at("fut", k)
    return [p["r"] + ((e * k) % 9 - 4) * 0.05, p["f"] + ((e * k) % 7 - 3) * 0.05, p["h"]]


def output_lines(v):
    """JSON rows as a model run would write them: both id forms, list and plain answers,
    broken answers, unknown tokens, and a stale first row for some tokens."""
    e = F.col("event_id")
    pts = [[fixed(c, 2) for c in _noisy(k)] for k in range(1, 7)]
    three = [F.concat(F.lit("("), a, F.lit(","), b, F.lit(","), h, F.lit(")")) for a, b, h in pts]
    two = [F.concat(F.lit("("), a, F.lit(", "), b, F.lit(")")) for a, b, _ in pts]
    body = F.when(e % 23 == 0, F.concat_ws(",", *three[:5])).when(e % 31 == 0, F.concat_ws(",", *two)).otherwise(
        F.concat_ws(",", *three))
    answer = F.when(e % 29 == 0, F.lit("I cannot answer.")).otherwise(
        F.concat(F.lit("<reason_start>about 5.7 m away<reason_end><traj_start>["), body, F.lit("]<traj_end>")))
    token = F.when(e % 37 == 0, F.concat(F.lit("zz_"), "token")).otherwise(F.col("token"))
    rows = v.futures.select("event_id", answer.alias("answer"), F.concat(token, F.lit("_trajectory")).alias("ident"))
    rec = F.when(e % 5 == 0, F.to_json(F.struct(F.col("ident").alias("sample_id"), "answer"))).otherwise(
        F.to_json(F.struct(F.col("ident").alias("id"), F.array("answer").alias("answer"))))
    real = rows.select((e * 2 + 1).alias("pos"), rec.alias("value"))
    stale = rows.filter(e % 41 == 0).select((e * 2).alias("pos"), F.to_json(F.struct(
        F.col("ident").alias("id"), F.lit("stale").alias("answer"))).alias("value"))
    return real.unionByName(stale)


def preds(v):
    return src.parse_records(output_lines(v))


register("preds", """
SELECT CASE WHEN event_id % 37 = 0 THEN 'zz_' || token ELSE token END AS token, event_id,
  CASE WHEN event_id % 29 = 0 THEN 'I cannot answer.' ELSE
  '<reason_start>about 5.7 m away<reason_end><traj_start>[' || CASE WHEN event_id % 23 = 0 THEN t5
    WHEN event_id % 31 = 0 THEN p6 ELSE t6 END || ']<traj_end>' END AS answer
FROM (SELECT token, event_id, string_agg(three, ',' ORDER BY step) AS t6, string_agg(two, ',' ORDER BY step) AS p6,
        string_agg(three, ',' ORDER BY step) FILTER (WHERE step <= 5) AS t5
      FROM (SELECT *, printf('(%.2f,%.2f,%.2f)', nr, nf, h) AS three, printf('(%.2f, %.2f)', nr, nf) AS two
            FROM (SELECT *, r + ((event_id*step) % 9 - 4)*0.05::DOUBLE AS nr, f + ((event_id*step) % 7 - 3)*0.05::DOUBLE AS nf FROM future))
      GROUP BY token, event_id)
""")

_TRI = r"\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)"
_PAIR = r"\(\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)(?:\s*,\s*[+-]?\d+(?:\.\d+)?)?\s*\)"


def _nums(text: str, pattern: str, group: int) -> str:
    return f"list_transform(regexp_extract_all({text}, '{pattern}', {group}), lambda s: TRY_CAST(s AS DOUBLE))"


register("parsed", f"""
SELECT token, answer, {_nums('answer', _TRI, 1)} AS ar, {_nums('answer', _TRI, 2)} AS af, {_nums('answer', _TRI, 3)} AS ah,
  {_nums('answer', _PAIR, 1)} AS br, {_nums('answer', _PAIR, 2)} AS bf FROM preds
""")


@query("a4_read_predictions", "SELECT token, answer FROM preds")
def a4(v):
    return preds(v).select("token", "answer")


@query("t3_parse_turn", """
SELECT token, CASE WHEN NOT contains(answer, '<traj_start>') THEN 'no trajectory block'
  WHEN len(ar) <> 6 THEN 'expected 6 waypoints, parsed ' || len(ar) END AS error,
  CASE WHEN contains(answer, '<traj_start>') AND len(ar) = 6 THEN ar[6] END AS last_r,
  CASE WHEN contains(answer, '<reason_start>') THEN 'about 5.7 m away' END AS trace FROM parsed""")
def t3(v):
    p = preds(v).select("token", turns.parse_turn(F.col("answer")).alias("t"))
    return p.select("token", "t.error", F.element_at("t.points", -1)["r"].alias("last_r"), "t.trace")


@query("t3_format_failures", """
SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM (
  SELECT CASE WHEN NOT contains(answer, '<traj_start>') THEN 'no trajectory block'
    WHEN len(ar) <> 6 THEN 'expected 6 waypoints, parsed ' || len(ar) END AS error FROM parsed) GROUP BY 1""")
def t3_rate(v):
    err = turns.parse_turn(F.col("answer"))["error"]
    return preds(v).select(F.coalesce(err, F.lit("ok")).alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))


@query("t4_split_reason_traj", """
SELECT token, CASE WHEN contains(answer, '<reason_start>') THEN 'about 5.7 m away' ELSE '' END AS reason,
  CASE WHEN contains(answer, '<traj_start>') THEN regexp_extract(answer, '<traj_start>(.*?)<traj_end>', 1) ELSE answer END AS traj
FROM preds""")
def t4(v):
    return preds(v).select("token", turns.split_reason_traj(F.col("answer")).alias("s")).select(
        "token", "s.reason", "s.traj")


_SQL_REPAIRS = [
    ("[a-zA-Z]", ""), (r"[\x{4e00}-\x{9fff}]", ""), (r"(\d+)\.\.+", r"\1."), ("[<>]", ""),
    (r"(\d+\.\d+)\s+(\d+\.\d+)(\s*[,\)])", r"\1, \2\3"), (r"(\d+\.\d+)-(\d+\.\d+)", r"\1, \2"),
    (r"(\(\s*-?\d+\.\d+,\s*-?\d+\.\d+),\s*-?\d+\.\d+(\s*\))", r"\1\2"), (r"\s+", ""),
    (r"(\d+\.\d+)\.(\d+)", r"\1\2"), (r"(\d+)\.\.(\d+)", r"\1.\2"), (r"(\d+)\.\-(\d+)", r"\1.\2"),
]


def _repaired(text: str) -> str:
    for pattern, by in _SQL_REPAIRS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


_BRACKET = r"[\[\(]([-\deE.+]+),\s*([-\deE.+]+)[\]\)]"

# damage of every kind the repairs know, chosen by event
_DAMAGE_SQL = r"""CASE event_id % 6 WHEN 0 THEN replace(answer, '.', '..') WHEN 1 THEN replace(answer, ',(', ' , (')
  WHEN 2 THEN regexp_replace(answer, '(\d+\.\d+),(-?\d+\.\d+)\)', '\1 \2)', 'g') WHEN 3 THEN replace(answer, '(', '( x')
  WHEN 4 THEN replace(answer, ',', ' , ') ELSE answer END"""
register("repaired", f"""
SELECT token, event_id, {_nums('clean', _BRACKET, 1)} AS rr, {_nums('clean', _BRACKET, 2)} AS rf FROM (
  SELECT token, event_id, {_repaired("CASE WHEN contains(a, '<traj_start>') THEN regexp_extract(a, '<traj_start>(.*?)<traj_end>', 1) ELSE a END")} AS clean
  FROM (SELECT token, event_id, {_DAMAGE_SQL} AS a FROM preds))
""")


def damaged(v):
    # event_id is part of the generated rows only through the frame, so join it back
    ids = v.frames.select("event_id", F.when(F.col("event_id") % 37 == 0, F.concat(F.lit("zz_"), "token"))
                          .otherwise(F.col("token")).alias("token"))
    a, m = F.col("answer"), F.col("event_id") % 6
    broken = (
        F.when(m == 0, F.replace(a, F.lit("."), F.lit("..")))
        .when(m == 1, F.replace(a, F.lit(",("), F.lit(" , (")))
        .when(m == 2, F.regexp_replace(a, r"(\d+\.\d+),(-?\d+\.\d+)\)", "$1 $2)"))
        .when(m == 3, F.replace(a, F.lit("("), F.lit("( x")))
        .when(m == 4, F.replace(a, F.lit(","), F.lit(" , ")))
        .otherwise(a))
    return preds(v).join(ids, "token").select("token", broken.alias("answer"))


@query("t5_repair_trajectory", """
SELECT token, i AS step, CASE WHEN len(rr) >= i THEN rr[i] ELSE rr[-1] END AS r, CASE WHEN len(rr) >= i THEN rf[i] ELSE rf[-1] END AS f
FROM repaired CROSS JOIN range(1, 7) t(i) WHERE len(rr) > 0""")
def t5(v):
    span = turns.split_reason_traj(F.col("answer"))["traj"]
    p = damaged(v).select("token", F.posexplode(turns.repair_points(span)).alias("i", "p"))
    return p.select("token", (F.col("i") + 1).alias("step"), "p.r", "p.f")


@query("t6_waypoint_counts", """
SELECT token, len(ar) AS strict, len(br) AS lenient, list_sum(ar) AS sum_r, list_sum(bf) AS sum_f FROM parsed""")
def t6(v):
    p = preds(v).select("token", turns.triples(F.col("answer")).alias("a"), turns.pairs(F.col("answer")).alias("b"))
    total = lambda c, n: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x[n]))
    return p.select("token", F.size("a").cast("long").alias("strict"), F.size("b").cast("long").alias("lenient"),
                    total("a", "r").alias("sum_r"), total("b", "f").alias("sum_f"))


# ---- scores ---------------------------------------------------------------------------

@query("d5_prediction_coverage", """
SELECT count(*) FILTER (WHERE p.token IS NOT NULL AND f.token IS NOT NULL) AS matched,
  count(*) FILTER (WHERE f.token IS NULL) AS unknown_predictions, count(*) FILTER (WHERE p.token IS NULL) AS unpredicted_frames
FROM preds p FULL JOIN frames f ON p.token = f.token""")
def d5(v):
    return scoring.coverage(preds(v), v.frames)


@query("f5_trajectory_score", f"""
SELECT count(*) FILTER (WHERE ok) AS scored, count(*) FILTER (WHERE NOT ok) AS dropped,
  {s6("avg(ade)")} AS ade, {s6("avg(fde)")} AS fde, {s6("avg(fde)")} AS final_position, {s6("avg(head)")} AS final_heading,
  {s6("count(*) FILTER (WHERE fde < 0.5 AND head < radians(10)) / count(*) FILTER (WHERE ok)::DOUBLE")} AS parked_well
FROM (SELECT len(ar) = 6 AS ok,
  CASE WHEN len(ar) = 6 THEN ({" + ".join(hyp(f"ar[{i}]-rs[{i}]", f"af[{i}]-fs[{i}]") for i in range(1, 7))})/6 END AS ade,
  CASE WHEN len(ar) = 6 THEN {hyp("ar[6]-rs[6]", "af[6]-fs[6]")} END AS fde,
  CASE WHEN len(ar) = 6 THEN abs({wrap("ah[6]-hs[6]")}) END AS head
  FROM parsed JOIN paths USING (token))""")
def f5(v):
    s = scoring.trajectory_score(preds(v), v.futures.select("token", "fut"))
    return s.select("scored", "dropped", *[r6(c).alias(c) for c in
                    ("ade", "fde", "final_position", "final_heading", "parked_well")])


@query("f6_l2_by_gear", f"""
SELECT sec, CASE WHEN grouping(reverse) = 1 THEN 'all' WHEN reverse THEN 'reverse' ELSE 'forward' END AS gear,
  {s6("avg(l2)")} AS l2, count(*) AS n
FROM (SELECT reverse, sec, {hyp("br[2*sec]-rs[2*sec]", "bf[2*sec]-fs[2*sec]")} AS l2
      FROM parsed JOIN paths USING (token) CROSS JOIN range(1, 4) t(sec) WHERE len(br) >= 6)
GROUP BY GROUPING SETS ((sec), (sec, reverse))""")
def f6(v):
    return scoring.l2_by_gear(preds(v), v.futures.select("token", "reverse", "fut")).select(
        "sec", "gear", r6("l2").alias("l2"), "n")


@query("f7_faithfulness", f"""
SELECT coalesce(decision, 'ALL') AS decision, count(*) AS n, {s6("avg(fid)")} AS entity_fidelity,
  {s6("avg(CASE WHEN len(probs) = 0 THEN 1.0 ELSE 0.0 END)")} AS clean_rate
FROM (SELECT decision, CASE WHEN len(m) = 0 THEN 1.0 ELSE len(list_intersect(m, allowed))/len(m)::DOUBLE END AS fid,
        {orl.problems('trace', 'decision', 'allowed')} AS probs
      FROM (SELECT *, {orl.mentions('trace')} AS m FROM student))
GROUP BY ROLLUP (decision)""")
def f7(v):
    return scoring.faithfulness(student(v)).select(
        "decision", "n", r6("entity_fidelity").alias("entity_fidelity"), r6("clean_rate").alias("clean_rate"))


def _ngram_sql(n: int) -> str:
    toks = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
    return f"""SELECT {n} AS n, count(DISTINCT g) AS distinct_grams, count(*) AS all_grams,
  {s6("count(DISTINCT g)/greatest(1, count(*))::DOUBLE")} AS share
FROM (SELECT unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i+{n}-1], ' '))) AS g
      FROM (SELECT {toks} AS w FROM documents))"""


@query("f8_distinct_ngrams", _ngram_sql(2) + "\nUNION ALL\n" + _ngram_sql(3))
def f8(v):
    return scoring.distinct_n(v.table("documents").select("text"), [2, 3]).select("n", "distinct_grams", "all_grams", r6("share").alias("share"))


@query("f8_unique_texts", "SELECT count(DISTINCT text) AS unique_texts, count(*) AS texts FROM documents")
def f8_unique(v):
    return scoring.unique_share(v.table("documents"))


register("valid_steps", "SELECT token, count(*) AS n_valid FROM plan_steps GROUP BY token")
register("plan_l2", f"""
SELECT step, avg(CASE WHEN step <= coalesce(n_valid, 0) THEN {hyp(
    "CASE WHEN len(rr) >= step THEN rr[step] ELSE rr[-1] END - rs[step]",
    "CASE WHEN len(rr) >= step THEN rf[step] ELSE rf[-1] END - fs[step]")} ELSE 0 END) AS l2, count(*) AS frames
FROM (SELECT token, rr, rf FROM repaired_plain WHERE len(rr) > 0) JOIN paths USING (token) LEFT JOIN valid_steps USING (token)
CROSS JOIN range(1, 7) t(step) GROUP BY step
""")
register("repaired_plain", f"""
SELECT token, {_nums('clean', _BRACKET, 1)} AS rr, {_nums('clean', _BRACKET, 2)} AS rf FROM (
  SELECT token, {_repaired("CASE WHEN contains(answer, '<traj_start>') THEN regexp_extract(answer, '<traj_start>(.*?)<traj_end>', 1) ELSE answer END")} AS clean
  FROM preds)
""")


def planning_truth(v):
    steps = windows.future_masked(v.frames, 6).select("token", F.size("steps").alias("n_valid"))
    return v.futures.select("token", "fut").join(steps, "token")


@query("f16_planning_l2", f"""
SELECT a.step, {s6("a.l2")} AS l2, a.frames, {s6("avg(b.l2)")} AS mean_to_step
FROM plan_l2 a JOIN plan_l2 b ON b.step <= a.step GROUP BY ALL""")
def f16(v):
    s = scoring.planning_l2(preds(v), planning_truth(v))
    return s.select("step", r6("l2").alias("l2"), "frames", r6("mean_to_step").alias("mean_to_step"))


@query("f28_conversation_lengths", """
SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')))::BIGINT AS words
FROM conversations GROUP BY conv_id""")
def f28(v):
    return scoring.conversation_lengths(v.table("conversations"))


# ---- training text ----------------------------------------------------------------------

register("ego_messages", f"""
SELECT token, printf('- Velocity (vx,vy): (%.2f,%.2f) - Heading Angular Velocity (v_yaw): (%.2f) - Acceleration (ax,ay): (%.2f,%.2f) - Heading Speed: (%.2f) - Steering: (%.2f)',
    ego_right_v*0.5, ego_fwd_v*0.5, yaw_rate, (m.rs[5]-m.rs[4]) - (m.rs[4]-m.rs[3]), (m.fs[5]-m.fs[4]) - (m.fs[4]-m.fs[3]), speed_ms*0.5, steer) AS ego_message,
  printf('[(%.2f,%.2f),(%.2f,%.2f),(%.2f,%.2f),(%.2f,%.2f)]', m.rs[1], m.fs[1], m.rs[2], m.fs[2], m.rs[3], m.fs[3], m.rs[4], m.fs[4]) AS his_message,
  replace(maneuver_type, '_', '-') || ' park, ' || side || printf(' side, into slot at (%.2f,%.2f,%.2f)', slot_r, slot_f, slot_dh) AS goal,
  p.traj_str, s.scene_token, s.split, s.event_id
FROM slot_frames s JOIN motion m USING (token) JOIN (SELECT token, traj_str FROM paths) p USING (token)
""")


def cache_frames(v):
    """Frames with rounded history, its differences and the future."""
    h = windows.history_motion(rounded_history(v))
    return h.join(v.futures.select("token", "fut"), "token")


@query("t13_user_message", "SELECT token AS sample_id, ego_message, his_message, goal, traj_str FROM ego_messages")
def t13(v):
    return training.ego_cache(cache_frames(v))


@query("t15_conversation_index", """
SELECT token || '_trajectory' AS qa_id, token AS sample_id, split, 2 AS turns FROM frames""")
def t15(v):
    return training.conversation_index(v.frames).select(
        "qa_id", "sample_id", "split", F.size("conversations").alias("turns"))


_Q = orl.quote
_SCENE = _Q(turns.SCENE_LINES)
register("training_rows", f"""
SELECT token || '_trajectory' AS qa_id, token AS sample_id, split,
  CASE WHEN event_id % 17 = 0 THEN {_SCENE} || CASE WHEN event_id % 19 = 0 THEN '' ELSE
      'Ego states: ' || ego_message || chr(10) || 'Historical trajectory (last 2 seconds): ' || his_message || chr(10) END
      || 'Please answer the following question: What is behind me?'
    WHEN event_id % 19 = 0 THEN {_Q(turns.MISSING_PROMPT)}
    ELSE {_SCENE} || 'Ego states: ' || ego_message || chr(10) || 'Historical trajectory (last 2 seconds): ' || his_message
      || chr(10) || 'Mission goal: ' || goal || chr(10) || {_Q(turns.PLAN_LINE)} END AS human,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN '<traj_start>' || {_Q(turns.ZERO_TRAJECTORY)} || '<traj_end>'
    WHEN event_id % 10 = 3 THEN '<traj_start>' || traj_str || '<traj_end>'
    ELSE '<reason_start>' || trace || '<reason_end><traj_start>' || traj_str || '<traj_end>' END AS gpt
FROM ego_messages JOIN (SELECT token, trace FROM said_gt) USING (token)
""")


def training_rows(v):
    """Rows with every branch: questions, frames without a cache row, frames without a trace."""
    ids = v.frames.select("token", "event_id")
    asked = training.conversation_index(v.frames).join(
        ids.withColumnRenamed("token", "sample_id"), "sample_id").withColumn(
        "question", F.when(F.col("event_id") % 17 == 0, "What is behind me?")).drop("event_id")
    cached = cache_frames(v).filter("event_id % 19 <> 0")
    said = traces.verbalised(facts(v)).filter("event_id % 10 <> 3").select("token", "trace", F.lit("factual").alias("role"))
    return training.render_conversations(asked, training.ego_cache(cached), training.factual_traces(said))


@query("t14_conversation_render", "SELECT * FROM training_rows")
def t14(v):
    return training_rows(v)


@query("t20_question_rows", "SELECT * FROM training_rows WHERE contains(human, 'Please answer')")
def t20(v):
    return training_rows(v).filter(F.contains("human", F.lit("Please answer")))


@query("d6_trace_join", """
SELECT split, contains(gpt, '<reason_start>') AS reasoned, count(*) AS n FROM training_rows GROUP BY ALL""")
def d6(v):
    return training_rows(v).groupBy("split", F.contains("gpt", F.lit("<reason_start>")).alias("reasoned")).agg(
        F.count(F.lit(1)).alias("n"))


@query("d7_ego_cache_join", """
SELECT sample_id, contains(human, 'unavailable') AS placeholder FROM training_rows""")
def d7(v):
    return training_rows(v).select("sample_id", F.contains("human", F.lit("unavailable")).alias("placeholder"))


@query("c8_factual_traces", """
SELECT token, trace FROM said_gt WHERE event_id % 3 <> 1 AND event_id % 14 <> 5""")
def c8(v):
    e = F.col("event_id")
    rows = traces.verbalised(facts(v)).select(
        "token", F.when(e % 14 == 5, "").otherwise(F.col("trace")).alias("trace"),
        F.when(e % 3 == 1, "counterfactual").when(e % 3 == 2, "factual").alias("role"))
    return training.factual_traces(rows).select("token", "trace")


@query("t12_select_candidate", f"""
SELECT s.token, s.decision, coalesce(c.text, s.trace) AS trace,
  CASE WHEN c.text IS NULL THEN 'teacher_fallback_mock' ELSE 'teacher' END AS teacher
FROM said_gt s LEFT JOIN (
  SELECT token, arg_min(text, round*10 + pos) AS text FROM candidates
  WHERE text <> '' AND len({orl.problems('text', 'decision', 'allowed')}) = 0 GROUP BY token) c USING (token)""")
def t12(v):
    said = traces.verbalised(facts(v)).select("token", "decision", "allowed", "trace", "event_id")
    e = F.col("event_id")
    tries = said.select("token", F.explode(F.array(
        F.struct(F.lit(1).alias("round"), F.lit(1).alias("pos"), F.lit(' "" ').alias("text")),
        F.struct(F.lit(1).alias("round"), F.lit(2).alias("pos"), F.when(e % 4 == 0, "I yield to a truck near the slot.").otherwise("I will abort.").alias("text")),
        F.struct(F.lit(2).alias("round"), F.lit(1).alias("pos"), F.when(e % 3 == 0, ' "The slot is close, so I move on." ').otherwise("There is a walker.").alias("text")),
    )).alias("c")).select("token", "c.*")
    return training.choose_candidate(tries, said, "teacher")


register("candidates", """
SELECT token, decision, allowed, round, pos, CASE pos*10 + round WHEN 11 THEN '' WHEN 21 THEN
    CASE WHEN event_id % 4 = 0 THEN 'I yield to a truck near the slot.' ELSE 'I will abort.' END
  ELSE CASE WHEN event_id % 3 = 0 THEN 'The slot is close, so I move on.' ELSE 'There is a walker.' END END AS text
FROM said_gt CROSS JOIN (VALUES (1, 1), (1, 2), (2, 1)) t(round, pos)
""")


@query("t16_chat_template", """
SELECT conv_id, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ||
  string_agg('<|im_start|>' || role || chr(10) || CASE WHEN text = '' THEN '' ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY turn) AS prompt
FROM conversations GROUP BY conv_id""")
def t16(v):
    per = v.table("conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return per.select("conv_id", turns.chat_text("You are a helpful assistant.", F.col("turns")).alias("prompt"))


_SYSTEM, _SEPS = "Be brief.", {"single": ("###", ""), "two": (" ", "</s>"), "mpt": ("<|im_end|>", ""), "gemma": ("<end>", ""), "plain": ("~", "^"), "llama_2": ("<s>", "</s>")}


def _style_sql(style: str) -> str:
    sep, sep2 = _SEPS[style]
    alternate = f"CASE WHEN i % 2 = 0 THEN '{sep}' ELSE '{sep2}' END"
    head, said, left = {
        "single": (_SYSTEM + sep, f"r || ': ' || text || '{sep}'", "r || ':'"), "two": (_SYSTEM + sep, f"r || ': ' || text || {alternate}", "r || ':'"),
        "mpt": (_SYSTEM + sep, f"r || text || '{sep}'", "r"), "gemma": ("", f"r || text || '{sep}'", "r"), "plain": (_SYSTEM, f"text || {alternate}", "''"),
        "llama_2": ("", f"""CASE WHEN i = 0 THEN '[INST] <<SYS>>' || chr(10) || '{_SYSTEM}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text || ' [/INST]'
          WHEN i % 2 = 0 THEN '{sep}[INST] ' || text || ' [/INST]' ELSE ' ' || text || ' {sep2}' END""", "''")}[style]
    return f"""SELECT conv_id, '{style}' AS style, '{head}' || string_agg(CASE WHEN coalesce(text, '') <> '' THEN {said} ELSE {left} END, '' ORDER BY i) AS prompt
FROM (SELECT conv_id, upper(role) AS r, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id"""


@query("t16_chat_styles", " UNION ALL ".join(_style_sql(s) for s in _SEPS))
def t16_styles(v):
    """Every conversation in each style; every fifth turn is left open."""
    text = F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text"))
    per = v.table("conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.upper("role").alias("role"), text.alias("text")))).alias("turns"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), turns.styled_chat(s, _SYSTEM, F.col("turns"), *seps).alias("prompt")) for s, seps in _SEPS.items()]))
    return per.select("conv_id", each.alias("p")).select("conv_id", "p.style", "p.prompt")


@query("t17_placeholder_segments", r"""
SELECT sample_id, count(*) FILTER (WHERE piece NOT IN ('<IMAGE>','<SCENE>','<TRACK>','<MAP>','<OBJECT>')) AS text_pieces,
  string_agg(CASE piece WHEN '<IMAGE>' THEN '-200' WHEN '<SCENE>' THEN '-201' WHEN '<TRACK>' THEN '-202' WHEN '<MAP>' THEN '-203' WHEN '<OBJECT>' THEN '-204' END, ',' ORDER BY i) AS markers
FROM (SELECT sample_id, unnest(list_filter(string_split(regexp_replace(human, '(<(IMAGE|SCENE|TRACK|MAP|OBJECT)>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')) AS piece,
        generate_subscripts(list_filter(string_split(regexp_replace(human, '(<(IMAGE|SCENE|TRACK|MAP|OBJECT)>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p <> ''), 1) AS i
      FROM training_rows) GROUP BY sample_id""")
def t17(v):
    seg = training_rows(v).select("sample_id", turns.segments(F.col("human")).alias("s"))
    ids = F.filter(F.transform("s", lambda x: x["marker_id"]), lambda m: m.isNotNull())
    return seg.select(
        "sample_id", (F.size("s") - F.size(ids)).cast("long").alias("text_pieces"),
        F.array_join(F.transform(ids, lambda m: m.cast("string")), ",").alias("markers"))


@query("t18_loss_spans", r"""
SELECT conv_id, turn, role, length(text) AS chars,
  CASE WHEN role = 'assistant' THEN length(text) ELSE length(text) - length(replace(text, chr(10), '')) END AS kept_chars
FROM conversations""")
def t18(v):
    c = v.table("conversations").withColumn("s", turns.loss_spans(F.col("role"), F.col("text")))
    # the rendered turn adds three markers or newlines and the role name around the text
    kept = F.aggregate(F.filter("s", lambda x: x["keep"]), F.lit(0), lambda a, x: a + F.length(x["span"]))
    shell = F.length(F.lit("<|im_start|>\n<|im_end|>\n")) + F.when(F.col("role") == "assistant", 9).otherwise(0)
    return c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"),
                    (kept - shell).cast("long").alias("kept_chars"))


@query("t19_interventions", """
SELECT a.token, b.token AS donor, b.trace AS swapped, '' AS emptied FROM said_gt a JOIN said_gt b
ON b.scene_token = a.scene_token AND b.frame_idx = CASE WHEN a.frame_idx = a.last_idx THEN 0 ELSE a.frame_idx + 1 END
WHERE a.token <> b.token""".replace("FROM said_gt a", "FROM (SELECT *, max(frame_idx) OVER (PARTITION BY scene_token) AS last_idx FROM said_gt) a"))
def t19(v):
    said = traces.verbalised(facts(v)).select("scene_token", "token", "frame_idx", "trace")
    last = said.groupBy("scene_token").agg(F.max("frame_idx").alias("_last"))
    nxt = F.when(F.col("frame_idx") == F.col("_last"), 0).otherwise(F.col("frame_idx") + 1)
    donors = said.select("scene_token", F.col("frame_idx").alias("_at"), F.col("token").alias("donor"),
                         F.col("trace").alias("swapped"))
    asked = said.join(last, "scene_token").withColumn("_at", nxt)
    return asked.join(donors, ["scene_token", "_at"]).filter("token <> donor").select(
        "token", "donor", "swapped", F.lit("").alias("emptied"))
