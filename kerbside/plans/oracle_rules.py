"""Decision rules, phrases and checks once more as SQL for the check engine."""

from __future__ import annotations

from kerbside.functions import lexicon as lex
from kerbside.plans.oracle_views import CTES, hyp, register


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(column: str, table: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


register("rule_frames", """
SELECT s.*, p.rs, p.fs, p.hs, p.traj_str,
  lag(s.reverse) OVER (PARTITION BY s.scene_token ORDER BY s.frame_idx) AS prev_reverse,
  sqrt(slot_r*slot_r + slot_f*slot_f) AS dist, abs(slot_dh) AS aerr
FROM slot_frames s JOIN (SELECT token, rs, fs, hs, traj_str FROM paths) p USING (token)
""")

_OBJ = """{'cls': cls, 'r': "right", 'f': forward}"""


def _pick(cond: str, key: str, last: bool) -> str:
    tie = "obj_pos DESC" if last else "obj_pos"
    return f"first({_OBJ} ORDER BY {key}, {tie}) FILTER (WHERE {cond})"


def picks(objects: str) -> str:
    along = "(CASE WHEN reverse THEN 0 - forward ELSE forward END)"
    dr = hyp('"right" - slot_r - 3.0::DOUBLE*cos(slot_dh)', "forward - slot_f - 3.0::DOUBLE*sin(slot_dh)")
    dl = hyp('"right" - slot_r + 3.0::DOUBLE*cos(slot_dh)', "forward - slot_f + 3.0::DOUBLE*sin(slot_dh)")
    vehicle = "cls IN ('car', 'truck')"
    swept = "least(" + ", ".join(hyp(f'rs[{i}] - "right"', f"fs[{i}] - forward") for i in range(1, 7)) + ")"
    return f"""
SELECT token,
  {_pick(f'{along} > 0 AND {along} <= 5 AND abs("right") <= 1.2', along, False)} AS in_path,
  {_pick(f'{vehicle} AND {dl} <= 2', dl, True)} AS flank_left,
  {_pick(f'{vehicle} AND {dr} <= 2', dr, True)} AS flank_right,
  {_pick('forward > 0 AND forward <= 8 AND abs("right") <= 2.5', 'forward', False)} AS front,
  {_pick('forward < 0 AND forward >= -6 AND abs("right") <= 2.0', '-forward', False)} AS rear,
  {_pick(f'{swept} <= 2.5', swept, True)} AS swept,
  coalesce(bool_or({hyp('"right" - slot_r', 'forward - slot_f')} <= 1.2), false) AS occupied
FROM rule_frames r JOIN (SELECT token, cls, "right", forward, obj_pos FROM {objects}) o USING (token)
GROUP BY token
"""


def _obs(pick: str, role: str) -> str:
    return (f"CASE WHEN {pick} IS NOT NULL THEN {{'kind': 'obstacle', 'name': {pick}.cls, 'r': {pick}.r, "
            f"'f': {pick}.f, 'value': NULL::DOUBLE, 'role': '{role}'}} END")


def _metric(name: str, value: str, when: str = "true") -> str:
    return (f"CASE WHEN {when} THEN {{'kind': 'metric', 'name': '{name}', 'r': NULL::DOUBLE, 'f': NULL::DOUBLE, "
            f"'value': {value}, 'role': NULL::VARCHAR}} END")


def _manner(name: str) -> str:
    return (f"CASE WHEN {name} IS NOT NULL THEN {{'kind': 'manner', 'name': {name}, 'r': NULL::DOUBLE, "
            f"'f': NULL::DOUBLE, 'value': NULL::DOUBLE, 'role': NULL::VARCHAR}} END")


def facts(pick_view: str) -> str:
    slot = ("{'kind': 'slot', 'name': CASE WHEN coalesce(occupied, false) THEN 'occupied' ELSE 'free' END, "
            "'r': slot_r, 'f': slot_f, 'value': NULL::DOUBLE, 'role': NULL::VARCHAR}")
    dist, aerr = _metric("dist_to_slot", "dist"), _metric("align_err", "aerr")
    clear = _metric("clearance", hyp("in_path.r", "in_path.f"), "in_path IS NOT NULL")
    fl, fr = _obs("flank_left", "flank_left"), _obs("flank_right", "flank_right")
    front, rear, swept = _obs("front", "front"), _obs("rear", "rear"), _obs("swept", "swept")
    inp = _obs("in_path", "in_path")
    empty = "[]"
    steer, purpose, closer = _manner("m_steer"), _manner("m_purpose"), _manner("m_closer")
    plan = {
        "shift_gear": ([front, slot, dist], [steer]),
        "stop_yield": ([inp, clear], []),
        "complete_park": ([fl, fr, slot, dist, aerr], [closer]),
        "reverse": ([fl, fr, rear, slot, dist, aerr], [closer, steer]),
        "creep": ([inp, clear, swept], []),
        "align": ([swept, front, slot, dist, aerr], [steer]),
        "approach": ([front, swept, slot, dist], [purpose]),
    }

    def choose(side: int) -> str:
        arms = "".join(
            f" WHEN '{d}' THEN list_filter([{', '.join(parts[side])}], lambda e: e IS NOT NULL)"
            for d, parts in plan.items() if parts[side])
        return f"CASE decision{arms} ELSE {empty} END"

    key = "printf('%s|%.1f|%.1f', {e}.name, {e}.r + 0.0, {e}.f + 0.0)"
    fresh = (f"list_filter(cited, lambda e, i: e.kind <> 'obstacle' OR NOT list_contains("
             f"list_transform(list_filter(cited[1:i-1], lambda y: y.kind = 'obstacle'), "
             f"lambda z: replace({key.format(e='z')}, '-0.0', '0.0')), replace({key.format(e='e')}, '-0.0', '0.0')))")
    return f"""
SELECT * EXCLUDE (cited, extra), list_concat({fresh}, extra) AS factors FROM (
SELECT *, {choose(0)} AS cited, {choose(1)} AS extra FROM (
SELECT *,
  CASE WHEN prev_reverse IS NOT NULL AND prev_reverse <> reverse THEN 'shift_gear'
       WHEN speed_ms < 0.1 AND in_path IS NOT NULL THEN 'stop_yield'
       WHEN speed_ms < 0.1 AND dist < 1.5 AND aerr < 0.2 THEN 'complete_park'
       WHEN reverse THEN 'reverse'
       WHEN in_path IS NOT NULL AND {hyp('in_path.r', 'in_path.f')} <= 4 AND speed_ms < 0.5 THEN 'creep'
       WHEN abs(steer) > 0.5 AND speed_ms < 0.6 THEN 'align' ELSE 'approach' END AS decision,
  CASE WHEN abs(steer) > 0.6 THEN 'tight_turn' WHEN abs(steer) < 0.25 THEN 'gentle_turn' END AS m_steer,
  CASE WHEN dist > 3 THEN 'setup_forward' ELSE 'short_adjust' END AS m_purpose,
  CASE WHEN flank_left IS NOT NULL AND flank_right IS NOT NULL THEN
    CASE WHEN {hyp('flank_left.r', 'flank_left.f')} <= {hyp('flank_right.r', 'flank_right.f')}
         THEN 'closer_left' ELSE 'closer_right' END END AS m_closer
FROM rule_frames LEFT JOIN {pick_view} USING (token)))
"""


register("picks_gt", picks("objects"))
register("picks_det", picks("det_objects"))
register("facts_gt", facts("picks_gt"))
register("facts_det", facts("picks_det"))

_AT = "printf('@(%.1f,%.1f)', e.r, e.f)"
CANON = (
    "CASE e.kind WHEN 'obstacle' THEN 'obstacle[' || concat_ws('|', e.name, e.role) || ']' || " + _AT
    + " WHEN 'slot' THEN 'slot(' || e.name || ')' || " + _AT
    + " WHEN 'metric' THEN e.name || printf('=%.1f', e.value) ELSE 'manner(' || e.name || ')' END")


def joined(expr: str) -> str:
    return f"array_to_string(list_transform(factors, lambda e: {expr}), ';')"


def bearing(r: str, f: str) -> str:
    lon = f"CASE WHEN {f} > 0.7 THEN 'ahead' WHEN {f} < -0.7 THEN 'behind' END"
    lat = f"CASE WHEN {r} > 0.7 THEN 'on my right' WHEN {r} < -0.7 THEN 'on my left' END"
    return f"coalesce(nullif(concat_ws(' ', {lon}, {lat}), ''), 'right here')"


_D = "printf('%.1f', abs(e.f))"
_EU = "printf('%.1f', sqrt(e.r*e.r + e.f*e.f))"
PHRASE = f"""CASE e.kind
 WHEN 'obstacle' THEN 'a ' || e.name || CASE coalesce(e.role, '')
   WHEN 'flank_left' THEN ' in the bay to my left' WHEN 'flank_right' THEN ' in the bay to my right'
   WHEN 'front' THEN ' ahead about ' || {_D} || ' m away, limiting how far I can pull forward'
   WHEN 'rear' THEN ' behind me about ' || {_D} || ' m away, limiting how far I can back up'
   WHEN 'swept' THEN ' about ' || {_EU} || ' m from the path I am steering through'
   ELSE ' ' || {bearing('e.r', 'e.f')} || ' about ' || {_D} || ' m away' END
 WHEN 'slot' THEN 'the target slot is ' || CASE WHEN e.name = 'free' THEN 'clear' ELSE 'occupied' END || ', ' || {bearing('e.r', 'e.f')}
 WHEN 'metric' THEN CASE e.name WHEN 'dist_to_slot' THEN 'the slot is about ' || printf('%.1f', e.value) || ' m away'
   WHEN 'clearance' THEN 'there is about ' || printf('%.1f', e.value) || ' m of clearance'
   ELSE CASE WHEN e.value < 0.2 THEN 'my heading is nearly on target' ELSE 'my heading still needs correcting' END END
 ELSE {case_of('e.name', lex.MANNER_TEXT)} END"""

ALLOWED = """list_distinct(flatten(list_transform(factors, lambda e: CASE e.kind
  WHEN 'obstacle' THEN ['obstacle', 'obstacle:' || e.name] WHEN 'slot' THEN ['slot'] ELSE []::VARCHAR[] END)))"""


def verbalised(view: str) -> str:
    return f"""
SELECT *, {case_of('decision', lex.DECISION_HEAD)} || CASE len(phrases) WHEN 0 THEN '.'
  WHEN 1 THEN ' because ' || phrases[1] || '.'
  ELSE ' because ' || array_to_string(phrases[1:len(phrases)-1], ', ') || ', and ' || phrases[-1] || '.' END AS trace
FROM (SELECT *, list_transform(factors, lambda e: {PHRASE}) AS phrases, {ALLOWED} AS allowed FROM {view})
"""


register("said_gt", verbalised("facts_gt"))
register("said_det", verbalised("facts_det"))


def mentions(text: str) -> str:
    """Entity mentions of a text column as a list."""
    words = f"list_distinct(regexp_extract_all(lower({text}), '[a-z_]+'))"
    classes: dict[str, list[str]] = {}
    for word, cls in lex.OBSTACLE_WORDS.items():
        classes.setdefault(cls, []).append(word)
    any_word = "[" + ", ".join(quote(w) for w in lex.OBSTACLE_WORDS) + "]"
    arms = [f"CASE WHEN list_has_any({words}, {any_word}) THEN 'obstacle' END"]
    for cls, ws in classes.items():
        arms.append(f"CASE WHEN list_has_any({words}, [{', '.join(quote(w) for w in ws)}]) THEN 'obstacle:{cls}' END")
    slots = "[" + ", ".join(quote(w) for w in lex.SLOT_WORDS) + "]"
    arms.append(f"CASE WHEN list_has_any({words}, {slots}) THEN 'slot' END")
    return f"list_filter([{', '.join(arms)}], lambda m: m IS NOT NULL)"


def claims(text: str) -> str:
    """Decision mentions of a text column as a list."""
    by: dict[str, list[str]] = {}
    for phrase, name in lex.DECISION_PHRASES.items():
        by.setdefault(name, []).append(phrase)
    arms = [
        f"CASE WHEN regexp_matches(lower({text}), '\\b({'|'.join(ps)})(s|es|ed|ing)?\\b') THEN '{n}' END"
        for n, ps in by.items()]
    return f"list_filter([{', '.join(arms)}], lambda m: m IS NOT NULL)"


def problems(text: str, decision: str, allowed: str) -> str:
    sub = "CASE WHEN " + decision + " IN ('complete_park', 'reverse') THEN ['align'] ELSE []::VARCHAR[] END"
    return (f"list_concat(list_transform(list_filter({mentions(text)}, lambda m: NOT list_contains({allowed}, m)), lambda m: 'entity:' || m), "
            f"CASE WHEN list_contains({claims(text)}, {decision}) THEN []::VARCHAR[] ELSE "
            f"list_transform(list_filter({claims(text)}, lambda d: NOT list_contains({sub}, d)), lambda d: 'decision:' || d) END)")


ACTION = """CASE decision
  WHEN 'stop_yield' THEN CASE WHEN last < 0.15 THEN 1.0 ELSE 0.0 END
  WHEN 'complete_park' THEN CASE WHEN endd < 0.6 AND last < 0.15 THEN 1.0 ELSE 0.0 END
  WHEN 'reverse' THEN CASE WHEN endd >= 0.4 AND fs[2] > 0.2 THEN 0.0 ELSE 1.0 END
  WHEN 'approach' THEN CASE WHEN endd >= 0.4 AND fs[2] < -0.2 THEN 0.0 ELSE 1.0 END
  WHEN 'creep' THEN CASE WHEN fs[2] < -0.2 OR fs[2] > 1.2 THEN 0.0 ELSE 1.0 END
  WHEN 'align' THEN CASE WHEN endd > 3.0 AND abs(hs[6]) < 0.05 THEN 0.0 ELSE 1.0 END
  ELSE 1.0 END::DOUBLE"""

assert "facts_gt" in CTES
