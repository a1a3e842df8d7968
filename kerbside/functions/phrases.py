"""Text columns of the reasoning layer: templates, mentions, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions import lexicon as lex
from kerbside.functions.fmt import fixed
from kerbside.operators.rules import DECISIONS, bearing


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


# ---- template text ----------------------------------------------------------

def _obstacle_text(e: Column) -> Column:
    ahead = fixed(F.abs(e["f"]), 1)
    euclid = fixed(F.sqrt(e["r"] * e["r"] + e["f"] * e["f"]), 1)
    a = F.concat(F.lit("a "), e["name"])
    return (
        F.when(e["role"] == "flank_left", F.concat(a, F.lit(" in the bay to my left")))
        .when(e["role"] == "flank_right", F.concat(a, F.lit(" in the bay to my right")))
        .when(e["role"] == "front", F.concat(
            a, F.lit(" ahead about "), ahead, F.lit(" m away, limiting how far I can pull forward")))
        .when(e["role"] == "rear", F.concat(
            a, F.lit(" behind me about "), ahead, F.lit(" m away, limiting how far I can back up")))
        .when(e["role"] == "swept", F.concat(
            a, F.lit(" about "), euclid, F.lit(" m from the path I am steering through")))
        .otherwise(F.concat(a, F.lit(" "), bearing(e["r"], e["f"]), F.lit(" about "), ahead, F.lit(" m away")))
    )


def factor_text(e: Column) -> Column:
    """Qualitative phrase of one factor; null when it has nothing to say."""
    state = F.when(e["name"] == "free", "clear").otherwise("occupied")
    where = F.when(e["r"].isNotNull() & e["f"].isNotNull(), F.concat(F.lit(", "), bearing(e["r"], e["f"])))
    slot = F.concat(F.lit("the target slot is "), state, F.coalesce(where, F.lit("")))
    value = fixed(e["value"], 1)
    metric = (
        F.when(e["name"] == "dist_to_slot", F.concat(F.lit("the slot is about "), value, F.lit(" m away")))
        .when(e["name"] == "clearance", F.concat(F.lit("there is about "), value, F.lit(" m of clearance")))
        .when(e["name"] == "align_err", F.when(
            F.coalesce(e["value"], F.lit(0.0)) < 0.20, "my heading is nearly on target"
        ).otherwise("my heading still needs correcting"))
    )
    return (
        F.when(e["kind"] == "obstacle", _obstacle_text(e))
        .when(e["kind"] == "slot", slot)
        .when(e["kind"] == "metric", metric)
        .when(e["kind"] == "manner", _lookup(lex.MANNER_TEXT, e["name"]))
    )


def factor_phrases(factors: Column) -> Column:
    return F.array_compact(F.transform(factors, factor_text))


def template_trace(decision: Column, phrases: Column) -> Column:
    """``<head> because a, b, and c.`` from ready phrases."""
    head = F.coalesce(_lookup(lex.DECISION_HEAD, decision), F.concat(F.lit("I am "), decision))
    n = F.size(phrases)
    last = F.element_at(phrases, -1)
    # nullif keeps element_at and slice away from empty arrays
    some = F.when(n > 0, phrases)
    lead = F.array_join(F.slice(some, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, F.concat(head, F.lit(".")))
        .when(n == 1, F.concat(head, F.lit(" because "), F.get(phrases, F.lit(0)), F.lit(".")))
        .otherwise(F.concat(head, F.lit(" because "), lead, F.lit(", and "), F.element_at(some, -1), F.lit(".")))
    )


def teacher_prompt(decision: Column, phrases: Column, allowed: Column) -> Column:
    """User prompt of the teacher."""
    lines = F.array_join(F.transform(phrases, lambda p: F.concat(F.lit("- "), p)), "\n")
    names = F.array_join(F.array_sort(allowed), ", ")
    return F.concat(
        F.lit("Decision: "), decision,
        F.lit("\nGrounding (use only these):\n"), F.when(lines == "", "- (no extra grounding)").otherwise(lines),
        F.lit("\nEntities you may name: "), F.when(names == "", "(no named entities)").otherwise(names),
        F.lit("\n" + lex.TEACHER_CLOSING),
    )


# ---- mentions ---------------------------------------------------------------

def mention_keys(factors: Column) -> Column:
    """Entities a fact allows: obstacle, obstacle:<class>, slot."""
    def keys(e: Column) -> Column:
        return (
            F.when(e["kind"] == "obstacle", F.array(F.lit("obstacle"), F.concat(F.lit("obstacle:"), e["name"])))
            .when(e["kind"] == "slot", F.array(F.lit("slot")))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.flatten(F.transform(factors, keys)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z_]+)"), 1)


def entity_mentions(text: Column) -> Column:
    """Entities a text names, by whole words of the fixed vocabulary."""
    found = F.array_distinct(words(text))
    classes = F.array_distinct(F.array_compact(F.transform(
        found, lambda w: F.try_element_at(F.create_map(
            *[F.lit(x) for kv in lex.OBSTACLE_WORDS.items() for x in kv]), w))))
    none = F.array().cast("array<string>")
    slot_words = F.array(*[F.lit(w) for w in lex.SLOT_WORDS])
    return F.concat(
        F.when(F.size(classes) > 0, F.array(F.lit("obstacle"))).otherwise(none),
        F.transform(classes, lambda c: F.concat(F.lit("obstacle:"), c)),
        F.when(F.arrays_overlap(found, slot_words), F.array(F.lit("slot"))).otherwise(none),
    )


def decision_mentions(text: Column) -> Column:
    """Decisions a text claims: any phrase at word bounds with a regular ending."""
    low = F.lower(text)
    by_decision: dict[str, list[str]] = {}
    for phrase, name in lex.DECISION_PHRASES.items():
        by_decision.setdefault(name, []).append(phrase)
    hits = [
        F.when(low.rlike(rf"(?U)\b(?:{'|'.join(phrases)})(?:s|es|ed|ing)?\b"), F.lit(name))
        for name, phrases in by_decision.items()
    ]
    return F.array_compact(F.array(*hits))


def hallucinations(text: Column, decision: Column, allowed: Column) -> Column:
    """``entity:..`` not in the fact and ``decision:..`` claimed instead of the true one."""
    entities = F.transform(F.array_except(entity_mentions(text), allowed), lambda m: F.concat(F.lit("entity:"), m))
    claimed = decision_mentions(text)
    none = F.array().cast("array<string>")
    contained = none
    for name, parts in lex.SUBSUMED.items():
        contained = F.when(decision == name, F.array(*[F.lit(p) for p in parts])).otherwise(contained)
    wrong = F.when(F.array_contains(claimed, decision), none).otherwise(F.array_except(claimed, contained))
    return F.concat(entities, F.transform(wrong, lambda d: F.concat(F.lit("decision:"), d)))


# ---- turns and validators ---------------------------------------------------

def waypoints_text(points: Column) -> Column:
    """``[(r,f,h),...]`` with two decimals; anything but six points fails the job."""
    body = F.array_join(F.transform(points, lambda p: F.concat(
        F.lit("("), fixed(p["r"], 2), F.lit(","), fixed(p["f"], 2), F.lit(","), fixed(p["h"], 2), F.lit(")"))), ",")
    text = F.concat(F.lit("["), body, F.lit("]"))
    return F.when(F.size(points) == 6, text).otherwise(
        F.raise_error(F.lit("a trajectory must have 6 waypoints")))


def assistant_turn(trace: Column, traj: Column) -> Column:
    """Reason block and trajectory block; without a trace the trajectory block alone."""
    block = F.concat(F.lit(lex.TRAJ_START), traj, F.lit(lex.TRAJ_END))
    reason = F.concat(F.lit(lex.REASON_START), trace, F.lit(lex.REASON_END))
    return F.when(trace.isNotNull() & (trace != ""), F.concat(reason, block)).otherwise(block)


def entity_fidelity(text: Column, allowed: Column) -> Column:
    named = entity_mentions(text)
    return F.when(F.size(named) == 0, 1.0).otherwise(
        F.size(F.array_intersect(named, allowed)) / F.size(named))


def action_fidelity(decision: Column, fut: Column) -> Column:
    """1 unless the six waypoints clearly contradict the decision."""
    def at(i: int) -> Column:
        return F.element_at(fut, i)

    early = at(2)["f"]
    last = F.hypot(at(6)["r"] - at(5)["r"], at(6)["f"] - at(5)["f"])
    end = F.hypot(at(6)["r"], at(6)["f"])
    turned = F.abs(at(6)["h"])
    moving = end >= 0.4
    broken = (
        F.when(decision == "stop_yield", last >= 0.15)
        .when(decision == "complete_park", (end >= 0.6) | (last >= 0.15))
        .when(decision == "reverse", moving & (early > 0.2))
        .when(decision == "approach", moving & (early < -0.2))
        .when(decision == "creep", (early < -0.2) | (early > 1.2))
        .when(decision == "align", (end > 3.0) & (turned < 0.05))
        .when(decision.isin("shift_gear", "abort"), F.lit(False))
        .otherwise(F.lit(True))
    )
    return F.when(broken, 0.0).otherwise(1.0)


def markers_in_order(turn: Column) -> Column:
    marks = [lex.REASON_START, lex.REASON_END, lex.TRAJ_START, lex.TRAJ_END]
    once = F.lit(True)
    for m in marks:
        once = once & (F.regexp_count(turn, F.lit(m)) == 1)
    at = [F.locate(m, turn) for m in marks]
    return once & (at[0] < at[1]) & (at[1] < at[2]) & (at[2] < at[3])


def schema_conformance(decision: Column, factors: Column, fut: Column, turn: Column) -> Column:
    """1 when the decision is known, factors are typed, six waypoints, markers in order."""
    typed = F.forall(factors, lambda e: (
        ((e["kind"] == "obstacle") & e["r"].isNotNull() & e["f"].isNotNull())
        | (e["kind"] == "slot")
        | ((e["kind"] == "metric") & e["value"].isNotNull())
        | (e["kind"] == "manner")))
    good = (
        decision.isin(DECISIONS) & typed
        & (fut.isNull() | (F.size(fut) == 6))
        & (turn.isNull() | markers_in_order(turn))
    )
    return F.when(good, 1.0).otherwise(0.0)


def reconcile(dec_p: Column, keys_p: Column, dec_g: Column, keys_g: Column) -> Column:
    """Perception against ground truth: contradiction, perception_limited or ok."""
    extra = F.size(F.array_except(keys_p, keys_g)) > 0
    missing = F.size(F.array_except(keys_g, keys_p)) > 0
    yield_flip = (dec_p == "stop_yield") != (dec_g == "stop_yield")
    return (
        F.when(extra | yield_flip, "contradiction")
        .when(missing | (dec_p != dec_g), "perception_limited")
        .otherwise("ok")
    )
