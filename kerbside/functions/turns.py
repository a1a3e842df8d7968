"""Reading model output text and building prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions import lexicon as lex
from kerbside.functions.fmt import fixed

# ---- parsing ------------------------------------------------------------------

# number patterns of the three readers, fixed values
STRICT_TRIPLE = r"\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)"
PAIR_OR_TRIPLE = (r"\(\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)"
                  r"(?:\s*,\s*[+-]?\d+(?:\.\d+)?)?\s*\)")
BRACKETED_PAIR = r"[\[\(]([-\deE.+]+),\s*([-\deE.+]+)[\]\)]"

# repairs applied in this order before the pairs are read, fixed values
REPAIRS = [
    (r"[a-zA-Z]", ""),
    (r"[\u4e00-\u9fff]", ""),
    (r"(\d+)\.\.+", r"$1."),
    (r"[<>]", ""),
    (r"(\d+\.\d+)\s+(\d+\.\d+)(?=\s*[,\)])", r"$1, $2"),
    (r"(\d+\.\d+)-(\d+\.\d+)", r"$1, $2"),
    (r"(\(\s*-?\d+\.\d+,\s*-?\d+\.\d+),\s*-?\d+\.\d+(\s*\))", r"$1$2"),
    (r"\s+", ""),
    (r"(\d+\.\d+)\.(\d+)", r"$1$2"),
    (r"(\d+)\.\.(\d+)", r"$1.$2"),
    (r"(\d+)\.\-(\d+)", r"$1.$2"),
]


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def between(text: Column, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the next ``end``; null without both."""
    pattern = f"(?s){start}(.*?){end}"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _numbers(text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda s: s.try_cast("double"))


def triples(text: Column) -> Column:
    """(r, f, h) structs of every strict three-number waypoint."""
    parts = [_numbers(text, STRICT_TRIPLE, g) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.struct(
        z["0"].alias("r"), z["1"].alias("f"), z["2"].alias("h")))


def pairs(text: Column) -> Column:
    """(r, f) structs of two- or three-number waypoints; a plus sign is allowed."""
    parts = [_numbers(text, PAIR_OR_TRIPLE, g) for g in (1, 2)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.struct(z["0"].alias("r"), z["1"].alias("f")))


def parse_turn(text: Column, n: int = 6) -> Column:
    """Struct(trace, points, error); points are null unless exactly ``n`` parsed."""
    trace = between(text, lex.REASON_START, lex.REASON_END)
    block = between(text, lex.TRAJ_START, lex.TRAJ_END)
    points = triples(block)
    count = F.size(points)
    error = (
        F.when(block.isNull(), "no trajectory block")
        .when(count != n, F.concat(F.lit(f"expected {n} waypoints, parsed "), count.cast("string")))
        .when(trace.isNull(), "no reasoning block")
    )
    return F.struct(
        F.when(error.isNull(), strip(trace)).otherwise(trace).alias("trace"),
        F.when(block.isNotNull() & (count == n), points).alias("points"),
        error.alias("error"),
    )


def split_reason_traj(text: Column) -> Column:
    """Struct(reason, traj): closed trajectory span, else the text without reasoning."""
    reason = F.coalesce(strip(between(text, lex.REASON_START, lex.REASON_END)), F.lit(""))
    rest = F.regexp_replace(text, f"(?s){lex.REASON_START}.*?{lex.REASON_END}", "")
    traj = F.coalesce(between(text, lex.TRAJ_START, lex.TRAJ_END), rest)
    return F.struct(reason.alias("reason"), traj.alias("traj"))


def repair_points(text: Column, n: int = 6) -> Column:
    """``n`` (r, f) points after the repairs: padded with the last, cut to ``n``;
    null when nothing could be read."""
    for pattern, by in REPAIRS:
        text = F.regexp_replace(text, pattern, by)

    def read(clean: Column) -> Column:
        parts = [_numbers(clean, BRACKETED_PAIR, g) for g in (1, 2)]
        return F.transform(F.arrays_zip(*parts), lambda z: F.struct(z["0"].alias("r"), z["1"].alias("f")))

    def padded(got: Column) -> Column:
        some = F.when(F.size(got) > 0, got)
        missing = F.greatest(F.lit(0), F.lit(n) - F.size(some))
        return F.slice(F.concat(some, F.array_repeat(F.element_at(some, -1), missing)), 1, n)

    # the repaired text and its points are computed once for a row, however often they are used
    return _once(_once(text, read), padded)


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


# ---- prompts --------------------------------------------------------------------

SCENE_LINES = (
    "Scene information: <scene_start><SCENE><scene_end>\n"
    "Object-wise tracking information: <track_start><TRACK><track_end>\n"
    "Map information: <map_start><MAP><map_end>\n"
)
PLAN_LINE = "Planning trajectory: <trajectory>"
MISSING_PROMPT = (
    SCENE_LINES
    + "Ego states: unavailable in smoke mode\n"
    + "Historical trajectory (last 2 seconds): unavailable in smoke mode\n"
    + "Mission goal: keep forward\n"
    + PLAN_LINE
)
ZERO_TRAJECTORY = "[" + ",".join(["(0.00,0.00,0.00)"] * 6) + "]"
COMMAND_TEXT = {"reverse": "reverse", "right": "turn right", "left": "turn left", "forward": "keep forward"}


def _pt(*values: Column) -> Column:
    parts = []
    for i, c in enumerate(values):
        parts += [F.lit("(" if i == 0 else ","), fixed(c, 2)]
    return F.concat(*parts, F.lit(")"))


def ego_message() -> Column:
    """Velocities in metres per half second, right before forward; no map position."""
    return F.concat(
        F.lit("- Velocity (vx,vy): "), _pt(F.col("ego_right_v") * 0.5, F.col("ego_fwd_v") * 0.5),
        F.lit(" - Heading Angular Velocity (v_yaw): "), _pt(F.col("yaw_rate")),
        F.lit(" - Acceleration (ax,ay): "), _pt(F.col("acc_r"), F.col("acc_f")),
        F.lit(" - Heading Speed: "), _pt(F.col("speed_ms") * 0.5),
        F.lit(" - Steering: "), _pt(F.col("steer")),
    )


def history_message() -> Column:
    pts = [F.concat(F.lit("" if i == 1 else ","), _pt(F.element_at("his", i)["r"], F.element_at("his", i)["f"]))
           for i in range(1, 5)]
    return F.concat(F.lit("["), *pts, F.lit("]"))


def mission_goal(command: Column) -> Column:
    """Maneuver, side and local slot when known, else the per-frame command."""
    side = F.when(F.coalesce("side", F.lit("")) != "", F.concat(F.lit(", "), F.col("side"), F.lit(" side")))
    slot = F.when(F.col("slot_r").isNotNull(), F.concat(
        F.lit(", into slot at "), _pt(F.col("slot_r"), F.col("slot_f"), F.col("slot_dh"))))
    full = F.concat(F.replace("maneuver_type", F.lit("_"), F.lit("-")), F.lit(" park"),
                    F.coalesce(side, F.lit("")), F.coalesce(slot, F.lit("")))
    plain = F.element_at(F.create_map(*[F.lit(x) for kv in COMMAND_TEXT.items() for x in kv]), command)
    return F.when(F.coalesce("maneuver_type", F.lit("")) != "", full).otherwise(plain)


def user_prompt(ego: Column, his: Column, goal: Column) -> Column:
    return F.concat(
        F.lit(SCENE_LINES + "Ego states: "), ego,
        F.lit("\nHistorical trajectory (last 2 seconds): "), his,
        F.lit("\nMission goal: "), goal, F.lit("\n" + PLAN_LINE))


def question_prompt(ego: Column, his: Column, question: Column) -> Column:
    """Question form; the ego lines are left out when the ego cache has no row."""
    known = F.concat(F.lit("Ego states: "), ego, F.lit("\nHistorical trajectory (last 2 seconds): "), his, F.lit("\n"))
    return F.concat(F.lit(SCENE_LINES), F.coalesce(known, F.lit("")),
                    F.lit("Please answer the following question: "), question)


# ---- chat template, segments, loss spans --------------------------------------------

def chat_text(system: str, turns: Column) -> Column:
    """ChatML text of ordered (role, text) structs; an empty last turn stays open."""
    body = F.transform(turns, lambda t: F.when(
        F.coalesce(t["text"], F.lit("")) != "",
        F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")),
    ).otherwise(F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"))))
    head = f"<|im_start|>system\n{system}<|im_end|>\n" if system else ""
    return F.concat(F.lit(head), F.array_join(body, ""))


# what stands around turns in each style, fixed values: head, a said turn, an open last turn; separators may alternate
CHAT_STYLES = {
    "single": ("{system}{sep}", "{role}: {text}{sep}", "{role}:"),
    "two": ("{system}{sep}", "{role}: {text}{alternate}", "{role}:"),
    "mpt": ("{system}{sep}", "{role}{text}{sep}", "{role}"),
    "gemma": ("", "{role}{text}{sep}", "{role}"),
    "plain": ("{system}", "{text}{alternate}", ""),
}
INSTRUCTION = ("[INST] ", " [/INST]")
SYSTEM_BLOCK = ("<<SYS>>\n", "\n<</SYS>>\n\n")


def _filled(form: str, values: dict[str, Column]) -> Column:
    """``form`` with a column for each name in braces."""
    parts = [p for p in re.split(r"({\w+})", form) if p]
    return F.concat(F.lit(""), *[values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in parts])


def styled_chat(style: str, system: str, turns: Column, sep: str, sep2: str = "") -> Column:
    """Text of ordered (role, text) structs in one of ``CHAT_STYLES`` or ``llama_2``; a turn without text stays open.

    With alternating separators turns 0, 2, .. end in ``sep`` and the others in ``sep2``.  ``llama_2`` puts the system text into the
    first instruction; ``sep`` opens and ``sep2`` closes an exchange, but none opens the whole.
    """
    said = lambda t: F.coalesce(t["text"], F.lit("")) != ""
    if style == "llama_2":
        block = SYSTEM_BLOCK[0] + system + SYSTEM_BLOCK[1] if system else ""

        def exchange(t: Column, i: Column) -> Column:
            asked = F.concat(F.when(i > 0, sep).otherwise(""), F.lit(INSTRUCTION[0]), F.when(i == 0, block).otherwise(""), t["text"], F.lit(INSTRUCTION[1]))
            return F.when(~said(t), "").when(i % 2 == 0, asked).otherwise(F.concat(F.lit(" "), t["text"], F.lit(" " + sep2)))

        return F.array_join(F.transform(turns, exchange), "")
    if style not in CHAT_STYLES:
        raise ValueError(f"unknown chat style {style!r}")
    head, full, left_open = CHAT_STYLES[style]

    def turn(t: Column, i: Column) -> Column:
        values = {"role": t["role"], "text": t["text"], "sep": F.lit(sep), "alternate": F.when(i % 2 == 0, sep).otherwise(sep2)}
        return F.when(said(t), _filled(full, values)).otherwise(_filled(left_open, values))

    return F.concat(F.lit(head.format(system=system, sep=sep)), F.array_join(F.transform(turns, turn), ""))


# placeholder -> signed id, fixed values
PLACEHOLDERS = {"<IMAGE>": -200, "<SCENE>": -201, "<TRACK>": -202, "<MAP>": -203, "<OBJECT>": -204}
_PLACEHOLDER_RE = "<(?:IMAGE|SCENE|TRACK|MAP|OBJECT)>"


def segments(text: Column) -> Column:
    """Text pieces and placeholders in order; empty text pieces are dropped."""
    parts = F.split(text, f"(?<={_PLACEHOLDER_RE})|(?={_PLACEHOLDER_RE})")
    ids = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    return F.filter(
        F.transform(parts, lambda p: F.struct(p.alias("piece"), F.try_element_at(ids, p).alias("marker_id"))),
        lambda s: s["piece"] != "")


# markers whose loss is always kept, fixed values
KEPT_MARKERS = [
    "<|im_start|>", "<|im_end|>", "<trajectory>", "<traj_start>", "<traj_end>", "<track_start>", "<track_end>",
    "<scene_start>", "<scene_end>", "<map_start>", "<map_end>", "<ego_start>", "<ego_end>",
    "<command_start>", "<command_end>", "<question_start>", "<question_end>", "<answer_start>", "<answer_end>",
]


def loss_spans(role: Column, text: Column) -> Column:
    """Spans of one rendered turn with keep flags: assistant text is kept, other text
    ignored, and marker spans and newlines kept everywhere."""
    marks = "|".join(m.replace("|", r"\|") for m in KEPT_MARKERS)
    rendered = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    pieces = F.filter(F.split(rendered, f"(?<={marks}|\n)|(?={marks}|\n)"), lambda p: p != "")
    always = F.array(*[F.lit(m) for m in KEPT_MARKERS], F.lit("\n"))
    return F.transform(pieces, lambda p: F.struct(
        p.alias("span"), (F.array_contains(always, p) | (role == "assistant")).alias("keep")))
