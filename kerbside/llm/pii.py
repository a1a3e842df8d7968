"""Personal data by column expressions alone: patterns propose, checksums confirm, context words adjust the score.

Positions come from the pieces between the matches: ``split`` and ``regexp_extract_all`` follow the same matcher,
so a match starts after the pieces and matches before it.  Quantifiers are possessive where that
changes nothing, so neither a long run of letters nor a long number makes the matcher slow or deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, with patterns that find the same spans as the plain ones.
#: email starts where no earlier start could match: at the start of a run, or right after the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: 13 digits or more; a shorter run fails as a whole, so it need not be proposed.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Spans that the method adds.
#: Characters of an IBAN after its country and check digits, by country (ISO 13616 registry); they end where the country
#: says, whatever follows.  Numbers of other letters end where the run does, or before a known number.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FK FI FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST",
    22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE",
    27: "MT SC", 28: "LC", 29: "RU",
}
_FIXED = "|".join(rf"(?:{'|'.join(of.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, of in IBAN_REST.items())
_KNOWN = "|".join(" ".join(IBAN_REST.values()).split())
IBAN = rf"(?<![A-Za-z0-9])(?:{_FIXED}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_KNOWN})[0-9]{{2}}))?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: Words near a span that speak for its kind; they add ``CONTEXT`` to its score.
NEAR = {
    "email": "mail|contact|write|reach", "ip": "ip|address|server|host", "card": "card|visa|master|credit|pay",
    "phone": "phone|call|tel|mobile|fax|dial", "iban": "iban|bank|account|konto|transfer", "ssn": "ssn|social|security|insurance",
}
START_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.4}
CHECKSUM, CONTEXT, THRESHOLD = 0.4, 0.2, 0.6
REACH = 40
_STEP = 64

_SPAN = "array<struct<start: bigint, value: string, before: string, after: string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _running(xs: Column) -> Column:
    """Running sums of a non-empty array, in blocks so that long arrays take near-linear time."""
    def with_blocks(blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: _total(F.slice(blocks, F.lit(1), b)))
        return _let(before, lambda off: F.transform(
            xs, lambda _, i: F.get(off, F.floor(i / _STEP).cast("int")) + _total(F.slice(xs, (i - i % _STEP + 1).cast("int"), (i % _STEP + 1).cast("int")))))

    at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _STEP).cast("int"))
    return _let(F.transform(at, lambda b: _total(F.slice(xs, b * _STEP + 1, F.lit(_STEP)))), with_blocks)


def _matches(text: Column, pattern: str, maybe: Column) -> Column:
    """All matches of ``pattern`` with their starts (code points, from 0) and what stands around them."""
    def built(pair: Column) -> Column:
        m, g = pair["m"], pair["g"]
        moves = F.transform(m, lambda _, i: F.length(F.get(g, i)).cast("bigint") + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        starts = _let(moves, lambda w: F.when(F.size(w) > 0, _running(w)).otherwise(F.array().cast("array<bigint>")))
        return _let(starts, lambda s: F.transform(m, lambda v, i: F.struct(
            F.get(s, i).alias("start"), v.alias("value"), F.right(F.get(g, i), F.lit(REACH)).alias("before"), F.left(F.get(g, i + 1), F.lit(REACH)).alias("after"))))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(maybe, _let(pair, built).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    flat = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4)), "")
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97).cast("int"))


def _octet(p: Column) -> Column:
    rest = F.ltrim(p, F.lit("0"))
    return (F.length(rest) < 3) | ((F.length(rest) == 3) & (rest <= "255"))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _octet),
    "card": lambda v: _let(_digits(v), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": lambda v: F.length(F.regexp_replace(v, " ", "")).between(15, 34) & (_mod97(v) == 1),
    "ssn": lambda v: ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 1, 1) != "9") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000"),
}
WITH_CHECKSUM = ("card", "iban")


def _kind(text: Column, kind: str, pattern: str, maybe: Column) -> Column:
    """Spans of a kind that pass its check, with their score."""
    def scored(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"])).rlike(f"(?<![a-z])(?:{NEAR[kind]})")
        score = F.lit(START_SCORE[kind] + (CHECKSUM if kind in WITH_CHECKSUM else 0.0)) + F.when(near, F.lit(CONTEXT)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    return F.transform(F.filter(_matches(text, pattern, maybe), lambda s: CHECKS[kind](s["value"])), scored)


def spans(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``kb_base`` and ``kb_added``: arrays of (kind, start, end, score) by kind, then start.

    Base spans stay whatever their score; an added span stays if its score reaches ``threshold`` and it overlaps no base
    span.  Offsets are code points, ends exclusive.  Null text counts as empty; repeated rows each give
    a row; an empty table an empty one; other columns pass through.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn("kb_text", t)
    c = F.col("kb_text")
    maybe = {
        "email": c.contains("@"), "ip": c.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": c.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": c.contains("+"),
        "iban": c.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), "ssn": c.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    }
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    base = F.concat(*[_kind(c, k, pattern[k], maybe[k]) for k in BASE])
    added = F.concat(*[_kind(c, k, pattern[k], maybe[k]) for k in ADDED])
    out = rows.select(*[F.col(f"`{x}`") for x in docs.columns], base.alias("kb_base"), added.alias("kb_more"))
    apart = F.filter("kb_more", lambda s: (s["score"] >= threshold) & ~F.exists("kb_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("kb_added", apart).drop("kb_more")


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans, added counts and the scores."""
    rows = spans(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("kb_t")), "kb_t")
    count = lambda of, k: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    every = F.concat("kb_base", "kb_added")
    return rows.select(
        id_col, *[count("kb_base", k) for k in BASE], F.sha2(written(F.col("kb_base")), 256).alias("base_sha256"), written(every).alias("spans"),
        *[count("kb_added", k) for k in ADDED], F.array_join(F.transform(every, lambda s: F.format_number(s["score"], 1)), ",").alias("scores"))
