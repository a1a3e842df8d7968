"""Soft-membership mixing, by DataFrame operations alone.

A classifier fitted on the labelled table gives each document its posterior over the domains good, poor and toxic.
Document rates r >= 0 then solve a least-squares problem: the expected tokens of each domain, the sum over documents of
rate x tokens x posterior, shall match a target.  Projected gradient steps in the metric of the tokens,

    r_d <- max(0, r_d - sum_k p_dk (S_k - T_k) / S_k0),

treat documents of equal posterior alike, so a step is one aggregation over pre-summed posteriors, and a document's rate
follows from its posterior and the few step vectors; nothing of the size of the corpus is kept on the driver.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import staged

DOMAINS = ("good", "poor", "toxic")
TRAIN_DOCS = 4000
#: A feature counts only if a domain holds it more or less often than by chance by so many standard deviations.
MIN_Z = 5.0
CHOSEN, FIT_STEPS, RIDGE = 64, 500, 1e-5
#: Gaps and moves are shares of the domain's own tokens; at 0 only the number of steps ends them.
STEPS, CLOSE = 40, 0.0
#: A target missed by more than this share of the domain's own tokens is warned of.
MISSED = 0.01
#: So many distinct posteriors may be on the driver; more stay in the cluster, one job a step.
DRIVER_CELLS = 50_000
DIGITS = 4


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _features(text: Column) -> Column:
    """Distinct 64-bit hashes of the words of a text and of its shape."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[^\p{L}]+"), lambda w: w != "")
    size = F.greatest(F.char_length(text), F.lit(1))
    share = lambda pattern: (size - F.char_length(F.regexp_replace(text, pattern, ""))) / size
    level = lambda name, x: F.concat(F.lit(name), F.least(F.floor(x * 50), F.lit(5)).cast("string"))
    shape = F.array(level("=mark", share(r"[#*$%&<>]")), level("=bar", share(r"\|")), level("=loud", share("!")), level("=upper", share("[A-Z]") / 4),
                    level("=digit", share("[0-9]")))
    kinds = _let(words, lambda w: F.concat(F.array_distinct(w), F.array(F.concat(F.lit("=kinds"), F.floor(
        10 * F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).cast("string")))))
    return F.array_distinct(F.transform(F.concat(kinds, shape), lambda w: F.xxhash64(w)))


def domain_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain number) of the labelled ids; a repeated id counts as toxic or good if any of its rows says so."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return known.select(id_col, F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("kb_domain"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> tuple[list, list[list[float]], list[float]]:
    """Softmax regression: the chosen features, weights of poor and toxic against good, and their offsets.

    It is fitted on at most ``most`` labelled documents of each domain, taken by the hash of their ids.  At most ``CHOSEN``
    features for each of poor and toxic, those that set it most apart from good, are used; only these reach the driver.
    """
    known = domain_of(labels, id_col)
    sizes = {r.kb_domain: r["count"] for r in known.groupBy("kb_domain").count().collect()}
    parts = [known.where(F.col("kb_domain") == k).orderBy(F.xxhash64(id_col), id_col).limit(most) for k in range(3)]
    chosen = parts[0].union(parts[1]).union(parts[2])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), t.alias("kb_t")).join(F.broadcast(chosen), id_col)  # at most 3 x ``most`` ids
    # copies would make chance words look telling: a set of features counts once in a domain
    rows = staged(rows.select("kb_domain", F.array_sort(_features(F.col("kb_t"))).alias("f")).distinct())
    best = _telling(rows)
    if not best:
        return [], [[], []], [-8.0, -8.0]
    wanted = _longs(best)
    sample = rows.select("kb_domain", F.array_sort(F.array_intersect("f", wanted)).alias("f")).groupBy("kb_domain", "f").count().collect()
    return best, *_softmax([(r.kb_domain, r.f, r["count"]) for r in sample], best, sizes)


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _telling(rows: DataFrame) -> list[int]:
    """Features that poor or toxic documents hold more or less often than good ones, beyond chance."""
    held = {r.kb_domain: r.n for r in rows.groupBy("kb_domain").agg(F.sum(F.size("f")).alias("n")).collect()}
    counts = rows.select("kb_domain", F.explode("f").alias("b")).groupBy("b").agg(
        *[F.count(F.when(F.col("kb_domain") == k, 1)).alias(f"n{k}") for k in range(3)])
    best: set[int] = set()
    for k in (1, 2):
        if not held.get(k) or not held.get(0):
            continue
        share = held[k] / (held[k] + held[0])
        both = F.col(f"n{k}") + F.col("n0")
        z = F.abs(F.col(f"n{k}") - both * share) / F.sqrt(both * (share * (1 - share)) + 1)
        best |= {r.b for r in counts.select("b", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "b").limit(CHOSEN).collect()}
    return sorted(best)


def _softmax(sample: list, best: list[int], sizes: dict[int, int]) -> tuple[list[list[float]], list[float]]:
    """Weighted softmax regression by gradient steps; good's weights are zero, offsets are moved to the labelled shares."""
    place = {b: i for i, b in enumerate(best)}
    sample = sorted(sample)
    x = np.zeros((len(sample), len(best) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, (_, f, _) in enumerate(sample):
        x[i, [place[b] for b in f]] = 1
    y = np.eye(3, dtype=np.float32)[[d for d, _, _ in sample]]
    n = np.array([c for _, _, c in sample], dtype=np.float32)
    drawn = [float(n[y[:, k] == 1].sum()) for k in range(3)]
    w = np.zeros((len(best) + 1, 3), dtype=np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, FIT_STEPS + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((y - p) * n[:, None]) / n.sum()
        g[:-1] -= RIDGE * w[:-1]
        g[:, 0] = 0
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    moved = [math.log(((sizes.get(k, 0) + 0.5) / (sizes.get(0, 0) + 0.5)) / ((drawn[k] + 0.5) / (drawn[0] + 0.5))) for k in (1, 2)]
    return [w[:-1, k].tolist() for k in (1, 2)], [float(w[-1, k]) + m for k, m in zip((1, 2), moved)]


def posteriors(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Every row with ``kb_tokens`` (words between white space) and ``kb_p``, its posteriors rounded to four digits."""
    best, weights, offsets = model
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    pairs = [F.split(F.lit(",".join(repr(w) for w in ws)), ",").cast("array<double>") for ws in weights]

    def scored(found: Column) -> Column:
        # the few chosen features of a text, looked up one by one
        def summed(table: Column) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, F.array_position(_longs(best), b).cast("int") - 1))

        logits = [F.lit(offset) + (summed(table) if best else F.lit(0.0)) for table, offset in zip(pairs, offsets)]
        return F.struct(logits[0].alias("a"), logits[1].alias("b"))

    def normal(s: Column) -> Column:
        top = F.greatest(s["a"], s["b"], F.lit(0.0))
        each = [F.exp(F.lit(0.0) - top), F.exp(s["a"] - top), F.exp(s["b"] - top)]
        whole = each[0] + each[1] + each[2]
        poor, toxic = F.round(each[1] / whole, DIGITS), F.round(each[2] / whole, DIGITS)
        return F.struct(F.round(F.lit(1.0) - poor - toxic, DIGITS).alias("good"), poor.alias("poor"), toxic.alias("toxic"))

    found = F.array_intersect(_features(t), _longs(best)) if best else F.array().cast("array<bigint>")
    tokens = F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.withColumns({"kb_tokens": tokens, "kb_p": _let(_let(found, scored), normal)})


def _rate(p: Column, history: list[list[float]]) -> Column:
    """Rate of a posterior after the steps in ``history``, each one number a domain."""
    if not history:
        return F.lit(1.0)
    steps = F.split(F.lit(";".join(",".join(repr(x) for x in h) for h in history)), ";")
    moves = F.transform(steps, lambda s: F.split(s, ",").cast("array<double>"))
    return F.aggregate(moves, F.lit(1.0), lambda r, h: F.greatest(
        F.lit(0.0), r - p["good"] * F.get(h, 0) - p["poor"] * F.get(h, 1) - p["toxic"] * F.get(h, 2)))


def _dealt(*of: Column) -> Column:
    """A number in [0, 1) by the hash of a document; floor(rate + it) is the next whole number as often as rate's fraction says."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("copies"), *of), 11) / F.lit(float(1 << 53))


def solve(scored: DataFrame, targets: dict[str, float] | None = None, steps: int = STEPS, close: float = CLOSE,
          driver_cells: int = DRIVER_CELLS) -> tuple[list[list[float]], dict]:
    """Step vectors of the projected gradient, and the domain totals before and after and their targets.

    ``targets`` are shares of the tokens that good and poor documents have now; by default good and poor keep
    their totals and toxic text goes.  Steps go on until each domain is within ``close`` of its target, or moves by less
    than that, as a share of its own tokens (the larger of start and target), at most ``steps`` times.
    """
    cells = staged(scored.groupBy(F.col("kb_p").alias("p")).agg(F.sum("kb_tokens").alias("n")))
    few = cells.select("n", *[F.col(f"p.{k}").alias(k) for k in DOMAINS]).limit(driver_cells + 1).collect()
    if len(few) <= driver_cells:
        few = np.array(sorted(tuple(r) for r in few), dtype=float).reshape(-1, 4)
        n, p = few[:, 0], few[:, 1:]
        rate = np.ones(len(n))

    def totals(history):
        nonlocal rate
        if len(few) > driver_cells:
            r = cells.agg(*[F.sum(F.col("n") * F.col(f"p.{k}") * _rate(F.col("p"), history)).alias(k) for k in DOMAINS]).first()
            return [r[k] or 0.0 for k in DOMAINS]
        if history:
            rate = np.maximum(0.0, rate - p @ np.array(history[-1]))
        return ((rate * n) @ p).tolist()

    start = now = totals([])
    budget = start[0] + start[1]
    want = [budget * targets.get(k, 0.0) for k in DOMAINS] if targets else [start[0], start[1], 0.0]
    own = [max(s, w) for s, w in zip(start, want)]
    history: list[list[float]] = []
    while len(history) < steps and any(abs(s - w) > close * o for s, w, o in zip(now, want, own)):
        history.append([(s - w) / s0 if s0 else 0.0 for s, w, s0 in zip(now, want, start)])
        was, now = now, totals(history)
        if all(abs(a - b) < close * o for a, b, o in zip(was, now, own)):
            break  # the targets are met as far as posteriors allow
    return history, {"before": start, "after": now, "targets": want}


def missed(totals: dict, share: float = MISSED) -> dict[str, tuple[float, float]]:
    """(reached, target) tokens of the domains whose target is missed by more than ``share`` of their own tokens."""
    each = zip(DOMAINS, totals["before"], totals["after"], totals["targets"])
    return {k: (now, want) for k, s, now, want in each if abs(now - want) > share * max(s, want)}


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text",
          keep_text: bool = True) -> DataFrame:
    """Every row with ``kb_tokens``, ``kb_p``, ``kb_rate`` and ``kb_copies``: the rate, rounded up as often as its fraction says.

    A hash of id and text decides, so that copies repeat from run to run and add up to the rates.

    Null text: no words; its posterior is that of a text without words, and it carries no tokens.  Repeated rows
    each count.  Without labels all documents are alike: with the default targets their rate follows from the priors.
    An empty table gives an empty result; other columns pass through.  Targets out of reach of the posteriors are warned of.
    """
    scored = posteriors(docs, fit(docs, labels, id_col, text), text)
    # written once: what follows would otherwise compute the posteriors again for each use
    scored = scored.withColumn("kb_dealt", _dealt(F.col(f"`{id_col}`"), F.col(f"`{text}`")))
    scored = staged(scored if keep_text else scored.drop(text))
    history, totals = solve(scored, targets)
    if short := missed(totals):
        warnings.warn("mixing misses targets: " + "; ".join(f"{k} {a:.6g} for {b:.6g} tokens" for k, (a, b) in short.items()), stacklevel=2)
    rated = scored.withColumn("kb_rate", F.round(_rate(F.col("kb_p"), history), 6))
    return rated.withColumn("kb_copies", F.floor(F.col("kb_rate") + F.col("kb_dealt")).cast("int")).drop("kb_dealt")
