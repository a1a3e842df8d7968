"""Importance resampling and mixing against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import importance, mixing

GOOD, BAD, TOXIC = "calm river harbour letter season water light".split(), "zzz | $$$ | win >>> ### cash".split(), ["idiot", "moron", "scum"]


def corpus(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = i % 8
        words = [rng.choice(BAD if kind == 0 else GOOD) + rng.choice("abcdef") for _ in range(rng.randint(15, 60))]
        if kind == 1:
            words[:2] = rng.sample(TOXIC, 2)
        rows.append((i, " ".join(words), "s", float(i)))
        if i % 3:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    rows += [(900, None, None, 1.0), (None, "calm rivera", "s", 2.0), (901, "", "s", 3.0), (5, rows[5][1], "s", 5.0), (902, "wordy " * 30_000, "s", 4.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, kb_rate string, score double").drop("kb_rate").repartition(3), spark.createDataFrame(
        labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), labels


def plain_buckets(t):
    w = [x for x in (t or "").encode().lower().split()]
    return [zlib.crc32(x) % importance.BUCKETS for x in w] + [zlib.crc32(a + b" " + b) % importance.BUCKETS for a, b in zip(w, w[1:])]


def test_log_weights_equal_plain(spark):
    rows, docs, labels, known = corpus(spark)
    out = importance.resample(docs, labels)
    good = {d for d, q, t in known if q == 1 and t == 0}
    target, raw = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, t, *_ in rows:
        for b in plain_buckets(t):
            raw[b] += 1
            target[b] += d in good
    ratio = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    want = sorted((d is None, d or 0, round(float(sum(ratio[b] for b in plain_buckets(t))), 5)) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.log_weight, 5)) for r in out.collect()) == want
    kept = [r for r in out.collect() if r.kept]
    lost = [r for r in out.collect() if not r.kept]
    assert min(r.score for r in kept) > max(r.score for r in lost)
    k = round(sum(q for _, q, _ in known) / len(known) * len(rows))
    assert k <= len(kept) <= k + 1
    assert sum(r.doc_id is not None and r.doc_id < 240 and r.doc_id % 8 == 0 for r in lost) >= 27


@pytest.mark.parametrize("k", [0, 1, 7, 4999, 5000, 9000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 3.0, rng.randint(0, 3) * 1.0, 1e9 * rng.random()]) for _ in range(5000)]
    got = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k)
    want = float("inf") if k == 0 else float("-inf") if k > 5000 else sorted(values)[-k]
    assert got == want


def test_gumbel_noise_samples_by_weight(spark):
    # two texts of equal weight: each is drawn about half the time
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "b a") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 2000, 10)] + [(i, 1, 0) for i in range(1, 2000, 10)], "doc_id long, quality int, toxic int")
    out = importance.resample(docs, labels, share=0.5)
    one = out.where("kept").groupBy((F.col("doc_id") % 2).alias("m")).count().collect()
    assert sum(r["count"] for r in one) == 1000 and all(abs(r["count"] - 500) < 80 for r in one)


def plain_rates(p, n, want, history_steps=mixing.STEPS):
    rate = np.ones(len(n))
    start = now = (rate * n) @ p
    for _ in range(history_steps):
        if np.abs(now - want).max() <= mixing.CLOSE * start.sum():
            break
        step = np.where(start > 0, (now - want) / np.where(start > 0, start, 1), 0)
        rate = np.maximum(0, rate - p @ step)
        was, now = now, (rate * n) @ p
        if np.abs(was - now).max() < mixing.CLOSE * start.sum():
            break
    return rate


@pytest.mark.parametrize("targets", [None, {"good": 0.7, "poor": 0.3, "toxic": 0.0}])
def test_rates_equal_plain_projected_gradient(spark, targets):
    rows, docs, labels, known = corpus(spark)
    out = mixing.rates(docs, labels, targets).collect()
    assert len(out) == len(rows) and {"doc_id", "text", "score"} <= set(out[0].asDict())
    p = np.array([[r.kb_p.good, r.kb_p.poor, r.kb_p.toxic] for r in out])
    n = np.array([r.kb_tokens for r in out], dtype=float)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    words = {(r.doc_id, r.score): len((r.text or "").split()) for r in out}
    assert all(words[(r.doc_id, r.score)] == r.kb_tokens for r in out)
    now = n @ p
    budget = now[0] + now[1]
    want = np.array([now[0], now[1], 0.0]) if targets is None else np.array([budget * targets[k] for k in mixing.DOMAINS])
    rate = plain_rates(p, n, want)
    assert np.allclose(rate, [r.kb_rate for r in out], atol=2e-5)
    # nearer to the targets than the corpus as it is
    assert np.abs((rate * n) @ p - want).sum() < 0.35 * np.abs(now - want).sum()
    hidden = [r for r in out if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 3 == 0]
    assert np.mean([(r.kb_p.toxic > 0.5) == (r.doc_id % 8 == 1) for r in hidden]) > 0.95
    assert np.mean([(r.kb_p.poor > 0.5) == (r.doc_id % 8 == 0) for r in hidden]) > 0.95


def scored(spark, cells):
    return spark.createDataFrame([(p, n) for *p, n in cells], "kb_p struct<good: double, poor: double, toxic: double>, kb_tokens long")


@pytest.mark.parametrize("driver_cells", [0, mixing.DRIVER_CELLS])
def test_small_toxic_share_goes(spark, driver_cells):
    # toxic text has 0.04 % of all tokens: the gap counts against its own tokens, not against all
    docs = scored(spark, [(1.0, 0.0, 0.0, 900_000), (0.0, 1.0, 0.0, 99_600), (0.02, 0.0, 0.98, 400)])
    history, totals = mixing.solve(docs, driver_cells=driver_cells)
    assert history and totals["after"][2] < 0.01 * totals["before"][2] and not mixing.missed(totals)
    assert np.allclose(totals["after"][:2], totals["targets"][:2], rtol=1e-4)
    # a domain that moves slowly is not settled while the others stand still
    docs = scored(spark, [(1.0, 0.0, 0.0, 900_000), (0.0, 1.0, 0.0, 99_000), (0.3, 0.3, 0.4, 1000)])
    _, totals = mixing.solve(docs, driver_cells=driver_cells)
    assert totals["after"][2] < 0.01 * totals["before"][2]


def test_copies_meet_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(BAD if i % 8 == 0 else GOOD) + rng.choice("abcdef") for _ in range(40))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 4000, 3)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
    out = mixing.rates(docs, labels, targets).collect()
    whole = sum(r.kb_tokens for r in out)
    for kind in ("good", "poor"):
        got = sum(r.kb_copies * r.kb_tokens * r.kb_p[kind] for r in out)
        assert abs(got - targets[kind] * whole) < 0.12 * targets[kind] * whole
    assert all(int(r.kb_rate) <= r.kb_copies <= int(r.kb_rate) + 1 for r in out)
    # the same document gets the same copies, whatever its place
    again = mixing.rates(docs.repartition(5), labels, targets, keep_text=False).collect()
    assert {r.doc_id: r.kb_copies for r in out} == {r.doc_id: r.kb_copies for r in again}


def test_missed_targets_are_told(spark):
    docs = spark.createDataFrame([(i, "calm river") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 8)) for i in range(20)], "doc_id long, quality int, toxic int")
    # equal texts: toxic ones cannot go without the good ones
    with pytest.warns(UserWarning, match="mixing misses targets: .*toxic"):
        mixing.rates(docs, labels).collect()


def test_mixing_is_native(spark):
    rows, docs, labels, _ = corpus(spark, 80)
    plan = mixing.posteriors(docs, mixing.fit(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(none, labels).collect() == [] and mixing.rates(none, labels).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert mixing.rates(some, labels).count() == 1 and importance.resample(some, labels).first().kept
