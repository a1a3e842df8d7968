"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Each text is a bag of hashed words and word pairs.  The raw model counts the n-grams of all documents, the target model those
of the labelled good ones; a text's log weight is the sum of the log ratios of its n-grams.  Adding Gumbel noise
and keeping the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_rows, small_batches, staged

BUCKETS, SMOOTHING, SEED = 8192, 1.0, 42
TARGET_DOCS = 20_000
BINS, FEW = 4096, 1000


def buckets_of(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and word pairs of ``text``; letters A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    crc = zlib.crc32
    grams = [crc(w) for w in words]
    # a pair's value continues the first word's by the second
    pairs = [crc(b" " + w, g) for g, w in zip(grams, words[1:])]
    return np.array(grams + pairs, dtype=np.int64) % buckets


def ngram_counts(docs: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """N-gram counts of all rows by bucket; each task hands on one row for each bucket."""
    def run(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                held += np.bincount(buckets_of(t, buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["b", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).mapInArrow(run, "b long, n long")
    out = np.zeros(buckets)
    for r in rows.groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return share(target) - share(raw)


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (ties counted), by counts in ever narrower bins: the driver sees at most ``BINS`` counts."""
    if k <= 0:
        return float("inf")
    ends = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not ends.n or k > ends.n:
        return float("-inf")
    lo, hi, above = ends.lo, ends.hi, 0
    c = F.col(column)
    while True:
        inside = scores.where(c.between(lo, hi))
        values = inside.groupBy(column).agg(F.count("*").alias("n")).orderBy(c.desc()).limit(FEW + 1).collect() if _few(inside, column) else None
        if values is not None:
            for r in values:
                above += r.n
                if above >= k:
                    return r[column]
        width = (hi - lo) / BINS
        at = F.least(F.floor((c - lo) / F.lit(width)), F.lit(BINS - 1))
        found = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["at"]):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n


def _few(inside: DataFrame, column: str) -> bool:
    return inside.select(column).distinct().limit(FEW + 1).count() <= FEW


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", share: float | None = None,
             buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """(id, n_grams, log_weight, score, kept) of every row; k is ``share`` of the rows, rounded.

    The target text is that of at most ``target_docs`` documents labelled quality 1 and not toxic, by the hash of their
    ids; by default ``share`` is the share of quality 1 among the labelled ids (all, if none is labelled).  The noise is a
    hash of id, text and ``seed``, so a run can be repeated.  Rows that tie at the k-th score, such as repeated ones, are
    all kept.  Null text: empty, log weight 0.  An empty table gives an empty result.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = known.where("q = 1 and t = 0").orderBy(F.xxhash64(id_col), id_col).limit(target_docs).select(id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    # the ids are at most ``target_docs``
    target = rows.join(F.broadcast(good.withColumnRenamed(id_col, "id")), "id", "left_semi")
    ratio = log_ratio(ngram_counts(target, "t", buckets), ngram_counts(rows, "t", buckets))
    if share is None:
        counted = known.agg(F.avg("q").alias("m")).first()
        share = 1.0 if counted.m is None else float(counted.m)

    def run(texts):
        out = []
        for t in texts:
            b = buckets_of(t, buckets)
            out.append((len(b), float(ratio[b].sum())))
        return out

    # 52 bits of the hash, moved off 0 and 1
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "t"), 12).cast("double") + 0.5) / F.lit(float(2**52))
    drawn = rows.withColumn("noise", -F.log(-F.log(unit)))
    scored = staged(map_rows(drawn, run, "t", "n_grams long, log_weight double").withColumn("score", F.col("log_weight") + F.col("noise")))
    line = kth_largest(scored, "score", round(share * scored.count()))
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", "score", (F.col("score") >= F.lit(line)).alias("kept"))
