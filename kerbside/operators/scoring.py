"""Trajectory, planning and text scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom, phrases as ph, turns


def match_predictions(preds: DataFrame, truth: DataFrame) -> DataFrame:
    return preds.join(truth, "token")


def coverage(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """How many predictions match a frame, how many have none, and uncovered frames."""
    p = preds.select("token", F.lit(1).alias("p"))
    t = truth.select("token", F.lit(1).alias("t"))
    return p.join(t, "token", "full").agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("t").isNull(), 1)).alias("unknown_predictions"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("unpredicted_frames"),
    )


def require_overlap(scored: DataFrame, count: str) -> DataFrame:
    """Fail when nothing was scored, as the scorers do."""
    return scored.filter(F.assert_true(F.col(count) > 0, F.lit("no overlapping tokens")).isNull())


def _gaps(pred: Column, truth: Column) -> Column:
    return F.zip_with(pred, truth, lambda p, g: geom.hypot(p["r"] - g["r"], p["f"] - g["f"]))


def trajectory_score(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """ADE, FDE, heading error and parked-well share over 6-waypoint predictions."""
    joined = match_predictions(preds, truth).withColumn("pred", turns.triples(F.col("answer")))
    six = (F.size("pred") == 6) & (F.size("fut") == 6)
    gaps = F.when(six, _gaps(F.col("pred"), F.col("fut")))
    rows = joined.select(
        six.alias("ok"),
        (F.size("pred") != 6).alias("short"),
        (F.aggregate(gaps, F.lit(0.0), lambda a, d: a + d) / 6).alias("ade"),
        F.element_at(gaps, -1).alias("fde"),
        F.when(six, geom.yaw_gap(F.element_at("pred", -1)["h"], F.element_at("fut", -1)["h"])).alias("head"))
    parked = F.col("ok") & (F.col("fde") < 0.5) & (F.col("head") < math.radians(10))
    return rows.agg(
        F.count_if("ok").alias("scored"), F.count_if("short").alias("dropped"),
        F.avg("ade").alias("ade"), F.avg("fde").alias("fde"), F.avg("fde").alias("final_position"),
        F.avg("head").alias("final_heading"),
        (F.count_if(parked) / F.count_if("ok")).alias("parked_well"))


def l2_by_gear(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean L2 at 1, 2 and 3 s, overall and by gear, in one pass of grouping sets."""
    joined = match_predictions(preds, truth).withColumn("pred", turns.pairs(F.col("answer")))
    full = joined.filter((F.size("pred") >= 6) & (F.size("fut") >= 6))
    picks = F.array(*[
        F.struct(F.lit(sec).alias("sec"),
                 geom.hypot(F.element_at("pred", i)["r"] - F.element_at("fut", i)["r"],
                            F.element_at("pred", i)["f"] - F.element_at("fut", i)["f"]).alias("l2"))
        for sec, i in ((1, 2), (2, 4), (3, 6))])
    rows = full.select("reverse", F.explode(picks).alias("p")).select("reverse", "p.sec", "p.l2")
    sets = rows.groupingSets([["sec"], ["sec", "reverse"]], "sec", "reverse").agg(
        F.avg("l2").alias("l2"), F.count(F.lit(1)).alias("n"), F.grouping("reverse").alias("_all"))
    gear = F.when(F.col("_all") == 1, "all").when(F.col("reverse"), "reverse").otherwise("forward")
    return sets.select("sec", gear.alias("gear"), "l2", "n")


def faithfulness(student: DataFrame) -> DataFrame:
    """Entity fidelity and clean share per decision and overall.

    ``student`` has token, decision, allowed and the text in ``trace``.
    """
    problems = ph.hallucinations(F.col("trace"), F.col("decision"), F.col("allowed"))
    rows = student.filter(F.trim("trace") != "").select(
        "decision", ph.entity_fidelity(F.col("trace"), F.col("allowed")).alias("fidelity"),
        (F.size(problems) == 0).alias("clean"))
    return rows.rollup("decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fidelity").alias("entity_fidelity"),
        F.avg(F.col("clean").cast("double")).alias("clean_rate"),
    ).withColumn("decision", F.coalesce("decision", F.lit("ALL")))


#: Odd factors for the places of an n-gram; what is added up are hashes, so sums of unequal n-grams agree by chance only.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: N-grams are dealt by the first bits of their key.
_BUCKET_BITS = 12


def gram_keys(offsets: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Keys of all n-grams of several texts as two rows of 64 bits.

    Text i has the tokens from ``offsets[i]`` to ``offsets[i + 1]``, each given by two hashes.
    """
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[0], offsets[-1])
    at = np.flatnonzero(left >= n) + offsets[0]
    return np.stack([sum((h[at + k] * _PLACES[k] for k in range(n)), np.zeros(len(at), np.uint64)) for h in (first, second)])


def unequal(keys: np.ndarray) -> np.ndarray:
    """Each key once, in order."""
    keys = keys[:, np.lexsort(keys[::-1])]
    return keys[:, np.concatenate([[True], (np.diff(keys) != 0).any(axis=0)])[:keys.shape[1]]]


def distinct_n(texts: DataFrame, sizes: list[int], column: str = "text") -> DataFrame:
    """Distinct n-grams over all n-grams, a row for each n of ``sizes``; no more than five words.

    The texts are read and split once.  N-grams are keyed by 128 bits made of two hashes of each word.  A batch of texts
    sends each of its keys once, as one row of bytes for each of 4096 buckets, and a task counts the keys of a bucket in
    numpy: no row and no entry of a hash table is made for a single n-gram.
    """
    if max(sizes) > len(_PLACES) or min(sizes) < 1:
        raise ValueError(f"n-grams have 1 to {len(_PLACES)} words")
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # long texts do not meet in one batch
    tokens = F.filter(F.split(column, r"\s+"), lambda t: t != "")
    words = texts.select(tokens.alias("tokens")).select(
        F.transform("tokens", lambda t: F.xxhash64(t)).alias("a"), F.transform("tokens", lambda t: F.xxhash64(F.lit(1), t)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).drop_null() for c in ("a", "b"))
            offsets = a.offsets.to_numpy()
            for n in sizes if len(a) else ():
                found = gram_keys(offsets, *[v.values.to_numpy().view(np.uint64) for v in (a, b)], n)
                keys = unequal(found)
                bucket = (keys[0] >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                # how many n-grams there are, repeats included, is told once a batch
                grams = np.zeros(len(starts), np.int64)
                grams[:1] = found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), n, np.int32)), pa.array(bucket[starts]), pa.array(grams),
                     pa.array([keys[:, i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], names=["n", "bucket", "grams", "keys"])

    def count(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), np.uint64).reshape(2, -1) for k in table.column("keys")]
        return pa.table({"n": table.column("n")[:1], "d": pa.array([unequal(np.concatenate(keys, axis=1)).shape[1]], pa.int64()),
                         "grams": pa.array([sum(table.column("grams").to_pylist())], pa.int64())})

    dealt = words.mapInArrow(run, "n int, bucket int, grams long, keys binary")
    found = dealt.groupBy("n", "bucket").applyInArrow(count, "n int, d long, grams long").groupBy("n").agg(
        F.sum("d").alias("distinct_grams"), F.sum("grams").alias("all_grams"))
    wanted = texts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("distinct_grams", "all_grams")]
    return wanted.join(found, "n", "left").select("n", *counts).withColumn(
        "share", F.col("distinct_grams") / F.greatest(F.lit(1), F.col("all_grams")))


def unique_share(texts: DataFrame, column: str = "text") -> DataFrame:
    # a hash pair keeps the shuffle narrow for long texts; equal texts always agree
    per = texts.select(F.sha2(column, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("unique_texts"), F.sum("n").alias("texts"))


def planning_l2(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Masked mean L2 per step over evaluated frames, with the running mean to the step.

    ``truth`` has fut and n_valid, the count of steps that really exist; a masked
    step contributes zero and still counts as a frame.
    """
    span = turns.split_reason_traj(F.col("answer"))["traj"]
    joined = match_predictions(preds, truth).withColumn("pred", turns.repair_points(span))
    gaps = F.zip_with("pred", "fut", lambda p, g: geom.hypot(p["r"] - g["r"], p["f"] - g["f"]))
    steps = joined.filter(F.col("pred").isNotNull()).select(
        "n_valid", F.posexplode(gaps).alias("i", "gap"))
    masked = F.when(F.col("i") < F.col("n_valid"), F.col("gap")).otherwise(0.0)
    per = steps.groupBy((F.col("i") + 1).alias("step")).agg(
        F.avg(masked).alias("l2"), F.count(F.lit(1)).alias("frames"))
    # six rows from here on
    upto = per.select(F.col("step").alias("s2"), F.col("l2").alias("v"))
    return per.join(F.broadcast(upto), F.col("s2") <= F.col("step")).groupBy("step", "l2", "frames").agg(
        F.avg("v").alias("mean_to_step"))


def conversation_lengths(turns_df: DataFrame) -> DataFrame:
    """Words per conversation over all its turns; a conversation without words is an error."""
    per = turns_df.select("conv_id", F.size(F.filter(
        F.split("text", r"\s+"), lambda w: w != "")).alias("w")).groupBy("conv_id").agg(F.sum("w").alias("words"))
    return per.filter(F.assert_true(F.col("words") > 0, F.lit("conversation without words")).isNull())
