"""Data-quality profiles of frames and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geom
from kerbside.operators.ordered import ordinal, over_scene


def exact_percentiles(df: DataFrame, value: str, shares: list[float], bucket: Column | None = None) -> DataFrame:
    """Linear-interpolated percentiles from order positions: one row per share.

    No task holds all values, unlike the ``percentile`` aggregate, and the result is
    exact, unlike ``percentile_approx``.  Equal values are counted once with a weight.
    """
    weights = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("w"))
    from kerbside.operators.ordered import running_sums
    upto = running_sums(weights, [value], {"hi": "w"},
                        bucket=F.floor(F.col(value) * 1000) if bucket is None else bucket)
    total = weights.agg(F.sum("w")).scalar()
    want = F.explode(F.array(*[F.lit(s) for s in shares]))
    spots = df.sparkSession.range(1).select(want.alias("share")).withColumn("at", F.col("share") * (total - 1))
    lo, hi = F.floor("at"), F.ceil("at")
    first = F.col("hi") - F.col("w")
    hit = upto.join(F.broadcast(spots), ((lo >= first) & (lo < F.col("hi"))) | ((hi >= first) & (hi < F.col("hi"))))
    v_lo = F.max(F.when((lo >= first) & (lo < F.col("hi")), F.col(value)))
    v_hi = F.max(F.when((hi >= first) & (hi < F.col("hi")), F.col(value)))
    return hit.groupBy("share", "at").agg(v_lo.alias("a"), v_hi.alias("b")).select(
        "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


def calibration(frames: DataFrame) -> DataFrame:
    """p10, p50, p90 of speed, steer, slot distance and slot heading, plus two shares."""
    cols = {
        "speed": F.col("speed_ms"), "abs_steer": F.abs("steer"),
        "dist_to_slot": geom.hypot(F.col("slot_r"), F.col("slot_f")), "abs_heading": F.abs("slot_dh"),
    }
    base = frames.select(*[F.round(c, 6).alias(n) for n, c in cols.items()], "reverse")
    out = None
    for name in cols:
        part = exact_percentiles(base, name, [0.1, 0.5, 0.9]).select(F.lit(name).alias("metric"), "share", "value")
        out = part if out is None else out.unionByName(part)
    shares = base.agg(
        F.avg(F.col("reverse").cast("double")).alias("a"), F.avg((F.col("speed") < 0.05).cast("double")).alias("b"))
    rows = shares.select(F.explode(F.array(
        F.struct(F.lit("reverse_share").alias("metric"), F.col("a").alias("value")),
        F.struct(F.lit("stopped_share").alias("metric"), F.col("b").alias("value")))).alias("r")).select(
        "r.metric", F.lit(None).cast("double").alias("share"), "r.value")
    return out.unionByName(rows)


def gear_changes(frames: DataFrame) -> DataFrame:
    """Flips, length and single-frame toggles per episode."""
    def build(w):
        prev, nxt = F.lag("reverse").over(w), F.lead("reverse").over(w)
        return {"flip": (prev != F.col("reverse")).cast("int"),
                "toggle": ((prev != F.col("reverse")) & (nxt != F.col("reverse"))).cast("int")}

    return over_scene(frames.select("scene_token", "frame_idx", "reverse"), 1, 1, build).groupBy("scene_token").agg(
        F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"), F.coalesce(F.sum("toggle"), F.lit(0)).alias("toggles"),
        F.count(F.lit(1)).alias("length"))


def gear_summary(per_scene: DataFrame) -> DataFrame:
    median = exact_percentiles(per_scene, "length", [0.5], F.floor(F.col("length") / 64)).select("value")
    return per_scene.agg(
        F.avg("flips").alias("mean_flips"), F.max("flips").alias("max_flips"), F.sum("toggles").alias("toggles"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length")).withColumn(
        "median_length", median.scalar())


def end_alignment(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """Final pose of each episode in its slot's frame: heading, depth and lateral offset."""
    last = frames.groupBy("scene_token").agg(F.max_by(F.struct("gx", "gy", "gyaw"), "frame_idx").alias("p"))
    rf = geom.to_local(F.col("p.gx"), F.col("p.gy"), F.col("slot_x"), F.col("slot_y"), F.col("slot_yaw"))
    return last.join(scenes, "scene_token").select(
        "scene_token", F.abs(rf.forward).alias("depth"), F.abs(rf.right).alias("lateral"),
        F.abs(geom.wrap(F.col("p.gyaw") - F.col("slot_yaw"))).alias("heading"))


def probe_folds(scenes: DataFrame, folds: int) -> DataFrame:
    """Episode-grouped folds: the place of an episode in name order, modulo ``folds``."""
    pos = ordinal(scenes, ["scene_token"], "_p", bucket=F.col("scene_token"))
    return pos.withColumn("fold", (F.col("_p") % folds).cast("int")).drop("_p")


def linear_probe(rows: DataFrame, folds: int = 5, max_iter: int = 20) -> DataFrame:
    """Grouped k-fold logistic regression on ``features`` (vector) against ``label``.

    One row per fold with accuracy, majority share and chance.  The folds loop runs on
    the driver, the training itself is distributed.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    pipe = Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=max_iter, regParam=0.01),
    ])
    classes = rows.agg(F.count_distinct("label")).scalar()
    out = None
    for k in range(folds):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        scored = pipe.fit(train).transform(test)
        counts = test.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        part = scored.agg(
            F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"),
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).withColumns({
            "majority": counts.agg(F.max("n") / F.sum("n")).scalar(), "chance": 1.0 / classes})
        out = part if out is None else out.unionByName(part)
    return out
