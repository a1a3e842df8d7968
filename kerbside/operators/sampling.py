"""Order, sampling and sharding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.ordered import ordinal

SCENE_ORDER = ["scene_token", "frame_idx"]


def frame_bucket(width: int = 65536) -> Column:
    """Pieces along (scene_token, frame_idx); a long scene is cut as well."""
    return F.struct("scene_token", F.floor(F.col("frame_idx") / width).alias("piece"))


def with_position(frames: DataFrame, name: str = "pos") -> DataFrame:
    return ordinal(frames, SCENE_ORDER, name, bucket=frame_bucket())


def every_kth(frames: DataFrame, k: int, *, bucket_us: int = 60_000_000) -> DataFrame:
    """All frames by timestamp, every k-th kept; ties by token."""
    pos = ordinal(frames, ["ts_us", "token"], "pos",
                  bucket=F.struct(F.floor(F.col("ts_us") / bucket_us).alias("t")))
    return pos.filter(F.col("pos") % k == 0)


def sample(frames: DataFrame, strategy: str, seed: int = 0) -> DataFrame:
    """``all``, ``first:N``, ``end:N``, ``random:N`` or ``random:P%`` (rounded up)."""
    if strategy == "all":
        return frames
    kind, _, amount = strategy.partition(":")
    total = frames.agg(F.count(F.lit(1))).scalar()
    share = re.fullmatch(r"(\d+(?:\.\d+)?)%", amount)
    n = F.ceil(total * (float(share.group(1)) / 100)) if share else F.lit(int(amount))
    if kind == "random":
        # order by a seeded hash: repeatable, and its first digits are ready-made buckets
        hashed = frames.withColumn("_h", _seeded("token", seed))
        return ordinal(hashed, ["_h", "token"], "_pos", bucket=F.substring("_h", 1, 3)).filter(
            F.col("_pos") < n).drop("_h", "_pos")
    placed = with_position(frames, "_pos")
    if kind == "first":
        return placed.filter(F.col("_pos") < n).drop("_pos")
    if kind == "end":
        return placed.filter(F.col("_pos") >= total - n).drop("_pos")
    raise ValueError(f"unknown sampling strategy {strategy!r}")


def _seeded(name: str, seed: int) -> Column:
    return F.md5(F.concat(name, F.lit(f":{seed}")))


def evenly(frames: DataFrame, n: int) -> DataFrame:
    """``n`` rows at rounded, evenly spaced positions (half to even)."""
    placed = with_position(frames)
    total = frames.agg(F.count(F.lit(1))).scalar()
    spots = frames.sparkSession.range(n).select(
        F.bround(F.col("id") * (total - 1) / max(1, n - 1), 0).cast("long").alias("pos")).distinct()
    return placed.join(spots, "pos", "left_semi")


def scene_dim(frames: DataFrame) -> DataFrame:
    """One row per scene with its length and its place in name order."""
    scenes = frames.groupBy("scene_token").agg(F.count(F.lit(1)).alias("n"))
    return ordinal(scenes, ["scene_token"], "scene_pos", bucket=F.col("scene_token"))


def episode_shard(frames: DataFrame, shards: int) -> DataFrame:
    """Whole episodes in name order, cut into near-equal groups, first groups larger."""
    dim = scene_dim(frames)
    total = dim.agg(F.count(F.lit(1))).scalar()
    q, m = F.floor(total / shards), total % shards
    edge = m * (q + 1)
    r = F.col("scene_pos")
    shard = F.when(r < edge, F.floor(r / (q + 1))).otherwise(m + F.floor((r - edge) / F.greatest(q, F.lit(1))))
    return frames.join(dim.select("scene_token", shard.cast("int").alias("shard")), "scene_token")


def contiguous_scenes(frames: DataFrame, workers: int) -> DataFrame:
    """floor(S/W) scenes per worker in order, the remainder to the last."""
    dim = scene_dim(frames)
    total = dim.agg(F.count(F.lit(1))).scalar()
    per = F.floor(total / workers)
    worker = F.when(per == 0, workers - 1).otherwise(F.least(F.floor(F.col("scene_pos") / per), F.lit(workers - 1)))
    return frames.join(dim.select("scene_token", worker.cast("int").alias("worker")), "scene_token")


def _fill(loads: list[int], length: int, count: int) -> list[int]:
    """How many of ``count`` equal scenes each shard takes when the emptiest is always next."""
    def taken(level: int) -> list[int]:
        return [0 if level < a else (level - a) // length + 1 for a in loads]

    low, high = min(loads), max(loads) + length * count
    while low < high:
        mid = (low + high) // 2
        if sum(taken(mid)) >= count:
            high = mid
        else:
            low = mid + 1
    got = taken(low)
    extra = sum(got) - count
    for s in reversed(range(len(loads))):
        if extra and got[s] and loads[s] + (got[s] - 1) * length == low:
            got[s] -= 1
            extra -= 1
    return got


def balanced_shard(frames: DataFrame, shards: int) -> DataFrame:
    """Longest scene first to the emptiest shard, ties by name and shard number.

    Scenes of equal length are interchangeable, so the driver only sees the histogram
    of scene lengths (distinct lengths, not scenes) and keeps one load per shard; which
    scene of a length class goes where follows from its place in the class.
    """
    spark = frames.sparkSession
    scenes = frames.groupBy("scene_token").agg(F.count(F.lit(1)).alias("n"))
    lengths = scenes.groupBy("n").agg(F.count(F.lit(1)).alias("scenes")).orderBy(F.desc("n")).collect()
    loads = [0] * shards
    plan = []
    for row in lengths:
        got = _fill(loads, row["n"], row["scenes"])
        plan += [(row["n"], s, loads[s], k) for s, k in enumerate(got) if k]
        loads = [a + row["n"] * k for a, k in zip(loads, got)]
    seats = spark.createDataFrame(plan, "n long, shard int, start long, k long").select(
        "n", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"),
        "start").withColumn("key", F.col("start") + F.col("i") * F.col("n"))
    width = F.col("n") * 4096
    seats = ordinal(seats, ["key", "shard"], "place", group=["n"], bucket=F.floor(F.col("key") / width))
    ranked = ordinal(scenes, ["scene_token"], "place", group=["n"], bucket=F.col("scene_token"))
    owner = ranked.join(seats.select("n", "place", "shard"), ["n", "place"]).select("scene_token", "shard")
    return frames.join(owner, "scene_token")


def scene_shuffle(frames: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Scenes in a seeded random order, frames in order inside a scene; ``pos`` is the place of a row."""
    hashed = frames.withColumn("_h", _seeded("scene_token", seed + epoch))
    bucket = F.struct(F.col("_h"), F.col("scene_token"), F.floor(F.col("frame_idx") / 65536).alias("piece"))
    return ordinal(hashed, ["_h", "scene_token", "frame_idx"], "pos", bucket=bucket).drop("_h")


def padded_partition(frames: DataFrame, workers: int, batch: int = 1) -> DataFrame:
    """Rows repeated from the start up to a multiple of workers x batch, in equal blocks."""
    placed = with_position(frames)
    total = frames.agg(F.count(F.lit(1))).scalar()
    unit = workers * batch
    full = F.ceil(total / unit) * unit
    copies = F.sequence(F.lit(0).cast("long"), F.floor((full - 1 - F.col("pos")) / total))
    spread = placed.withColumn("copy", F.explode(copies)).withColumn("slot", F.col("pos") + F.col("copy") * total)
    return spread.withColumn("worker", F.floor(F.col("slot") / (full / workers)).cast("int"))


def grouped_partition(frames: DataFrame, group: str, workers: int, batch: int, seed: int = 0, epoch: int = 0, key: str = "token") -> DataFrame:
    """Rows of each group in a seeded order, repeated from its start up to a multiple of workers x batch; batches of one group each,
    in a seeded order of their own, dealt to the workers in equal blocks.

    Adds ``slot`` (place in the whole epoch) and ``worker``.  Orders are by hash, so a group of any size is numbered in pieces.
    """
    unit = workers * batch
    named = frames.withColumns({"_g": F.coalesce(F.col(group).cast("string"), F.lit("")), "_h": _seeded(key, seed + epoch)})
    placed = ordinal(named, ["_h", key], "_pos", group=["_g"], bucket=F.substring("_h", 1, 3))
    sizes = named.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_full", F.ceil(F.col("_n") / unit) * unit)
    both = placed.join(sizes, "_g")
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_full") - 1 - F.col("_pos")) / F.col("_n")))
    rows = both.withColumn("_copy", F.explode(copies)).withColumn("_at", F.col("_pos") + F.col("_copy") * F.col("_n"))
    # one row for each batch; its place among all batches is that of its hash
    batches = sizes.select("_g", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_full") / batch - 1).cast("long"))).alias("_b")).withColumn(
        "_bh", F.md5(F.concat_ws(":", "_g", "_b", F.lit(str(seed + epoch)))))
    batches = ordinal(batches, ["_bh", "_g", "_b"], "_place", bucket=F.substring("_bh", 1, 3)).drop("_bh")
    total = sizes.agg(F.sum("_full").alias("_total"))
    out = rows.withColumn("_b", F.floor(F.col("_at") / batch)).join(batches, ["_g", "_b"]).crossJoin(F.broadcast(total))
    slot = F.col("_place") * batch + F.col("_at") % batch
    return out.withColumns({"slot": slot, "worker": F.floor(slot / (F.col("_total") / workers)).cast("int")}).select(*frames.columns, "slot", "worker")


def load_balance(assigned: DataFrame, worker: str = "worker") -> DataFrame:
    per = assigned.groupBy(worker).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.min("n").alias("min_load"), F.max("n").alias("max_load"), F.avg("n").alias("avg_load"),
        ((F.max("n") - F.min("n")) / F.avg("n") * 100).alias("imbalance_pct"))


def shard_report(traces: DataFrame, num_shards: int) -> DataFrame:
    """One row: missing shards, episodes in two shards with an example, totals, fallback rate."""
    per = traces.groupBy("shard", "scene_token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("teacher").endswith("_fallback_mock")).alias("fallbacks"))
    episodes = per.groupBy("scene_token").agg(
        F.collect_set("shard").alias("shards"), F.sum("n").alias("n"), F.sum("fallbacks").alias("fallbacks"))
    shared = F.size("shards") > 1
    row = episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("frames"), F.sum("fallbacks").alias("fallbacks"),
        F.count_if(shared).alias("shared_episodes"),
        F.min(F.when(shared, F.col("scene_token"))).alias("example"))
    present = per.agg(F.collect_set("shard")).scalar()
    missing = F.array_except(F.sequence(F.lit(0), F.lit(num_shards - 1)), present)
    return row.withColumns({
        "missing_shards": F.size(missing),
        "fallback_rate": F.round(F.col("fallbacks") / F.greatest(F.lit(1), F.col("frames")), 4)})
