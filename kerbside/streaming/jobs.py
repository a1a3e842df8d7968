"""Stream jobs: round ingest, gear changes, track lifecycle, late features (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.ordered import ordinal, running_sums, sparse_neighbours


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(path))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything available to Parquet; exactly once through the checkpoint."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()


def ingest_rounds(stream: DataFrame, key: str, table: str, checkpoint: str) -> None:
    """Insert-only ingest of round files.

    Every micro-batch writes its new keys to its own batch folder in overwrite mode,
    so a batch that is run again after a failure replaces itself and a re-run of the
    whole ingest adds nothing.
    """
    schema = stream.schema

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = (spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema)
                 .option("basePath", table).option("ignoreMissingFiles", "true").parquet(table)
                 .filter(F.col("batch") < batch_id).select(key)) if batch_id else None
        fresh = batch.dropDuplicates([key])
        if known is not None:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.timestamp_micros("ts_us"))


def gear_change_events(frames: DataFrame, late: str = "1 hour", pause: str = "1 day") -> DataFrame:
    """Frames whose gear differs from the frame before; works on streams and batches.

    The stream meets itself on (scene, frame_idx), which counts without gaps in a scene: state is
    keyed by single frames, so a scene with most of the traffic still spreads.  ``pause`` is the longest
    break between two frames of a scene and only lets old state go; a batch needs none.
    Event times are real ones: a stream drops rows at or before the epoch as late.
    """
    f = event_time(frames)
    cur = f.select("scene_token", "frame_idx", "token", "reverse", "at")
    prev = f.select("scene_token", (F.col("frame_idx") + 1).alias("frame_idx"),
                    F.col("reverse").alias("prev_reverse"), F.col("at").alias("prev_at"))
    if frames.isStreaming:
        cur, prev = cur.withWatermark("at", late), prev.withWatermark("prev_at", late)
    met = cur.join(prev, ["scene_token", "frame_idx"])
    if frames.isStreaming:
        met = met.filter((F.col("at") >= F.col("prev_at")) & (F.col("at") <= F.col("prev_at") + F.expr(f"INTERVAL {pause}")))
    return met.filter("reverse <> prev_reverse").select("scene_token", "frame_idx", "token", "reverse")


def late_features(conversations: DataFrame, features: DataFrame, bound: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """Conversations with their feature row, or marked incomplete once the bound passed."""
    c = event_time(conversations)
    f = event_time(features).select(F.col("token").alias("f_token"), "path", F.col("at").alias("f_at"))
    if conversations.isStreaming:
        c, f = c.withWatermark("at", late), f.withWatermark("f_at", late)
    on = (F.col("token") == F.col("f_token")) & (F.col("f_at") >= F.col("at")) & (
        F.col("f_at") <= F.col("at") + F.expr(f"INTERVAL {bound}"))
    return c.join(f, on, "leftOuter").select("token", "path", F.col("path").isNotNull().alias("complete"))


def late_features_to_end(conversations: DataFrame, features: DataFrame, done: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream of ``late_features`` to its end, then report what it still held as incomplete.

    The stream cannot know that nothing more comes, so rows inside its watermark stay in its state.
    ``done`` is the finished input of conversations as a batch; those without a row in ``out`` are added
    with ``complete`` false, in a batch of its own that a re-run writes anew.  Each conversation has one row.
    """
    joined = late_features(conversations, features)
    run_to_end(joined, f"{out}/part=stream", checkpoint)
    spark = done.sparkSession
    told = spark.read.schema(joined.schema).parquet(f"{out}/part=stream")
    rest = done.join(told, "token", "left_anti").select("token", F.lit(None).cast("string").alias("path"), F.lit(False).alias("complete"))
    rest.write.mode("overwrite").parquet(f"{out}/part=closing")


# ---- track lifecycle -------------------------------------------------------------------------

def track_lifecycle(scores: DataFrame, birth: float = 0.5, weak: float = 0.4, tolerance: int = 5, *, chunk: int = 4096) -> DataFrame:
    """Track ids per (scene, slot): born at a strong score, dead after ``tolerance`` weak ones.

    ``scores`` has scene_token, slot, frame_idx, score.  A strong score resets the miss
    count, so the state after it does not depend on the past: a track lives while fewer
    than ``tolerance`` weak scores follow its last strong one, and a strong score is a
    birth when the one before it was further than that.  This needs running counts only,
    so neither a long scene nor a long track sits in one task.  Ids count births in a
    scene by frame and slot.
    """
    piece = F.floor(F.col("frame_idx") / chunk)
    s = scores.withColumns({"_strong": (F.col("score") >= birth).cast("long"), "_weak": (F.col("score") < weak).cast("long")})
    run = running_sums(s, ["frame_idx"], {"strong_n": "_strong", "weak_n": "_weak"}, group=["scene_token", "slot"], bucket=piece)
    strong = run.filter("_strong = 1").select("scene_token", "slot", "frame_idx", "strong_n", "weak_n")
    linked = sparse_neighbours(strong, ["scene_token", "slot"], "frame_idx", "weak_n", "_prev_weak", "_next", chunk=chunk)
    gap = F.col("weak_n") - F.col("_prev_weak")
    born = linked.withColumn("_birth", F.when(F.col("_prev_weak").isNull() | (gap >= tolerance), 1).otherwise(0).cast("long"))
    # births number the tracks of a scene; every strong row keeps the count of births so far
    upto = running_sums(born, ["frame_idx"], {"birth_n": "_birth"}, group=["scene_token", "slot"], bucket=piece)
    ids = ordinal(upto.filter("_birth = 1").select("scene_token", "slot", "birth_n", "frame_idx"),
                  ["frame_idx", "slot"], "track_id", group=["scene_token"], bucket=piece).select(
        "scene_token", "slot", "birth_n", "track_id")
    # a row belongs to its last strong row; strong_n names that row inside the slot
    owner = upto.select("scene_token", "slot", "strong_n", F.col("weak_n").alias("_w0"), "birth_n")
    state = run.join(owner, ["scene_token", "slot", "strong_n"]).join(ids, ["scene_token", "slot", "birth_n"])
    misses = F.col("weak_n") - F.col("_w0")
    return state.filter(misses < tolerance).select("scene_token", "slot", "frame_idx", "track_id", misses.alias("misses"))
