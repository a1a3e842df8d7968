"""Relational export, dimension tables, path and field patches, splits, set checks
(A3, B24, B25, D1-D4, D27, J10, S1-S3, F22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import geom, rig
from kerbside.operators import boxes as bx, windows
from kerbside.operators.ordered import ordinal, sparse_neighbours

LIDAR = "LIDAR_TOP"
# visibility scale, fixed values
VISIBILITY = [("1", "v0-40"), ("2", "v40-60"), ("3", "v60-80"), ("4", "v80-100")]


def category_table(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in bx.CLASS_NAMES], "name string")
    return names.select(bx.category_token(F.col("name")).alias("token"), "name", F.col("name").alias("description"))


def visibility_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VISIBILITY, "token string, level string")


def sensor_table(spark: SparkSession) -> DataFrame:
    cams = rig.mounts(spark).select(F.col("camera").alias("channel"), F.lit("camera").alias("modality"))
    lidar = spark.createDataFrame([(LIDAR, "lidar")], "channel string, modality string")
    return lidar.unionByName(cams).withColumn("token", F.concat(F.lit("sensor_"), F.lower("channel")))


def calibrated_sensor_table(spark: SparkSession) -> DataFrame:
    cams = rig.rotation_quat(rig.extrinsics(rig.mounts(spark))).select(
        F.col("camera").alias("channel"), "tx", "ty", "tz", "qw", "qx", "qy", "qz", F.lit(rig.FOCAL).alias("focal"))
    lidar = spark.createDataFrame(
        [(LIDAR, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None)],
        "channel string, tx double, ty double, tz double, qw double, qx double, qy double, qz double, focal double")
    return lidar.unionByName(cams).withColumn("token", F.concat(F.lit("cs_"), F.lower("channel")))


def sample_data_table(frames: DataFrame) -> DataFrame:
    """One row per frame and channel; prev and next run along the channel."""
    spark = frames.sparkSession
    chained = windows.token_chain(frames.select("scene_token", "token", "frame_idx", "ts_us"))
    channels = F.broadcast(sensor_table(spark).select("channel", "modality"))  # seven rows

    def named(token: Column) -> Column:
        return F.when(token == "", "").otherwise(F.concat(F.lit("sd_"), F.col("channel"), F.lit("_"), token))

    return chained.crossJoin(channels).select(
        named(F.col("token")).alias("token"), F.col("token").alias("sample_token"),
        F.concat(F.lit("ep_"), "token").alias("ego_pose_token"),
        F.concat(F.lit("cs_"), F.lower("channel")).alias("calibrated_sensor_token"),
        F.col("ts_us").alias("timestamp"), named(F.col("prev")).alias("prev"), named(F.col("next")).alias("next"), "channel")


def ego_pose_table(frames: DataFrame) -> DataFrame:
    q = geom.yaw_quat(F.col("gyaw"))
    return frames.select(
        F.concat(F.lit("ep_"), "token").alias("token"), F.col("ts_us").alias("timestamp"),
        F.col("gx").alias("x"), F.col("gy").alias("y"), q.w.alias("qw"), q.z.alias("qz"))


def _ann_token() -> Column:
    return F.concat(F.lit("ann_"), "scene_token", F.lit("_"), F.col("actor_id").cast("string"),
                    F.format_string("_%04d", "frame_idx"))


def sample_annotation_table(boxes: DataFrame, poses: DataFrame) -> DataFrame:
    g = bx.to_global(boxes, poses).withColumn("token_", _ann_token())
    chained = sparse_neighbours(g, ["scene_token", "actor_id"], "frame_idx", "token_", "prev", "next")
    return chained.select(
        F.col("token_").alias("token"), F.col("token").alias("sample_token"),
        F.concat(F.lit("inst_"), "scene_token", F.lit("_"), F.col("actor_id").cast("string")).alias("instance_token"),
        F.lit("4").alias("visibility_token"), "cx", "cy", "cz", "w", "l", "h", "qw", "qz",
        F.coalesce("prev", F.lit("")).alias("prev"), F.coalesce("next", F.lit("")).alias("next"),
        F.lit(10).alias("num_lidar_pts"))


def instance_table(boxes: DataFrame) -> DataFrame:
    ann = _ann_token()
    return boxes.withColumn("ann", ann).groupBy("scene_token", "actor_id").agg(
        F.count(F.lit(1)).alias("nbr_annotations"),
        F.min_by("ann", "frame_idx").alias("first_annotation_token"),
        F.max_by("ann", "frame_idx").alias("last_annotation_token"),
        bx.category_token(F.min_by("category", "frame_idx")).alias("category_token"),
    ).select(F.concat(F.lit("inst_"), "scene_token", F.lit("_"), F.col("actor_id").cast("string")).alias("token"),
             "category_token", "nbr_annotations", "first_annotation_token", "last_annotation_token")


def relational_tables(frames: DataFrame, boxes: DataFrame) -> dict[str, DataFrame]:
    """The thirteen tables of the relational form, each its own lazy DataFrame."""
    spark = frames.sparkSession
    scenes = windows.scene_summary(frames)
    log = scenes.select(F.concat(F.lit("log_"), "scene_token").alias("token"), F.lit("").alias("logfile"))
    return {
        "sensor": sensor_table(spark),
        "calibrated_sensor": calibrated_sensor_table(spark),
        "scene": scenes.select(F.col("scene_token").alias("token"), "nbr_samples", "first_token", "last_token"),
        "log": log,
        "sample": windows.token_chain(frames.select("scene_token", "token", "frame_idx", "ts_us")).drop("frame_idx"),
        "sample_data": sample_data_table(frames),
        "ego_pose": ego_pose_table(frames),
        # the one map row lists all logs; kept long so no row grows with the data
        "map": log.select(F.lit("lot_map").alias("token"), F.col("token").alias("log_token")),
        "category": category_table(spark),
        "instance": instance_table(boxes),
        "sample_annotation": sample_annotation_table(boxes, frames),
        "attribute": spark.createDataFrame([], "token string, name string"),
        "visibility": visibility_table(spark),
    }


def export_relational(tables: dict[str, DataFrame], out: str, version: str) -> None:
    """One folder per table; the version table is written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").write.mode("overwrite").json(f"{out}/version")


# ---- joins -----------------------------------------------------------------------------

def sample_poses(sample: DataFrame, sample_data: DataFrame, ego_pose: DataFrame) -> DataFrame:
    """Sample -> its lidar sample_data -> ego pose."""
    lidar = sample_data.filter(F.col("channel") == LIDAR).select("sample_token", "ego_pose_token")
    pose = ego_pose.select(F.col("token").alias("ego_pose_token"), "x", "y", "qw", "qz")
    return sample.withColumnRenamed("token", "sample_token").join(lidar, "sample_token").join(pose, "ego_pose_token")


def same_scene_neighbours(frames: DataFrame) -> DataFrame:
    """prev/next kept only when that token exists and belongs to the same scene.

    A token-keyed join for chains that are not dense; dense scenes use windows.
    """
    own = frames.select("token", "scene_token", "prev", "next")
    other = frames.select(F.col("token").alias("t"), F.col("scene_token").alias("s"))
    links = own.select("token", "scene_token", F.explode(F.array(
        F.struct(F.lit("prev").alias("way"), F.col("prev").alias("t")),
        F.struct(F.lit("next").alias("way"), F.col("next").alias("t")))).alias("l")).select("token", "scene_token", "l.way", "l.t")
    good = links.filter("t <> ''").join(other, "t").filter("s = scene_token")
    per = good.groupBy("token").agg(
        F.max(F.when(F.col("way") == "prev", F.col("t"))).alias("prev"),
        F.max(F.when(F.col("way") == "next", F.col("t"))).alias("next"))
    return own.select("token").join(per, "token", "left")


def assign_split(frames: DataFrame, splits: DataFrame, val_name: str = "test") -> DataFrame:
    """Only ``val_name`` goes to val; everything else, unknown episodes too, is train."""
    joined = frames.drop("split").join(
        splits.select("scene_token", F.col("split").alias("_s"), F.lit(True).alias("_known")), "scene_token", "left")
    return joined.withColumn("split", F.when(F.col("_s") == val_name, "val").otherwise("train")).withColumn(
        "known", F.coalesce("_known", F.lit(False))).drop("_s", "_known")


def instance_index(boxes: DataFrame, offset: int = 0) -> DataFrame:
    """Dense index of every instance in (scene, actor) order."""
    dim = boxes.select("scene_token", "instance_token").distinct()
    return ordinal(dim, ["scene_token", "instance_token"], "_i", bucket=F.struct("scene_token")).withColumn(
        "index", F.col("_i") + offset).drop("_i")


# ---- strings and fields ----------------------------------------------------------------

def rebase_path(path: Column, root: str) -> Column:
    """Everything up to the last ``raw/`` becomes ``root``; without it the path stays."""
    return F.when(path.contains("raw/"), F.regexp_replace(path, r"^.*raw/", f"{root}/")).otherwise(path)


def swap_strings(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace ``old`` by ``new`` in every string of the schema, nested ones included."""
    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return F.replace(c, F.lit(old), F.lit(new))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, x: walk(x, t.valueType))
        if isinstance(t, T.StructType):
            inner = F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in t.fields])
            return F.when(c.isNotNull(), inner)
        return c

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def patch_missing(df: DataFrame) -> DataFrame:
    """Fill absent sensor stubs and counts; running it twice changes nothing."""
    defaults = {
        "lidar_path": F.lit(""),
        "sweeps": F.array().cast("array<string>"),
        "lidar2ego_rotation": F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]),
        "lidar2ego_translation": F.array(*[F.lit(0.0)] * 3),
        "num_lidar_pts": F.array().cast("array<int>"),
    }
    return df.withColumns({
        n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in defaults.items()})


# ---- sets --------------------------------------------------------------------------------

def union_rounds(parts: dict[str, DataFrame]) -> DataFrame:
    """Base and round files together, each row with the name of its file."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys only one side has, with an example of each."""
    l = left.select(key).distinct().withColumn("_l", F.lit(1))
    r = right.select(key).distinct().withColumn("_r", F.lit(1))
    only_l, only_r = F.col("_r").isNull(), F.col("_l").isNull()
    return l.join(r, key, "full").agg(
        F.count_if(only_l).alias("only_left"), F.count_if(only_r).alias("only_right"),
        F.min(F.when(only_l, F.col(key))).alias("left_example"), F.min(F.when(only_r, F.col(key))).alias("right_example"))


def split_audit(frames: DataFrame) -> DataFrame:
    """Frames, episodes and slots per split, and slots that occur in another split too.

    Scenes are counted by split and slots by (split, slot) pairs, so no row of a scene is joined on a slot number.
    """
    scenes = frames.groupBy("split", "scene_token").agg(F.count(F.lit(1)).alias("n"))
    size = scenes.groupBy("split").agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("episodes"))
    pairs = frames.select("split", "slot_idx").distinct().filter(F.col("slot_idx").isNotNull())
    splits = pairs.groupBy("slot_idx").agg(F.collect_set("split").alias("splits"))
    slots = splits.select(F.explode("splits").alias("split"), (F.size("splits") > 1).alias("_shared")).groupBy("split").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if("_shared").alias("shared_slots"))
    return size.join(slots, "split", "left").na.fill(0, ["slots", "shared_slots"])
