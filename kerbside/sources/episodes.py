"""Raw simulator episodes and other input folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE = ("x_world double, y_world double, z_world double, yaw_deg double, vx_world double, vy_world double, "
        "speed_ms double, yaw_rate_rads double, steer_normalized double, reverse boolean, timestamp_us long")
META = ("episode_id string, slot struct<width_m:double,length_m:double>, maneuver_type string, side string, "
        "collection_config struct<split:string,slot_idx:long,weather:string,occupancy:double>")
ACTORS = ("frame_idx long, actors array<struct<id:long,type_id:string,category:string,world_center:array<double>,"
          "yaw_deg:double,size_lwh:array<double>,velocity:array<double>>>")


def parse_meta(lines: DataFrame) -> DataFrame:
    """(episode, value) JSON metadata -> one row per episode."""
    return lines.select("episode", F.from_json("value", META).alias("m")).select(
        "episode", "m.maneuver_type", "m.side", "m.slot",
        F.col("m.collection_config.split").alias("split"), F.col("m.collection_config.slot_idx").alias("slot_idx"))


def parse_poses(lines: DataFrame) -> DataFrame:
    """(episode, pos, value) JSON poses; a missing gear flag counts as forward."""
    p = lines.select("episode", F.col("pos").alias("frame_idx"), F.from_json("value", POSE).alias("p"))
    return p.select("episode", "frame_idx", "p.*").withColumn("reverse", F.coalesce("reverse", F.lit(False)))


def assemble(meta: DataFrame, poses: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """One row per pose of the episodes that have both files; actors are optional."""
    f = poses.join(meta, "episode").withColumns({
        "scene_token": F.col("episode"),
        "token": F.concat("episode", F.format_string("_f%04d", "frame_idx"))})
    if actors is not None:
        f = f.join(actors, ["episode", "frame_idx"], "left")
    return f


def read_episodes(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Folders ``episode_*`` with meta.json, poses.json and maybe actors.json."""
    episode = F.regexp_extract(F.col("_metadata.file_path"), r"/(episode_[^/]+)/", 1)

    def load(name: str, schema: str) -> DataFrame:
        return (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", name).json(raw_dir).select(episode.alias("episode"), "*"))

    meta = load("meta.json", META).select(
        "episode", "maneuver_type", "side", "slot",
        F.col("collection_config.split").alias("split"), F.col("collection_config.slot_idx").alias("slot_idx"))
    # the file is one JSON array, so the position in the array is the frame index
    text = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "poses.json").text(raw_dir))
    poses = text.select(episode.alias("episode"), F.posexplode(F.from_json("value", f"array<struct<{_ddl(POSE)}>>")).alias("frame_idx", "p"))
    poses = poses.select("episode", F.col("frame_idx").cast("long").alias("frame_idx"), "p.*").withColumn(
        "reverse", F.coalesce("reverse", F.lit(False)))
    return assemble(meta, poses, load("actors.json", ACTORS))


def _ddl(columns: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (c.split() for c in columns.split(", ")))


def write_frames(frames: DataFrame, path: str, version: str) -> None:
    """Parquet partitioned by split, rows of a scene together (a long one in several files); the version is a column."""
    (frames.withColumn("version", F.lit(version)).repartitionByRange("split", "scene_token", "frame_idx")
     .sortWithinPartitions("scene_token", "frame_idx").write.partitionBy("split").mode("overwrite").parquet(path))


def write_new_version(tables: dict[str, DataFrame], manifest: DataFrame, out: str) -> None:
    """Refuses an existing output; the manifest comes last, so its presence means done."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{out}/{name}")
    manifest.write.mode("errorifexists").json(f"{out}/manifest")


def read_conversations(spark: SparkSession, spec: str | list[dict], schema: str) -> DataFrame:
    """One json or jsonl file, a brace list ``base{a,b}.json``, or a list of
    {path, strategy} entries; rows keep the position of their file."""
    from kerbside.operators.sampling import sample

    if isinstance(spec, str):
        m = re.fullmatch(r"(.*)\{([^}]*)\}(\.jsonl?)", spec)
        entries = [{"path": f"{m.group(1)}{x}{m.group(3)}"} for x in m.group(2).split(",")] if m else [{"path": spec}]
    else:
        entries = spec
    out = None
    for i, entry in enumerate(entries):
        path = entry["path"]
        if not re.search(r"\.jsonl?$", path):
            raise ValueError(f"unsupported conversation file: {path}")
        rows = spark.read.schema(schema).option("multiLine", str(path.endswith(".json")).lower()).json(path)
        if entry.get("strategy", "all") != "all":
            rows = sample(rows, entry["strategy"], entry.get("seed", 0))
        rows = rows.withColumn("source_pos", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def source_manifest(spark: SparkSession, folder: str, base: str, pattern: str = r"dagger_r(\d+)") -> DataFrame:
    """Base file first, then round files by number (path, length, name, round); fails when there is none.

    A source is one JSON file or a folder of such parts that has the name of one.  Only the listing is read, no content.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").option("recursiveFileLookup", "true").load(folder)
             .select(F.regexp_replace("path", r"(\.jsonl?)/[^/]+$", "$1").alias("path"), "length"))
    files = files.groupBy("path").agg(F.sum("length").alias("length")).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    number = F.regexp_extract("name", pattern, 1)
    listed = files.filter((F.col("name") == base) | (number != "")).withColumn(
        "round", F.when(F.col("name") == base, -1).otherwise(number.try_cast("int")))
    if listed.isEmpty():
        raise FileNotFoundError(f"no conversation files under {folder}")
    return listed.orderBy("round")


def read_sources(spark: SparkSession, folder: str, base: str, schema: str, strategy: str = "all", seed: int = 0) -> DataFrame:
    """Rows of the sources of a manifest, all sampled by one rule; ``source_pos`` is the place of a source in it."""
    # one small row for each round
    spec = [{"path": r.path, "strategy": strategy, "seed": seed} for r in source_manifest(spark, folder, base).collect()]
    return read_conversations(spark, spec, schema)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Lot geometry -> (layer, record, vertex, x, y) rows."""
    point = "array<array<double>>"
    schema = f"parking_slots array<struct<polygon:{point}>>, drivable_area struct<polygon:{point}>, aisle_lines array<{point}>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    layers = [
        doc.select(F.lit("parking_slots").alias("layer"), F.posexplode("parking_slots").alias("record", "g")).select(
            "layer", "record", F.col("g.polygon").alias("pts")),
        doc.select(F.lit("drivable_area").alias("layer"), F.lit(0).alias("record"), F.col("drivable_area.polygon").alias("pts")),
        doc.select(F.lit("aisle_lines").alias("layer"), F.posexplode("aisle_lines").alias("record", "pts")),
    ]
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return rows.select("layer", "record", F.posexplode("pts").alias("vertex", "p")).select(
        "layer", "record", "vertex", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
