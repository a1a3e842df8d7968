"""Queries that write files in the shared folder and read them back by the real readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kerbside.plans.queries_maps import vertices
from kerbside.plans.queries_text import output_lines
from kerbside.plans.registry import query
from kerbside.session import shared_folder
from kerbside.sources import episodes as eps
from kerbside.sources import predictions as src


def _folder(v) -> str:
    return f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"


@query("a2_frames_files", "SELECT token, split, frame_idx, 'v1.0' AS version FROM frames")
def a2_files(v):
    path = _folder(v)
    eps.write_frames(v.frames.select("token", "scene_token", "split", "frame_idx"), path, "v1.0")
    return v.spark.read.parquet(path).select("token", "split", "frame_idx", "version")


@query("a4_prediction_files", "SELECT token, answer FROM preds")
def a4_files(v):
    path = _folder(v)
    # the reader takes the last row of a token in file order, so rows are laid out by position
    output_lines(v).repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(path)
    return src.read_predictions(v.spark, path).select("token", "answer")


@query("a5_versioned_output", """
SELECT 'frames' AS tbl, token, reverse FROM frames UNION ALL SELECT 'manifest', 'total ' || count(*), NULL FROM frames""")
def a5(v):
    path = _folder(v)
    rows = v.frames.select("token", "reverse")
    eps.write_new_version({"frames": rows}, rows.agg(F.concat(F.lit("total "), F.count(F.lit(1))).alias("token")), path)
    back = v.spark.read.schema("token string, reverse boolean").json(f"{path}/frames").select(F.lit("frames").alias("tbl"), "token", "reverse")
    total = v.spark.read.schema("token string").json(f"{path}/manifest").select(F.lit("manifest").alias("tbl"), "token", F.lit(None).cast("boolean").alias("reverse"))
    return back.unionByName(total)


@query("a6_conversation_files", "SELECT conv_id, turn, role, text, conv_id % 2 AS source_pos FROM conversations")
def a6(v):
    path = _folder(v)
    rows = v.table("conversations").select("conv_id", "turn", "role", "text")
    for i, name in enumerate("ab"):
        rows.filter(F.col("conv_id") % 2 == i).write.json(f"{path}/talk_{name}.jsonl")
    back = eps.read_conversations(v.spark, f"{path}/talk_{{a,b}}.jsonl", "conv_id long, turn long, role string, text string")
    return back.withColumn("source_pos", F.col("source_pos").cast("long"))


@query("a7_source_manifest", """
SELECT conv_id, turn, role, conv_id % 4 AS source_pos FROM conversations WHERE conv_id % 4 < 3""")
def a7(v):
    """A base file and rounds 2 and 10, which come in the order of their numbers; a file of another name is none of them."""
    path = _folder(v)
    rows = v.table("conversations").select("conv_id", "turn", "role")
    for i, name in enumerate(("talk.jsonl", "dagger_r2.jsonl", "dagger_r10.jsonl", "notes.jsonl")):
        rows.filter(F.col("conv_id") % 4 == i).write.json(f"{path}/{name}")
    back = eps.read_sources(v.spark, path, "talk.jsonl", "conv_id long, turn long, role string")
    return back.withColumn("source_pos", F.col("source_pos").cast("long"))


@query("a9_map_file", """
SELECT CASE layer WHEN 'lanes' THEN 'aisle_lines' ELSE layer END AS layer, record::BIGINT AS record, vertex::BIGINT AS vertex, x, y FROM map_vertices""")
def a9(v):
    path = _folder(v)
    at = F.struct("vertex", F.array("x", "y").alias("p"))
    rings = vertices(v).groupBy("layer", "record").agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["p"]).alias("polygon"))
    by_layer = rings.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("record", "polygon"))), lambda s: s["polygon"]).alias("g"))
    take = lambda layer: F.first(F.when(F.col("layer") == layer, F.col("g")), ignorenulls=True)
    # a lot is one document: its size follows the lot, not the frames
    doc = by_layer.agg(take("parking_slots").alias("s"), take("drivable_area").alias("d"), take("lanes").alias("l"))
    doc.select(F.transform("s", lambda g: F.struct(g.alias("polygon"))).alias("parking_slots"),
               F.struct(F.get("d", F.lit(0)).alias("polygon")).alias("drivable_area"), F.col("l").alias("aisle_lines")).coalesce(1).write.json(path)
    return eps.read_map(v.spark, path).select("layer", F.col("record").cast("long").alias("record"), F.col("vertex").cast("long").alias("vertex"), "x", "y")


@query("a11_rank_files", "SELECT token, frame_idx % 3 AS rank, frame_idx AS answer FROM frames")
def a11(v):
    """Ranks 0 and 2 write lines, rank 1 an array for each scene; rank 3 has written nothing."""
    path = _folder(v)
    rows = v.frames.select("scene_token", "token", (F.col("frame_idx") % 3).alias("rank"), F.to_json(F.struct(F.col("token").alias("id"), F.col("frame_idx").alias("answer"))).alias("value"))
    rows.filter("rank <> 1").select(F.concat(F.lit("out_rank"), "rank").alias("part"), "value").write.partitionBy("part").text(path)
    arrays = rows.filter("rank = 1").groupBy("scene_token").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.text(f"{path}/out_rank1")
    back = src.read_rank_outputs(v.spark, path)
    return back.select(F.get_json_object("value", "$.id").alias("token"), F.col("rank").cast("long").alias("rank"), F.get_json_object("value", "$.answer").cast("long").alias("answer"))
