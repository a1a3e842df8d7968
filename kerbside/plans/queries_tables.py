"""Queries for sources, relational export, joins, sampling, sets and profiles (A, D, F22-F27, N, S, J9, J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import objects as ob, profiles, relational as rel, sampling, training, windows
from kerbside.plans.oracle_views import forward_of, hyp, r6 as s6, register, right_of, wrap
from kerbside.plans.queries_windows import annotations  # noqa: F401  (registers views used below)
from kerbside.plans.registry import query, r6
from kerbside.sources import episodes as eps


# ---- sources ----------------------------------------------------------------------------

def episode_lines(v):
    """Raw episode rows as JSON text: metadata per episode and one row per pose."""
    raw = v.raw_frames
    meta = raw.filter("has_meta").select("scene_token", "split", "slot_idx").distinct().select(
        F.col("scene_token").alias("episode"), F.to_json(F.struct(
            F.col("scene_token").alias("episode_id"),
            F.struct("split", "slot_idx").alias("collection_config"))).alias("value"))
    poses = raw.select(F.col("scene_token").alias("episode"), F.col("frame_idx").alias("pos"), F.to_json(F.struct(
        "x_world", "y_world", F.lit(0.0).alias("z_world"), "yaw_deg", "vx_world", "vy_world", "speed_ms",
        F.col("yaw_rate").alias("yaw_rate_rads"), F.col("steer").alias("steer_normalized"),
        F.when(F.col("reverse"), F.lit(True)).alias("reverse"), F.col("ts_us").alias("timestamp_us"))).alias("value"))
    return meta, poses


@query("a1_read_episodes", """
SELECT token, split, slot_idx, x_world, y_world, speed_ms, reverse FROM raw_frames WHERE has_meta""")
def a1(v):
    meta, poses = episode_lines(v)
    f = eps.assemble(eps.parse_meta(meta), eps.parse_poses(poses))
    return f.select("token", "split", "slot_idx", "x_world", "y_world", "speed_ms", "reverse")


@query("a2_frames_table", """
SELECT split, count(*) AS n, count(DISTINCT scene_token) AS scenes, min(token) AS first_token FROM frames GROUP BY split""")
def a2(v):
    return v.frames.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scene_token").alias("scenes"), F.min("token").alias("first_token"))


@query("a3_relational_export", """
SELECT * FROM (SELECT 'sensor' AS tbl, 7::BIGINT AS n UNION ALL SELECT 'calibrated_sensor', 7 UNION ALL SELECT 'category', 10
UNION ALL SELECT 'visibility', 4 UNION ALL SELECT 'attribute', 0
UNION ALL SELECT 'scene', count(DISTINCT scene_token) FROM frames UNION ALL SELECT 'log', count(DISTINCT scene_token) FROM frames
UNION ALL SELECT 'map', count(DISTINCT scene_token) FROM frames UNION ALL SELECT 'sample', count(*) FROM frames
UNION ALL SELECT 'sample_data', count(*)*7 FROM frames UNION ALL SELECT 'ego_pose', count(*) FROM frames
UNION ALL SELECT 'instance', count(DISTINCT (scene_token, actor_id)) FROM gt_boxes UNION ALL SELECT 'sample_annotation', count(*) FROM gt_boxes)""")
def a3(v):
    out = None
    for name, df in rel.relational_tables(v.frames, v.gt_boxes).items():
        part = df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a3_sample_annotation", f"""
SELECT 'ann_' || scene_token || '_' || actor_id || printf('_%04d', frame_idx) AS token, token AS sample_token,
  'inst_' || scene_token || '_' || actor_id AS instance_token, {s6("cx")} AS cx, {s6("cy")} AS cy,
  coalesce('ann_' || scene_token || '_' || actor_id || printf('_%04d', lag(frame_idx) OVER w), '') AS prev,
  coalesce('ann_' || scene_token || '_' || actor_id || printf('_%04d', lead(frame_idx) OVER w), '') AS next
FROM annotations WINDOW w AS (PARTITION BY scene_token, actor_id ORDER BY frame_idx)""")
def a3_ann(v):
    t = rel.sample_annotation_table(v.gt_boxes, v.frames)
    return t.select("token", "sample_token", "instance_token", r6("cx").alias("cx"), r6("cy").alias("cy"), "prev", "next")


@query("a3_sample_data", """
SELECT 'sd_' || channel || '_' || token AS token, token AS sample_token, 'ep_' || token AS ego_pose_token,
  coalesce('sd_' || channel || '_' || lag(token) OVER w, '') AS prev, coalesce('sd_' || channel || '_' || lead(token) OVER w, '') AS next
FROM frames CROSS JOIN (SELECT camera AS channel FROM rig UNION ALL SELECT 'LIDAR_TOP')
WINDOW w AS (PARTITION BY scene_token, channel ORDER BY frame_idx)""")
def a3_sd(v):
    return rel.sample_data_table(v.frames).select("token", "sample_token", "ego_pose_token", "prev", "next")


@query("a8_missing_detections", """
SELECT count(*) AS frames, count(*) FILTER (WHERE n IS NULL) AS missing, coalesce(sum(n), 0)::BIGINT AS detections
FROM frames LEFT JOIN (SELECT token, count(*) AS n FROM detections GROUP BY token) USING (token)""")
def a8(v):
    per = v.detections.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return v.frames.select("token").join(per, "token", "left").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n").isNull()).alias("missing"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("detections"))


@query("a10_every_third_by_time", """
SELECT token FROM (SELECT token, row_number() OVER (ORDER BY ts_us, token) - 1 AS pos FROM frames) WHERE pos % 3 = 0""")
def a10(v):
    return sampling.every_kth(v.frames.select("token", "ts_us"), 3, bucket_us=2_000_000).select("token")


# ---- paths and fields --------------------------------------------------------------------

_PATH_SQL = "CASE event_id % 3 WHEN 0 THEN '/old/raw/x/raw/' WHEN 1 THEN 'data/raw/' ELSE 'img/' END || token || '/CAM_FRONT.jpg'"


@query("b24_rebase_paths", f"""
SELECT token, CASE WHEN contains(p, 'raw/') THEN '/new/' || regexp_replace(p, '^.*raw/', '') ELSE p END AS path,
  replace(p, '/old/', '/moved/') AS swapped FROM (SELECT token, {_PATH_SQL} AS p FROM frames)""")
def b24(v):
    e = F.col("event_id") % 3
    head = F.when(e == 0, "/old/raw/x/raw/").when(e == 1, "data/raw/").otherwise("img/")
    df = v.frames.select("token", F.concat(head, "token", F.lit("/CAM_FRONT.jpg")).alias("p"))
    nested = df.select("token", "p", F.array(F.struct(F.col("p").alias("data_path"))).alias("cams"))
    moved = rel.swap_strings(nested, "/old/", "/moved/")
    return moved.select("token", rel.rebase_path(F.replace("p", F.lit("/moved/"), F.lit("/old/")), "/new").alias("path"),
                        F.get("cams", F.lit(0))["data_path"].alias("swapped"))


@query("b25_patch_missing", """
SELECT token, CASE WHEN event_id % 2 = 0 THEN 'scan' ELSE '' END AS lidar_path, 1.0::DOUBLE AS rot_w, 0 AS n_sweeps FROM frames""")
def b25(v):
    df = v.frames.select("token", F.when(F.col("event_id") % 2 == 0, "scan").alias("lidar_path"))
    once = rel.patch_missing(df)
    return rel.patch_missing(once).select(
        "token", "lidar_path", F.get("lidar2ego_rotation", F.lit(0)).alias("rot_w"), F.size("sweeps").alias("n_sweeps"))


# ---- joins --------------------------------------------------------------------------------

@query("d1_episode_attributes", "SELECT token, maneuver_type, side FROM slot_frames")
def d1(v):
    return v.frames.select("token", "scene_token").join(
        v.scenes.select("scene_token", "maneuver_type", "side"), "scene_token").select("token", "maneuver_type", "side")


@query("d2_assign_split", """
SELECT token, CASE WHEN has_meta AND split = 'test' THEN 'val' ELSE 'train' END AS split, has_meta AS known FROM frames""")
def d2(v):
    splits = v.frames.filter("has_meta").select("scene_token", "split").distinct()
    return rel.assign_split(v.frames, splits).select("token", "split", "known")


@query("d3_sample_pose", "SELECT token AS sample_token, gx AS x, gy AS y FROM frames")
def d3(v):
    t = rel.relational_tables(v.frames, v.gt_boxes)
    return rel.sample_poses(t["sample"], t["sample_data"], t["ego_pose"]).select("sample_token", "x", "y")


_BY = "PARTITION BY scene_token ORDER BY frame_idx"


@query("d4_same_scene_neighbours", f"SELECT token, lag(token) OVER ({_BY}) AS prev, lead(token) OVER ({_BY}) AS next FROM frames")
def d4(v):
    return rel.same_scene_neighbours(windows.token_chain(v.frames)).select("token", "prev", "next")


def _index(v):
    files = v.frames.filter("event_id % 50 <> 0").select("token", F.concat(F.lit("feat/"), "token", F.lit(".bin")).alias("path"))
    return training.stamp_features(training.conversation_index(v.frames), files)


@query("d8_stamp_feature_path", """
SELECT token AS sample_id, CASE WHEN event_id % 50 <> 0 THEN 'feat/' || token || '.bin' END AS feature_path FROM frames""")
def d8(v):
    return _index(v).select("sample_id", "feature_path")


def rounds(v):
    """Base and two cumulative rounds; together they hold every frame."""
    p = F.col("frame_idx") % 10
    f = v.frames.select("token", "scene_token", "frame_idx", "event_id", "ts_us")
    return {"base": f.filter((p != 1) & (p != 2)), "round_01": f.filter(p != 2), "round_02": f}


@query("d25_insert_only_merge", """
SELECT token, CASE frame_idx % 10 WHEN 1 THEN 'round_01' WHEN 2 THEN 'round_02' ELSE 'base' END AS source FROM frames""")
def d25(v):
    parts = {n: df.withColumn("source", F.lit(n)) for n, df in rounds(v).items()}
    merged = training.insert_only(training.insert_only(parts["base"], parts["round_01"], "token"), parts["round_02"], "token")
    return merged.select("token", "source")


@query("d26_reorder_to_reference", """
SELECT token AS sample_id, frame_idx, CASE WHEN event_id % 4 = 0 THEN 'present' END AS state FROM frames""")
def d26(v):
    ref = v.frames.select(F.col("token").alias("sample_id"), "frame_idx")
    samples = v.frames.filter("event_id % 4 = 0").select(F.col("token").alias("sample_id"), F.lit("present").alias("state"))
    return training.reorder_to(ref, samples)


@query("d27_instance_index", """
SELECT scene_token, instance_token, row_number() OVER (ORDER BY scene_token, instance_token) AS "index"
FROM (SELECT DISTINCT scene_token, instance_token FROM gt_boxes)""")
def d27(v):
    return rel.instance_index(v.gt_boxes, 1)


@query("j9_training_guards", """
SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 50 = 0) AS without_feature,
  min(token) FILTER (WHERE event_id % 50 = 0) AS feature_example, count(*) FILTER (WHERE split <> 'train') AS not_train,
  min(token) FILTER (WHERE split <> 'train') AS split_example FROM frames""")
def j9(v):
    return training.training_guards(_index(v))


@query("j10_category_counts", """
SELECT name, coalesce(n, 0) AS n FROM (SELECT unnest(['car','truck','construction_vehicle','bus','trailer','barrier','motorcycle','bicycle','pedestrian','traffic_cone']) AS name)
LEFT JOIN (SELECT category AS name, count(*) AS n FROM gt_boxes GROUP BY 1) USING (name)""")
def j10(v):
    per = rel.instance_table(v.gt_boxes).groupBy("category_token").agg(F.sum("nbr_annotations").alias("n"))
    cats = rel.category_table(v.spark).withColumnRenamed("token", "category_token")
    return cats.join(per, "category_token", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


# ---- sampling and sharding ------------------------------------------------------------------

def _keys(v):
    return v.frames.select("token", "scene_token", "frame_idx")


_POS = "(SELECT token, scene_token, frame_idx, row_number() OVER (ORDER BY scene_token, frame_idx) - 1 AS pos, count(*) OVER () AS n FROM frames)"


@query("n1_sampling_first_end", f"""
SELECT token, 'first' AS part FROM {_POS} WHERE pos < 100 UNION ALL SELECT token, 'end' FROM {_POS} WHERE pos >= n - 100""")
def n1(v):
    a = sampling.sample(_keys(v), "first:100").select("token", F.lit("first").alias("part"))
    return a.unionByName(sampling.sample(_keys(v), "end:100").select("token", F.lit("end").alias("part")))


@query("n1_sampling_random", """
SELECT token FROM (SELECT token, row_number() OVER (ORDER BY md5(token || ':3'), token) - 1 AS pos, count(*) OVER () AS n FROM frames)
WHERE pos < ceil(n*0.07::DOUBLE)""")
def n1_random(v):
    """A repeatable 7 percent sample."""
    return sampling.sample(_keys(v), "random:7%", seed=3).select("token")


register("scene_dim", """
SELECT scene_token, count(*) AS n, row_number() OVER (ORDER BY scene_token) - 1 AS pos, count(*) OVER () AS s FROM frames GROUP BY 1""")


@query("n2_episode_shard", """
SELECT token, CASE WHEN pos < (s % 4)*(s // 4 + 1) THEN pos // (s // 4 + 1)
  ELSE s % 4 + (pos - (s % 4)*(s // 4 + 1)) // (s // 4) END::INTEGER AS shard FROM frames JOIN scene_dim USING (scene_token)""")
def n2(v):
    return sampling.episode_shard(_keys(v), 4).select("token", "shard")


register("lpt", """
SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT scene_token, n, row_number() OVER (ORDER BY n DESC, scene_token) AS k FROM scene_dim),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS scene_token, NULL::INTEGER AS shard
 UNION ALL SELECT o.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.n ELSE x END),
   o.scene_token, (list_position(loads, list_min(loads)) - 1)::INTEGER FROM r JOIN o ON o.k = r.k + 1)
SELECT scene_token, shard FROM r WHERE k > 0)""")


@query("n3_balanced_shard", "SELECT scene_token, shard FROM lpt")
def n3(v):
    return sampling.balanced_shard(_keys(v), 3).select("scene_token", "shard").distinct()


@query("n4_contiguous_scenes", """
SELECT token, least(pos // (s // 4), 3)::INTEGER AS worker FROM frames JOIN scene_dim USING (scene_token)""")
def n4(v):
    return sampling.contiguous_scenes(_keys(v), 4).select("token", "worker")


@query("n5_scene_shuffle", """
SELECT token, row_number() OVER (ORDER BY md5(scene_token || ':8'), scene_token, frame_idx) - 1 AS pos FROM frames""")
def n5(v):
    return sampling.scene_shuffle(_keys(v), 7, 1).select("token", "pos")


@query("n6_padded_partition", f"""
SELECT token, pos + c*n AS slot, (pos + c*n) // (((n + 6) // 7*7) // 7) AS worker
FROM {_POS} CROSS JOIN range(0, 2) t(c) WHERE pos + c*n < (n + 6) // 7*7""")
def n6(v):
    return sampling.padded_partition(_keys(v), 7).select("token", "slot", F.col("worker").cast("long").alias("worker"))


_EPOCH = """(SELECT token, g, idx, idx // 3 AS b, n_full FROM (
  SELECT token, g, pos + c*n AS idx, ceil(n/15.0)::BIGINT*15 AS n_full FROM (
    SELECT token, split AS g, row_number() OVER (PARTITION BY split ORDER BY md5(token || ':6'), token) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM frames)
  CROSS JOIN range(0, 15) t(c)) WHERE idx < n_full)"""


@query("n6_grouped_partition", f"""
SELECT token, place*3 + idx % 3 AS slot, (place*3 + idx % 3) // (total // 5) AS worker FROM {_EPOCH} e
JOIN (SELECT g, b, row_number() OVER (ORDER BY md5(g || ':' || b || ':6'), g, b) - 1 AS place FROM (SELECT DISTINCT g, b FROM {_EPOCH})) USING (g, b)
CROSS JOIN (SELECT count(*) AS total FROM {_EPOCH})""")
def n6_grouped(v):
    """Batches of three of one split each for five workers, epoch 2 of seed 4."""
    f = v.frames.select("token", "split")
    return sampling.grouped_partition(f, "split", 5, 3, seed=4, epoch=2).select("token", F.col("slot").cast("long").alias("slot"), F.col("worker").cast("long").alias("worker"))


@query("n7_stride_and_even", f"""
SELECT token, 'stride' AS part FROM {_POS} WHERE pos % 13 = 0
UNION ALL SELECT token, 'even' FROM {_POS} WHERE pos IN (SELECT round_even(i*(SELECT count(*) - 1 FROM frames)/36.0::DOUBLE, 0)::BIGINT FROM range(0, 37) t(i))""")
def n7(v):
    stride = sampling.with_position(_keys(v)).filter("pos % 13 = 0").select("token", F.lit("stride").alias("part"))
    return stride.unionByName(sampling.evenly(_keys(v), 37).select("token", F.lit("even").alias("part")))


@query("n8_episode_in_order", """
SELECT token, frame_idx FROM frames WHERE scene_token = (SELECT min(scene_token) FROM frames)""")
def n8(v):
    first = v.frames.agg(F.min("scene_token")).scalar()
    return v.frames.filter(F.col("scene_token") == first).orderBy("frame_idx").select("token", "frame_idx")


@query("n9_global_running_sum", f"""
SELECT token, row_number() OVER (ORDER BY scene_token, frame_idx) - 1 AS pos,
  {s6("sum(speed_ms) OVER (ORDER BY scene_token, frame_idx ROWS UNBOUNDED PRECEDING)")} AS distance FROM frames""")
def n9(v):
    from kerbside.operators.ordered import running_sums

    pos = sampling.with_position(v.frames.select("token", "scene_token", "frame_idx", "speed_ms"))
    total = running_sums(pos, sampling.SCENE_ORDER, {"distance": "speed_ms"}, bucket=sampling.frame_bucket())
    return total.select("token", "pos", r6("distance").alias("distance"))


@query("f31_load_balance", f"""
SELECT min(n) AS min_load, max(n) AS max_load, {s6("avg(n)")} AS avg_load, {s6("(max(n) - min(n))/avg(n)*100")} AS imbalance_pct
FROM (SELECT least(pos // (s // 4), 3) AS worker, count(*) AS n FROM frames JOIN scene_dim USING (scene_token) GROUP BY 1)""")
def f31(v):
    r = sampling.load_balance(sampling.contiguous_scenes(_keys(v), 4))
    return r.select("min_load", "max_load", r6("avg_load").alias("avg_load"), r6("imbalance_pct").alias("imbalance_pct"))


@query("f4_shard_merge_check", """
SELECT count(*) AS episodes, sum(n)::BIGINT AS frames, sum(fb)::BIGINT AS fallbacks, 0::BIGINT AS shared_episodes, NULL::VARCHAR AS example,
  0 AS missing_shards, round(sum(fb)/sum(n)::DOUBLE, 4) AS fallback_rate
FROM (SELECT scene_token, count(*) AS n, count(*) FILTER (WHERE event_id % 43 = 0) AS fb FROM frames GROUP BY 1)""")
def f4(v):
    t = sampling.episode_shard(v.frames.select("token", "scene_token", "frame_idx", "event_id"), 4).withColumn(
        "teacher", F.when(F.col("event_id") % 43 == 0, "teacher_fallback_mock").otherwise("teacher"))
    return sampling.shard_report(t, 4)


# ---- sets --------------------------------------------------------------------------------------

@query("s1_rounds_union", """
SELECT source, count(*) AS n FROM (SELECT 'base' AS source FROM frames WHERE frame_idx % 10 NOT IN (1, 2)
 UNION ALL SELECT 'round_01' FROM frames WHERE frame_idx % 10 <> 2 UNION ALL SELECT 'round_02' FROM frames) GROUP BY 1""")
def s1(v):
    return rel.union_rounds(rounds(v)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("s2_new_keys", "SELECT token FROM frames WHERE frame_idx % 10 = 2")
def s2(v):
    r = rounds(v)
    return r["round_02"].join(r["round_01"], "token", "left_anti").select("token")


@query("s3_coverage_check", """
SELECT count(*) FILTER (WHERE d.token IS NULL) AS only_left, 0::BIGINT AS only_right, min(f.token) FILTER (WHERE d.token IS NULL) AS left_example,
  NULL::VARCHAR AS right_example FROM frames f LEFT JOIN (SELECT DISTINCT token FROM detections) d ON d.token = f.token""")
def s3(v):
    return rel.set_difference(v.frames, v.detections, "token")


@query("f22_split_audit", """
SELECT split, count(*) AS frames, count(DISTINCT scene_token) AS episodes, count(DISTINCT slot) AS slots, count(DISTINCT slot) FILTER (WHERE splits > 1) AS shared_slots
FROM (SELECT *, CASE WHEN user_id % 12 = 0 THEN slot_idx - 10 ELSE slot_idx END AS slot FROM frames)
JOIN (SELECT slot, count(DISTINCT split) AS splits FROM (SELECT split, CASE WHEN user_id % 12 = 0 THEN slot_idx - 10 ELSE slot_idx END AS slot FROM frames) GROUP BY slot) USING (slot)
GROUP BY split""")
def f22(v):
    """Every other test user parks in a slot that the training split has as well."""
    moved = F.when(F.col("user_id") % 12 == 0, F.col("slot_idx") - 10).otherwise(F.col("slot_idx"))
    return rel.split_audit(v.frames.withColumn("slot_idx", moved))


# ---- profiles --------------------------------------------------------------------------------------

_METRICS = {"speed": "speed_ms", "abs_steer": "abs(steer)", "dist_to_slot": s6(hyp("slot_r", "slot_f")), "abs_heading": "abs(slot_dh)"}


@query("f23_calibration", " UNION ALL ".join(
    f"SELECT '{n}' AS metric, {p}::DOUBLE AS share, {s6(f'quantile_cont({e}, {p})')} AS value FROM slot_frames"
    for n, e in _METRICS.items() for p in (0.1, 0.5, 0.9)) + f"""
UNION ALL SELECT 'reverse_share', NULL, {s6("avg(reverse::INTEGER)")} FROM frames
UNION ALL SELECT 'stopped_share', NULL, {s6("avg((speed_ms < 0.05)::INTEGER)")} FROM frames""")
def f23(v):
    return profiles.calibration(v.slot_frames).select("metric", "share", r6("value").alias("value"))


@query("f24_gear_changes", f"""
SELECT {s6("avg(flips)")} AS mean_flips, max(flips)::BIGINT AS max_flips, sum(toggles)::BIGINT AS toggles, min(n) AS min_length, max(n) AS max_length,
  {s6("quantile_cont(n, 0.5)")} AS median_length
FROM (SELECT scene_token, count(*) AS n, count(*) FILTER (WHERE p <> reverse) AS flips, count(*) FILTER (WHERE p <> reverse AND x <> reverse) AS toggles
  FROM (SELECT *, lag(reverse) OVER ({_BY}) AS p, lead(reverse) OVER ({_BY}) AS x FROM frames) GROUP BY 1)""")
def f24(v):
    s = profiles.gear_summary(profiles.gear_changes(v.frames))
    return s.select(r6("mean_flips").alias("mean_flips"), F.col("max_flips").cast("long").alias("max_flips"), "toggles",
                    "min_length", "max_length", r6("median_length").alias("median_length"))


register("endings", f"""
SELECT scene_token, {s6("abs(" + forward_of("gx", "gy", "slot_x", "slot_y", "slot_yaw") + ")")} AS depth,
  {s6("abs(" + right_of("gx", "gy", "slot_x", "slot_y", "slot_yaw") + ")")} AS side_off, {s6("abs(" + wrap("gyaw - slot_yaw") + ")")} AS heading
FROM (SELECT scene_token, arg_max(gx, frame_idx) AS gx, arg_max(gy, frame_idx) AS gy, arg_max(gyaw, frame_idx) AS gyaw FROM frames GROUP BY 1)
JOIN scenes USING (scene_token)""")


@query("f25_end_alignment", f"""
SELECT 'heading' AS metric, {s6("quantile_cont(heading, 0.95)")} AS value FROM endings
UNION ALL SELECT 'depth', {s6("quantile_cont(depth, 0.99)")} FROM endings
UNION ALL SELECT 'lateral', {s6("quantile_cont(side_off, 0.9)")} FROM endings
UNION ALL SELECT 'beyond_slack', {s6("avg((side_off > 0.6)::INTEGER)")} FROM endings""")
def f25(v):
    e = profiles.end_alignment(v.frames, v.scenes)
    e = e.select(*[r6(n).alias(n) for n in ("heading", "depth", "lateral")])
    out = e.agg(F.lit("beyond_slack").alias("metric"), F.avg((F.col("lateral") > 0.6).cast("double")).alias("value"))
    for name, share in (("heading", 0.95), ("depth", 0.99), ("lateral", 0.9)):
        out = out.unionByName(profiles.exact_percentiles(e, name, [share]).select(F.lit(name).alias("metric"), "value"))
    return out.select("metric", r6("value").alias("value"))


@query("f26_nearest_agents", f"""
SELECT token, rank, obj_pos, cls, round(dist, 2) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY dist, obj_pos) AS rank
FROM (SELECT *, {hyp('"right"', 'forward')} AS dist FROM objects)) WHERE rank <= 5""")
def f26(v):
    return ob.nearest_agents(v.objects, 5).select("token", "rank", "obj_pos", "cls", F.round("dist", 2).alias("dist"))


@query("f27_linear_probe")
def f27(v):
    """Episode-grouped probe on the embeddings; ten vectors stand for one episode."""
    from pyspark.ml.functions import array_to_vector

    e = v.table("embeddings").select("vec_id", "label", F.format_string(
        "ep_%04d", F.floor(F.col("vec_id") / 10)).alias("scene_token"), array_to_vector("embedding").alias("features"))
    folds = profiles.probe_folds(e.select("scene_token").distinct(), 3)
    p = profiles.linear_probe(e.join(folds, "scene_token"), 3, 10)
    return p.select("fold", "n", r6("accuracy").alias("accuracy"), r6("majority").alias("majority"), r6("chance").alias("chance"))


@query("f32_evaluated_ratio", f"""
SELECT count(d.token) AS evaluated, count(*) AS frames, {s6("count(d.token)/count(*)::DOUBLE")} AS ratio
FROM frames f LEFT JOIN (SELECT DISTINCT token FROM detections) d ON d.token = f.token""")
def f32(v):
    seen = v.detections.select("token", F.lit(1).alias("hit")).distinct()
    return v.frames.select("token").join(seen, "token", "left").agg(
        F.count("hit").alias("evaluated"), F.count(F.lit(1)).alias("frames")).select(
        "evaluated", "frames", r6(F.col("evaluated") / F.col("frames")).alias("ratio"))
