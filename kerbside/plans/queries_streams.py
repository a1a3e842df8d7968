"""Queries for the stream jobs (L1-L4); streams run over stage tables with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kerbside.plans.oracle_views import register
from kerbside.plans.queries_tables import rounds
from kerbside.plans.registry import query
from kerbside.session import shared_folder
from kerbside.streaming import jobs, tracker
from kerbside.streaming.rounds import Rounds


#: The derived frames count time from zero; streams need real event times.
START_US = 1_700_000_000_000_000


def _work(v) -> str:
    return f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"


def _as_stream(v, df, folder: str):
    df.write.mode("overwrite").parquet(folder)
    return jobs.read_stream(v.spark, folder, df.schema)


@query("l1_round_ingest", "SELECT token FROM frames")
def l1(v):
    work = _work(v)
    table = f"{work}/table"
    for name, df in rounds(v).items():
        df.select("token", "scene_token", "frame_idx").write.mode("overwrite").parquet(f"{work}/in/{name}")
        # each round arrives after the one before it; the checkpoint remembers what was read
        stream = jobs.read_stream(v.spark, f"{work}/in", "token string, scene_token string, frame_idx long")
        jobs.ingest_rounds(stream, "token", table, f"{work}/checkpoint")
    return v.spark.read.parquet(table).select("token")


class _Crash(Exception):
    """A driver that is lost between two writes."""


def versioned(v) -> Rounds:
    """Three cumulative rounds; the second is lost before its pointer and run again, the third is run twice."""
    class Lost(Rounds):
        def _commit(self, number, parent):
            raise _Crash

    schema = "token string, scene_token string, frame_idx long"
    parts = list(rounds(v).values())
    root = f"{_work(v)}/rounds"
    store = Rounds(v.spark, root, schema, version="v1.0-lot")
    store.ingest(0, parts[0])
    try:
        Lost(v.spark, root, schema, version="v1.0-lot").ingest(1, parts[1].limit(5))
    except _Crash:
        pass
    store.ingest(1, parts[1])
    store.ingest(2, parts[2])
    store.ingest(2, parts[2].limit(5))
    return store


_ROUND = "CASE frame_idx % 10 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"


@query("l1_versioned_rounds", f"SELECT token, frame_idx, {_ROUND}::INTEGER AS round, 'v1.0-lot' AS version FROM frames")
def l1_versioned(v):
    return versioned(v).read().select("token", "frame_idx", "round", "version")


@query("l1_round_snapshots", f"""
SELECT s.round::INTEGER AS round, count(*) AS rows, count(*) FILTER (WHERE {_ROUND} = s.round) AS added, count(*) FILTER (WHERE {_ROUND} = s.round) AS tokens
FROM range(0, 3) s(round) JOIN frames ON {_ROUND} <= s.round GROUP BY s.round""")
def l1_snapshots(v):
    """Every snapshot with its rows, its new-only table and its token list."""
    store, out = versioned(v), None
    for p in store.pointers():
        n = p["round"]
        one = store.read(as_of=n).agg(F.count(F.lit(1)).alias("rows")).crossJoin(store.new(n).agg(F.count(F.lit(1)).alias("added"))).crossJoin(
            store.tokens(n).agg(F.count(F.lit(1)).alias("tokens"))).select(F.lit(n).alias("round"), "rows", "added", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query("l2_gear_change_events", """
SELECT token, reverse FROM (SELECT *, lag(reverse) OVER (PARTITION BY scene_token ORDER BY frame_idx) AS p
  FROM (SELECT token, scene_token, frame_idx, (frame_idx = 0) <> reverse AS reverse FROM frames)) WHERE p <> reverse""")
def l2(v):
    work = _work(v)
    # from frame 20 of a scene on there is a pause of a minute
    pause = F.when(F.col("frame_idx") >= 20, 60_000_000).otherwise(0)
    f = v.frames.select("scene_token", "frame_idx", "token", ((F.col("frame_idx") == 0) != F.col("reverse")).alias("reverse"),
                        (F.col("ts_us") + START_US + pause).alias("ts_us"))
    events = jobs.gear_change_events(_as_stream(v, f, f"{work}/in"))
    jobs.run_to_end(events, f"{work}/out", f"{work}/checkpoint")
    return v.spark.read.schema(events.schema).parquet(f"{work}/out").select("token", "reverse")


register("track_rows", """
SELECT scene_token, det_pos AS slot, frame_idx, score, count(*) FILTER (WHERE score >= 0.5) OVER w AS strong_n, count(*) FILTER (WHERE score < 0.4) OVER w AS weak_n
FROM detections WINDOW w AS (PARTITION BY scene_token, det_pos ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""")
register("track_state", """
SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT scene_token, slot, frame_idx, score, row_number() OVER (PARTITION BY scene_token, slot ORDER BY frame_idx) AS k FROM track_rows),
r AS (SELECT DISTINCT scene_token, slot, 0::BIGINT AS k, NULL::BIGINT AS frame_idx, false AS alive, 0 AS misses, false AS birth FROM o
 UNION ALL SELECT r.scene_token, r.slot, o.k, o.frame_idx,
   CASE WHEN o.score >= 0.5 THEN true WHEN r.alive AND o.score < 0.4 AND r.misses + 1 >= 5 THEN false ELSE r.alive END,
   CASE WHEN o.score >= 0.5 THEN 0 WHEN r.alive AND o.score < 0.4 THEN r.misses + 1 ELSE r.misses END,
   o.score >= 0.5 AND NOT r.alive
 FROM r JOIN o ON o.scene_token = r.scene_token AND o.slot = r.slot AND o.k = r.k + 1)
SELECT *, sum(birth::INTEGER) OVER (PARTITION BY scene_token, slot ORDER BY frame_idx) AS birth_n FROM r WHERE k > 0)""")


@query("l3_track_lifecycle", """
SELECT scene_token, slot, frame_idx, track_id, misses::BIGINT AS misses FROM track_state JOIN (
  SELECT scene_token, slot, birth_n, row_number() OVER (PARTITION BY scene_token ORDER BY frame_idx, slot) - 1 AS track_id FROM track_state WHERE birth)
USING (scene_token, slot, birth_n) WHERE alive""")
def l3(v):
    return jobs.track_lifecycle(v.detections.select("scene_token", F.col("det_pos").alias("slot"), "frame_idx", "score"))


#: Overlap above which a strong box beside a living track is no birth.
VETO = 0.1
_SIDES = ", ".join(f"{v} {sign} CASE WHEN abs(yaw - floor(yaw/pi() + 0.5)*pi()) > pi()/4 THEN {a} ELSE {b} END/2 AS {v}{n}"
                   for v, a, b in (("x", "w", "l"), ("y", "l", "w")) for n, sign in ((0, "-"), (1, "+")))
register("sided", f"""
SELECT scene_token, frame_idx, det_pos AS slot, score, row_number() OVER (PARTITION BY scene_token ORDER BY frame_idx, det_pos) AS k, {_SIDES} FROM detections""")
register("near_slots", f"""
SELECT scene_token, frame_idx, slot, list(other) AS near FROM (
  SELECT a.scene_token, a.frame_idx, a.slot, b.slot AS other, (a.x1 - a.x0)*(a.y1 - a.y0) + (b.x1 - b.x0)*(b.y1 - b.y0) AS area,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))*greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common
  FROM sided a JOIN sided b ON a.scene_token = b.scene_token AND a.frame_idx = b.frame_idx AND a.slot <> b.slot)
WHERE common/(area - common) > {VETO} GROUP BY ALL""")
register("vetoed_tracks", """
SELECT * FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT scene_token, frame_idx, slot, score, k, coalesce(near, []) AS near FROM sided LEFT JOIN near_slots USING (scene_token, frame_idx, slot)),
r AS (SELECT DISTINCT scene_token, 0::BIGINT AS k, NULL::BIGINT AS frame_idx, NULL::BIGINT AS slot, 0::BIGINT AS born,
    []::STRUCT(slot BIGINT, id BIGINT, misses BIGINT)[] AS living, NULL::STRUCT(slot BIGINT, id BIGINT, misses BIGINT) AS own FROM o
  UNION ALL
  SELECT scene_token, k, frame_idx, slot, born + CASE WHEN birth THEN 1 ELSE 0 END,
    CASE WHEN now IS NULL THEN others ELSE list_append(others, now) END, now
  FROM (SELECT *, CASE WHEN birth THEN {'slot': slot, 'id': born, 'misses': 0::BIGINT} WHEN t IS NULL THEN NULL
      WHEN score >= 0.5 THEN {'slot': slot, 'id': t.id, 'misses': 0::BIGINT} WHEN score >= 0.4 THEN t
      WHEN t.misses + 1 >= 5 THEN NULL ELSE {'slot': slot, 'id': t.id, 'misses': t.misses + 1} END AS now
    FROM (SELECT *, t IS NULL AND score >= 0.5 AND NOT list_has_any(near, list_transform(others, lambda l: l.slot)) AS birth
      FROM (SELECT o.scene_token, o.k, o.frame_idx, o.slot, o.score, o.near, r.born, list_filter(r.living, lambda l: l.slot = o.slot)[1] AS t,
        list_filter(r.living, lambda l: l.slot <> o.slot) AS others
        FROM r JOIN o ON o.scene_token = r.scene_token AND o.k = r.k + 1))))
SELECT scene_token, slot, frame_idx, own.id AS track_id, own.misses AS misses FROM r WHERE k > 0 AND own IS NOT NULL)""")


@query("l3_overlap_veto", "SELECT scene_token, slot, frame_idx, track_id, misses FROM vetoed_tracks")
def l3_veto(v):
    return tracker.tracked(tracker.with_sides(v.detections), VETO)


@query("l3_track_stream", "SELECT scene_token, slot, frame_idx, track_id, misses FROM vetoed_tracks")
def l3_stream(v):
    """The stream is stopped half-way through every scene and started again from its checkpoint."""
    work = _work(v)
    rows = tracker.with_sides(v.detections).withColumn("at", F.timestamp_micros(F.col("frame_idx") * 500_000 + START_US))
    half = v.frames.groupBy("scene_token").agg((F.max("frame_idx") / 2).alias("half"))
    groups = half.count() // 64 + 1
    parts = rows.join(half, "scene_token").withColumn("part", (F.col("frame_idx") > F.col("half")).cast("int")).drop("half")
    for part in (0, 1):
        parts.where(F.col("part") == part).drop("part").write.parquet(f"{work}/in/{part}")
        stream = jobs.read_stream(v.spark, f"{work}/in", rows.schema)
        tracker.run_tracker(v.spark, tracker.track_stream(stream, VETO, groups=groups), f"{work}/out", f"{work}/checkpoint")
    return v.spark.read.schema(tracker.OUT).parquet(f"{work}/out").where("not late").drop("late")


@query("l4_late_features", """
SELECT token, CASE WHEN event_id % 50 <> 0 AND event_id % 7 <> 0 THEN 'feat/' || token END AS path, event_id % 50 <> 0 AND event_id % 7 <> 0 AS complete FROM frames""")
def l4(v):
    """One row per conversation: with its feature if that came in time, else incomplete."""
    work = _work(v)
    c = v.frames.select("token", (F.col("ts_us") + START_US).alias("ts_us"))
    late = F.when(F.col("event_id") % 7 == 0, 20_000_000).otherwise(1_000_000)
    f = v.frames.filter("event_id % 50 <> 0").select("token", (F.col("ts_us") + START_US + late).alias("ts_us"), F.concat(F.lit("feat/"), "token").alias("path"))
    jobs.late_features_to_end(_as_stream(v, c, f"{work}/c"), _as_stream(v, f, f"{work}/f"), c, f"{work}/out", f"{work}/checkpoint")
    return v.spark.read.parquet(f"{work}/out").select("token", "path", "complete")
