"""Map geometry: points, patches, lanes and rasters.

Map layers are vertex tables (layer, record, vertex, x, y).  Point and patch questions
join on a coarse tile key, so a point only meets records whose box touches its tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import geom
from kerbside.operators import raster
from kerbside.operators.ordered import spread
from kerbside.operators.raster import codes as _codes, distinct

TILE = 8.0


def assemble(vertices: DataFrame) -> DataFrame:
    """(layer, record) -> ordered ring of points and bounds."""
    return vertices.groupBy("layer", "record").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("vertex", "x", "y"))),
                    lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def _tile(c: Column, tile: float = TILE) -> Column:
    return F.floor(c / tile)


def tiled(records: DataFrame, margin: float = 0.0, tile: float = TILE) -> DataFrame:
    """Each record once per tile its (widened) bounds touch; sx, sy name its first tile."""
    at = lambda c: _tile(c, tile)
    records = records.withColumns({"sx": at(F.col("min_x") - margin), "sy": at(F.col("min_y") - margin)})
    return records.withColumn("tx", F.explode(F.sequence(at(F.col("min_x") - margin), at(F.col("max_x") + margin)))).withColumn(
        "ty", F.explode(F.sequence(at(F.col("min_y") - margin), at(F.col("max_y") + margin))))


def once(x0: Column, y0: Column, tile: float = TILE) -> Column:
    """True in exactly one of the tiles a pair shares, so no later dedup is needed."""
    return (F.col("tx") == F.greatest(F.col("sx"), _tile(x0, tile))) & (F.col("ty") == F.greatest(F.col("sy"), _tile(y0, tile)))


# a tiled map side up to this many rows (tens of MB at most) is sent to every executor
BROADCAST_ROWS = 100_000


def map_side(records: DataFrame) -> DataFrame:
    """Tiled records, as ``small_side``."""
    return small_side(tiled(records))


def small_side(side: DataFrame) -> DataFrame:
    """``side``, broadcast only when a count shows that its rows are few; a larger map is joined by tile with a shuffle, where AQE splits
    the busy tiles.  Left to its estimates, Spark may send the frames around instead."""
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(side) if few else side.hint("merge")


def edges(ring: Column) -> Column:
    """Closed list of (a, b) edges."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd rule."""
    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > py) != (b["y"] > py)
        at = F.when(spans, (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return spans & F.coalesce(px < at, F.lit(False))

    return F.aggregate(edges(ring), F.lit(False), lambda acc, e: acc != crossing(e))


def _inside(px: Column, py: Column) -> Column:
    """Bounds first: the exact test then runs on the few records that can hold the point."""
    near = (px >= F.col("min_x")) & (px <= F.col("max_x")) & (py >= F.col("min_y")) & (py <= F.col("max_y"))
    return F.when(near, contains(F.col("ring"), px, py)).otherwise(False)


def layers_on_point(points: DataFrame, records: DataFrame) -> DataFrame:
    """First record of each polygon layer under each point (points: token, px, py)."""
    p = points.withColumns({"tx": _tile(F.col("px")), "ty": _tile(F.col("py"))})
    near = p.join(map_side(records), ["tx", "ty"])
    return near.filter(_inside(F.col("px"), F.col("py"))).groupBy("token", "layer").agg(
        F.min("record").alias("record"))


def clip_span(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Part [t0, t1] of the segment a-b inside a rectangle; t0 > t1 means outside."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t0, t1 = F.lit(0.0), F.lit(1.0)
    out = F.lit(False)
    for p, q in ((-dx, a["x"] - x0), (dx, x1 - a["x"]), (-dy, a["y"] - y0), (dy, y1 - a["y"])):
        r = q / F.nullif(p, F.lit(0.0))
        t0 = F.greatest(t0, F.when(p < 0, r))
        t1 = F.least(t1, F.when(p > 0, r))
        out = out | ((p == 0) & (q < 0))
    return F.when(out, 2.0).otherwise(t0), t1


def records_in_patch(patches: DataFrame, records: DataFrame) -> DataFrame:
    """Records that intersect or lie within each patch (token, x0, y0, x1, y1)."""
    p = patches.withColumn("tx", F.explode(F.sequence(_tile(F.col("x0")), _tile(F.col("x1"))))).withColumn(
        "ty", F.explode(F.sequence(_tile(F.col("y0")), _tile(F.col("y1")))))
    x0, y0, x1, y1 = (F.col(n) for n in ("x0", "y0", "x1", "y1"))
    boxes_meet = (F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0)
    pairs = p.join(map_side(records), ["tx", "ty"]).filter(once(x0, y0) & boxes_meet)

    def touches(e: Column) -> Column:
        t0, t1 = clip_span(e["a"], e["b"], x0, y0, x1, y1)
        return t0 <= t1

    within = F.forall("ring", lambda v: (v["x"] >= x0) & (v["x"] <= x1) & (v["y"] >= y0) & (v["y"] <= y1))
    meets = F.exists(edges(F.col("ring")), touches) | contains(F.col("ring"), x0, y0)
    return pairs.withColumns({"intersects": meets, "within": within}).filter("intersects OR within").select(
        "token", "layer", "record", "intersects", "within")


def patches_around(points: DataFrame, radius: float) -> DataFrame:
    """The square patch (x0, y0, x1, y1) of side 2 x radius around each point (token, px, py)."""
    return points.select("token", *[(F.col(c) + d).alias(n) for n, c, d in (
        ("x0", "px", -radius), ("y0", "py", -radius), ("x1", "px", radius), ("y1", "py", radius))])


def lines_in_patch(patches: DataFrame, vertices: DataFrame) -> DataFrame:
    """Lines with a node strictly inside a patch, and whether all of theirs are; a line without nodes is in none.

    Nodes meet patches by tile; a node lies in one tile only, so nothing is met twice.
    """
    p = patches.withColumn("tx", F.explode(F.sequence(_tile(F.col("x0")), _tile(F.col("x1"))))).withColumn(
        "ty", F.explode(F.sequence(_tile(F.col("y0")), _tile(F.col("y1")))))
    nodes = vertices.withColumns({"tx": _tile(F.col("x")), "ty": _tile(F.col("y"))})
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    some = p.join(small_side(nodes), ["tx", "ty"]).filter(inside).groupBy("token", "layer", "record").agg(F.count(F.lit(1)).alias("_in"))
    sizes = vertices.groupBy("layer", "record").agg(F.count(F.lit(1)).alias("_all"))
    return some.join(small_side(sizes), ["layer", "record"]).select("token", "layer", "record", F.lit(True).alias("intersects"), (F.col("_in") == F.col("_all")).alias("within"))


def segments(vertices: DataFrame, closed: bool) -> DataFrame:
    """Consecutive vertex pairs of each record; rings get their closing edge."""
    w = Window.partitionBy("layer", "record").orderBy("vertex")
    nxt = {n: F.lead(n).over(w) for n in ("x", "y")}
    if closed:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nxt = {n: F.coalesce(c, F.first(n).over(whole)) for n, c in nxt.items()}
    return vertices.select("layer", "record", F.col("vertex").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                           nxt["x"].alias("bx"), nxt["y"].alias("by")).filter("bx IS NOT NULL")


def discretise(segs: DataFrame, step: float = 0.5) -> DataFrame:
    """Points every ``step`` metres along each line by arc length, and its end.

    Steps run on over the corners of a line: a segment takes up where the one before it left off.
    """
    length = geom.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    line = Window.partitionBy("layer", "record").orderBy("seg")
    placed = segs.withColumn("len", length).filter("len > 0").withColumns({
        "start": F.coalesce(F.sum("len").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "last": F.lead("seg").over(line).isNull()})
    # a step that falls on a corner belongs to the segment that it begins; sums of lengths are rounded before they decide
    first = F.ceil(F.round(F.col("start") / step, 9)).cast("int")
    end = F.col("start") + F.col("len")
    after = F.ceil(F.round(end / step, 9)).cast("int") - 1
    at = F.when(first <= after, F.transform(F.sequence(first, after), lambda i: i * step - F.col("start"))).otherwise(F.array().cast("array<double>"))
    ends = F.when(F.col("last"), F.array("len")).otherwise(F.array().cast("array<double>"))
    pts = placed.withColumn("along", F.explode(F.concat(at, ends)))
    t = F.col("along") / F.col("len")
    return pts.select("layer", "record", "seg", (F.col("start") + F.col("along")).alias("s"), (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"),
                      (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y"))


def closest_lane(points: DataFrame, lane_points: DataFrame, radius: float) -> DataFrame:
    """Nearest lane within a square of ``radius``; the later lane wins a tie."""
    q = lane_points.select(F.col("record").alias("lane"), "x", "y")
    q = q.withColumns({"tx": _tile(F.col("x")), "ty": _tile(F.col("y"))})
    span = lambda c: F.sequence(_tile(c - radius), _tile(c + radius))
    p = points.withColumn("tx", F.explode(span(F.col("px")))).withColumn("ty", F.explode(span(F.col("py"))))
    near = p.join(small_side(q), ["tx", "ty"]).filter(
        (F.abs(F.col("x") - F.col("px")) <= radius) & (F.abs(F.col("y") - F.col("py")) <= radius))
    d = geom.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    # a lane has many points near a frame: reduce to one row per lane first
    per = near.groupBy("token", "lane").agg(F.min(d).alias("dist"))
    return per.groupBy("token").agg(F.min(F.struct("dist", (-F.col("lane")).alias("n"))).alias("m")).select(
        "token", (-F.col("m.n")).alias("lane"), F.col("m.dist").alias("dist"))


def connected_lanes(lanes: DataFrame, lane_edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Incoming and outgoing lanes per row of ``lanes`` (token, lane); a lane that is not in ``known`` (lane) fails the job."""
    if known is not None:
        there = known.select("lane").distinct().withColumn("_known", F.lit(True))
        lanes = lanes.join(there, "lane", "left").select("token", F.when(F.col("_known"), F.col("lane")).otherwise(
            F.raise_error(F.concat(F.coalesce(F.col("lane").cast("string"), F.lit("null")), F.lit(" is not a known lane"))).cast("long")).alias("lane"))
    out = lanes.join(lane_edges.select(F.col("src").alias("lane"), F.col("dst").alias("other")), "lane").withColumn("way", F.lit("outgoing"))
    inc = lanes.join(lane_edges.select(F.col("dst").alias("lane"), F.col("src").alias("other")), "lane").withColumn("way", F.lit("incoming"))
    return out.unionByName(inc).select("token", "lane", "way", "other")


def finest_roads(on_record: DataFrame, nodes: DataFrame, end_nodes: DataFrame, layers: list[str]) -> DataFrame:
    """Next roads of the finest layer under each point: (token, layer, record, next_layer, next_record).

    ``layers`` run from coarse to fine; ``nodes`` (layer, record, node) are the corners of every road, ``end_nodes`` those of the edge
    a road leads to.  A road of the coarsest layer has no direction: its next ones share ANY corner with it.  Any
    other leads to the roads that hold ALL nodes of its end edge.  Roads are related to each other once, by their
    nodes; only then do points join, so their number never multiplies that.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    best = on_record.withColumn("fine", place).filter("fine > 0").groupBy("token").agg(F.max(F.struct("fine", "layer", "record")).alias("b"))
    best = best.select("token", "b.layer", "b.record")
    asked = (nodes.filter(F.col("layer") == layers[0]).withColumn("needs", F.lit(1))
             .unionByName(end_nodes.filter(F.col("layer").isin(layers[1:])).distinct().withColumn("needs", F.count(F.lit(1)).over(Window.partitionBy("layer", "record")).cast("int")))).distinct()
    held = nodes.filter(F.col("layer").isin(layers)).distinct().select("node", F.col("layer").alias("next_layer"), F.col("record").alias("next_record"))
    shared = asked.join(held, "node").groupBy("layer", "record", "needs", "next_layer", "next_record").agg(F.count(F.lit(1)).alias("n"))
    itself = (F.col("layer") == F.col("next_layer")) & (F.col("record") == F.col("next_record"))
    pairs = shared.filter((F.col("n") >= F.col("needs")) & ~itself).select("layer", "record", "next_layer", "next_record")
    under = on_record.select("token", F.col("layer").alias("next_layer"), F.col("record").alias("next_record"))
    # what lies under the point itself is no next road
    return best.join(pairs, ["layer", "record"]).join(under, ["token", "next_layer", "next_record"], "left_anti").select(
        "token", "layer", "record", "next_layer", "next_record")


def next_roads(on_record: DataFrame, vertices: DataFrame) -> DataFrame:
    """Other records of the layer that share a node with the record under the point.

    Nodes are matched by position; record pairs are found once and then joined to the
    points, so the number of points never multiplies the node join.
    """
    node = vertices.select("layer", "record", F.round("x", 3).alias("nx"), F.round("y", 3).alias("ny")).distinct()
    other = node.select("layer", F.col("record").alias("next_record"), "nx", "ny")
    pairs = node.join(other, ["layer", "nx", "ny"]).filter("record <> next_record").select(
        "layer", "record", "next_record").distinct()
    return on_record.join(pairs, ["layer", "record"]).select("token", "layer", "record", "next_record")


# ---- vectors and rasters around a frame ----------------------------------------------------------

# map element -> class, fixed values; anything else is dropped
ELEMENT_CLASS = {"lanes": 0, "aisle_lines": 0, "crossings": 1, "parking_slots": 2, "drivable_area": 2}


def element_class(layer: Column) -> Column:
    pairs = [F.lit(x) for kv in ELEMENT_CLASS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), layer)


#: One piece of a clipped line, in the ego frame.
PIECE = "struct<seg: {seg}, p: struct<x: double, y: double>, q: struct<x: double, y: double>, len: double>"


def clip_to_patch(poses: DataFrame, segs: DataFrame, half: float, min_length: float = 0.5, pieces: bool = True) -> DataFrame:
    """Map lines in the ego frame, clipped to the patch and cut into connected parts.

    One row per kept part: (token, layer, record, part, length, pieces, line), lines counted
    from 0 in each frame by layer, record and part; ``pieces`` may be left out.  Parts start
    anew where a clipped piece does not continue the one before it.

    Frames go by token to tasks that clip the lines of many of them at once in numpy, and the rows of a token follow one another.
    A map of few segments is sent to the tasks; a larger one meets the frames by tile first.
    """
    reach = half * 2 ** 0.5
    s = segs.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"),
                          "min_y": F.least("ay", "by"), "max_y": F.greatest("ay", "by")})
    # tiles as wide as the patch's circle: a frame looks at four of them at most
    wide = 2 * reach
    ends, bounds = ["ax", "ay", "bx", "by"], ["min_x", "max_x", "min_y", "max_y"]
    side = tiled(s.filter(" AND ".join(f"{c} IS NOT NULL" for c in ends)), tile=wide).select("layer", "record", "seg", *ends, *bounds, "tx", "ty", "sx", "sy")
    # sine and cosine as Spark has them
    p = spread(poses.select("token", "gx", "gy", F.cos("gyaw").alias("cos"), F.sin("gyaw").alias("sin")), "token").filter(
        "gx IS NOT NULL AND gy IS NOT NULL AND cos IS NOT NULL")
    pose = ["gx", "gy", "cos", "sin"]
    kind = segs.schema["seg"].dataType.simpleString()
    numbers = T.StructType.fromDDL("part bigint, length double" + f", pieces array<{PIECE.format(seg=kind)}>" * pieces + ", line int").fields
    out = [segs.schema["layer"], segs.schema["record"], *numbers]

    def clipped(grid, line, seg, a, b, gx, gy, cos, sin):
        return _clip_lines(grid, line, seg, [_to_ego(*c, gx, gy, cos, sin) for c in (a, b)], half, min_length)

    def made(found, seg, *names):
        at, first, part, length, number, cut = found
        own = [_pieces(seg, *cut, kind)] if pieces else []
        return at, *[n.take(pa.array(first)) for n in names], part, length, *own, number

    few = side.limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows <= BROADCAST_ROWS:
        few = few.take(pc.sort_indices(few, sort_keys=[(c, "ascending") for c in ("layer", "record", "seg")], null_placement="at_start")).combine_chunks()
        layer, record = (_codes(few.column(c)) for c in ("layer", "record"))
        names = {c: distinct(few.column(c)) for c in ("layer", "record")}
        lines = raster.change(layer, record)
        near = near_rows(few, wide, reach)
        seg, (ax, ay, bx, by) = raster.values(few, "seg"), (raster.values(few, c) for c in ends)

        def found(grid, gx, gy, cos, sin):
            of, to = near(gx, gy)
            # the order of the map, which is that of its lines, inside a token
            order = np.lexsort((to, grid[of]))
            of, to = of[order], to[order]
            return to, clipped(grid[of], lines[to], seg[to], (ax[to], ay[to]), (bx[to], by[to]), gx[of], gy[of], cos[of], sin[of])

        def kernel(*given):
            to, got = found(*given)
            return made(got, seg[to], *[names[c].take(pa.array(code[to])) for c, code in (("layer", layer), ("record", record))])

        def arrays(*given):
            to, (at, first, part, length, number, (_, sizes, points, each)) = found(*given)
            return at, {"layer": layer[to][first], "record": record[to][first], "part": part, "length": length, "line": number, "sizes": sizes, "points": points, "len": each}

        return raster.kept(raster.per_grid(p, ["token"], pose, out, kernel), [raster.Steps(p, ["token"], pose, arrays, names)])

    span = lambda c: F.sequence(_tile(c - reach, wide), _tile(c + reach, wide))
    p = p.withColumn("tx", F.explode(span(F.col("gx")))).withColumn("ty", F.explode(span(F.col("gy"))))
    meet = (F.col("min_x") <= F.col("gx") + reach) & (F.col("max_x") >= F.col("gx") - reach) & (F.col("min_y") <= F.col("gy") + reach) & (F.col("max_y") >= F.col("gy") - reach)
    pairs = p.join(side.hint("merge"), ["tx", "ty"]).filter(once(F.col("gx") - reach, F.col("gy") - reach, wide) & meet)

    types = [raster.arrow(f) for f in out[:2]]

    def joined(grid, layer, record, seg, ax, ay, bx, by, gx, gy, cos, sin):
        layer, record = (pa.array(c) if isinstance(c, np.ndarray) else c for c in (layer, record))
        line = raster.change(*[_codes(c) for c in (layer, record)])
        return made(clipped(grid, line, seg, (ax, ay), (bx, by), gx, gy, cos, sin), seg, layer.cast(types[0]), record.cast(types[1]))

    return raster.per_grid(pairs, ["token"], ["layer", "record", "seg", *ends, *pose], out, joined, in_order=True)


def near_rows(tiles: pa.Table, wide: float, reach: float) -> Callable:
    """For frames (gx, gy): the pairs of a frame and a row of the tiled map whose bounds come near it, each once."""
    value = {c: raster.values(tiles, c) for c in ("min_x", "max_x", "min_y", "max_y", "tx", "ty", "sx", "sy")}
    tx, ty = value["tx"], value["ty"]
    left, low = (int(t.min()) if len(t) else 0 for t in (tx, ty))
    high = (int(ty.max()) if len(ty) else 0) - low + 1
    right = int(tx.max()) - left if len(tx) else -1
    code = (tx - left) * high + ty - low
    order = np.argsort(code, kind="stable")
    code = code[order]
    tile = lambda c: np.floor(c / wide).astype(np.int64)

    def near(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x0, y0 = tile(gx - reach), tile(gy - reach)
        of, i = raster.counted(tile(gx + reach) - x0 + 1)
        row, j = raster.counted((tile(gy + reach) - y0 + 1)[of])
        of = of[row]
        x, y = x0[of] + i[row] - left, y0[of] + j - low
        there = np.flatnonzero((x >= 0) & (x <= right) & (y >= 0) & (y < high))
        of, at = of[there], x[there] * high + y[there]
        start = np.searchsorted(code, at)
        pair, step = raster.counted(np.searchsorted(code, at, side="right") - start)
        of, to = of[pair], order[start[pair] + step]
        c = {n: v[to] for n, v in value.items()}
        kept = (c["tx"] == np.maximum(c["sx"], x0[of])) & (c["ty"] == np.maximum(c["sy"], y0[of]))
        kept &= (c["min_x"] <= gx[of] + reach) & (c["max_x"] >= gx[of] - reach) & (c["min_y"] <= gy[of] + reach) & (c["max_y"] >= gy[of] - reach)
        return of[kept], to[kept]

    return near


def _to_ego(x, y, gx, gy, cos, sin) -> tuple[np.ndarray, np.ndarray]:
    """``geom.to_ego_xy`` of arrays."""
    dx, dy = x - gx, y - gy
    return dx * cos + dy * sin, -(dx * sin - dy * cos)


def _clip_lines(grid, line, seg, ends, half: float, min_length: float) -> tuple:
    """Parts of the segments of frames that are longer than ``min_length``: (grid, first, part, length, line, cut).

    Segments come by grid, line and seg; ``first`` is an index of a segment of the part, ``cut`` says for ``_pieces`` what is left of which segments.
    """
    (ax, ay), (bx, by) = ends
    dx, dy = bx - ax, by - ay
    t0, t1, out = np.zeros(len(dx)), np.ones(len(dx)), np.zeros(len(dx), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q in ((-dx, ax + half), (dx, half - ax), (-dy, ay + half), (dy, half - ay)):
            r = q / p
            np.maximum(t0, r, out=t0, where=p < 0)
            np.minimum(t1, r, out=t1, where=p > 0)
            out |= (p == 0) & (q < 0)
    kept = np.flatnonzero((t0 < t1) & ~out)
    grid, line, seg, t0, t1, dx, dy, ax, ay = (c[kept] for c in (grid, line, seg, t0, t1, dx, dy, ax, ay))
    length = np.sqrt(dx * dx + dy * dy) * (t1 - t0)
    fresh = np.r_[True, (grid[1:] != grid[:-1]) | (line[1:] != line[:-1])][:len(grid)]
    new = fresh.copy()
    new[1:] |= (seg[:-1] != seg[1:] - 1) | (t1[:-1] != 1.0) | (t0[1:] != 0.0)
    part = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    # parts are counted from 1 in each line
    number = part[starts] - part[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))[starts]] + 1
    whole = np.bincount(part, weights=length, minlength=len(starts))
    long = whole >= min_length
    at = grid[starts[long]]
    order = np.arange(len(at)) - np.searchsorted(at, at)
    held = long[part]
    sizes = np.bincount(part[held], minlength=len(starts))[long]
    points = [(c[held], d[held], t[held]) for c, d, t in ((ax, dx, t0), (ay, dy, t0), (ax, dx, t1), (ay, dy, t1))]
    return at, kept[starts[long]], number[long], whole[long], order, (kept[held], sizes, [c + d * t for c, d, t in points], length[held])


def _pieces(seg, of, sizes, points, length, kind: str) -> pa.Array:
    pair = lambda x, y: pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    px, py, qx, qy = points
    each = pa.StructArray.from_arrays([pa.array(seg[of], type={"int": pa.int32(), "bigint": pa.int64()}[kind]), pair(px, py), pair(qx, qy), pa.array(length)],
                                      names=["seg", "p", "q", "len"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32()), each)


def resample(parts: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Points about every ``spacing`` metres along each part, both ends included: one more than whole spacings, two at least."""
    if raster.steps_of(parts):
        fields = [parts.schema["layer"], parts.schema["record"], *T.StructType.fromDDL("part bigint, line int, length double, i int, x double, y double").fields]
        return raster.stacked([s.then(lambda grid, c: _samples(grid, c, spacing)) for s in raster.steps_of(parts)], fields)
    # rounded first: a whole length that its sum left a little short still counts
    n = F.greatest(F.lit(1), F.floor(F.round("length", 6) / spacing).cast("int"))
    cum = F.transform("pieces", lambda x, i: F.struct(
        F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0.0), lambda a, y: a + y["len"]).alias("start"), x.alias("x")))
    pts = parts.withColumns({"n": n, "_cum": cum}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    s = F.col("length") * F.col("i") / F.col("n")
    placed = pts.withColumn("s", s)
    # the last piece that starts at or before s
    piece = F.element_at(F.filter("_cum", lambda c: c["start"] <= F.col("s")), -1)
    q = placed.withColumn("c", piece)
    t = F.least(F.lit(1.0), (F.col("s") - F.col("c.start")) / F.col("c.x.len"))
    return q.select("token", "layer", "record", "part", "line", "length", "i",
                    (F.col("c.x.p.x") + (F.col("c.x.q.x") - F.col("c.x.p.x")) * t).alias("x"),
                    (F.col("c.x.p.y") + (F.col("c.x.q.y") - F.col("c.x.p.y")) * t).alias("y"))


def _samples(grid, c: dict, spacing: float) -> tuple[np.ndarray, dict]:
    """``resample`` of the arrays of ``clip_to_patch``."""
    whole, sizes, each = c["length"], c["sizes"], c["len"]
    n = np.maximum(1, np.floor(np.round(whole, 6) / spacing).astype(np.int64))
    part, i = raster.counted(n + 1)
    s = whole[part] * i / n[part]
    # where a piece starts in its part, added up piece by piece
    first = np.cumsum(sizes) - sizes
    of, step = raster.counted(sizes)
    start = np.zeros(len(each))
    for k in range(1, int(sizes.max(initial=0))):
        at = np.flatnonzero(step == k)
        start[at] = start[at - 1] + each[at - 1]
    # the last piece that starts at or before s
    piece = first[part]
    for k in range(1, int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes[part] > k)
        at = at[start[first[part[at]] + k] <= s[at]]
        piece[at] = first[part[at]] + k
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.minimum(1.0, (s - start[piece]) / each[piece])
    px, py, qx, qy = (v[piece] for v in c["points"])
    return grid[part], {**{k: c[k][part] for k in ("layer", "record", "part", "line", "length")}, "i": i, "x": px + (qx - px) * t, "y": py + (qy - py) * t}


def line_raster(samples: DataFrame, cell: float, half: float, thickness: int = 1) -> DataFrame:
    """Cells touched by line samples widened to ``thickness`` cells, with class and id.

    A cell covered by several lines of one class keeps the largest line id.
    """
    size = int(2 * half / cell)
    r = thickness // 2
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1)])
    cells = samples.withColumn("cls", element_class(F.col("layer"))).filter("cls IS NOT NULL").select(
        "token", "cls", "line", F.floor((F.round("x", 6) + half) / cell).alias("bx"),
        F.floor((F.round("y", 6) + half) / cell).alias("by"), F.explode(around).alias("d"))
    placed = cells.select("token", "cls", "line", (F.col("bx") + F.col("d.i")).alias("cx"), (F.col("by") + F.col("d.j")).alias("cy"))
    inside = placed.filter(F.col("cx").between(0, size - 1) & F.col("cy").between(0, size - 1))
    return inside.groupBy("token", "cls", "cx", "cy").agg(F.max("line").alias("line"))


def drop_overlaps(raster: DataFrame, grow: int = 0) -> DataFrame:
    """Cells of a class survive unless a later class lies within ``grow`` cells."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-grow, grow + 1) for j in range(-grow, grow + 1)])
    # only cells that a later class could cover look around
    early = raster.filter(F.col("cls") < max(ELEMENT_CLASS.values())).select("token", "cls", "cx", "cy", F.explode(around).alias("d")).select(
        "token", "cls", "cx", "cy", (F.col("cx") + F.col("d.i")).alias("nx"), (F.col("cy") + F.col("d.j")).alias("ny"))
    later = raster.select("token", F.col("cls").alias("later"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    covered = early.join(later, ["token", "nx", "ny"]).filter("later > cls").select("token", "cls", "cx", "cy").distinct()
    return raster.join(covered, ["token", "cls", "cx", "cy"], "left_anti")


def patch_mask(poses: DataFrame, records: DataFrame, cell: float, half: float) -> DataFrame:
    """Cells of each frame's patch whose centre lies in a polygon layer."""
    n = int(2 * half / cell)
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda i: -half + cell * (i + 0.5)
    cells = spread(poses.select("token", "gx", "gy", "gyaw"), "token").select("*", F.explode(idx).alias("cx")).withColumn("cy", F.explode(idx))
    g = geom.rotate(at(F.col("cx")), at(F.col("cy")), F.col("gyaw"))
    pts = cells.select("token", "cx", "cy", (F.col("gx") + g.x).alias("px"), (F.col("gy") + g.y).alias("py"))
    p = pts.withColumns({"tx": _tile(F.col("px")), "ty": _tile(F.col("py"))})
    hit = p.join(map_side(records), ["tx", "ty"]).filter(_inside(F.col("px"), F.col("py")))
    return hit.select("token", "layer", "cx", "cy").distinct()


def mask_iou(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Summed intersection over summed union per layer."""
    p = pred.select(*keys, "layer", "cx", "cy").withColumn("p", F.lit(1))
    t = truth.select(*keys, "layer", "cx", "cy").withColumn("t", F.lit(1))
    both = p.join(t, [*keys, "layer", "cx", "cy"], "full")
    return both.groupBy("layer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("inter"), F.count(F.lit(1)).alias("whole")).withColumn(
        "iou", F.col("inter") / F.col("whole"))
