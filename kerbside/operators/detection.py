"""Detection and motion scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import geom
from kerbside.operators.ordered import running_sums
from kerbside.operators.raster import counted

RECALLS = 101


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_frames(
    detections: DataFrame,
    truth: DataFrame,
    thresholds: list[float],
    *,
    inclusive: bool = False,
    extra=None,
    payload: tuple[str, ...] = ("w", "l", "h", "yaw", "vx", "vy"),
    newest_first: bool = True,
) -> DataFrame:
    """Greedy match per (token, cls): best score first, nearest free truth box.

    Matching never looks outside a frame, so the score order is only needed inside
    it; a frame's boxes (bounded by ``guard_max_boxes``) meet as two arrays
    next to each other and no global sort happens.  Returns one row per detection and
    threshold with gt_pos (null = false positive), dist and the payload of both sides.

    ``extra(det, gt)`` may add a condition on the chosen pair: it gets x, y and the payload of both sides as arrays by name
    (a missing number is NaN) and returns an array of truth values.  Score ties: the larger det_pos first with ``newest_first``,
    else the smaller.  All frames of an Arrow batch are matched together, one rank of their score order after another.
    """
    keep = [*payload]
    tie = -F.col("det_pos") if newest_first else F.col("det_pos")
    d = detections.groupBy("token", "cls").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("neg"), tie.alias("tie"), "det_pos", "score", "event_id", "x", "y", *keep))).alias("dets"))
    g = truth.groupBy("token", "cls").agg(F.sort_array(F.collect_list(F.struct(
        F.col("actor_id").alias("pos"), "x", "y", *keep))).alias("gts"))
    both = d.join(g, ["token", "cls"], "left")
    det_type, gt_type = (both.schema[c].dataType.elementType for c in ("dets", "gts"))
    limits, own = [float(t) for t in thresholds], ["det_pos", "score", "event_id"]
    schema = T.StructType([
        both.schema["token"], both.schema["cls"], T.StructField("thr", T.DoubleType()), *[T.StructField(c, det_type[c].dataType) for c in own],
        T.StructField("gt_pos", T.LongType()), T.StructField("dist", T.DoubleType()),
        *[T.StructField(f"d_{c}", det_type[c].dataType) for c in keep], *[T.StructField(f"g_{c}", gt_type[c].dataType) for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dets, gts = batch.column("dets").flatten(), batch.column("gts").flatten()
            frame, rank = counted(_sizes(batch.column("dets")))
            pos, dist = _greedy(frame, rank, dets, _sizes(batch.column("gts")), gts, limits, inclusive, extra, keep)
            names = [batch.column(c).take(pa.array(frame)) for c in ("token", "cls")]
            for thr, found, far in zip(limits, pos, dist, strict=True):
                missed = found < 0
                hit = gts.take(pa.array(found, mask=missed))
                yield pa.RecordBatch.from_arrays([
                    *names, pa.array(np.full(len(frame), thr)), *[dets.field(c) for c in own],
                    hit.field("pos").cast(pa.int64()), pa.array(far, mask=missed),
                    *[dets.field(c) for c in keep], *[pc.if_else(pa.array(~missed), hit.field(c), None) for c in keep]],
                    names=schema.fieldNames())

    return both.mapInArrow(run, schema)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _greedy(frame, rank, dets, n_gts, gts, limits, inclusive, extra, keep) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each of ``limits``: index of the truth box of every detection (-1 for none) and its distance.

    ``frame`` and ``rank`` give each detection's frame and its place there; boxes of equal ``pos`` are taken together, and
    one without ``pos`` never.  A distance that is null comes before all others and is no hit, so a truth box without a
    place leaves its frame without hits.
    """
    number = lambda side, c: side.field(c).to_numpy(zero_copy_only=False)
    unplaced = pc.or_(gts.field("x").is_null(), gts.field("y").is_null()).to_numpy(zero_copy_only=False)
    named = gts.field("pos").is_valid().to_numpy(zero_copy_only=False)
    pos = pc.fill_null(gts.field("pos"), 0).to_numpy(zero_copy_only=False)
    of, _ = counted(n_gts)
    new = np.r_[True, (of[1:] != of[:-1]) | (pos[1:] != pos[:-1]) | (named[1:] != named[:-1])][:len(of)]
    box, first = np.cumsum(new) - 1, np.flatnonzero(new)
    usable = np.where(np.bincount(of[unplaced & named], minlength=len(n_gts)) > 0, 0, n_gts)
    det, step = counted(usable[frame])
    gt = (np.cumsum(n_gts) - n_gts)[frame][det] + step
    dx, dy = number(gts, "x")[gt] - number(dets, "x")[det], number(gts, "y")[gt] - number(dets, "y")[det]
    dist = np.sqrt(dx * dx + dy * dy)
    within = (lambda t: dist <= t) if inclusive else (lambda t: dist < t)
    # a nearest box beyond the widest limit is no hit at any
    near = np.flatnonzero(named[gt] & within(max(limits)))
    near = near[np.lexsort((gt[near], dist[near], det[near], rank[det[near]]))]
    det, gt, dist = det[near], gt[near], dist[near]
    fits = np.ones(len(det), bool)
    if extra is not None:
        # a missing value of a box may be no number at all (a text); only numbers are handed over
        sides = [{c: number(side, c)[at] for c in ("x", "y", *keep)} for side, at in ((dets, det), (gts, gt))]
        fits = np.asarray(extra(*sides), bool)
    cuts = np.flatnonzero(np.diff(rank[det])) + 1
    runs = [*zip(np.r_[0, cuts], np.r_[cuts, len(det)], strict=True)] if len(det) else []
    found, far = [], []
    for t in limits:
        hit, taken = within(t) & fits, np.zeros(len(first), bool)
        to, gap = np.full(len(frame), -1), np.full(len(frame), np.nan)
        for a, b in runs:
            free = a + np.flatnonzero(~taken[box[gt[a:b]]])
            best = free[np.r_[True, det[free][1:] != det[free][:-1]][:len(free)]]
            best = best[hit[best]]
            taken[box[gt[best]]] = True
            to[det[best]], gap[det[best]] = first[box[gt[best]]], dist[best]
        found.append(to)
        far.append(gap)
    return found, far


def box_errors(matches: DataFrame) -> DataFrame:
    """Size, heading, overlap and velocity errors of matched pairs, and where both sides have an attribute, whether they differ.

    A truth box without an attribute (null or empty) has no attribute error.
    """
    size = (F.abs(F.col("g_w") - F.col("d_w")) + F.abs(F.col("g_l") - F.col("d_l")) + F.abs(F.col("g_h") - F.col("d_h"))) / 3
    inter = F.least("g_w", "d_w") * F.least("g_l", "d_l") * F.least("g_h", "d_h")
    vol = F.col("g_w") * F.col("g_l") * F.col("g_h") + F.col("d_w") * F.col("d_l") * F.col("d_h") - inter
    attr = {}
    if "g_attr" in matches.columns:
        attr["attr_err"] = F.when(F.coalesce(F.col("g_attr"), F.lit("")) != "", F.when(F.col("g_attr") == F.col("d_attr"), 0.0).otherwise(1.0))
    return matches.withColumns({
        **attr, "size_err": size,
        "yaw_err": geom.yaw_gap(F.col("g_yaw"), F.col("d_yaw")),
        "scale_err": 1 - inter / vol,
        "vel_err": geom.hypot(F.col("g_vx") - F.col("d_vx"), F.col("g_vy") - F.col("d_vy")),
    })


def detection_table(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class and overall: GT, TP, FP, FN, recall, precision and mean errors."""
    hit = F.col("gt_pos").isNotNull()
    per = box_errors(matches).groupBy("cls").agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"),
        F.sum("dist").alias("c"), F.sum("size_err").alias("s"), F.sum("yaw_err").alias("y"))
    gt = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("gt"))
    both = gt.join(per, "cls", "full").na.fill(0, ["gt", "tp", "fp"])
    out = both.rollup("cls").agg(*[F.sum(n).alias(n) for n in ("gt", "tp", "fp", "c", "s", "y")])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return out.select(
        F.coalesce("cls", F.lit("ALL")).alias("cls"), "gt", "tp", "fp", (F.col("gt") - tp).alias("fn"),
        safe(tp, F.col("gt")).alias("recall"), safe(tp, tp + F.col("fp")).alias("precision"),
        F.when(tp > 0, F.col("c") / tp).alias("centre_err"), F.when(tp > 0, F.col("s") / tp).alias("size_err"),
        F.when(tp > 0, F.degrees(F.col("y") / tp)).alias("yaw_err_deg"))


# ---- which boxes are scored -------------------------------------------------------------------

def in_class_range(df: DataFrame) -> DataFrame:
    """Boxes (x, y, cls) nearer to the car than the range in which their class is scored."""
    from kerbside.operators.boxes import class_range

    return df.filter(geom.hypot(F.col("x"), F.col("y")) < class_range(F.col("cls")))


def of_annotations(truth: DataFrame, wanted: DataFrame, key: str = "annotation") -> DataFrame:
    """Truth boxes whose annotation id is in the set ``wanted``, of any size."""
    return truth.join(wanted.select(key).distinct(), key, "left_semi")


# ---- precision over recall -------------------------------------------------------------

def score_bucket() -> Column:
    """Order-preserving pieces of (score desc, event_id desc): equal scores still split."""
    return F.struct((-F.floor(F.col("score") * 1000)).alias("s"), (-F.floor(F.col("event_id") / 65536)).alias("e"))


def ranked_hits(matches: DataFrame) -> DataFrame:
    """Running TP and FP counts per (cls, thr) in score order, without a global sort."""
    hit = F.col("gt_pos").isNotNull().cast("long")
    rows = matches.withColumns({"_tp": hit, "_fp": 1 - hit})
    order = [F.desc("score"), F.desc("event_id"), F.desc("det_pos")]
    return running_sums(rows, order, {"tp": "_tp", "fp": "_fp"}, group=["cls", "thr"], bucket=score_bucket())


def pr_curve(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and confidence at 101 recalls, interpolated between curve points.

    All points with the same TP count share a recall, so the curve is first reduced
    to its first and last point per count; only then are recalls attached.
    """
    npos = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("npos"))
    ends = ranked.groupBy("cls", "thr", "tp").agg(
        F.min("fp").alias("fp_first"), F.max("fp").alias("fp_last"),
        F.max("score").alias("conf_first"), F.min("score").alias("conf_last"))
    # a count's successor is the count plus one, so an equi join finds the next point
    nxt = ends.select("cls", "thr", (F.col("tp") - 1).alias("tp"), F.col("fp_first").alias("nfp"),
                      F.col("conf_first").alias("nconf"))
    # before the first match the curve holds the value of its very first point
    lead = ends.filter("tp = 1 AND fp_first = 0").select(
        "cls", "thr", F.lit(0).cast("long").alias("tp"), F.lit(None).cast("long").alias("fp_first"),
        F.lit(None).cast("long").alias("fp_last"), F.lit(None).cast("double").alias("conf_first"),
        F.lit(None).cast("double").alias("conf_last"))
    joined = ends.unionByName(lead).join(nxt, ["cls", "thr", "tp"], "left").join(F.broadcast(npos), "cls")
    tp, n = F.col("tp").cast("double"), F.col("npos").cast("double")
    lo_r, hi_r = tp / n, (tp + 1) / n
    span = F.sequence(F.greatest(F.lit(0), F.ceil(lo_r * 100) - 1).cast("int"),
                      F.least(F.lit(100), F.ceil(hi_r * 100) + 1).cast("int"))
    x = F.col("k") * 0.01
    last = F.col("nfp").isNull()
    placed = joined.filter(F.ceil(lo_r * 100) - 1 <= 100).withColumn("k", F.explode(span)).filter(
        (x >= lo_r) & F.when(last, x == lo_r).otherwise(x < hi_r))
    p_lo = F.col("tp") / (F.col("tp") + F.col("fp_last"))
    p_hi = (F.col("tp") + 1) / (F.col("tp") + 1 + F.col("nfp"))
    start = F.col("fp_last").isNull()
    share = (x - lo_r) / (hi_r - lo_r)
    prec = F.when(last, p_lo).when(start, p_hi).otherwise(p_lo + (p_hi - p_lo) * share)
    conf = F.when(last, F.col("conf_last")).when(start, F.col("nconf")).otherwise(
        F.col("conf_last") + (F.col("nconf") - F.col("conf_last")) * share)
    inside = placed.select("cls", "thr", "k", prec.alias("prec"), conf.alias("conf"))
    # classes x thresholds x 101 recalls: a table of fixed size
    grid = ends.select("cls", "thr").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100))))
    return grid.join(inside, ["cls", "thr", "k"], "left").na.fill(0.0, ["prec", "conf"])


ERRORS = {"trans_err": "dist", "scale_err": "scale_err", "orient_err": "yaw_err", "vel_err": "vel_err"}
#: With matches that carry attributes; some pairs have no attribute error, so its mean counts those that do.
FIVE_ERRORS = {**ERRORS, "attr_err": "attr_err"}


def tp_error_curve(ranked: DataFrame, curve: DataFrame, errors: dict[str, str] = ERRORS) -> DataFrame:
    """Running mean of each error over matches, read at the curve's confidences.

    The attribute error is the mean over the matches so far that have one, zero before the first; a class without any has 1 throughout.
    """
    hits = box_errors(ranked.filter(F.col("gt_pos").isNotNull()))
    order = [F.desc("score"), F.desc("event_id"), F.desc("det_pos")]
    sources = {f"_{n}": c for n, c in errors.items()}
    if "attr_err" in errors:
        # a running sum takes no nulls
        hits = hits.withColumns({"_has": F.col("attr_err").isNotNull().cast("long"), "_attr": F.coalesce("attr_err", F.lit(0.0))})
        sources |= {"_attr_err": "_attr", "_attrs": "_has"}
    sums = running_sums(hits, order, sources, group=["cls", "thr"], bucket=score_bucket())
    mean = {n: F.col(f"_{n}") / F.col("tp") for n in errors}
    if "attr_err" in errors:
        some = hits.groupBy("cls", "thr").agg(F.max("_has").alias("_some"))
        sums = sums.join(F.broadcast(some), ["cls", "thr"])
        mean["attr_err"] = F.when(F.col("_some") == 0, 1.0).otherwise(
            F.coalesce(F.col("_attr_err") / F.nullif(F.col("_attrs"), F.lit(0)), F.lit(0.0)))
    means = sums.select("cls", "thr", F.col("tp").alias("c"), "score", *[mean[n].alias(n) for n in errors])
    # how many matches lie above each confidence: count per interval, then add up
    marks = curve.groupBy("cls", "thr").agg(F.sort_array(F.collect_set("conf")).alias("marks"))
    slot = F.size(F.filter("marks", lambda m: m < F.col("score")))
    per = means.join(F.broadcast(marks), ["cls", "thr"]).groupBy("cls", "thr", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = curve.select("cls", "thr", "k", "conf").join(F.broadcast(marks), ["cls", "thr"]).withColumn(
        "at", F.array_position("marks", F.col("conf")))
    above = grid.join(per, (grid.cls == per.cls) & (grid.thr == per.thr) & (per.slot >= grid["at"]), "left").groupBy(
        grid.cls, grid.thr, "k", "conf").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("above"))
    total = means.groupBy("cls", "thr").agg(F.max("c").alias("total"))
    spots = above.join(total, ["cls", "thr"]).withColumn("lo", F.least(F.col("above") + 1, F.col("total")))
    low = means.select("cls", "thr", F.col("c").alias("lo"), F.col("score").alias("s_lo"),
                       *[F.col(n).alias(f"lo_{n}") for n in errors])
    high = means.select("cls", "thr", F.col("c").alias("above"), F.col("score").alias("s_hi"),
                        *[F.col(n).alias(f"hi_{n}") for n in errors])
    both = F.broadcast(spots).join(low, ["cls", "thr", "lo"])
    both = both.join(high, ["cls", "thr", "above"], "left")
    inside = (F.col("above") >= 1) & (F.col("above") < F.col("total"))
    share = (F.col("conf") - F.col("s_lo")) / (F.col("s_hi") - F.col("s_lo"))
    value = lambda n: F.when(inside, F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * share).otherwise(F.col(f"lo_{n}"))
    return both.select("cls", "thr", "k", "conf", *[value(n).alias(n) for n in errors])


def average_precision(curve: DataFrame, min_recall: float = 0.1, min_precision: float = 0.1) -> DataFrame:
    first = round(100 * min_recall) + 1
    gain = F.greatest(F.lit(0.0), F.col("prec") - min_precision)
    return curve.filter(F.col("k") >= first).groupBy("cls", "thr").agg(
        (F.avg(gain) / (1 - min_precision)).alias("ap"))


def tp_scores(errors: DataFrame, min_recall: float = 0.1, names: dict[str, str] = ERRORS) -> DataFrame:
    """Mean error from the first usable recall to the last with a confidence, else 1."""
    first = round(100 * min_recall) + 1
    last = errors.groupBy("cls", "thr").agg(F.max(F.when(F.col("conf") != 0, F.col("k"))).alias("last"))
    used = (F.col("k") >= first) & (F.col("k") <= F.col("last"))
    return errors.join(F.broadcast(last), ["cls", "thr"]).groupBy("cls", "thr").agg(*[
        F.coalesce(F.avg(F.when(used, F.col(n))), F.lit(1.0)).alias(n) for n in names])


# errors that mean nothing for a class, fixed values
EXCLUDED = {"traffic_cone": ["attr_err", "vel_err", "orient_err"], "barrier": ["attr_err", "vel_err"]}


def detection_score(ap: DataFrame, tp: DataFrame, at: float = 2.0, names: dict[str, str] = ERRORS) -> DataFrame:
    """mAP over classes and distances, mean TP errors at 2 m, and the combined score."""
    def cell(name: str) -> Column:
        banned = [c for c, names in EXCLUDED.items() if name in names]
        return F.avg(F.when(~F.col("cls").isin(banned), F.col(name))) if banned else F.avg(name)

    means = tp.filter(F.col("thr") == at).agg(*[cell(n).alias(n) for n in names])
    gain = sum((F.lit(1.0) - F.least(F.lit(1.0), F.col(n)) for n in names), F.lit(0.0))
    k = len(names)
    return ap.agg(F.avg("ap").alias("map")).crossJoin(F.broadcast(means)).select(
        "map", *names, ((F.col("map") * k + gain) / (2 * k)).alias("score"))


def epa(motion_matches: DataFrame, matches: DataFrame, truth: DataFrame, at: float = 2.0) -> DataFrame:
    """(TP with a good trajectory - 0.5 * false detections) / truth boxes per class."""
    good = motion_matches.filter((F.col("thr") == at) & F.col("gt_pos").isNotNull()).groupBy("cls").agg(
        F.count(F.lit(1)).alias("tp"))
    false = matches.filter((F.col("thr") == at) & F.col("gt_pos").isNull()).groupBy("cls").agg(F.count(F.lit(1)).alias("fp"))
    n = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("gt"))
    out = n.join(good, "cls", "left").join(false, "cls", "left").na.fill(0, ["tp", "fp"])
    return out.withColumn("epa", (F.col("tp") - 0.5 * F.col("fp")) / (F.col("gt") + 1e-5))


def mode_errors(df: DataFrame, miss_at: float = 2.0) -> DataFrame:
    """minADE, minFDE and miss flag; ``modes`` is an array of paths, ``truth`` the masked path.

    Only steps that exist in ``truth`` count; without any the row has null errors.
    """
    n = F.size("truth")

    def gaps(mode: Column) -> Column:
        return F.transform(F.arrays_zip(F.slice(mode, F.lit(1), n).alias("m"), F.col("truth").alias("t")),
                           lambda z: geom.hypot(z["m"]["x"] - z["t"]["x"], z["m"]["y"] - z["t"]["y"]))

    some = n > 0
    # as a column of its own the gaps are worked out once, not for each of the three
    held = df.withColumn("_gaps", F.transform("modes", gaps))
    ade = F.array_min(F.transform("_gaps", lambda g: F.aggregate(g, F.lit(0.0), lambda a, v: a + v) / F.size(g)))
    fde = F.array_min(F.transform("_gaps", lambda g: F.try_element_at(g, F.lit(-1))))
    far = F.array_min(F.transform("_gaps", lambda g: F.array_max(g)))
    return held.withColumns({
        "min_ade": F.when(some, ade), "min_fde": F.when(some, fde),
        "miss": F.when(some, F.when(far > miss_at, 1.0).otherwise(0.0)),
    }).drop("_gaps")


# ---- decoding ------------------------------------------------------------------------------

def topk_decode(logits: DataFrame, max_num: int, threshold: float, limit: float) -> DataFrame:
    """Best ``max_num`` (query, class) scores of a frame above a threshold that backs
    off by 0.9 until something passes; below 0.01 everything passes; then a range test.

    ``logits`` has token, query, label, logit and the box centre x, y.
    """
    from pyspark.sql import Window

    scored = logits.withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
    w = Window.partitionBy("token").orderBy(F.desc("score"), "query", "label")
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_num)
    best = F.max("score").over(Window.partitionBy("token"))
    # the thresholds tried, largest first: threshold * 0.9^i while at least 0.01
    tried, t = [], threshold * 0.9
    while t >= 0.01:
        tried.append(t)
        t *= 0.9
    lowered = F.array_max(F.filter(F.array(*[F.lit(x) for x in tried]), lambda x: x <= best))
    ok = F.when(best > threshold, F.col("score") > threshold).otherwise(
        F.col("score") >= F.coalesce(lowered, F.lit(-1.0)))
    return top.withColumn("_ok", ok).filter("_ok").filter(
        (F.abs("x") <= limit) & (F.abs("y") <= limit)).drop("_ok")


# ---- tracking -----------------------------------------------------------------------------

def tracking_summary(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """CLEAR-MOT style counts and rates for one score level.

    ``matches`` is the per-frame match at one threshold with scene_token, frame_idx
    and the track id in det_pos; the last track id of a truth actor decides a switch.
    """
    from kerbside.operators.ordered import sparse_neighbours

    hits = matches.filter(F.col("gt_pos").isNotNull())
    seq = sparse_neighbours(hits, ["scene_token", "gt_pos"], "frame_idx", "det_pos", "_prev", "_next")
    switches = seq.agg(F.count_if(F.col("_prev") != F.col("det_pos")).alias("ids"),
                       F.avg("dist").alias("motp"), F.count(F.lit(1)).alias("tp"))
    cover = truth.join(
        hits.select("token", F.col("gt_pos").alias("actor_id"), F.lit(1).alias("_hit")), ["token", "actor_id"], "left")
    flagged = cover.select("scene_token", "actor_id", "frame_idx", F.coalesce("_hit", F.lit(0)).alias("hit"))
    tracks = flagged.groupBy("scene_token", "actor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.min("frame_idx").alias("start"),
        F.min(F.when(F.col("hit") == 1, F.col("frame_idx"))).alias("first_hit"))
    runs = sparse_neighbours(flagged, ["scene_token", "actor_id"], "frame_idx", "hit", "_p", "_n")
    frags = runs.agg(F.count_if((F.col("hit") == 0) & (F.col("_p") == 1)).alias("frag"))
    share = F.col("h") / F.col("n")
    per = tracks.agg(
        F.sum("n").alias("gt"), F.count_if(share >= 0.8).alias("mt"), F.count_if(share <= 0.2).alias("ml"),
        (F.avg(F.col("first_hit") - F.col("start")) * 0.5).alias("tid"))
    false = matches.agg(F.count_if(F.col("gt_pos").isNull()).alias("fp"), F.count_distinct("token").alias("_frames"))
    row = switches.crossJoin(F.broadcast(frags)).crossJoin(F.broadcast(per)).crossJoin(F.broadcast(false))
    fn = F.col("gt") - F.col("tp")
    return row.select(
        "gt", "tp", "fp", fn.alias("fn"), "ids", "frag", "mt", "ml", "motp", "tid",
        (F.col("fp") / F.col("_frames")).alias("faf"), (F.col("tp") / F.col("gt")).alias("recall"),
        F.greatest(F.lit(0.0), 1 - (F.col("fp") + fn + F.col("ids")) / F.col("gt")).alias("mota"))


# ---- pair overlap --------------------------------------------------------------------------

def _common_area(ax, ay, bx, by) -> np.ndarray:
    """Twice the signed area of rings A clipped by the edges of the rings B; one row of corners for each pair."""
    x, y, n = ax, ay, np.full(len(ax), 4)
    for i in range(4):
        px, py, qx, qy = (c[:, k, None] for k in (i, (i + 1) % 4) for c in (bx, by))
        at = np.arange(x.shape[1])
        after = np.where(at + 1 < n[:, None], at + 1, 0)
        vx, vy = np.take_along_axis(x, after, 1), np.take_along_axis(y, after, 1)
        off = lambda u, w: (qx - px) * (w - py) - (qy - py) * (u - px)
        su, sv = off(x, y), off(vx, vy)
        here = at < n[:, None]
        inside_u, inside_v = here & (su >= 0), here & (sv >= 0)
        # a corner without a place is on neither side
        out_u, out_v = here & (su < 0), here & (sv < 0)
        crosses = (inside_u & out_v) | (out_u & inside_v)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = su / (su - sv)
        pair = lambda a, b: np.stack([a, b], axis=2).reshape(len(a), -1)
        given = pair(crosses, inside_v & (inside_u | out_u))
        xs, ys = pair(x + (vx - x) * t, vx), pair(y + (vy - y) * t, vy)
        n = given.sum(axis=1)
        order = np.argsort(~given, axis=1, kind="stable")[:, :max(1, n.max(initial=0))]
        x, y = np.take_along_axis(xs, order, 1), np.take_along_axis(ys, order, 1)
    twice = np.zeros(len(x))
    for j in range(x.shape[1]):
        after = np.where(j + 1 < n, min(j + 1, x.shape[1] - 1), 0)
        rows = np.arange(len(x))
        nx, ny = x[rows, after], y[rows, after]
        some = (j < n) & (n > 2)
        # in the order of a running sum, so that it ends with the same bits
        twice = np.where(some, twice + x[:, j] * ny - nx * y[:, j], twice)
    return twice


def pair_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """3-D IoU of box pairs of a frame that can touch.

    Pairs whose centres are further apart than the two half diagonals have IoU zero
    and are left out.  The footprint of A is clipped by the four edges of B, for all pairs of an
    Arrow batch at once, and the area comes from the shoelace sum.
    """
    def side(df: DataFrame, tag: str, pos: str) -> DataFrame:
        corners = geom_corners()
        return df.select("token", F.col(pos).alias(f"{tag}_pos"), F.col("x").alias(f"{tag}x"), F.col("y").alias(f"{tag}y"),
                         F.col("z").alias(f"{tag}z"), F.col("h").alias(f"{tag}h"), F.col("w").alias(f"{tag}w"),
                         F.col("l").alias(f"{tag}l"), F.col("yaw").alias(f"{tag}yaw"), corners.alias(f"{tag}c"))

    def geom_corners() -> Column:
        from kerbside.functions.geom import box_corners
        c = box_corners(F.col("x"), F.col("y"), F.col("l"), F.col("w"), F.col("yaw"))
        return F.array(*[F.struct(p.x.alias("x"), p.y.alias("y")) for p in reversed(c)])

    pairs = side(a, "a", "actor_id").join(side(b, "b", "det_pos"), "token")
    reach = (geom.hypot(F.col("aw"), F.col("al")) + geom.hypot(F.col("bw"), F.col("bl"))) / 2
    near = pairs.filter(geom.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= reach)

    overlap_of = [f"{t}{c}{i}" for t in "ab" for c in "xy" for i in range(4)]
    corner = {f"{t}{c}{i}": F.get(f"{t}c", F.lit(i))[c] for t in "ab" for c in "xy" for i in range(4)}
    kept = ["token", "a_pos", "b_pos", *[f"{t}{c}" for t in "ab" for c in ("z", "h", "w", "l")]]
    flat = near.select(*kept, *[c.alias(f"_{n}") for n, c in corner.items()])
    schema = T.StructType([*[flat.schema[c] for c in kept], T.StructField("_twice", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {n: batch.column(f"_{n}").to_numpy(zero_copy_only=False) for n in overlap_of}
            ring = lambda t: [np.stack([value[f"{t}{c}{i}"] for i in range(4)], axis=1) for c in "xy"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(_common_area(*ring("a"), *ring("b")))], names=schema.fieldNames())

    near = flat.mapInArrow(run, schema)
    twice = F.col("_twice")
    overlap = F.greatest(F.lit(0.0), F.least(F.col("az") + F.col("ah") / 2, F.col("bz") + F.col("bh") / 2)
                         - F.greatest(F.col("az") - F.col("ah") / 2, F.col("bz") - F.col("bh") / 2))
    inter = F.abs(twice) / 2 * overlap
    vol = F.col("aw") * F.col("al") * F.col("ah") + F.col("bw") * F.col("bl") * F.col("bh")
    sized = near.select("token", "a_pos", "b_pos", inter.alias("inter"), vol.alias("_vol"))
    return sized.select("token", "a_pos", "b_pos", "inter", (F.col("inter") / (F.col("_vol") - F.col("inter"))).alias("iou"))
