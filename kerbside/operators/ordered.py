"""Ordered computations that stay parallel when one group holds most of the rows.

A plain window partitioned by scene sends a whole scene to one task.  Here every
group is cut into order-preserving pieces; windows see one piece plus a few
neighbouring rows, and totals of the (small) pieces carry across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kerbside.session import written

CHUNK = 4096


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before a step that multiplies them.

    A narrow input may sit in few files; the explicit count keeps AQE from merging the
    partitions by their small size before the fan-out.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def over_scene(
    df: DataFrame,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    group: Sequence[str] = ("scene_token",),
    order: str = "frame_idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``order`` must count 0,1,2,.. inside a group.  Rows near a cut are also sent to
    the neighbouring chunk, so each (group, chunk) window is complete, and only the
    home copy of a row is kept.  ``build`` gets the window and returns name -> Column.
    """
    if max(before, after) >= chunk:
        raise ValueError("chunk must exceed the window reach")
    pos = F.col(order)
    home = F.floor(pos / chunk)
    offset = pos % chunk
    copies = F.array(
        home,
        F.when((offset < after) & (home > 0), home - 1),
        F.when(offset >= chunk - before, home + 1),
    )
    spread = df.withColumn("_chunk", F.explode(F.array_compact(copies)))
    window = Window.partitionBy(*group, "_chunk").orderBy(order)
    added = spread.select("*", *[c.alias(n) for n, c in build(window).items()])
    return added.filter(F.col("_chunk") == home).drop("_chunk")


def ordinal(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    *,
    group: Sequence[str] = (),
    bucket: Column,
) -> DataFrame:
    """0-based position of each row inside its group, in ``order``.

    ``bucket`` must not decrease along ``order``.  Rows are numbered inside a
    (group, bucket) piece and shifted by the sizes of the earlier pieces, which are
    counted in a separate pre-aggregated pass.
    """
    keys = [*group, "_bucket"]
    cut = df.withColumn("_bucket", bucket)
    return _with_offsets(
        cut, cut, keys, group, {"_n": F.count(F.lit(1))},
        lambda w: {name: (F.row_number().over(w) - 1 + F.col("_before_n")).cast("long")},
        order,
    )


def running_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str],
    *,
    group: Sequence[str] = (),
    bucket: Column,
) -> DataFrame:
    """Inclusive running sums (new name -> source column) in ``order`` per group."""
    keys = [*group, "_bucket"]
    cut = df.withColumn("_bucket", bucket)
    totals = {f"_s{i}": F.sum(src) for i, src in enumerate(sums.values())}

    def build(w: WindowSpec) -> dict[str, Column]:
        reach = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {
            new: F.sum(src).over(reach) + F.col(f"_before_s{i}")
            for i, (new, src) in enumerate(sums.items())
        }

    return _with_offsets(cut, cut, keys, group, totals, build, order)


def _with_offsets(cut, counted, keys, group, totals, build, order) -> DataFrame:
    pieces = counted.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    offsets = _before(pieces, keys, group, list(totals))
    window = Window.partitionBy(*keys).orderBy(*order)
    joined = cut.join(offsets, keys)
    added = joined.select("*", *[c.alias(n) for n, c in build(window).items()])
    return added.drop("_bucket", *[f"_before{n}" for n in totals])


def _before(pieces: DataFrame, keys, group, totals: list[str]) -> DataFrame:
    """``_before*``: totals of the earlier pieces of the group, in two levels.

    Pieces are dealt by range of (group, bucket) and written once, so that the ranges hold.  Totals of
    ranges, a few for each task, are summed first; then pieces add up inside their range.  No task sees
    all pieces of an ungrouped order or of a large group.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(pieces.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*group, "_range").agg(*[F.sum(t).alias(t) for t in totals]).select(
        *group, "_range", *[F.coalesce(F.sum(t).over(across), F.lit(0)).alias(f"_r{t}") for t in totals])
    placed = ranged.join(ranges, [*group, "_range"])
    return placed.select(*keys, *[(F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"_r{t}")).alias(f"_before{t}") for t in totals])


def sparse_neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: str,
    prev_name: str,
    next_name: str,
    *,
    chunk: int = CHUNK,
) -> DataFrame:
    """Previous and next ``value`` per group where positions may have gaps.

    Inside a chunk plain lag/lead serve; at its ends the last and first value of the
    nearest non-empty chunks are taken from a summary with one row per chunk.
    """
    cut = df.withColumn("_bucket", F.floor(F.col(order) / chunk))
    keys = [*group, "_bucket"]
    edge = Window.partitionBy(*group).orderBy("_bucket")
    ends = (
        cut.groupBy(*keys)
        .agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
        .select(*keys, F.lag("_last").over(edge).alias("_prev_last"),
                F.lead("_first").over(edge).alias("_next_first"))
    )
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        cut.join(ends, keys)
        .withColumn(prev_name, F.coalesce(F.lag(value).over(w), F.col("_prev_last")))
        .withColumn(next_name, F.coalesce(F.lead(value).over(w), F.col("_next_first")))
        .drop("_bucket", "_prev_last", "_next_first")
    )
