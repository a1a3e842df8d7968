"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import shared_folder

ARROW_ROWS = 1000
CUT = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of one Arrow batch, so that long texts do not meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_rows(df: DataFrame, fn: Callable[[list], list], column: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """One output row per row: ``fn`` gets the texts of a batch (null: empty) and returns a tuple for each.

    The columns in ``keep`` are passed through in front of those that ``schema`` adds.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != column])
    tag = "kb_text_"
    inner = df.select(*[F.col(f"`{c}`").alias(f"kb_{i}_") for i, c in enumerate(keep)],
                      F.coalesce(F.col(f"`{column}`"), F.lit("")).alias(tag))
    added = df.sparkSession.createDataFrame([], schema).schema
    out = inner.drop(tag).schema
    for f in added:
        out = out.add(f)
    n = len(keep)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added]
        for b in batches:
            rows = fn(b.column(n).to_pylist())
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=names)

    small_batches(df.sparkSession)
    done = inner.mapInArrow(run, out)
    return done.select(*[F.col(f"kb_{i}_").alias(c) for i, c in enumerate(keep)], *added.fieldNames())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Join sorted batches into tables that never cut a run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < CUT:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1]) + 1
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, rows = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected links (a, b)."""
    label = np.arange(n)
    if not len(a):
        return label
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
    nodes = src[first]
    while True:
        least = np.minimum(label[nodes], np.minimum.reduceat(label[dst], first))
        new = label.copy()
        np.minimum.at(new, label[nodes], least)
        new[nodes] = np.minimum(new[nodes], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): (v, c), c the smallest node reachable from v.

    Labels move one hop and then jump along their own label each round, so that rounds grow with the
    logarithm of the longest chain.  A hub's rows meet pre-aggregated or in a join that can be split.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        hop = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        labels = staged(hop.join(jump, "c").select("v", "was", F.least("c", "j").alias("c")))
        if labels.where("c <> was").isEmpty():
            return labels.select("v", "c")
        labels = labels.select("v", "c")
