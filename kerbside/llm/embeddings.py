"""Exact cosine links between vectors of one label, by dual traversal of cover trees.

Vectors of a label are dealt into chunks of bounded size: by the nearest of a bounded sample of pivots, and by hash
where a cell is larger.  Two chunks meet only if the balls around their pivots come near enough.  A task holds
two chunks, builds a cover tree for each (nested nets whose covering radii halve from level to level) and walks both at
once, dropping a pair of nodes when the distance of their centres exceeds the link distance plus both covering
radii.  What is left at the leaves is tested in double precision.  A task returns counts and a spanning star of
its links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbside.llm.common import components, local_labels, staged, whole_groups

THRESHOLD = 0.93
CHUNK, PIVOTS = 4096, 4096
TOP, FINEST = 2.0, 0.125
_SLACK = 1e-9
_DENSE = 1 << 14


class CoverTree:
    """Levels of nested centres over unit vectors ``x``; every level has a covering radius for each node."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        self.centres = [np.zeros(min(n, 1), dtype=np.int64)]
        self.parent: list[np.ndarray] = []  # of each node of a level, its node in the level above
        at = np.zeros(n, dtype=np.int64)    # node of each point in the last level
        radius = TOP / 2
        while n and radius >= FINEST:
            above = self.centres[-1]
            chosen, own = self._net(above, at, radius)
            self.parent.append(at[chosen])
            self.centres.append(chosen)
            at, radius = own, radius / 2
        self.leaf = at
        self.order = np.argsort(at, kind="stable")
        self.begin = np.searchsorted(at[self.order], np.arange(len(self.centres[-1]) + 1))
        # exact radii: how far the points below a node lie from its centre
        self.radius = []
        node = at
        for level in range(len(self.centres) - 1, -1, -1):
            far = np.zeros(len(self.centres[level]))
            if n:
                np.maximum.at(far, node, np.linalg.norm(x - x[self.centres[level][node]], axis=1))
            self.radius.insert(0, far)
            if level:
                node = self.parent[level - 1][node]
        self.kids = []
        for p, c in zip(self.parent, self.centres):
            order = np.argsort(p, kind="stable")
            self.kids.append((order, np.searchsorted(p[order], np.arange(len(c) + 1))))

    def _net(self, above: np.ndarray, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres no two of which cover each other, those of the level above first; the node of each point."""
        x, n = self.x, len(self.x)
        own = np.full(n, -1)
        chosen: list[int] = []
        limit = 1 - radius * radius / 2  # cosine at that distance
        order = np.r_[above, np.setdiff1d(np.arange(n), above)]
        for start in range(0, n, 512):
            block = order[start:start + 512]
            if chosen:
                known = np.array(chosen)
                cos = x[block] @ x[known].T
                best = cos.argmax(1)
                near = cos[np.arange(len(block)), best] >= limit
                # old centres stay centres: the nets are nested
                near &= np.arange(start, start + len(block)) >= len(above)
                own[block[near]] = best[near]
                block = block[~near]
            if not len(block):
                continue
            inner = x[block] @ x[block].T >= limit
            free = np.ones(len(block), dtype=bool)
            first = start < len(above)
            for i in range(len(block)):
                if not free[i]:
                    continue
                own[block[i]] = len(chosen)
                chosen.append(int(block[i]))
                free[i] = False
                take = free & inner[i]
                if first:
                    take &= np.arange(len(block)) >= len(above) - start
                own[block[take]] = len(chosen) - 1
                free &= ~take
        return np.array(chosen, dtype=np.int64), own


def _product(one_kids, two_kids, p: np.ndarray, q: np.ndarray):
    """All pairs of children of the node pairs (p, q), in pieces of bounded size."""
    (o1, b1), (o2, b2) = one_kids, two_kids
    n1, n2 = b1[p + 1] - b1[p], b2[q + 1] - b2[q]
    size = n1 * n2
    for i in np.flatnonzero(size > _DENSE):
        rows, cols = o1[b1[p[i]]:b1[p[i] + 1]], o2[b2[q[i]]:b2[q[i] + 1]]
        for s in range(0, len(rows), max(1, (1 << 20) // len(cols))):
            yield rows[s:s + max(1, (1 << 20) // len(cols))], cols, True
    small = np.flatnonzero((size <= _DENSE) & (size > 0))
    if len(small):
        ends = np.cumsum(size[small])
        for part in np.split(small, np.searchsorted(ends, np.arange(1 << 17, ends[-1], 1 << 17))):
            if not len(part):
                continue
            k = size[part]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            wide = np.repeat(n2[part], k)
            yield o1[np.repeat(b1[p[part]], k) + at // wide], o2[np.repeat(b2[q[part]], k) + at % wide], False


def linked(one: CoverTree, two: CoverTree, threshold: float):
    """Pairs (point of one, point of two) with cosine at ``threshold`` or more, in pieces."""
    link = np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    if not len(one.x) or not len(two.x):
        return
    p = q = np.zeros(1, dtype=np.int64)
    for level in range(1, len(one.centres)):
        c1, c2, r1, r2 = one.centres[level], two.centres[level], one.radius[level], two.radius[level]
        keep_p, keep_q = [], []
        for a, b, dense in _product(one.kids[level - 1], two.kids[level - 1], p, q):
            if dense:
                d2 = 2 - 2 * (one.x[c1[a]] @ two.x[c2[b]].T)
                i, j = np.nonzero(np.sqrt(np.maximum(d2, 0)) <= link + 1e-7 + r1[a][:, None] + r2[b][None])
                keep_p.append(a[i])
                keep_q.append(b[j])
            else:
                near = np.linalg.norm(one.x[c1[a]] - two.x[c2[b]], axis=1) <= link + r1[a] + r2[b]
                keep_p.append(a[near])
                keep_q.append(b[near])
        p = np.concatenate(keep_p) if keep_p else np.empty(0, dtype=np.int64)
        q = np.concatenate(keep_q) if keep_q else np.empty(0, dtype=np.int64)
    for a, b, dense in _product((one.order, one.begin), (two.order, two.begin), p, q):
        if dense:
            i, j = np.nonzero(one.x[a] @ two.x[b].T >= threshold)
            yield a[i], b[j]
        else:
            near = np.einsum("ij,ij->i", one.x[a], two.x[b]) >= threshold
            yield a[near], b[near]


def _unit(values: np.ndarray) -> np.ndarray:
    # scaling by the largest component first keeps very large and very small vectors finite
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def pair_links(k: np.ndarray, n: np.ndarray, x: np.ndarray, side: np.ndarray, threshold: float):
    """Of one pair of chunks (``side`` 0 and 1, or 2 for a chunk with itself): links for each item, and its star."""
    same = bool((side == 2).all())
    ones = np.arange(len(k)) if same else np.flatnonzero(side == 0)
    twos = ones if same else np.flatnonzero(side == 1)
    one = CoverTree(x[ones])
    two = one if same else CoverTree(x[twos])
    count = np.zeros(len(k), dtype=np.int64)
    a_all, b_all = [], []
    for a, b in linked(one, two, threshold):
        a, b = ones[a], twos[b]
        if same:
            away = a != b
            a, b = a[away], b[away]
            np.add.at(count, a, n[b])
        else:
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
        if len(a):
            # a star of what is linked so far replaces the pairs
            a_all.append(a)
            b_all.append(b)
            if sum(map(len, a_all)) > 1 << 20:
                label = local_labels(len(k), np.concatenate(a_all), np.concatenate(b_all))
                moved = np.flatnonzero(label != np.arange(len(k)))
                a_all, b_all = [moved], [label[moved]]
    label = local_labels(len(k), np.concatenate(a_all), np.concatenate(b_all)) if a_all else np.arange(len(k))
    return count, label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; links join rows of one label with cosine at ``threshold`` or more.

    A null label, and a vector that is null, empty, zero or holds a null or non-finite component, links with nothing;
    vectors of different lengths do not link.  Equal vectors are one item with a count, known by a 64-bit hash.  A null id
    takes part but names no component (null only where no row of the component has an id; kept is then false).  Repeated
    rows each give a row and link with each other; an empty table gives an empty result; extra columns are ignored.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), F.col(f"`{label}`").alias("label"))
    sound = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("k", F.when(F.col("label").isNotNull() & sound, F.xxhash64("label", "v")))
    items = staged(rows.where("k is not null").groupBy("k").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n")))
    group = ["label", "dim"]
    items = items.withColumn("dim", F.size("v"))
    dealt = _cells(items, chunk, pivots)
    chunks = dealt.groupBy(*group, "cell", "shard").agg(F.max("away").alias("far"), F.first("centre").alias("centre"))
    left = chunks.select(*group, *[F.col(c).alias(f"{c}1") for c in ("cell", "shard", "far", "centre")])
    right = chunks.select(*group, *[F.col(c).alias(f"{c}2") for c in ("cell", "shard", "far", "centre")])
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    reach = F.lit(float(np.arccos(threshold)) + 1e-6)
    # angles obey the triangle inequality; a chunk without a pivot is near everything
    near = F.coalesce(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) <= reach + F.col("far1") + F.col("far2"), F.lit(True))
    ahead = (F.col("cell1") < F.col("cell2")) | ((F.col("cell1") == F.col("cell2")) & (F.col("shard1") <= F.col("shard2")))
    pairs = left.join(right, group).where(ahead & near).select(*group, "cell1", "shard1", "cell2", "shard2")
    same = (F.col("cell1") == F.col("cell2")) & (F.col("shard1") == F.col("shard2"))
    ends = pairs.select(*group, F.xxhash64("label", "dim", "cell1", "shard1", "cell2", "shard2").alias("pair"), F.explode(F.when(same, F.array(
        F.struct(F.col("cell1").alias("cell"), F.col("shard1").alias("shard"), F.lit(2).alias("side")))).otherwise(F.array(
            F.struct(F.col("cell1").alias("cell"), F.col("shard1").alias("shard"), F.lit(0).alias("side")),
            F.struct(F.col("cell2").alias("cell"), F.col("shard2").alias("shard"), F.lit(1).alias("side"))))).alias("e"))
    ends = ends.select(*group, "pair", "e.cell", "e.shard", "e.side")
    met = dealt.join(ends, [*group, "cell", "shard"]).select("pair", "side", "k", "n", "v").repartition("pair").sortWithinPartitions("pair")

    def run(batches):
        for t in whole_groups(batches, ["pair"]):
            pair = t.column("pair").to_numpy()
            for part in np.split(np.arange(len(pair)), np.flatnonzero(pair[1:] != pair[:-1]) + 1):
                own = t.slice(int(part[0]), len(part)).combine_chunks()
                k, n, side = (own.column(c).to_numpy() for c in ("k", "n", "side"))
                v = own.column("v").combine_chunks()
                x = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
                count, star = pair_links(k, n, x, side, threshold)
                some = np.flatnonzero(count > 0)
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(k[star[some]]), pa.array(count[some])], names=["a", "b", "n"])

    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    found = staged(met.mapInArrow(run, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("others"))
    comp = components(found.select("a", "b"))
    known = items.select("k", "n").join(counts, "k", "left").join(comp.withColumnRenamed("v", "k"), "k", "left").select(
        "k", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("c", "k").alias("c"))
    least = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("m")).join(known, "k").groupBy("c").agg(F.min("m").alias("component_id"))
    named = known.join(least, "c").select("k", "n_links", "component_id")
    out = rows.select("id", "k").join(named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _cells(items: DataFrame, chunk: int, pivots: int) -> DataFrame:
    """Items with their cell (nearest pivot of their label, -1: none), angle to the pivot, and shard of the cell."""
    spark = items.sparkSession
    sample = items.where(F.pmod("k", F.lit(chunk)) == 0).orderBy("k").limit(pivots).select("label", "dim", "k", "v").collect()
    grouped: dict[tuple, list] = {}
    for r in sample:
        grouped.setdefault((r.label, r.dim), []).append(r)
    known = {g: (np.array([r.k for r in rs]), _unit(np.array([r.v for r in rs], dtype=np.float64))) for g, rs in grouped.items()}
    shared = spark.sparkContext.broadcast(known)  # at most ``pivots`` vectors

    def run(batches):
        for b in batches:
            cell, away = np.full(b.num_rows, -1, dtype=np.int64), np.full(b.num_rows, np.pi)
            centre: list = [None] * b.num_rows
            groups = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist()))
            vectors = b.column("v").to_pylist()
            for g in set(groups) & set(shared.value):
                ks, x = shared.value[g]
                at = [i for i, h in enumerate(groups) if h == g]
                cos = _unit(np.array([vectors[i] for i in at], dtype=np.float64)) @ x.T
                best = cos.argmax(1)
                cell[at], away[at] = ks[best], np.arccos(np.clip(cos[np.arange(len(at)), best], -1, 1))
                for i, j in zip(at, best):
                    centre[i] = x[j].tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away), pa.array(centre, pa.list_(pa.float64()))],
                                             names=[*b.schema.names, "cell", "away", "centre"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    added = spark.createDataFrame([], "cell long, away double, centre array<double>").schema
    placed = staged(items.mapInArrow(run, StructType([*items.schema, *added])))
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("held"))
    shards = F.ceil(F.col("held") / chunk).cast("int")
    return placed.join(sizes, ["label", "dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("k"), shards).cast("int")).drop("held")
