"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities, then rewrite what changes.

Documents of an old shard form blocks (rows of equal text stay in one; a block beyond its share is dealt by id into
sub-blocks).  Block sizes are summed on the cluster; the driver sees one number for each block, whose count is a
parameter.  A minimum-cost flow from old sizes to new capacities says how many bytes each old shard gives to each new one;
whole blocks are then taken in order until the flow is met.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import staged

SHARDS, OLD_SHARDS, BLOCKS, SUB_BLOCKS = 16, 12, 512, 256
#: A block beyond one in so many of a shard's bytes or rows is split.
PARTS = 64
#: Rows of equal text stay in one shard up to one in so many of its bytes.
TOGETHER = 2


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow of the whole supply to at most ``demand``; successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    if sum(supply) > sum(demand):
        raise ValueError("capacities are smaller than the bytes to place")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    high = [0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        before = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        for d, i in queue:
            dist[i] = d
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            if u < n:
                ahead = [(n + j, cost[u][j]) for j in range(m)]
            else:
                ahead = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in ahead:
                if (e := d + c + high[u] - high[v]) < dist[v]:
                    dist[v], before[v] = e, u
                    heapq.heappush(queue, (e, v))
        ends = [j for j in range(m) if room[j]]
        end = n + min(ends, key=lambda j: dist[n + j] + high[n + j])
        # only differences of potentials matter; nodes beyond the end keep theirs on its level
        for v in range(n + m):
            high[v] += min(dist[v], dist[end])
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *[flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def transfers(sizes: dict[tuple, int], old: dict[tuple, int], capacity: list[int], olds: int) -> dict[tuple, int]:
    """New shard of each block: large blocks first, at home where they fit; the others as the cheapest flow says.

    An old shard's blocks are taken from the largest on by the flow with most left; what no flow takes whole goes
    where most room is left.
    """
    placed: dict[tuple, int] = {}
    room = list(capacity)
    order = sorted(sizes, key=lambda b: (-sizes[b], b))

    def put(b: tuple, j: int) -> None:
        placed[b] = j
        room[j] -= sizes[b]

    for b in order:
        if sizes[b] * PARTS * len(capacity) <= sum(capacity):
            break
        home = old[b] if old[b] < len(room) and room[old[b]] >= sizes[b] else -1
        put(b, home if home >= 0 else max(range(len(room)), key=lambda j: (room[j], -j)))
    rest = [b for b in order if b not in placed]
    have = [0] * olds
    for b in rest:
        have[old[b]] += sizes[b]
    want = [max(r, 0) for r in room]
    want[max(range(len(want)), key=want.__getitem__)] += max(sum(have) - sum(want), 0)
    flow = min_cost_flow(have, want, [[0 if i == j else 1 for j in range(len(capacity))] for i in range(olds)])
    loose = []
    for b in rest:
        due = flow[old[b]]
        fits = [j for j in range(len(due)) if due[j] >= sizes[b]]
        if fits:
            j = max(fits, key=lambda j: (due[j], j == old[b], -j))
            due[j] -= sizes[b]
            put(b, j)
        else:
            loose.append(b)
    for b in loose:
        put(b, max(range(len(room)), key=lambda j: (room[j], j == old[b], -j)))
    return placed


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, old_shard: str | None = None,
           olds: int = OLD_SHARDS, blocks: int = BLOCKS, sub_blocks: int = SUB_BLOCKS, capacity: list[int] | None = None) -> DataFrame:
    """Every row's id, size, text_crc32, ``old``, ``shard`` and ``slot`` (gapless from 0 in a shard).

    Size: UTF-8 bytes of the text (null: none) plus 1.  ``capacity``: bytes for each new shard, near equal by
    default.  ``old_shard`` names the column with the present shard (0 .. ``olds`` - 1); without it, the layout of ``olds``
    shards by the hash of the text is taken as the present one.  Rows of equal text share a shard unless they alone exceed
    half of it.  Null ids and repeated rows are placed like others; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.xxhash64(t)
    old = F.col(f"`{old_shard}`").cast("int") if old_shard else F.pmod(F.xxhash64(digest), F.lit(olds)).cast("int")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                       digest.alias("digest"), old.alias("old"))
    rows = staged(rows.withColumn("block", F.pmod(F.shiftright("digest", 17), F.lit(blocks)).cast("int")))
    first = {(r.old, r.block): (int(r.s), int(r.n)) for r in rows.groupBy("old", "block").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    total, count = sum(s for s, _ in first.values()), sum(n for _, n in first.values())
    # blocks beyond a part of a shard are dealt by their texts, and texts beyond it by their ids
    share_s, share_n = max(total // (shards * PARTS), 1), max(count // (shards * PARTS), 1)
    large = [k for k, (s, n) in first.items() if s > share_s or n > share_n]
    key = F.array("old", "block")
    big = _listed(key, large)
    sub = F.when(big, F.pmod(F.shiftright("digest", 29), F.lit(sub_blocks))).otherwise(F.lit(-1)).cast("int")
    rows = rows.withColumn("sub", sub)
    cut = rows.where("sub >= 0").groupBy("old", "block", "sub").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    huge = [(r.old, r.block, r.sub) for r in cut.where((F.col("s") > share_s) | (F.col("n") > share_n)).collect()]
    key3 = F.array("old", "block", "sub")
    rows = rows.withColumn("part", F.when(_listed(key3, huge), F.pmod(F.xxhash64("id"), F.lit(sub_blocks))).otherwise(F.lit(-1)).cast("int"))
    return _place(rows, id_col, shards, olds, capacity)


def _listed(key, keys: list[tuple]):
    """Whether the array ``key`` is one of ``keys``, a list bounded by the number of blocks."""
    if not keys:
        return F.lit(False)
    return F.concat_ws(":", key.cast("array<string>")).isin([":".join(map(str, k)) for k in keys])


def _place(rows: DataFrame, id_col: str, shards: int, olds: int, capacity: list[int] | None) -> DataFrame:
    spark = rows.sparkSession
    names = ["old", "block", "sub", "part"]
    found = rows.groupBy(*names).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    sizes = {tuple(r[c] for c in names): int(r.s) for r in found}
    counts = {tuple(r[c] for c in names): int(r.n) for r in found}
    total = sum(sizes.values())
    even = [total // shards + (j < total % shards) for j in range(shards)]
    # the parts of one text are numbered apart, but stay together up to a share of a shard
    text_size: dict[tuple, int] = {}
    for b, s in sizes.items():
        text_size[b[:3]] = text_size.get(b[:3], 0) + s
    unit = {b: b[:3] if text_size[b[:3]] * TOGETHER * shards <= total else b for b in sizes}
    unit_size: dict[tuple, int] = {}
    for b, u in unit.items():
        unit_size[u] = unit_size.get(u, 0) + sizes[b]
    chosen = transfers(unit_size, {u: u[0] for u in unit_size}, capacity or even, olds)
    placed = {b: chosen[u] for b, u in unit.items()}
    begin, filled = {}, [0] * shards
    for b in sorted(sizes):
        begin[b] = filled[placed[b]]
        filled[placed[b]] += counts[b]
    plan = spark.createDataFrame([(*b, placed[b], begin[b]) for b in sizes], "old int, block int, sub int, part int, shard int, begin long")
    # the plan has one row for each block: its size is bounded by the parameters
    put = rows.join(F.broadcast(plan), names)
    within = Window.partitionBy(*names).orderBy(F.col("id").asc_nulls_last(), "digest")
    slot = (F.col("begin") + F.row_number().over(within) - 1).alias("slot")
    return put.select(F.col("id").alias(id_col), "size", "text_crc32", "old", "shard", slot)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of the shards that gain or lose rows under ``path``, a folder for each; ids must be unique.

    Shards whose rows all stay are left as they are on disk.
    """
    touched = placed.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("shard")).distinct()
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col).join(touched, "shard", "left_semi")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
