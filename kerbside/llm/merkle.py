"""Merkle manifest of a table by a rollup of nested structs.

Rows get their rank inside their group; the low digits of the rank are grouped away one after another
inside blocks of ``fan ** digits`` rows, and every grouping nests the structs of the children in the
struct of their parent.  One shuffle by (group, block) serves all digits.  What is left of a block is one
row with its whole tree, so the proofs of its leaves come from transforms of that row and one explode.  The
blocks of a group are the leaves of the next tier; only a block's path, one row for each block, is joined
back, as a row that nested all blocks would have no size bound.  The roots of the groups are one more tier.

The hash of a node is SHA-256, in lower-case hexadecimal, of its children's hashes as text, left to right.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import staged

FAN, DIGITS = 2, 10
STEP = "struct<before: array<string>, after: array<string>>"
#: Digits of a row's place in its partition, in numbers by ``monotonically_increasing_id``.
PLACE_BITS = 33


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` leads to along its proof."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")), 256))


def proof_text(steps: Column) -> Column:
    """The hashes of the siblings, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.concat(s["before"], s["after"]))), "")


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``r``, the place in their group by ``order`` from 0, and ``n``, the rows of the group.

    Rows are sorted by range over all tasks and written once; places inside a partition are shifted by the
    rows that the group has in earlier partitions, of which there is one number for each of its partitions.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    cut = staged(cut.withColumn("uid", F.monotonically_increasing_id()))
    cut = cut.withColumn("part", F.shiftright("uid", PLACE_BITS))
    pieces = cut.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("first"))
    whole = Window.partitionBy(group)
    pieces = pieces.select(group, "part", "first", F.sum("size").over(whole).alias("n"),
                           (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("before"))
    return cut.join(pieces, [group, "part"]).withColumn("r", F.col("uid") - F.col("first") + F.col("before")).drop("uid", "part", "first", "before")


def nodes_at(level: int, fan: int) -> Column:
    """Nodes of the group that stand ``level`` levels above its ``n`` leaves."""
    return F.expr(f"(n + {fan**level - 1}) div {fan**level}")


def nested(nodes: DataFrame, fan: int, digits: int) -> DataFrame:
    """(g, block, n, tree) from (g, r, n, h, row): ``digits`` digits of the rank are grouped away.

    A tree is struct<h, kids: array of child structs>, and struct<h, row> at the leaves.  A group with one node left keeps its hash.
    """
    cur = nodes.select("g", "n", "r", F.expr(f"r div {fan**digits}").alias("block"), F.struct("h", "row").alias("tree"))
    cur = cur.repartition("g", "block")
    for level in range(1, digits + 1):
        child = F.struct(F.pmod("r", F.lit(fan)).alias("digit"), "tree")
        cur = cur.groupBy("g", "block", "n", F.expr(f"r div {fan}").alias("r")).agg(F.collect_list(child).alias("kids"))
        # a run has one node for each digit, so the trees are never compared
        kids = F.transform(F.array_sort("kids", lambda a, b: (a["digit"] - b["digit"]).cast("int")), lambda k: k["tree"])
        cur = cur.select("g", "block", "n", "r", kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["h"]), "")
        h = F.when(nodes_at(level - 1, fan) > 1, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["h"])
        cur = cur.select("g", "block", "n", "r", F.struct(h.alias("h"), "kids").alias("tree"))
    return cur.select("g", "block", "n", "tree")


def opened(more: Column) -> Callable[[Column], Column]:
    """The children of an open node, each with its steps so far; ``more``: there is a step between them."""

    def children(node: Column) -> Column:
        kids = node["node"]["kids"]
        hashes = F.transform(kids, lambda k: k["h"])

        def child(k: Column, i: Column) -> Column:
            step = F.struct(F.slice(hashes, F.lit(1), i).alias("before"),
                            F.slice(hashes, i + 2, F.greatest(F.size(hashes) - i - 1, F.lit(0))).alias("after"))
            return F.struct(k.alias("node"), F.when(more, F.concat(F.array(step), node["steps"])).otherwise(node["steps"]).alias("steps"))

        return F.transform(kids, child)

    return children


def unnested(blocks: DataFrame, fan: int, digits: int) -> DataFrame:
    """(g, block, row, h, steps) for every leaf of (g, block, n, tree, up): steps from the leaf, then ``up``, those of its block."""
    cur = blocks.withColumn("open", F.array(F.struct(F.col("tree").alias("node"), F.expr(f"cast(array() as array<{STEP}>)").alias("steps"))))
    for level in range(digits - 1, -1, -1):
        cur = cur.select("g", "n", "up", "top", F.flatten(F.transform("open", opened(nodes_at(level, fan) > 1))).alias("open"))
    leaf = cur.select("g", "top", "up", F.explode("open").alias("leaf"))
    return leaf.select("g", "top", F.col("leaf.node.row").alias("row"), F.col("leaf.node.h").alias("h"), F.concat("leaf.steps", "up").alias("steps"))


def rollup(nodes: DataFrame, fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """(g, top, row, h, steps) from (g, r, n, h, row): the root of each group and the proof of each node under it."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    blocks = nested(nodes, fan, digits)
    none = F.expr(f"cast(array() as array<{STEP}>)")
    if most <= fan**digits:
        return unnested(blocks.select("g", "block", "n", "tree", F.col("tree.h").alias("top"), none.alias("up")), fan, digits)
    blocks = staged(blocks)
    upper = blocks.select("g", F.col("block").alias("r"), nodes_at(digits, fan).alias("n"), F.col("tree.h").alias("h"), F.struct("block").alias("row"))
    paths = rollup(upper, fan, digits).select("g", F.col("row.block").alias("block"), "top", F.col("steps").alias("up"))
    return unnested(blocks.join(paths, ["g", "block"]), fan, digits)


def manifest(rows: DataFrame, leaf: Column, group: str, order: Sequence[str], keep: Sequence[Column] = (), fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """Every row's ``keep`` columns with ``leaf``, ``subroot`` (of its group), ``root`` and ``proof`` (array of steps).

    Groups ascend by ``group`` as text, null first; rows ascend by ``order``, nulls first, then by leaf hash; equal rows
    are leaves of their own.  A proof leads over the subroot to the root: each step holds the hashes ``before``
    and ``after`` the node in its run, both empty for a node alone in its run.  An empty table gives an empty manifest.
    Columns are used by name only here, so none of the table's can clash.
    """
    # 1 and the text, so that null (0) is a key like any other and comes first
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    sort = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    given = [c.alias(f"k{i}") for i, c in enumerate(keep)]
    flat = rows.select(g.alias("g"), leaf.alias("h"), F.struct(*sort).alias("o"), F.struct(F.lit(0).alias("none"), *given).alias("row"))
    under = staged(rollup(ranked(flat, "g", ["o", "h"]), fan, digits))
    tops = under.select("g", "top").distinct()
    groups = ranked(tops.select(F.lit("").alias("all"), "g", "top"), "all", ["g"])
    over = rollup(groups.select(F.col("all").alias("g"), "r", "n", F.col("top").alias("h"), F.struct("g").alias("row")), fan, digits)
    over = over.select(F.col("row.g").alias("g"), F.col("top").alias("root"), F.col("steps").alias("above"))
    full = under.join(over, "g")
    names = [rows.select(c).columns[0] for c in keep]
    return full.select(*[F.col(f"row.k{i}").alias(name) for i, name in enumerate(names)], F.col("h").alias("leaf"), F.col("top").alias("subroot"),
                       "root", F.concat("steps", "above").alias("proof"))
