"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree on at least ``blocks - radius`` of
``blocks`` bit blocks, so each choice of that many blocks gives one table of buckets and every link lies
in some bucket.  Within a bucket a BK-tree (children keyed by the whole-number Hamming distance to
their parent) is searched along the edges within the radius.  A bucket beyond ``shard`` members is dealt into
shards; each pair of shards is one tree and one bounded set of queries, so no task holds a hot bucket.
Only a spanning star of each local component leaves a task, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import components, local_labels, map_rows, staged, whole_groups

RADIUS, SHINGLE, BLOCKS, SHARD = 4, 4, 6, 256
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, signed: bit set if set in over half the shingle hashes; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    ones = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8")
    for at in range(0, len(packed), 4096):
        ones += np.unpackbits(packed[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Every row (of it ``keep``, by default all but the text) with its ``fp`` (long); a null text counts as empty."""
    return map_rows(docs, lambda texts: [(fingerprint(t, shingle),) for t in texts], text, "fp long", keep)


class Forest:
    """BK-trees of many groups at once; ``group`` numbers the groups 0, 1, ... and is sorted."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, groups: int):
        self.fp = fp
        self.root = np.full(groups, -1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([], dtype=int)
        self.root[group[first]] = first
        rest = np.setdiff1d(np.arange(len(group)), first, assume_unique=True)
        at = self.root[group[rest]]
        keys, children = [], []
        while len(rest):
            key = at * 128 + np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
            # the first row of each (node, distance) becomes the child, the others go below it
            edge, lead, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(rest[lead])
            at = rest[lead][back]
            stay = np.ones(len(rest), dtype=bool)
            stay[lead] = False
            rest, at = rest[stay], at[stay]
        self.keys = np.concatenate(keys) if keys else np.array([], dtype=np.int64)
        self.children = np.concatenate(children) if children else np.array([], dtype=np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[order], self.children[order]

    def search(self, group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (query index, node index) at ``radius`` or less, for queries in blocks."""
        for start in range(0, len(fp), 4096):
            q = np.arange(start, min(start + 4096, len(fp)))
            node = self.root[group[q]]
            q, node = q[node >= 0], node[node >= 0]
            while len(q):
                d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                low = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 128 + np.minimum(d + radius, 64), "right")
                n = high - low
                total = int(n.sum())
                begin = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
                q, node = np.repeat(q, n), self.children[begin + np.arange(total)]


def bucket_links(t: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the local components of every (key, one, two) group of ``t``."""
    key, one, two, own = (t.column(c).to_numpy() for c in ("key", "one", "two", "own"))
    fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    new = np.r_[True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    keep = np.flatnonzero(size[group] > 1)
    tree = keep[own[keep] == one[keep]]
    ask = keep[own[keep] == two[keep]]
    forest = Forest(group[tree], fp[tree], len(size))
    a, b = [], []
    for q, node in forest.search(group[ask], fp[ask], radius):
        a.append(ask[q])
        b.append(tree[node])
    if not a:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    away = a != b
    label = local_labels(len(fp), a[away], b[away])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def block_keys(fp, radius: int, blocks: int):
    """Array of bucket keys, one per choice of ``blocks - radius`` blocks; each holds the table's number on top."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for i in chosen:
            width = edge[i + 1] - edge[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect the distinct ``fp`` within ``radius`` as all such pairs would."""
    if not radius < blocks:
        raise ValueError("blocks must be more than radius")
    rows = prints.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    shards = F.coalesce(F.ceil(F.col("n") / shard), F.lit(1)).cast("int")
    dealt = rows.join(hot, "key", "left").select("fp", "key", shards.alias("s"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    pairs = dealt.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    pairs = pairs.select("fp", "key", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    pairs = pairs.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")

    def run(batches):
        for t in whole_groups(batches, ["key", "one", "two"]):
            a, b = bucket_links(t, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    prints.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    shingle: int = SHINGLE, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable over fingerprint links.

    Null text: empty, so fingerprint 0, linked like any other.  Repeated rows and ids each give a row.  A
    null id takes part but never names a component (null only where no row of the component has an id).
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = staged(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", shingle))
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = components(links(prints.select("fp"), radius, blocks, shard))
    named = prints.join(comp.withColumnRenamed("v", "fp"), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    roots = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "c").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
                blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays.

    Of repeated rows one stays.  Null text is empty; a null id stays only where no row of its component has an id.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("uid"))
    # once written, the numbers of the rows hold
    rows = staged(fingerprints(marked, "t", shingle, ["row", "id", "uid"]))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid")).alias("first")
    prints = rows.groupBy("fp").agg(first)
    comp = components(links(prints.select("fp"), radius, blocks, shard))
    named = prints.join(comp.withColumnRenamed("v", "fp"), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    stays = named.groupBy("c").agg(F.min("first").alias("first")).select("first.uid")
    return rows.join(stays, "uid", "left_semi").select("row.*")


def fp_hex(fp):
    """16 lowercase hex digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
