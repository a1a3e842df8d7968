"""SimHash: fingerprints, links and components against plain brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kerbside.llm import simhash
from kerbside.llm.common import components


def plain_fp(text, k=4):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=4):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_equals_plain():
    for t in ["", " \n", "One", "a b c", "A b C d", "É b c d\x0be f g", "x " * 9000, "ß   a b c d"]:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fp(t)


@pytest.mark.parametrize("shard", [4, 256])
def test_components_equal_brute_force(spark, shard):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            v = base
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            rows.append(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(set(rows))]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    comp = {r.v: r.c for r in components(simhash.links(prints, shard=shard)).collect()}
    want = plain_components(signed, [v & (2**64 - 1) for v in signed])
    assert [comp.get(v, v) for v in signed] == want


def test_whole_operator_with_nulls_repeats_and_extra_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night falls over the hills " * 3
    rows = [(1, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, None), (7, None, "a"), (8, "", "b"), (9, "unlike all", "c"),
            (5, text.upper(), "d"), (11, "z " * 30000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()))
    fps = [plain_fp(r[1]) for r in rows]
    want = sorted((r[0] is None, r[0] or 0, f, c) for r, f, c in zip(rows, fps, plain_components([r[0] for r in rows], fps)))
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_search_finds_every_link():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**20, 600).astype(np.uint64))
    n = len(fp)
    t = pa.table({"key": np.zeros(n, np.int64), "one": np.zeros(n, np.int32), "two": np.zeros(n, np.int32),
                  "own": np.zeros(n, np.int32), "fp": fp.view(np.int64)})
    found = set()
    forest = simhash.Forest(np.zeros(n, np.int64), fp, 1)
    for q, node in forest.search(np.zeros(n, np.int64), fp, 4):
        found |= set(zip(q.tolist(), node.tolist()))
    want = {(i, j) for i in range(n) for j in range(n) if int(fp[i] ^ fp[j]).bit_count() <= 4}
    assert found == want
    assert len(simhash.bucket_links(t, 4)[0]) <= n
