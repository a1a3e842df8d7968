"""Cover-tree links against all pairs in double precision."""

import numpy as np
import pytest

from kerbside.llm import embeddings


def cloud(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    x = base[rng.integers(0, 40, n)] + rng.choice([0.0, 0.1, 0.35, 1.0], size=(n, 1)) * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dual_traversal_finds_exactly_the_links():
    x, y = cloud(1), cloud(2)
    for one, two in ((x, y), (x, x), (x[:1], y), (x[:0], y)):
        found = set()
        for a, b in embeddings.linked(embeddings.CoverTree(one), embeddings.CoverTree(two), 0.93):
            pairs = list(zip(a.tolist(), b.tolist()))
            assert not found & set(pairs)
            found |= set(pairs)
        assert found == set(map(tuple, np.argwhere(one @ two.T >= 0.93).tolist()))


def test_nets_are_nested_and_cover():
    t = embeddings.CoverTree(cloud(3))
    for level in range(1, len(t.centres)):
        assert set(t.centres[level - 1].tolist()) <= set(t.centres[level].tolist())
        assert t.radius[level].max() <= 2 * 2.0 ** (1 - level) + 1e-9  # own radius and those of the levels below


def brute(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    n = len(rows)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return [(rows[i][0], links[i], c := least.get(find(i)), rows[i][0] is not None and rows[i][0] == c) for i in range(n)]


@pytest.mark.parametrize("chunk", [16, 4096])
def test_operator_equals_brute_force(spark, chunk):
    x = np.r_[cloud(5, 250, 8), np.repeat(cloud(6, 3, 8), 30, axis=0)].astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1), (904, [], 1), (905, rows[0][1], None), (None, rows[0][1], 0),
             (906, [1.0, 2.0], 0), (907, [1.0, 2.1], 0), (0, rows[0][1], 0), (908, [float("inf")] + [1.0] * 7, 0), (None, None, None), (909, [2 * c for c in rows[3][1]], 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, k string").repartition(3)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, chunk=chunk).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
