"""Removal of repeats against plain brute force."""

import random
import re

import numpy as np
import pytest

from kerbside.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """(id, words, removed, kept) of each row."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (key, _), ws in zip(rows, words):
        for i in range(len(ws) - window + 1):
            if key is not None:
                w = tuple(ws[i:i + window])
                least[w] = min(key, least.get(w, key))
    out = []
    for (key, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if key is not None and least[tuple(ws[i:i + window])] < key:
                gone.update(range(i, i + window))
        out.append((str(key), len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out)


def given(seed):
    """Passages of all lengths around the window, shared by few or by a third of all rows, at any offset."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "\x0b", "a\x1cb", " ", "\x85"]
    def prose(n):
        return rng.choices(vocabulary, k=n)
    passages = [prose(n) for n in (6, 7, 11, 12, 13, 13, 14, 19, 20, 26, 60)]
    rows = []
    for i in range(150):
        ws = prose(rng.randrange(30))
        for _ in range(rng.choice([0, 1, 1, 3])):
            p = rng.choice(passages)
            a = rng.randrange(3)
            ws += p[a:len(p) - rng.randrange(2)] + prose(rng.randrange(9))
        if i % 3 == 0:
            ws += passages[8]
        rows.append((rng.randrange(-50, 200) if i % 17 else None, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(5, None), (6, ""), (7, " \n "), rows[3], rows[3], (8, "x " * 400), (9, "x " * 13), (1, "x " * 12), (2, "x"), (rows[8][0], rows[3][1])]
    return rows


@pytest.mark.parametrize("window,sizes", [(13, {}), (13, {"pack_words": 200, "part_hashes": 300}), (2, {"pack_words": 500, "part_hashes": 10**6}), (6, {"small_words": 100, "pack_words": 300})])
def test_equals_brute_force(spark, window, sizes):
    rows = given(window)
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kept string, pack int").repartition(3)
    out = repeats.without_repeats(docs, window=window, **sizes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == plain(rows, window)
    for r in out:
        runs = [(x.first, x.words) for x in r.removed]
        assert sum(n for _, n in runs) == r.n_removed and all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:]))


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_window_holds_a_whole_grid_block():
    for window in range(1, 40):
        block = (window + 1) // 2
        assert all(any(p % block == 0 and p + block <= s + window for p in range(s, s + window)) for s in range(2 * block))


def test_equal_block_hashes_do_not_remove_unequal_windows(monkeypatch, spark):
    # the worst block hash: every block hits; the windows' own keys decide
    rows = given(1)[:60]
    whole = repeats.rolling
    monkeypatch.setattr(repeats, "rolling", lambda h, width, factor: np.zeros(max(len(h) - width + 1, 0), np.uint64) if width == 7 else whole(h, width, factor))
    pack = repeats.Pack([r[0] for r in rows], [(r[1] or "").encode() for r in rows], [1] * len(rows))
    anchors = repeats.Anchors(pack, 7)
    found = repeats.Windows(pack, anchors, np.ones(len(anchors.hash), bool), 13, 7)
    assert len(found.at) == int(pack.inside(13).sum())


def test_one_giant_row(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "head " + long[-5000:])], "doc_id long, text string")
    out = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert out[1].n_removed == 0 and out[2].kept.split()[:1] == ["head"] and out[2].n_words - out[2].n_removed <= 2


def test_parts_and_packs_grow_with_the_corpus():
    for words in (1, 10**6, 10**9, 10**11, 2 * 10**13):
        packs, parts = repeats.sizes(words, repeats.PACK_WORDS, repeats.PART_HASHES, repeats.SMALL_WORDS)
        assert words / packs / parts >= 60 or parts == 1 or words <= 10**9
        assert words / packs <= 30 * 10**6 and words / parts <= 70 * 10**6
