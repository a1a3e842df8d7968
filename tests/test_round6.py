"""Findings of round 3 on time that were left open: corners in images, the track stream, distinct n-grams."""

import random

from pyspark.sql import functions as F

from kerbside.functions import rig
from kerbside.operators import boxes, scoring

BOX = "token string, actor_id long, x double, y double, z double, l double, w double, h double, yaw double"


def test_corners_seen_equal_the_exploded_corners_of_odd_boxes(spark):
    rng = random.Random(3)
    rows = [(f"t{n % 40}" if n % 50 else None, n % 7 if n % 33 else None, rng.uniform(-32, 32), rng.uniform(-32, 32), 0.8,
             rng.choice([0.6, 4.5, 7.0]), 2.0, rng.choice([1.6, 3.0]), rng.uniform(-3.2, 3.2)) for n in range(600)]
    odd = [("a", 1, 10.0, 0.0, 0.8, 4.5, 2.0, None, 0.1), ("b", 1, 10.0, 0.0, float("nan"), 4.5, 2.0, 1.6, 0.1), ("c", 1, 10.0, 0.0, 0.8, 4.5, 2.0, 1.6, None),
           ("d", 1, 1.5, 1.0, 0.8, 0.0, 2.0, 1.6, 0.0), ("e", 1, float("inf"), 1.0, 0.8, 4.5, 2.0, 1.6, 0.0), ("f", 1, 12.0, 0.0, 0.8, 4.5, 2.0, 1.6, 0.0)]
    df = spark.createDataFrame(rows + odd, BOX).repartition(3)
    cams = rig.extrinsics(rig.mounts(spark))
    inside = rig.in_image(*rig.project(F.col("x"), F.col("y"), F.col("z")))
    keys = ["token", "actor_id", "camera"]
    want = boxes.corners_3d(df).crossJoin(cams).where(inside).groupBy(*keys).count()
    seen = boxes.corners_seen(df, cams)
    got = seen.groupBy(*keys).agg(F.sum("corners_in"))
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    # one row for a box and a camera that shows some of it, not one for each corner and camera
    assert seen.count() <= df.count() * len(rig.MOUNTS) / 2 and seen.where("corners_in < 1").count() == 0


def test_no_box_gives_no_corners(spark):
    assert boxes.corners_seen(spark.createDataFrame([], BOX), rig.extrinsics(rig.mounts(spark))).count() == 0


def test_distinct_ngrams_of_odd_texts_equal_a_plain_count(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "aa", "b\u00e4", "1"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " \t\n", "a", "a  b", "a b\tc", "a a a a", "aa a", "a aa", "x y " * 3000]
    got = {r.n: r for r in scoring.distinct_n(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), [1, 2, 3]).collect()}
    for n in (1, 2, 3):
        words = [(t or "").split() for t in texts]
        grams = [tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1)]
        assert got[n][1:] == (len(set(grams)), len(grams), len(set(grams)) / len(grams))


def test_without_texts_there_are_no_ngrams(spark):
    for rows in ([], [(None,)], [("a",)]):
        assert sorted(scoring.distinct_n(spark.createDataFrame(rows, "text string"), [2, 3]).collect()) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)]
