"""Versioned ingest: a crash between any two writes leaves nothing behind that counts."""

import pytest

from kerbside.streaming.rounds import Rounds

SCHEMA = "token string, value long"
STEPS = ["_write_new", "_write_tokens", "_commit"]


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted((r.token, r.value, r["round"], r.version) for r in df.collect())


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_lost_round_is_run_again_as_if_it_had_not_been(spark, tmp_path, step, after):
    store = Rounds(spark, str(tmp_path), SCHEMA, version="v9")
    assert store.read().collect() == [] and store.pointers() == []
    store.ingest(0, table(spark, ("a", 1), ("b", 2), ("b", 1)))
    lost = Rounds(spark, str(tmp_path), SCHEMA, version="v9")
    whole = getattr(Rounds, step)

    def broken(*args):
        if after:
            whole(lost, *args)
        raise RuntimeError("lost")

    setattr(lost, step, broken)
    with pytest.raises(RuntimeError):
        lost.ingest(1, table(spark, ("z", 9)))
    stands = step == "_commit" and after
    assert rows(store.read()) == [("a", 1, 0, "v9"), ("b", 1, 0, "v9"), *([("z", 9, 1, "v9")] if stands else [])]
    assert store.ingest(1, table(spark, ("a", 7), ("c", 3))) is not stands
    want = [("a", 1, 0, "v9"), ("b", 1, 0, "v9"), ("z", 9, 1, "v9") if stands else ("c", 3, 1, "v9")]
    assert rows(store.read()) == want and rows(store.read(as_of=0)) == want[:2]
    assert store.ingest(1, table(spark, ("q", 1))) is False and rows(store.read()) == want
    last = store.pointers()[-1]
    assert (last["parent"], last["added"], last["total"]) == (0, 1, 3) and [r.token for r in store.tokens(1).collect()] == [want[2][0]]


def test_rounds_come_in_order(spark, tmp_path):
    store = Rounds(spark, str(tmp_path), SCHEMA)
    store.ingest(3, table(spark, ("a", 1)))
    with pytest.raises(ValueError, match="round 2 comes after round 3"):
        store.ingest(2, table(spark, ("b", 1)))
    store.ingest(5, table(spark))
    assert store.pointers()[-1]["total"] == 1
