"""Registered queries against their SQL on the smallest data, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# one per family; the driver's check covers all of them
SAMPLE = ["b12_box_to_global", "e2_annotation_chain", "e5_future_local", "j1_extract_fact", "f6_l2_by_gear",
          "d17_confidence_match", "n6_padded_partition", "d19_layers_on_point", "t18_loss_spans"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(str(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(str(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["e5_future_local", "j1_extract_fact", "d17_confidence_match", "k1_occupancy_raster"])
def test_no_single_partition_exchange(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
