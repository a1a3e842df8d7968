"""The pipeline stage by stage on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from kerbside.llm.common import staged

VOCAB = [a + b + c for a in ("br", "st", "pl", "m", "t") for b in ("a", "e", "o", "ai") for c in ("nd", "rk", "ll", "se", "t")]


def prose(rng, n):
    return ". ".join(" ".join(rng.choice(VOCAB) for _ in range(9)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        t = prose(rng, rng.randint(4, 12))
        if i % 8 == 1:
            t = t.replace(" ", " moron ", 1).replace(".", " scum.", 2)
        if i % 8 == 2:
            t = " | ".join(w + "$$" for w in prose(rng, 6).split())
        rows.append((i, t))
        labels.append((i, 0 if i % 8 == 2 else 1, 1 if i % 8 == 1 else 0))
    long = prose(rng, 60)
    rows += [(1000, long), (1001, long), (1002, long.replace("Br", "Kr", 1)), (1000, long), (1100, prose(rng, 8) + " token = pl4nd9"),
             (1200, None), (1201, ""), (None, prose(rng, 9))]
    spark.createDataFrame([(d_, t, "en", "s", len(t or ""), "more") for d_, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, kb_text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder))
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    first = set(ids["quality rules"])
    assert not {i for i in range(160) if i % 8 == 2} & first and not {1200, 1201} & first
    assert {i for i in range(160) if i % 8 not in (1, 2)} <= first and None in first
    second = ids["near duplicates"]
    assert [i for i in second if i in (1000, 1001, 1002)] == [1000] and len(second) == len(set(second))
    assert first - set(second) <= {1001, 1002}
    text = {r.doc_id: r.text for r in kept["secrets"]}
    assert "pl4nd9" not in text[1100] and "[SECRET]" in text[1100] and set(ids["secrets"]) == set(second)
    fourth = set(ids["mixture"])
    assert not {i for i in range(160) if i % 8 == 1} & fourth
    assert {i for i in range(160) if i % 8 not in (1, 2)} <= fourth
    assert sorted(map(str, ids["tokens"])) == sorted(map(str, ids["mixture"])) and all(r.exact and len(r.ids) == r.n_tokens for r in kept["tokens"])


def test_run_equals_the_stages_and_takes_an_empty_table(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
