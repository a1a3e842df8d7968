"""Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kerbside.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows, fan):
    """(leaf, subroot, root, text of the proof) of each row."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    leaf = [digest(*[field(r[c]) for c in COLUMNS]) for r in rows]
    proof = [[] for _ in rows]

    def tree(nodes, members):
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), fan):
                run = nodes[i:i + fan]
                for j, under in enumerate(members[i:i + fan]):
                    for m in under:
                        proof[m] += run[:j] + run[j + 1:]
                up.append((digest(*run), sum(members[i:i + fan], [])))
            nodes, members = [h for h, _ in up], [m for _, m in up]
        return nodes[0]

    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r["lang"], []).append(i)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = []
    for g in order:
        groups[g].sort(key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf[i]))
        subroots.append(tree([leaf[i] for i in groups[g]], [[i] for i in groups[g]]))
    root = tree(subroots, [groups[g] for g in order])
    at = {i: s for g, s in zip(order, subroots) for i in groups[g]}
    return sorted((str(rows[i]["doc_id"]), leaf[i], at[i], root, "".join(proof[i])) for i in range(len(rows)))


def built(docs, **how):
    leaf = merkle.leaf_hash(*[F.col(c) for c in COLUMNS])
    return merkle.manifest(docs, leaf, "lang", ["doc_id"], [F.col("doc_id")], **how)


def found(docs, **how):
    out = built(docs, **how).withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("p", merkle.proof_text(F.col("proof"))).collect()
    assert all(r.back == r.root for r in out)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in out)


@pytest.mark.parametrize("fan,digits", [(2, 2), (3, 1), (2, 10)])
def test_equals_plain_tree_with_nulls_ties_repeats_and_clashing_names(spark, fan, digits):
    rows = [(i * 7 % 23, "t" * (i % 5), ["en", "de", None, "", "é"][0 if i % 3 else i % 5], None if i % 4 else "s", None if i % 6 else i, "x", "y") for i in range(41)]
    rows += [(None, "a", "en", None, 3, "x", "y"), (None, None, "en", None, 3, "x", "y"), rows[3], rows[3], (5, "ß\x00" * 5000, "de", "s", 2**63 - 1, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, fan=fan, digits=digits) == plain([r.asDict() for r in docs.collect()], fan)


def test_one_row_is_its_own_root_and_an_empty_table_has_none(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, "x", "y")], SCHEMA)
    row = built(docs).first()
    assert row.leaf == row.subroot == row.root and row.proof == []
    assert built(docs.where("false")).collect() == []


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(i, "a", "en", "s", i, "x", "y") for i in range(20)], SCHEMA)
    leaf = merkle.leaf_hash(*[F.col(c) for c in COLUMNS])
    bad = merkle.leaf_hash(*[F.when(F.col("doc_id") == 7, 99).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in COLUMNS])
    out = merkle.manifest(docs, leaf, "lang", ["doc_id"], [F.col("doc_id"), bad.alias("given")], digits=3)
    wrong = out.where(merkle.fold(F.col("given"), F.col("proof")) != F.col("root")).collect()
    assert [r.doc_id for r in wrong] == [7]
