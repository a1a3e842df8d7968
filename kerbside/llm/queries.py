"""The registered queries ``opN_*``: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import alignment, bpe, embeddings, html, importance, merkle, mixing, oracles, pii, quality_rules, repeats, resharding, secrets, simhash
from kerbside.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


@query
def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("kb_base", 256).alias("base_sha256"), F.col("kb_spans").alias("spans"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op8_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resharding.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


@query
def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Target shares of the tokens for the query of operator 10.
TARGETS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.rates(docs, table(spark, sf_dir, "labels"), TARGETS, keep_text=False)
    return out.select("doc_id", "source", F.col("kb_tokens").alias("n_tokens"), *[F.col(f"kb_p.{k}").alias(f"p_{k}") for k in mixing.DOMAINS],
                      F.col("kb_rate").alias("rate"), F.col("kb_copies").alias("copies"))


#: Columns of a leaf, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op13_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = merkle.leaf_hash(*[F.col(c) for c in LEAF])
    # a decimal, so that the largest long has a successor
    more = F.when(F.col("tampered"), F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    tampered = merkle.leaf_hash(*[more if c == "n_chars" else F.col(c) for c in LEAF])
    docs = docs.withColumn("tampered", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False)))
    out = merkle.manifest(docs, given, "lang", ["doc_id"], [F.col("doc_id"), tampered.alias("given")])
    out = out.withColumn("folded_root", merkle.fold(F.col("given"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op11_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = alignment.scored(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
