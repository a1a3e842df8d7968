"""Corpus pipeline: quality rules, near-duplicates, secrets, mixture, tokens.

Each stage gets the rows its predecessor kept, as read back from Parquet, and returns them with the columns of
``documents``; the last returns token ids in place of the text.  Nulls, empty texts, repeated rows, empty tables and extra
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bpe, mixing, quality_rules, secrets, simhash
from kerbside.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicate stages take shingles of five words.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = docs.select(*COLUMNS)
    field = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, field, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=SHINGLE)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secrets.redact(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic text goes, good and poor text keeps its tokens: each document stays as often as its rate, rounded by its hash, says."""
    mixed = mixing.rates(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("kb_copies")))
    return mixed.where("kb_copies > 0").select(*COLUMNS, each.alias("kb_copy")).drop("kb_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and whether they decode to its text."""
    out = bpe.encode(docs.select(*COLUMNS))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The stages fit models and link over components, which SQL does not express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
