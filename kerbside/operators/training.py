"""Training rows: conversations, joins to traces and ego cache, guards, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import phrases as ph, turns
from kerbside.operators import ego


def conversation_index(frames: DataFrame) -> DataFrame:
    """Token-only training rows: two empty turns, filled when rendered."""
    empty = F.array(*[F.struct(F.lit(w).alias("from"), F.lit("").alias("value")) for w in ("human", "gpt")])
    return frames.select(
        F.concat("token", F.lit("_trajectory")).alias("qa_id"), F.col("token").alias("sample_id"),
        "split", empty.alias("conversations"))


def ego_cache(frames: DataFrame) -> DataFrame:
    """What the prompt needs per frame; ``frames`` carries his, his_diff, acc and fut."""
    command = ego.future_command(F.col("reverse"), F.element_at("fut", -1)["r"])
    return frames.select(
        F.col("token").alias("sample_id"), turns.ego_message().alias("ego_message"),
        turns.history_message().alias("his_message"), turns.mission_goal(command).alias("goal"),
        ph.waypoints_text(F.col("fut")).alias("traj_str"))


def factual_traces(traces: DataFrame) -> DataFrame:
    """Traces the base training uses: factual role (also when unset) and some text."""
    role = F.coalesce("role", F.lit("factual"))
    return traces.filter((role == "factual") & (F.coalesce("trace", F.lit("")) != ""))


def render_conversations(index: DataFrame, cache: DataFrame, traces: DataFrame) -> DataFrame:
    """Prompt and answer per row: question form, placeholder form or trajectory form."""
    t = traces.select(F.col("token").alias("sample_id"), "trace")
    joined = index.join(cache, "sample_id", "left").join(t, "sample_id", "left")
    asked = F.col("question").isNotNull() if "question" in index.columns else F.lit(False)
    question = F.col("question") if "question" in index.columns else F.lit(None).cast("string")
    missing = F.col("ego_message").isNull()
    prompt = (
        F.when(asked, turns.question_prompt(F.col("ego_message"), F.col("his_message"), question))
        .when(missing, turns.MISSING_PROMPT)
        .otherwise(turns.user_prompt(F.col("ego_message"), F.col("his_message"), F.col("goal"))))
    zero = ph.assistant_turn(F.lit(None).cast("string"), F.lit(turns.ZERO_TRAJECTORY))
    answer = (
        F.when(asked, "")
        .when(missing, zero)
        .otherwise(ph.assistant_turn(F.col("trace"), F.col("traj_str"))))
    return joined.select("qa_id", "sample_id", "split", prompt.alias("human"), answer.alias("gpt"))


def stamp_features(index: DataFrame, files: DataFrame) -> DataFrame:
    """Feature path only where the file exists; ``files`` has token and path."""
    f = files.select(F.col("token").alias("sample_id"), F.col("path").alias("feature_path"))
    return index.join(f, "sample_id", "left")


def insert_only(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append rows whose key is absent; existing rows win and a re-run changes nothing."""
    fresh = new.join(base.select(key), key, "left_anti")
    return base.unionByName(fresh)


def merge_conversations(base: DataFrame, new: DataFrame, key: str = "qa_id") -> DataFrame:
    """Insert-only merge that fails when a row to be added has no feature path."""
    fresh = new.join(base.select(key), key, "left_anti")
    checked = fresh.filter(F.assert_true(
        F.col("feature_path").isNotNull(), F.concat(F.lit("no feature path: "), F.col(key))).isNull())
    return base.unionByName(checked)


def reorder_to(reference: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples on the reference rows and their order column; absent ones stay as nulls."""
    return reference.join(samples, key, "left")


def training_guards(index: DataFrame) -> DataFrame:
    """Counts of rows that break a rule, each with one example; a clean set has zeros."""
    no_file = F.col("feature_path").isNull()
    not_train = F.col("split") != "train"
    return index.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(no_file).alias("without_feature"),
        F.min(F.when(no_file, F.col("sample_id"))).alias("feature_example"),
        F.count_if(not_train).alias("not_train"),
        F.min(F.when(not_train, F.col("sample_id"))).alias("split_example"))


def require_trainable(index: DataFrame) -> DataFrame:
    """The rows themselves, failing the job on the first one that breaks a rule."""
    fine = (
        F.assert_true(F.col("feature_path").isNotNull(), F.concat(F.lit("no feature: "), "sample_id")).isNull()
        & F.assert_true(F.col("split") == "train", F.concat(F.lit("not a train row: "), "sample_id")).isNull())
    return index.filter(fine)


def choose_candidate(candidates: DataFrame, facts: DataFrame, teacher: str) -> DataFrame:
    """First clean non-empty candidate in (round, pos) order, else the template, tagged.

    ``facts`` has token, decision, allowed and the template in ``trace``.
    """
    text = F.regexp_replace(turns.strip(F.col("text")), '^"+|"+$', "")
    named = candidates.withColumn("text", text).filter("text <> ''").join(
        facts.select("token", "decision", "allowed"), "token")
    clean = named.filter(F.size(ph.hallucinations(F.col("text"), F.col("decision"), F.col("allowed"))) == 0)
    best = clean.groupBy("token").agg(F.min_by("text", F.struct("round", "pos")).alias("_text"))
    return facts.join(best, "token", "left").select(
        "token", "decision", F.coalesce("_text", "trace").alias("trace"),
        F.when(F.col("_text").isNull(), f"{teacher}_fallback_mock").otherwise(teacher).alias("teacher"))
