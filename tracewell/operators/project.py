"""Projections between the record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.dist import filter_target
from tracewell.operators.features import position_features, token_features

# Fixed value.
SYSTEM_PROMPT = "Please reason step by step, and put your final answer within \\boxed{}."


def word_problems(df: DataFrame) -> DataFrame:
    """id (the question), question, answer."""
    return df.select(F.col("question").alias("id"), "question", "answer")


def subject_problems(df: DataFrame, subject: str | None = None) -> DataFrame:
    """id (the problem), problem, solution, level (the subject if one is given)."""
    return df.select(F.col("problem").alias("id"), "problem", "solution", (F.lit(subject) if subject else F.col("level")).alias("level"))


def union_subjects(tables: dict[str, DataFrame]) -> DataFrame:
    """The bag union of subject tables, each with its name as level."""
    out = None
    for name, df in tables.items():
        one = subject_problems(df, name)
        out = one if out is None else out.unionByName(one)
    return out


def assembled_candidate(df: DataFrame, beta: float = 0.4) -> DataFrame:
    """A candidate record from its parts: position and token features are derived, the flag is kl >= beta."""
    kl = F.col("distribution_features.kl_expert_amateur")
    p = position_features(F.col("step"), F.col("sequence_length"))
    return df.select(
        F.lit("candidate_v1").alias("schema_version"), "prompt_id", "question", "dataset", "step", "prefix", "target_token_id", "target_token_text", "sequence_length",
        p["normalized_position"].alias("normalized_position"), p.alias("position_features"), "distribution_features", token_features(F.col("target_token_text")).alias("token_features"),
        "step_features", "contrastive_target", F.coalesce(~F.isnan(kl) & (kl >= beta), F.lit(False)).alias("fixed_kl_selected"), "expert_generation_metadata",
    )


def selected_sample(df: DataFrame, name: str | Column, score: Column, text_field: str = "question", max_token_id_exclusive: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Training samples from candidates; rows whose filtered target is empty are dropped.

    ``prompt_id`` is the text field if it isn't empty, else the candidate's prompt_id.
    """
    t = filter_target(F.col("contrastive_target"), max_token_id_exclusive)
    label = F.lit(name) if isinstance(name, str) else name
    rows = df.withColumn("_t", t).withColumn("_score", score).withColumn("_name", label).where("_t is not null")
    return rows.select(
        *keep, F.coalesce(F.nullif(F.col(text_field), F.lit("")), F.col("prompt_id")).alias("prompt_id"), "step", "prefix", F.col("_t.tokens").alias("tokens"), F.col("_t.token_ids").alias("token_ids"), F.col("_t.weights").alias("weights"),
        F.col("distribution_features.kl_expert_amateur").alias("kl_divergence"),
        F.struct(F.col("_name").alias("selector_name"), F.col("_score").alias("selector_score"), F.col("prompt_id").alias("original_prompt_id"), F.col("token_features.token_category").alias("token_category"), F.col("step_features.step_type").alias("step_type"), F.col("_t.dropped").alias("dropped_out_of_vocab_target_tokens"), F.lit(max_token_id_exclusive).cast("int").alias("max_token_id_exclusive")).alias("selection_metadata"),
    )


def example_summary(df: DataFrame, length: int = 300) -> DataFrame:
    """A short form of an evaluation output; the stored text itself stays whole."""
    return df.select("id", "question", "gold", "prediction", F.substring("response", 1, length).alias("response"))


def sample_key(df: DataFrame) -> Column:
    """What identifies a sample: prompt, step and prefix."""
    return F.struct("prompt_id", F.col("step").cast("int").alias("step"), "prefix")


def sample_metadata(df: DataFrame, default: str = "unknown") -> DataFrame:
    """selector, category and step of samples; ``default`` where there is no metadata, the text None where a value is null."""
    m = F.col("selection_metadata")
    get = lambda f: F.when(m.isNull(), default).otherwise(F.coalesce(m[f], F.lit("None")))
    return df.withColumn("selector_name", get("selector_name")).withColumn("token_category", get("token_category")).withColumn("step_type", get("step_type"))


def eval_row(df: DataFrame, gold: Column, prediction: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """An evaluation output; the id defaults to the question, correct is equality of the texts."""
    return df.select(*keep, "index", F.coalesce("id", "question").alias("id"), "question", gold.alias("gold"), prediction.alias("prediction"), F.coalesce(gold == prediction, F.lit(False)).alias("correct"), "response")


def kl_log_row(df: DataFrame, expert_text: Column, amateur_text: Column) -> DataFrame:
    """A divergence log row; the token is the expert's most likely one, texts are trimmed."""
    d = F.col("distribution_features")
    return df.select("prompt_id", "step", F.trim(expert_text).alias("token"), d["kl_expert_amateur"].alias("kl_divergence"), d["expert_entropy"].alias("expert_entropy"), d["amateur_entropy"].alias("amateur_entropy"), F.trim(expert_text).alias("expert_top1_token"), F.trim(amateur_text).alias("amateur_top1_token"))


def plain_prompt(question: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The plain-text prompt for models without a chat template."""
    return F.concat(F.lit(f"System: {system}\nUser: "), question, F.lit("\nAssistant: "))


def text_prefixes(tokens: Column) -> Column:
    """The text before each step from 1 on: the first ``step`` words."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.struct(i.alias("step"), F.array_join(F.slice(tokens, 1, i), " ").alias("prefix")))
