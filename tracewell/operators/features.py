"""Feature structs and vectors of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.classify import classify_token

# Names and order of the features that a learned selector reads.
NUMERIC = ("kl_expert_amateur", "expert_entropy", "amateur_entropy", "entropy_gap", "expert_top1_prob", "amateur_top1_prob", "expert_top2_margin", "expert_amateur_top1_prob_gap", "target_expert_prob", "target_amateur_prob", "target_prob_gap", "normalized_position")
TOKEN_CATEGORIES = ("number", "operator", "equals", "variable", "punctuation", "newline", "word", "space", "currency_or_unit", "final_answer_marker", "other")
STEP_TYPES = ("setup", "calculation", "transformation", "verification", "final_answer", "other")
BUCKETS = ("early", "middle", "late")
FEATURE_NAMES = (*NUMERIC, "top1_match", *[f"token_category={c}" for c in TOKEN_CATEGORIES], *[f"step_type={c}" for c in STEP_TYPES], *[f"position_bucket={b}" for b in BUCKETS])
_FLAGGED = ("number", "operator", "equals", "variable", "punctuation", "newline", "space", "currency_or_unit", "final_answer_marker")


def position_bucket(p: Column, missing: str = "unknown") -> Column:
    """early below 0.33, middle below 0.66, late from there on; ``missing`` for null."""
    return F.when(p.isNull(), missing).when(p < 0.33, "early").when(p < 0.66, "middle").otherwise("late")


def position_features(step: Column, length: Column) -> Column:
    """Step, length, their ratio (0 for an empty sequence) and the bucket as flags."""
    p = F.when(length > 0, step / length).otherwise(0.0)
    b = position_bucket(p)
    return F.struct(step.alias("step"), length.alias("sequence_length"), p.alias("normalized_position"), *[(b == x).alias(f"is_{x}") for x in BUCKETS])


def token_features(token: Column) -> Column:
    """The category of a token text and its flags."""
    c = classify_token(token)
    return F.struct(c.alias("token_category"), *[(c == x).alias(f"is_{x}") for x in _FLAGGED])


def confidence_buckets(distribution: Column) -> Column:
    """The confidence buckets a step is in; may be several. Missing values stand for zero and no match."""
    h, gap = F.coalesce(distribution["expert_entropy"], F.lit(0.0)), F.coalesce(distribution["entropy_gap"], F.lit(0.0))
    return F.array_compact(F.array(
        F.when(h <= 1.0, "low_expert_entropy").otherwise("high_expert_entropy"), F.when(gap >= 1.0, "high_entropy_gap"),
        F.when(~F.coalesce(distribution["top1_match"], F.lit(False)), "top1_mismatch"),
    ))


def feature_array(distribution: Column, category: Column, step_type: Column, position: Column) -> Column:
    """The 33 features in their fixed order; missing numbers are zero, unknown categories all zero."""
    p = F.coalesce(position, F.lit(0.0))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    nums = [F.coalesce(distribution[n], F.lit(0.0)) for n in NUMERIC[:-1]]
    t, s, b = F.coalesce(category, F.lit("other")), F.coalesce(step_type, F.lit("other")), position_bucket(p)
    return F.array(*nums, p, one(F.coalesce(distribution["top1_match"], F.lit(False))), *[one(t == x) for x in TOKEN_CATEGORIES], *[one(s == x) for x in STEP_TYPES], *[one(b == x) for x in BUCKETS])


def standardized(features: Column, means: list[float], scales: list[float]) -> Column:
    """(x - mean) / scale, position by position."""
    return F.zip_with(F.zip_with(features, F.array(*map(F.lit, means)), lambda x, m: x - m), F.array(*map(F.lit, scales)), lambda x, s: x / s)
