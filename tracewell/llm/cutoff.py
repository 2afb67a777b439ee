"""Problem 6: the cutoff that keeps a target fraction of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.labels import label_key
from tracewell.operators.ranking import block_offsets, sorted_blocks, with_offsets
from tracewell.operators.records import finite_or_null, one_per_key
from tracewell.session import bounded


def scored_candidates(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``candidate_id``, ``step_type`` (as in ``targets``), ``keep_fraction``, ``score`` of each distinct candidate.

    Only candidates whose step type spells one of the targets and whose score is neither null nor NaN.
    """
    t = targets.where("step_type is not null").select(label_key("step_type").alias("_k"), "step_type", "keep_fraction")
    rows = records.select("candidate_id", label_key(F.col("step_features.step_type")).alias("_k"), finite_or_null(F.col("distribution_features.kl_expert_amateur")).alias("score"))
    return one_per_key(rows.where("_k is not null and score is not null"), "candidate_id").join(t, "_k").drop("_k")


def _want(m: str) -> str:
    return f"cast(ceil(keep_fraction * {m}) as long)"


def cutoffs(scored: DataFrame) -> DataFrame:
    """Per step type: rows ``m``, ``target`` k = ceil(fraction x m), ``cutoff`` (the k-th largest score), ``kept``.

    Rows are sorted once, globally, by type, score and identifier; block counts give each row's exact
    place. Ties at the cutoff are all kept, so ``kept`` may exceed ``target``. A type without rows, or
    with a target of zero rows, has no cutoff and isn't in the result.
    """
    group = ["step_type"]
    blocks = sorted_blocks(scored, group, [F.col("score").desc(), F.col("candidate_id")])
    offsets = block_offsets(blocks, group)
    at = with_offsets(blocks, offsets, group).withColumn("_rank", F.col("_before") + F.col("_pos") - F.col("_first") + 1)
    found = at.where(F.col("_rank") == F.expr(_want("_total"))).select("step_type", F.col("_total").alias("m"), F.col("_rank").alias("target"), F.col("score").alias("cutoff"))
    kept = blocks.join(bounded(found.select(F.col("step_type").alias("_t"), "cutoff")), F.col("step_type") == F.col("_t")).where("score >= cutoff")
    sizes = kept.groupBy("step_type").agg(F.count("*").alias("kept"))
    return found.join(sizes, "step_type")


def kept_candidates(scored: DataFrame) -> DataFrame:
    """``candidate_id`` at or above the cutoff of its type.

    The cutoffs, one row per target, are broadcast once their number is checked.
    """
    group = ["step_type"]
    blocks = sorted_blocks(scored, group, [F.col("score").desc(), F.col("candidate_id")])
    at = with_offsets(blocks, block_offsets(blocks, group), group).withColumn("_rank", F.col("_before") + F.col("_pos") - F.col("_first") + 1)
    found = at.where(F.col("_rank") == F.expr(_want("_total"))).select(F.col("step_type").alias("_t"), F.col("score").alias("_cutoff"))
    return blocks.join(bounded(found), F.col("step_type") == F.col("_t")).where("score >= _cutoff").select("candidate_id")
