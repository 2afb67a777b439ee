"""Aggregated reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.dist import filtered_size
from tracewell.operators.budget import common_text
from tracewell.operators.features import position_bucket
from tracewell.operators.project import sample_metadata
from tracewell.operators.ranking import ranked
from tracewell.operators.records import finite_or_null


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group``, ``median``: exact medians; null and NaN are left out, a group without values has no row.

    A global sort gives each value its place, so a group's values are never all in one task.
    """
    places = ranked(df.select(*group, finite_or_null(F.col(value)).alias("_v")).where("_v is not null"), group, [F.col("_v")], "_at", "_of")
    middle = places.where("_at in (floor((_of + 1) / 2), floor((_of + 2) / 2))")
    return middle.groupBy(*group).agg(F.avg("_v").alias("median"))


def _one_median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row with the median, null of nothing."""
    return medians(df.select(value.cast("double").alias("_x")), [], "_x").agg(F.max("median").alias(name))


def summary(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``metric``, ``n``, ``mean``, ``median`` (exact), ``min``, ``max``; null and NaN are left out, of nothing all is null."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), finite_or_null(c.cast("double")).alias("v")) for n, c in columns.items()])).alias("x")).select("x.*")
    base = long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return base.join(medians(long, ["metric"], "v"), "metric", "left").select("metric", "n", "mean", "median", "min", "max")


def mixed_totals(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: records of either kind and the rate of candidates with the fixed flag (null without any)."""
    both = candidates.select(F.lit(1).alias("c"), F.coalesce("fixed_kl_selected", F.lit(False)).cast("int").alias("f")).union(samples.select(F.lit(0), F.lit(0)))
    return both.agg(F.count("*").alias("total_records"), F.coalesce(F.sum("c"), F.lit(0)).alias("candidate_records"), (F.count("*") - F.coalesce(F.sum("c"), F.lit(0))).alias("selected_sample_records"), F.try_divide(F.sum("f"), F.sum("c")).alias("selection_rate"))


def reasons(decided: DataFrame) -> DataFrame:
    """``reason``, ``n`` over all candidates, selected or not."""
    return decided.groupBy(F.col("decision.reason").alias("reason")).agg(F.count("*").alias("n"))


def selection_summary(decided: DataFrame, size: Column) -> DataFrame:
    """One row: candidates, selected, rate (0 without any), target tokens and divergence of the selected."""
    sel = F.col("decision.selected")
    v = F.when(sel, finite_or_null(F.col("decision.score")))
    base = decided.agg(
        F.count("*").alias("candidates_seen"), F.count_if(sel).alias("selected"), F.coalesce(F.try_divide(F.count_if(sel), F.count("*")), F.lit(0.0)).alias("selection_rate"),
        F.coalesce(F.sum(F.when(sel, size)), F.lit(0)).alias("target_tokens"), F.avg(v).alias("score_mean"),
    )
    return base.crossJoin(_one_median(decided, v, "score_median"))  # one row each


def milestone(decided: DataFrame, cutoff: int | None, order: str) -> DataFrame:
    """One row per selector: samples before and after the vocabulary filter, tokens, rate, divergence, commonest categories."""
    d = decided.withColumn("_z", filtered_size(F.col("contrastive_target"), cutoff)).withColumn("_ok", F.col("decision.selected") & (F.col("_z") > 0))
    v = F.when(F.col("_ok"), finite_or_null(F.col("distribution_features.kl_expert_amateur")))
    base = d.groupBy("selector").agg(
        F.count_if("_ok").alias("samples"), F.count_if(F.col("decision.selected")).alias("samples_before_vocab_filter"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_z"))), F.lit(0)).alias("target_tokens"),
        (F.count_if("_ok") / F.count("*")).alias("selection_rate"), F.coalesce(F.avg(v), F.lit(0.0)).alias("kl_mean"),
    ).withColumn("samples_dropped_by_vocab_filter", F.col("samples_before_vocab_filter") - F.col("samples"))
    mid = medians(d.select("selector", v.alias("_v")), ["selector"], "_v").withColumnRenamed("median", "kl_median")
    base = base.join(mid, "selector", "left").withColumn("kl_median", F.coalesce("kl_median", F.lit(0.0)))
    kept = d.where("_ok")
    for name, c in (("main_token_types", "token_features.token_category"), ("main_step_types", "step_features.step_type")):
        text = common_text(kept.select("selector", F.col(c).alias("v"), order), ["selector"], "v", order).withColumnRenamed("text", name)
        base = base.join(text, "selector", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return base


def sample_summary(samples: DataFrame) -> DataFrame:
    """One row: records, prompts, mean records per prompt, divergence, target tokens."""
    v = finite_or_null(F.col("kl_divergence"))
    z = F.size("token_ids")
    base = samples.agg(
        F.count("*").alias("records"), F.count_distinct("prompt_id").alias("prompts"), F.coalesce(F.try_divide(F.count("prompt_id"), F.count_distinct("prompt_id")), F.lit(0.0)).alias("records_per_prompt_mean"),
        F.avg(v).alias("kl_mean"), F.min(v).alias("kl_min"), F.max(v).alias("kl_max"), F.coalesce(F.sum(z), F.lit(0)).alias("target_tokens_total"), F.coalesce(F.avg(z), F.lit(0.0)).alias("target_tokens_mean"),
    )
    return base.crossJoin(_one_median(samples, v, "kl_median"))  # one row each


def supporting_statistics(log: DataFrame, confident: float = 1.0, uncertain: float = 3.0, tail: float = 1.0) -> DataFrame:
    """One row: ratios (per cent) and mean divergence of top-1 match, mismatch, confidence mismatch and tail.

    Bounds are strict. A null or NaN divergence counts in the totals but in no mean.
    """
    k = finite_or_null(F.col("kl_divergence"))
    match = F.col("expert_top1_token").eqNullSafe(F.col("amateur_top1_token"))
    conf = (F.col("expert_entropy") < confident) & (finite_or_null(F.col("amateur_entropy")) > uncertain)
    pct = lambda c: F.coalesce(F.try_divide(F.count_if(c) * 100.0, F.count("*")), F.lit(0.0))
    mean = lambda c: F.avg(F.when(c, k))
    return log.agg(
        F.count("*").alias("total"), pct(match).alias("match_pct"), mean(match).alias("match_kl"), pct(~match).alias("mismatch_pct"), mean(~match).alias("mismatch_kl"),
        F.count_if(conf).alias("confidence_mismatch"), mean(conf).alias("confidence_mismatch_kl"), F.count_if(k > tail).alias("high_kl"), pct(k > tail).alias("high_kl_pct"),
    )


def histogram(values: DataFrame, column: str, width: float = 0.1, bins: int = 50) -> DataFrame:
    """``bin``, ``n``, ``pct``: all bins from 0, the overflow bin (also NaN), and any negative bin there is.

    Nulls are no values. Bins are floor(v / width) in floating point.
    """
    v = F.col(column)
    b = F.when(F.isnan(v) | (v >= width * bins), F.lit(bins)).otherwise(F.floor(v / F.lit(width).cast("double"))).cast("long")
    c = values.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    spine = values.sparkSession.range(bins + 1).select(F.col("id").alias("bin"))
    from pyspark.sql import Window

    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per bin
    return spine.join(c, "bin", "full_outer").fillna(0, ["n"]).withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, whole), F.lit(0.0)))


def accuracy(outputs: DataFrame, by: list[str]) -> DataFrame:
    """``total``, ``correct``, ``accuracy`` per group; a null mark is wrong."""
    ok = F.coalesce("correct", F.lit(False))
    return outputs.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.avg(ok.cast("double")).alias("accuracy"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature``, ``mean``, ``scale``: mean and population deviation, a zero deviation as one."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite_or_null(F.col(c).cast("double")).alias("v")) for c in columns])).alias("x")).select("x.*")
    s = F.stddev_pop("v")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.when(s == 0, 1.0).otherwise(s).alias("scale"))


def run_counters(ledger: DataFrame) -> DataFrame:
    """One row of counters over a run's ledger: processed, accepted, rejected by reason, candidates written."""
    r = lambda x: F.count_if(F.col("rejection_reason").eqNullSafe(x))
    return ledger.agg(F.count("*").alias("processed"), F.count_if("accepted").alias("accepted"), r("incorrect").alias("rejected_incorrect"), r("degenerate").alias("rejected_degenerate"), F.coalesce(F.sum("num_candidates"), F.lit(0)).alias("candidates_written"))


def _mixed(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Candidates and selected samples in one form: the values of the counters and of the metrics, null where a kind has none."""
    d = F.col("distribution_features")
    flag = F.coalesce("fixed_kl_selected", F.lit(False))
    text = lambda c: F.coalesce(c, F.lit("None"))
    yes = lambda c: F.when(c, "True").otherwise("False")
    a = candidates.select(
        text(F.col("token_features.token_category")).alias("token_categories"), text(F.col("step_features.step_type")).alias("step_types"), position_bucket(F.col("normalized_position")).alias("prefix_position_buckets"),
        F.lit(None).cast("string").alias("selector_names"), yes(flag).alias("fixed_kl_selected_flags"), yes(F.coalesce(d["top1_match"], F.lit(False))).alias("top1_match_flags"),
        F.when(flag, "fixed_kl_selected").otherwise("fixed_kl_rejected").alias("selected_by_rule"), d["kl_expert_amateur"].alias("kl"), *[d[m].alias(m) for m in ("expert_entropy", "amateur_entropy", "entropy_gap")],
    )
    m = sample_metadata(samples)
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    b = m.select(
        F.col("token_category").alias("token_categories"), F.col("step_type").alias("step_types"), F.lit("unknown").alias("prefix_position_buckets"), F.col("selector_name").alias("selector_names"),
        *none("string", "fixed_kl_selected_flags", "top1_match_flags", "selected_by_rule"), F.col("kl_divergence").alias("kl"), *none("double", "expert_entropy", "amateur_entropy", "entropy_gap"),
    )
    return a.unionByName(b)


COUNTERS = ("token_categories", "step_types", "prefix_position_buckets", "selector_names", "fixed_kl_selected_flags", "top1_match_flags", "selected_by_rule")


def selection_counters(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """``counter``, ``value``, ``n``: the seven counters over candidates and selected samples, in one pass."""
    mixed = _mixed(candidates, samples)
    long = mixed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in COUNTERS])).alias("x")).select("x.*")
    return long.where("value is not null").groupBy("counter", "value").agg(F.count("*").alias("n"))


def selection_summaries(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """The four summaries: divergence over candidates and samples, entropies and their gap over candidates."""
    return summary(_mixed(candidates, samples), {m: F.col(m) for m in ("kl", "expert_entropy", "amateur_entropy", "entropy_gap")})
