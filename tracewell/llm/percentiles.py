"""Problem 7: exact percentiles of large columns, from daily results that can be combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.labels import canonical_label
from tracewell.operators.features import TOKEN_CATEGORIES
from tracewell.operators.ranking import block_offsets, sorted_blocks, with_offsets
from tracewell.operators.records import finite_or_null, one_per_key

METRICS = ("kl_expert_amateur", "expert_entropy", "entropy_gap")
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def daily_counts(records: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """The combinable result of single days: ``day``, ``token_category``, ``metric``, ``value``, ``n``.

    Counts of equal values lose nothing, so any union of such tables (partitions, days) gives exact
    percentiles. Null and NaN values count nowhere; categories spelled otherwise are read as the one
    they spell, and a null category is a group of its own.
    """
    d = F.col("distribution_features")
    rows = one_per_key(records.select("candidate_id", F.to_date("logged_at").alias("day"), F.col("token_features.token_category").alias("token_category"), *[finite_or_null(d[m]).alias(m) for m in metrics]), "candidate_id")
    long = rows.select("day", canonical_label(F.col("token_category"), TOKEN_CATEGORIES).alias("token_category"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) + F.lit(0.0)).alias("value")) for m in metrics])).alias("x"))
    return long.select("day", "token_category", "x.metric", "x.value").where("value is not null").groupBy("day", "token_category", "metric", "value").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, group: Sequence[str] = ("token_category", "metric"), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``group``, ``q``, ``rows``, ``value``: percentiles with linear interpolation, error zero.

    ``counts`` may hold a value several times (from several days). One global sort by group and value
    with counts per block locates the two neighbouring order statistics of each quantile; running sums
    are made only in the blocks that hold one, and a block is one partition of the sort.
    """
    group = list(group)
    merged = counts.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    blocks = sorted_blocks(merged, group, [F.col("value")])
    offsets = block_offsets(blocks, group, F.col("n"))
    h = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in quantiles]))
    totals = offsets.select(*group, F.col("_total").alias("rows")).distinct().withColumn("_x", h).select(*group, "rows", F.col("_x.q").alias("q"))
    goals = totals.withColumn("h", (F.col("rows") - 1) * F.col("q")).select(*group, "rows", "q", "h", F.explode(F.array(F.floor("h") + 1, F.ceil("h") + 1)).alias("goal")).distinct()
    on = F.col("goal").between(F.col("o._before") + 1, F.col("o._before") + F.col("o._n"))
    for g in group:
        on = on & F.col(f"g.{g}").eqNullSafe(F.col(f"o.{g}"))
    placed = goals.alias("g").join(offsets.alias("o"), on).select(*[F.col(f"g.{g}").alias(g) for g in group], "rows", "q", "h", "goal", "_pid", "_first", "_before", "_n", "_total")
    needed = placed.select(*group, "_pid", "_first", "_before", "_n", "_total").distinct()
    run = Window.partitionBy("_pid", *group).orderBy("value")
    sums = with_offsets(blocks, needed, group).withColumn("_to", F.col("_before") + F.sum("n").over(run)).withColumn("_from", F.col("_to") - F.col("n") + 1)
    hit = F.col("p.goal").between(F.col("s._from"), F.col("s._to")) & (F.col("p._pid") == F.col("s._pid"))
    for g in group:
        hit = hit & F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}"))
    stats = placed.alias("p").join(sums.alias("s"), hit).select(*[F.col(f"p.{g}").alias(g) for g in group], "p.rows", "p.q", "p.h", "p.goal", "s.value")
    low, high = F.min_by("value", "goal"), F.max_by("value", "goal")
    return stats.groupBy(*group, "q", "rows", "h").agg(low.alias("_lo"), high.alias("_hi")).select(
        *group, "q", "rows", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("h") - F.floor("h"))).alias("value")
    )
