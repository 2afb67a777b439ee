"""Problem 1: capping the records of dominant contributors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.labels import prompt_key, text_key
from tracewell.llm.splits import node_components
from tracewell.operators.ranking import ranked
from tracewell.operators.records import finite_or_null, one_per_key

#: Up to this rank Spark limits each group before the shuffle (its default for the threshold of group limits).
GROUP_LIMIT = 1000


def _first_ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Rows whose rank in their group is at most ``limit``, with ``_rank``.

    Small limits cut every group in each input partition before the shuffle, so a hot group sends
    few rows; larger ones use a global sort that spreads a group over partitions.
    """
    if limit <= GROUP_LIMIT:
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= limit)
    return ranked(df, by, order, "_rank", "_size").where(F.col("_rank") <= limit).drop("_size")


def stratum_quotas(counts: DataFrame, contributor: Sequence[str], cap: int, weight: Column | None = None) -> DataFrame:
    """``quota`` per contributor and stratum from their counts ``n``.

    The cap is apportioned over a contributor's strata by largest remainder, in proportion to ``weight``
    (a positive whole number; the stratum's count by default). A stratum with fewer rows than its part
    keeps them all, and its spare slots go to the others in the same proportion. Equal remainders go to
    the larger stratum, then to the lesser name. The arithmetic is exact.
    """
    exact = "decimal(38,0)"
    by = [F.col(c) for c in contributor]
    c = counts.withColumn("_w", (F.col("n") if weight is None else weight).cast("decimal(18,0)")).withColumn("_m", F.col("n").cast("decimal(18,0)"))
    rising = Window.partitionBy(*by).orderBy(F.col("n") / F.col("_w"), F.col("n"), F.col("stratum").desc())
    whole, before = Window.partitionBy(*by), rising.rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)).cast("decimal(19,0)")
    left, rest = F.lit(cap).cast("decimal(19,0)") - sum_of("_m", before), sum_of("_w", whole) - sum_of("_w", before)
    c = c.withColumn("_full", (F.col("_m") * rest).cast(exact) <= (left * F.col("_w")).cast(exact))
    # full strata form a prefix: once one is cut, all with more rows for their weight are
    c = c.withColumn("_full", F.min("_full").over(rising))
    cut_off = F.when(~F.col("_full"), F.col("_w"))
    c = c.withColumn("_left", F.greatest(F.lit(0), F.lit(cap) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("n"))).over(whole), F.lit(0))).cast("decimal(19,0)")).withColumn("_rest", sum_of(cut_off, whole))
    c = c.withColumn("_part", F.when(~F.col("_full"), F.expr("(_left * _w) div _rest")).otherwise(F.lit(0)))
    c = c.withColumn("_over", F.when(~F.col("_full"), ((F.col("_left") * F.col("_w")).cast(exact) - F.col("_part") * F.col("_rest").cast("decimal(19,0)")).cast(exact)))
    c = c.withColumn("_more", F.col("_left") - F.sum("_part").over(whole))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_over").desc_nulls_last(), F.col("n").desc(), F.col("stratum")))
    return c.select(*contributor, "stratum", "n", F.when(F.col("_full"), F.col("n")).otherwise(F.col("_part") + F.when(turn <= F.col("_more"), 1).otherwise(0)).cast("long").alias("quota"))


def cap_contributors(df: DataFrame, key: str, contributor: Sequence[str], quality: str, cap: int, stratum: str | None = None) -> DataFrame:
    """``key`` of the rows kept: at most ``cap`` per contributor, those of highest quality.

    ``df`` has one row per key. Null and NaN quality come last and are equal; ties go to the smaller
    key. With ``stratum`` the cap is apportioned over the contributor's strata first (null is a
    stratum); without, the contributor is one stratum. A null contributor is one too. A cap of zero
    keeps nothing.
    """
    if cap < 0:
        raise ValueError("cap must not be negative")
    names = [f"_c{i}" for i in range(len(contributor))]
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(contributor, names, strict=True)], finite_or_null(F.col(quality)).alias("_q"), (F.col(stratum) if stratum else F.lit(None).cast("string")).alias("stratum"))
    order = [F.col("_q").desc_nulls_last(), F.col("_key").asc_nulls_last()]
    first = _first_ranks(rows, [*names, "stratum"] if stratum else names, order, cap)
    if stratum:
        quotas = stratum_quotas(rows.groupBy(*names, "stratum").agg(F.count("*").alias("n")), names, cap)
        q = quotas.select(*[F.col(n).alias(f"_j{n}") for n in names], F.col("stratum").alias("_js"), "quota")
        on = F.col("stratum").eqNullSafe(F.col("_js"))
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"_j{n}"))
        first = first.join(q, on).where("_rank <= quota")
    return first.select(F.col("_key").alias(key))


def samples_with_prompt(samples: DataFrame, logged: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per sample_id with ``prompt``: the key of its prompt's component.

    ``problems``: id, question. A sample without an original id is known by the question in its
    prompt_id, through the problem tables. Samples with neither share the prompt null of their run.
    """
    meta = F.col("selection_metadata")
    s = one_per_key(samples, "sample_id").select(
        "sample_id", "run_id", "kl_divergence", meta["step_type"].alias("step_type"),
        F.coalesce(prompt_key(meta["original_prompt_id"]), prompt_key(F.col("prompt_id"))).alias("own"),
    )
    nodes = node_components(logged)
    known = problems.select(text_key(F.col("question")).alias("own"), prompt_key(F.col("id")).alias("id_key")).where("own is not null").groupBy("own").agg(F.min("id_key").alias("id_key"))
    keys = (
        s.select("own").where("own is not null").distinct()
        .join(known, "own", "left")
        .join(nodes.select(F.col("node").alias("own"), F.col("component").alias("c1")), "own", "left")
        .join(nodes.select(F.col("node").alias("id_key"), F.col("component").alias("c2")), "id_key", "left")
        .select("own", F.coalesce("c1", "c2", "id_key", "own").alias("prompt"))
    )
    return s.join(keys, "own", "left").drop("own")


def beyond_cap(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows that the cap lets go."""
    return rows.join(kept, key, "left_anti")


def cap_report(rows: DataFrame, kept: DataFrame, key: str, contributor: Sequence[str]) -> DataFrame:
    """Per contributor: rows, rows kept, rows that go, and its share before and after."""
    k = kept.select(F.col(key), F.lit(1).alias("_kept"))
    per = rows.join(k, key, "left").groupBy(*contributor).agg(F.count("*").alias("rows"), F.count("_kept").alias("kept"))
    return per.withColumn("dropped", F.col("rows") - F.col("kept"))
