"""Joins and set algebra between runs, vocabularies and sample files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.dist import clipped, kl
from tracewell.operators.features import confidence_buckets, position_bucket


def last_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row (by ``order``) of each key; null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def improved_cases(base: DataFrame, tuned: DataFrame, key: str) -> DataFrame:
    """``key`` of the cases right after tuning and wrong or missing before."""
    b = base.select(key, F.coalesce("correct", F.lit(False)).alias("_b"))
    return tuned.join(b, key, "left").where(F.coalesce("correct", F.lit(False)) & ~F.coalesce("_b", F.lit(False))).select(key)


def common_runs(runs: dict[str, DataFrame], key: str) -> DataFrame:
    """``key`` and a column per run (correct or not) for the keys that all runs have."""
    out = None
    for name, df in runs.items():
        one = df.select(key, F.coalesce("correct", F.lit(False)).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def run_overlap(common: DataFrame, base: str, fixed: str, rule: str) -> DataFrame:
    """One row of counts over the common keys: accuracies and the set algebra of right answers."""
    b, f, r = F.col(base), F.col(fixed), F.col(rule)
    n = F.count_if
    return common.agg(
        F.count("*").alias("total_common"), *[F.avg(c.cast("double")).alias(f"accuracy_{x}") for x, c in ((base, b), (fixed, f), (rule, r))], n(b & f & r).alias("all_correct"), n(~(b | f | r)).alias("all_wrong"),
        n(f & ~b).alias("fixed_improves_over_base"), n(b & ~f).alias("fixed_regresses_from_base"), n(r & ~b).alias("rule_improves_over_base"), n(b & ~r).alias("rule_regresses_from_base"), n(r & ~f).alias("rule_correct_fixed_wrong"), n(f & ~r).alias("fixed_correct_rule_wrong"),
    )


def run_examples(common: DataFrame, key: str, base: str, fixed: str, rule: str, k: int = 5) -> DataFrame:
    """``category``, ``key``: the first k keys, in order, of each kind of difference."""
    b, f, r = F.col(base), F.col(fixed), F.col(rule)
    kinds = {"fixed_improves_over_base": f & ~b, "fixed_regresses_from_base": b & ~f, "rule_improves_over_base": r & ~b, "rule_regresses_from_base": b & ~r, "rule_correct_fixed_wrong": r & ~f, "fixed_correct_rule_wrong": f & ~r}
    long = common.select(key, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in kinds.items()]))).alias("category"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(key))).where(F.col("rank") <= k)


def unprocessed(prompts: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Prompts that the ledger doesn't have; a null key is never processed."""
    return prompts.join(ledger.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def aligned(expert: DataFrame, amateur: DataFrame) -> DataFrame:
    """Expert step t with the amateur's position t - 1 of the same prompt."""
    a = amateur.select("prompt_id", (F.col("position") + 1).alias("step"), F.col("probabilities").alias("amateur"))
    return expert.join(a, ["prompt_id", "step"])


def overlap_of_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: distinct keys in both, in one only, and the rates (null on an empty side)."""
    both = a.select(*key).distinct().withColumn("_a", F.lit(1)).unionByName(b.select(*key).distinct().withColumn("_a", F.lit(2))).groupBy(*key).agg(F.sum("_a").alias("s"))
    n = lambda x: F.count_if(F.col("s") == x)
    return both.agg(n(3).alias("matching"), n(1).alias("original_only"), n(2).alias("selected_only"), F.try_divide(n(3), n(3) + n(1)).alias("original_overlap_rate"), F.try_divide(n(3), n(3) + n(2)).alias("selected_overlap_rate"))


def vocabulary_audit(a: DataFrame, b: DataFrame, prefix: int, shown: int = 5) -> DataFrame:
    """One row: sizes, whether the first ``prefix`` ids and all agree, the first difference, and ``shown`` differences as text.

    ``a`` and ``b``: id, token. The samples are the least ids, kept as a bounded top-k.
    """
    j = a.select("id", F.col("token").alias("ta")).join(b.select("id", F.col("token").alias("tb")), "id", "full_outer").withColumn("same", F.col("ta").eqNullSafe(F.col("tb")))
    base = j.agg(F.count("ta").alias("size_a"), F.count("tb").alias("size_b"), F.count_if(~F.col("same") & (F.col("id") < prefix)).alias("_p"), F.count_if(~F.col("same")).alias("differences"), F.min(F.when(~F.col("same"), F.col("id"))).alias("first_difference"))
    few = j.where("not same").orderBy("id").limit(shown).select("id", F.concat(F.col("id").cast("string"), F.lit(": "), F.coalesce("ta", F.lit("")), F.lit(" | "), F.coalesce("tb", F.lit(""))).alias("t"))
    sample = few.agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "; "), F.lit("")).alias("samples"))
    base = base.crossJoin(sample)  # one row each
    return base.select("samples", "size_a", "size_b", (F.col("_p") == 0).alias("prefix_equal"), ((F.col("differences") == 0) & (F.col("size_a") == F.col("size_b"))).alias("fully_equal"), "differences", "first_difference")


def shared_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """``token``, ``id_a``, ``id_b`` of the tokens in both vocabularies."""
    return a.select("token", F.col("id").alias("id_a")).join(b.select("token", F.col("id").alias("id_b")), "token")


def shared_vocabulary_kl(steps: DataFrame, a: DataFrame, b: DataFrame, key: list[str], eps: float = 1e-6) -> DataFrame:
    """``key``, ``kl`` of two distributions over different vocabularies.

    ``steps`` has ``expert`` over vocabulary ``a`` and ``amateur`` over ``b`` (id, token). Both are projected
    onto the tokens that the vocabularies share by string, renormalised, raised to ``eps`` and renormalised
    again. The alignment is one array of id pairs, as long as the vocabulary, which every row uses; null
    where no token is shared or an id is outside its distribution.
    """
    pairs = shared_vocabulary(a, b).agg(F.array_sort(F.collect_list(F.struct("id_a", "id_b"))).alias("_ids"))
    t = steps.join(F.broadcast(pairs))  # one row: the two vocabularies are bounded, whatever the number of steps
    at = lambda p, f: F.transform("_ids", lambda x: F.try_element_at(F.col(p), (x[f] + 1).cast("int")))
    norm = lambda p: clipped(clipped(p, 0.0), eps)
    return t.select(*key, kl(norm(at("expert", "id_a")), norm(at("amateur", "id_b"))).alias("kl"))


def vocabulary_difference(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """The first k tokens, in order, that only ``a`` has."""
    return a.select("token").subtract(b.select("token")).orderBy("token").limit(k)


def excluded(categories: tuple[str, ...] = (), steps: tuple[str, ...] = (), positions: tuple[str, ...] = (), confidence: tuple[str, ...] = ()) -> Column:
    """Whether a candidate is excluded: by category, step type, position (missing counts as early) or any confidence bucket."""
    out = F.lit(False)
    if categories:
        out = out | F.coalesce(F.col("token_features.token_category"), F.lit("unknown")).isin(*categories)
    if steps:
        out = out | F.coalesce(F.col("step_features.step_type"), F.lit("unknown")).isin(*steps)
    if positions:
        out = out | position_bucket(F.col("normalized_position"), "early").isin(*positions)
    if confidence:
        out = out | F.arrays_overlap(confidence_buckets(F.col("distribution_features")), F.array(*map(F.lit, confidence)))
    return out
