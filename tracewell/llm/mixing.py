"""Problem 9: mixing sources to target weights by tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.labels import label_key
from tracewell.llm.tokens import DEFAULT_VOCABULARY, encoded
from tracewell.operators.ranking import ranked
from tracewell.session import bounded, cut


def source_sizes(documents: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``source`` (as in ``targets``, null for none of them), ``tokens``, materialised.

    Null and empty texts have no tokens. A source spelled otherwise is the one it spells.
    """
    t = targets.where("source is not null").select(label_key("source").alias("_k"), F.col("source").alias("_s"))
    sized = encoded(documents.withColumn("_k0", label_key("source")), "doc_id", "text", path, True, ("_k0",))
    return cut(sized.join(bounded(t), F.col("_k0") == F.col("_k"), "left").select("doc_id", F.col("_s").alias("source"), "tokens"))


def length_counts(sized: DataFrame) -> list[tuple[str | None, int, int]]:
    """(source, tokens, documents): one entry per source and distinct length, so bounded by the longest text."""
    return [(r["source"], r["tokens"], r["n"]) for r in sized.groupBy("source", "tokens").agg(F.count("*").alias("n")).collect()]


def _parts(n: int) -> list[int]:
    """Binary parts whose sums are all numbers from 0 to ``n``."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n, k = n - out[-1], k * 2
    return out


def _exchange(take: dict[int, int], lengths: dict[int, int], gap: int, most: int) -> int:
    """Bring the sum of ``take`` nearer by up to ``gap``, changing each length by at most ``most`` documents; returns the gap left.

    A bounded knapsack over exact sums: bit sets of the reachable changes, within ``most`` times the greatest
    length either way, with documents given back or added in binary parts.
    """
    zero = max(most * max(lengths), gap)
    mask, goal, reach, trail = (1 << (2 * zero + 1)) - 1, zero + gap, 1 << zero, []
    for z in sorted(lengths, key=lambda z: (-min(take[z], lengths[z] - take[z]), z)):
        trail.append((z, reach))
        for k in _parts(min(take[z], most)):
            reach |= reach >> (z * k)
        for k in _parts(min(lengths[z] - take[z], most)):
            reach |= (reach << (z * k)) & mask
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    left = goal - at
    for z, before in reversed(trail):
        low, high = -min(take[z], most), min(lengths[z] - take[z], most)
        x = next(x for x in sorted(range(low, high + 1), key=abs) if 0 <= at - z * x <= 2 * zero and before >> (at - z * x) & 1)
        take[z] += x
        at -= z * x
    return left


def fit_budget(budget: int, lengths: dict[int, int]) -> dict[int, int]:
    """How many documents of each length come nearest to ``budget`` from below; no choice comes nearer.

    Every length first gives the whole part of its proportional number, then the largest remainders fill up,
    and knapsacks over ever larger changes close the gap. No sum can beat the greatest multiple of the
    lengths' common divisor, so reaching that is a proof. If no change of moderate size does, the lengths are
    filled from the least up, which is a vertex of the relaxed problem, and one knapsack over all changes of
    2 x (greatest length) + 2 documents is exact, as an optimum lies that near to any such vertex
    (the proximity theorem for integer programs with one row).
    """
    lengths = {z: n for z, n in lengths.items() if z > 0 and n > 0}
    own = sum(z * n for z, n in lengths.items())
    if budget >= own:
        return dict(lengths)
    if budget <= 0 or not lengths:
        return {}
    budget -= budget % math.gcd(*lengths)
    take = {z: n * budget // own for z, n in lengths.items()}
    rest = budget - sum(z * k for z, k in take.items())
    for z in sorted(lengths, key=lambda z: (-(lengths[z] * budget % own), z)):
        if z <= rest and take[z] < lengths[z]:
            take[z] += 1
            rest -= z
    for z in sorted(lengths, reverse=True):
        k = min(rest // z, lengths[z] - take[z])
        take[z] += k
        rest -= z * k
    near = 2 * max(lengths) + 2
    for most in (1, 4, 16, 64):
        if rest and most < near:
            rest = _exchange(take, lengths, rest, most)
    if rest:
        vertex, left = dict.fromkeys(lengths, 0), budget
        for z in sorted(lengths):
            vertex[z] = min(lengths[z], left // z)
            left -= z * vertex[z]
            if vertex[z] < lengths[z]:
                break
        if _exchange(vertex, lengths, left, near) < rest:
            take = vertex
    return {z: k for z, k in take.items() if k}


def mix_plan(counts: list[tuple[str | None, int, int]], targets: list[tuple[str, float, int]]) -> dict[str, dict]:
    """Per source: budget, own tokens, whole copies, and the documents of each length for the rest.

    The total size is that of all texts in the corpus; the budget of a source is its weight of it.
    """
    whole = sum(z * n for _, z, n in counts)
    plan = {}
    for source, weight, repeats in targets:
        lengths = {z: n for s, z, n in counts if s == source}
        own = sum(z * n for z, n in lengths.items())
        budget = weight * whole
        copies = min(repeats, int(budget // own)) if own else 0
        rest = int(budget) - copies * own if copies < repeats else 0
        plan[source] = {"weight": weight, "max_repeats": repeats, "budget": budget, "own": own, "whole": whole, "short": own * repeats < budget, "copies": copies, "rest": fit_budget(rest, lengths)}
    return plan


def plan_for(sized: DataFrame, targets: DataFrame) -> dict[str, dict]:
    """The plan from the sizes; the target table has one row per source and is small by definition."""
    t = [(r["source"], float(r["target_weight"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()]
    return mix_plan(length_counts(sized), t)


def mixed(sized: DataFrame, plan: dict[str, dict], seed: int = 5) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``repeats`` (>= 1) of the mixture; ties go by hash and doc_id."""
    spark = sized.sparkSession
    rows = [(s, z, k) for s, p in plan.items() for z, k in p["rest"].items()]
    extra = spark.createDataFrame(rows, "source string, tokens long, k long")
    copies = spark.createDataFrame([(s, p["copies"]) for s, p in plan.items()], "source string, copies int")
    chosen = ranked(sized.where("tokens > 0").join(bounded(copies), "source"), ["source", "tokens"], [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")])
    r = F.col("copies") + (F.col("position") <= F.coalesce("k", F.lit(0))).cast("int")
    return chosen.join(extra, ["source", "tokens"], "left").select("doc_id", "source", "tokens", r.alias("repeats")).where("repeats > 0")


def mix_report(mix: DataFrame, plan: dict[str, dict]) -> DataFrame:
    """Per source: weight wanted, own tokens, tokens mixed, share reached, and whether it falls short."""
    spark = mix.sparkSession
    t = spark.createDataFrame([(s, p["weight"], p["max_repeats"], float(p["budget"]), int(p["own"]), bool(p["short"])) for s, p in plan.items()], "source string, target_weight double, max_repeats int, target_tokens double, own_tokens long, short boolean")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("docs"))
    from pyspark.sql import Window

    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return t.join(got, "source", "left").fillna(0, ["mixed_tokens", "docs"]).withColumn("share", F.try_divide(F.col("mixed_tokens"), whole))
