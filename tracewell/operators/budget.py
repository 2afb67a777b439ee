"""Budgets: top per cent, top n, and the greedy token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import ranked, sorted_blocks


def _score_order(score: str, tie: str) -> list[Column]:
    s = F.col(score)
    return [F.coalesce(F.when(~F.isnan(s), s), F.lit(0.0)).desc(), F.col(tie).asc_nulls_last()]


def top_percent(df: DataFrame, percent: float, score: str, tie: str) -> DataFrame:
    """The best max(1, floor(n p / 100)) rows; a null or NaN score counts as zero, ties go by ``tie``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    r = ranked(df, [], _score_order(score, tie), "_rank", "_n")
    return r.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * (percent / 100.0)))).drop("_rank", "_n")


def max_samples(df: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """The best n rows, in order."""
    return df.orderBy(*_score_order(score, tie)).limit(n)


def greedy_budget(df: DataFrame, budget: int, size: str, score: str, tie: str) -> DataFrame:
    """Rows taken from the best on while they fit; a row that doesn't fit is skipped, later ones may still.

    Exact and distributed: after a global sort, running sums over block totals find the first row that
    doesn't fit; everything before it is in, and from there on only rows of at most the remaining size
    count. Each round ends at a larger size than may come later, so there are at most as many rounds
    as distinct sizes. The driver sees one sum per block. Null sizes count as zero.
    """
    z = F.coalesce(F.col(size), F.lit(0)).cast("long")
    blocks = sorted_blocks(df.withColumn("_z", z), [], _score_order(score, tie))
    after: tuple[int, int] = (-1, -1)
    left, taken = budget, F.lit(False)
    while left >= 0:
        later = (F.col("_pid") > after[0]) | ((F.col("_pid") == after[0]) & (F.col("_pos") > after[1]))
        fits = later & (F.col("_z") <= left)
        sums = sorted((r["_pid"], r["s"]) for r in blocks.where(fits).groupBy("_pid").agg(F.sum("_z").alias("s")).collect())
        before, stop = 0, None
        for pid, s in sums:
            if before + s > left:
                stop = pid
                break
            before += s
        if stop is None:
            taken = taken | fits
            break
        run = F.sum("_z").over(Window.partitionBy("_pid").orderBy("_pos"))
        over = blocks.where(fits & (F.col("_pid") == stop)).withColumn("_run", run + before).where(F.col("_run") > left)
        row = over.orderBy("_pos").select("_pos", "_run", "_z").first()
        taken = taken | (fits & ((F.col("_pid") < stop) | ((F.col("_pid") == stop) & (F.col("_pos") < row["_pos"]))))
        left -= row["_run"] - row["_z"]
        after = (stop, row["_pos"])
    return blocks.where(taken).drop("_z", "_pid", "_pos")


def with_budgets(df: DataFrame, score: str, tie: str, size: str, percent: float | None = None, samples: int | None = None, tokens: int | None = None) -> DataFrame:
    """Per cent, then samples, then tokens, as far as they are given."""
    if percent is not None:
        df = top_percent(df, percent, score, tie)
    if samples is not None:
        df = max_samples(df, samples, score, tie)
    if tokens is not None:
        df = greedy_budget(df, tokens, size, score, tie)
    return df


def most_common(df: DataFrame, by: Sequence[str], value: str, order: str, k: int | None = None) -> DataFrame:
    """``by``, ``value``, ``n``, ``rank``: values by falling count, ties by the least ``order``.

    The window runs over the distinct values of each group only.
    """
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("n").desc(), F.col("_first"), F.col(value))
    c = c.withColumn("rank", F.row_number().over(w)).drop("_first")
    return c if k is None else c.where(F.col("rank") <= k)


def common_text(df: DataFrame, by: Sequence[str], value: str, order: str, k: int = 5) -> DataFrame:
    """``by``, ``text``: the k most common values as ``value:count`` pairs."""
    top = most_common(df, by, value, order, k)
    pair = F.struct("rank", F.concat(F.coalesce(value, F.lit("None")), F.lit(":"), F.col("n").cast("string")).alias("t"))
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ", ").alias("text"))
