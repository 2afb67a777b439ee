"""Exact positions in globally sorted groups without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut


def sorted_blocks(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted and materialised ``df`` with ``_pid`` and ``_pos`` (from 0) in its block.

    The range key includes ``order``, so a group of any size spreads over as many partitions as it
    needs; the block number and the position in the block come from the stored partitions and are
    the same in every later read.
    """
    keys = [*[F.col(g) for g in group], *order]
    stored = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    return stored.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )


def block_offsets(blocks: DataFrame, group: Sequence[str], weight: Column | None = None) -> DataFrame:
    """One row per group and block: ``_first`` position, weight ``_before`` the block, group ``_total``.

    At most blocks + groups rows; the window runs over these counts only.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    by = [F.col(g) for g in group]
    counts = blocks.groupBy(*by, "_pid").agg(F.min("_pos").alias("_first"), F.sum(w).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_total", F.sum("_n").over(whole))


def with_offsets(blocks: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Blocks with the columns of their offsets; null group keys match one another."""
    o = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_pid").alias("_o_pid"), "_first", "_n", "_before", "_total")
    on = blocks["_pid"] == o["_o_pid"]
    for g in group:
        on = on & blocks[g].eqNullSafe(o[f"_o_{g}"])
    return blocks.join(o, on).drop("_o_pid", *[f"_o_{g}" for g in group])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], position: str = "position", total: str = "group_size") -> DataFrame:
    """``df`` with the exact position (from 1) of each row in its group and the size of the group.

    ``order`` must be a total order for repeatable results. An empty table gives an empty result.
    """
    blocks = sorted_blocks(df, group, order)
    out = with_offsets(blocks, block_offsets(blocks, group), group)
    return (
        out.withColumn(position, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
        .withColumnRenamed("_total", total)
        .drop("_pid", "_pos", "_first", "_n", "_before")
    )
