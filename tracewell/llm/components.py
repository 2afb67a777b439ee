"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: larger (or smaller-or-equal) neighbours move to the least neighbour of a node.

    The least neighbour is an aggregate, so a node with very many links is never one collected row.
    """
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p"))
            .select("p.a", "p.b")
        )
    return moved.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node``, ``component`` (the least node) for every node of ``links`` (columns u, v).

    Links with a null end or both ends equal join nothing and are left out. Each round is
    checkpointed; the loop ends when the links are stars, which takes O(log^2 n) rounds.
    """
    links = cut(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        links = cut(_star(_star(links, True), False))
        # stars: every node has one parent, and no parent has a parent
        parents = links.select(F.col("v").alias("u")).distinct()
        loose = links.groupBy("u").count().where("count > 1").select("u").union(links.join(parents, "u", "left_semi").select("u"))
        if loose.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
