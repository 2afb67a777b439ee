"""Joins of many rows with a table of one row per key, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table (a few numbers each) that are broadcast at most.
MOST_NARROW = 500_000
#: A key is hot if it holds more than one in so many rows, so that there are at most so many of them.
HOT_PARTS = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, most: int = MOST_NARROW) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``, materialised, a few numbers wide); rows without a match go.

    A table of at most ``most`` rows, which is counted, is broadcast. For a larger one the keys that hold
    more than a thousandth of all rows (so a thousand keys at most) meet their part of the table by
    broadcast, and the others, none of which is large, by a shuffle. Null keys match nothing.
    """
    rows = rows.where(F.col(key).isNotNull())
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("_n") > total / HOT_PARTS).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    few = rows.sparkSession.createDataFrame([(h,) for h in hot], table.select(key).schema)
    warm = table.join(F.broadcast(few), key)
    return rows.join(F.broadcast(warm), key).unionByName(rows.join(F.broadcast(few), key, "left_anti").join(table, key))
