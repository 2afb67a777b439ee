"""One record per key from rows that may have been delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """A row per value of ``key``; rows with a null key count as one record.

    Rows delivered again carry the same values, so any of them stands for the record.
    """
    return df.dropDuplicates([key])


def finite_or_null(c: Column) -> Column:
    """``c`` with NaN as null, so that both are missing and equal."""
    return F.when(~F.isnan(c), c)
