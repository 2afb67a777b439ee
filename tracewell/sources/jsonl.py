"""JSON lines sources with a stable order, and readers of the record types."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators.compare import last_per_key

_OBJECT = r"^\s*\{"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``ord`` (physical order in a file), ``line`` of the non-blank lines.

    The order within a file is the byte position of its splits and the position within these, so it
    needs no pass through one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    return raw.where(F.trim("line") != "").select("path", F.struct("_b", "_i").alias("ord"), "line")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't a JSON object: ``line`` and ``error``."""
    t = lines(spark, path)
    bad = ~F.col("line").rlike(_OBJECT) | F.json_object_keys("line").isNull()
    return t.where(bad).select("ord", "line", F.when(~F.col("line").rlike(_OBJECT), "not an object").otherwise("invalid JSON").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, mode: str = "strict") -> DataFrame:
    """Records of a JSON lines file, with ``ord``; blank lines are skipped.

    ``strict`` fails at run time on a line that isn't an object; ``drop`` skips such lines. A missing
    path is an empty table with ``drop``.
    """
    if mode == "drop" and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema).withColumn("ord", F.lit(None).cast("struct<_b:bigint,_i:bigint>"))
    t = lines(spark, path).withColumn("_ok", F.col("line").rlike(_OBJECT) & F.json_object_keys("line").isNotNull())
    t = t.where("_ok") if mode == "drop" else t.where(F.assert_true("_ok", F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 200))).isNull())
    return t.select("ord", F.from_json("line", schema).alias("r")).select("r.*", "ord")


def prompts(df: DataFrame, prompt_field: str = "question", id_field: str = "id", order: str = "ord", limit: int | None = None) -> DataFrame:
    """``id``, ``question``: the id is the prompt itself where it is null or empty; null prompts are an error.

    A limit of zero gives no rows.
    """
    rows = df.where(F.assert_true(F.col(prompt_field).isNotNull(), F.lit("a prompt has no text")).isNull())
    rows = rows.orderBy(order).limit(limit) if limit is not None else rows
    return rows.select(F.coalesce(F.nullif(F.col(id_field).cast("string"), F.lit("")), F.col(prompt_field)).alias("id"), F.col(prompt_field).alias("question"))


def first_rows(df: DataFrame, order: str, start: int = 0, n: int | None = None) -> DataFrame:
    """A slice by order; n of None is without end, an empty slice an error at run time is left to the caller."""
    out = df.orderBy(order).offset(start)
    return out if n is None else out.limit(n)


def processed_ids(ledger: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Distinct non-null ids of a ledger, as text."""
    return ledger.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()


def outputs(df: DataFrame, order: str) -> DataFrame:
    """Evaluation outputs by key: the id, or the index where there is none; the last row of a key counts."""
    keyed = df.withColumn("key", F.coalesce(F.col("id"), F.col("index").cast("string")))
    return last_per_key(keyed, "key", order, ["prediction", "gold", "correct"])


def checkpoint_dirs(path: str) -> list[tuple[str, int]]:
    """Directories named checkpoint-<n> and their step, in order of name."""
    found = sorted(d for d in os.listdir(path) if re.fullmatch(r"checkpoint-\d+", d))
    return [(d, int(d.rpartition("-")[2])) for d in found]


def csv_set(text: str | None) -> set[str]:
    """The trimmed, non-empty parts of a comma-separated argument."""
    return {x.strip() for x in (text or "").split(",") if x.strip()}


def token_cutoff(explicit: int | None, vocabulary_size: int | None) -> int | None:
    """The vocabulary cutoff: an explicit one goes before the tokenizer's size."""
    return explicit if explicit is not None else vocabulary_size
