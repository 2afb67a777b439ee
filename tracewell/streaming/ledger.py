"""Resumable candidate logging as a stream: each batch is written once, ids go to the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_batch(batch: DataFrame, batch_id: int, candidates_path: str, ledger_path: str, make: Callable[[DataFrame], DataFrame], key: str = "prompt_id") -> None:
    """Write the candidates of a batch's new prompts and their ledger rows.

    Output goes to a folder per batch that is overwritten, so a batch repeated after a failure leaves
    no duplicates, and the ledger of earlier batches keeps processed prompts out.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    done = _read(spark, ledger_path)
    if done is not None:
        fresh = fresh.join(done.where(F.col("batch") < batch_id).select(key).distinct(), key, "left_anti")
    fresh = fresh.persist()
    made = make(fresh)
    made.write.mode("overwrite").parquet(f"{candidates_path}/batch={batch_id}")
    counts = made.groupBy(key).agg(F.count("*").alias("num_candidates"))
    fresh.select(key).join(counts, key, "left").fillna(0, ["num_candidates"]).write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
    fresh.unpersist()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and len(fs.listStatus(p)) else None


def log_candidates(spark: SparkSession, source: str, schema: StructType | str, candidates_path: str, ledger_path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], key: str = "prompt_id") -> StreamingQuery:
    """Process what is new in a folder of JSON lines and stop; a later call goes on where this one ended."""
    stream = spark.readStream.schema(schema).json(source)
    run = lambda b, i: append_batch(b, i, candidates_path, ledger_path, make, key)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gated(generations: DataFrame, system_prompt: str, require_correct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``rejection_reason``): the correctness gate, then the degeneration gate.

    ``generations``: prompt_id, question, gold_text, generation. Gold and predicted answers are
    compared as texts. The gates come before any costlier step.
    """
    from tracewell.functions.classify import degeneration_reasons, gold_answer, predicted_answer

    g = generations.withColumn("gold_answer", gold_answer(F.col("gold_text"))).withColumn("predicted_answer", predicted_answer(F.col("generation")))
    g = g.withColumn("is_correct", F.coalesce(F.col("gold_answer") == F.col("predicted_answer"), F.lit(False)))
    g = g.withColumn("degeneration_reasons", degeneration_reasons(F.col("generation"), F.col("question"), F.lit(system_prompt))).withColumn("is_degenerate", F.size("degeneration_reasons") > 0)
    wrong = ~F.col("is_correct") if require_correct else F.lit(False)
    g = g.withColumn("rejection_reason", F.when(wrong, "incorrect").when(F.col("is_degenerate"), "degenerate"))
    return g.where("rejection_reason is null"), g.where("rejection_reason is not null")


def windowed_counts(events: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Counts per time window and group with a watermark; works on batch and streaming tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
