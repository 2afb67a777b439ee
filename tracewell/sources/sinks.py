"""Sinks: JSON lines, partitioned output, reports as JSON, markdown and text."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write records as JSON lines, nulls included, and return their number (counted while writing)."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def fan_out(df: DataFrame, path: str, by: str = "selector") -> None:
    """One folder of JSON lines per value of ``by``, whose name is made safe."""
    from tracewell.functions.classify import safe_name

    df.withColumn(by, safe_name(F.col(by))).write.mode("overwrite").partitionBy(by).option("ignoreNullFields", "false").json(path)


def write_report(report: DataFrame | dict[str, Any], path: str) -> dict[str, Any]:
    """A one-row report as JSON with sorted keys; returns what was written."""
    made = report if isinstance(report, dict) else report.first().asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(made, indent=2, sort_keys=True, default=str) + "\n")
    return made


def markdown_rows(milestone: DataFrame) -> DataFrame:
    """``selector``, ``line``: the milestone table's lines, rates in per cent and divergences with four digits."""
    cells = ["selector", "samples", "target_tokens", F.format_string("%.2f%%", F.col("selection_rate") * 100), F.format_string("%.4f", "kl_mean"), F.format_string("%.4f", "kl_median"), "main_token_types", "main_step_types"]
    text = [F.col(c).cast("string") if isinstance(c, str) else c for c in cells]
    return milestone.select("selector", F.concat(F.lit("| "), F.array_join(F.array(*text), " | "), F.lit(" |")).alias("line"))


def case_report(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``block``: the two records of a case as JSON with a rule below."""
    return df.select(key, F.concat(F.lit("base: "), F.coalesce(F.to_json("base", {"ignoreNullFields": "false"}), F.lit("null")), F.lit("\ntuned: "), F.to_json("tuned", {"ignoreNullFields": "false"}), F.lit("\n" + "=" * 40)).alias("block"))
