"""Schema contracts and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The required fields and the version of the contracts.
SAMPLE_FIELDS = ("prompt_id", "step", "prefix", "tokens", "token_ids", "weights", "kl_divergence")
CANDIDATE_FIELDS = ("schema_version", "prompt_id", "step", "prefix", "distribution_features", "token_features", "step_features", "contrastive_target")
TARGET_FIELDS = ("token_ids", "tokens", "weights")
CANDIDATE_VERSION = "candidate_v1"
DTYPES = {"float32": "float32", "fp32": "float32", "float": "float32", "bfloat16": "bfloat16", "bf16": "bfloat16", "float16": "float16", "fp16": "float16", "half": "float16", "auto": "auto"}


def missing_keys(json_text: Column, required: tuple[str, ...]) -> Column:
    """The required keys that a JSON object doesn't have, sorted; present nulls count as there."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))))


def missing_fields(df: DataFrame, required: tuple[str, ...]) -> Column:
    """The required fields that are absent or null in a row of a typed table, sorted."""
    have = set(df.columns)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) if f in have else F.lit(f) for f in required])))


def _same(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def _first(checks: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for bad, message in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), message).otherwise(out)
    return out


def sample_error(df: DataFrame) -> Column:
    """First failing check of a selected sample, null if it is valid."""
    gone = missing_fields(df, SAMPLE_FIELDS)
    return _first([
        (F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ","))),
        (~_same(F.col("token_ids"), F.col("weights")), F.lit("token_ids and weights differ in length")),
        (~_same(F.col("tokens"), F.col("token_ids")), F.lit("tokens and token_ids differ in length")),
    ])


def candidate_error(df: DataFrame) -> Column:
    """First failing check of a candidate, null if it is valid: fields, version, target fields, lengths."""
    gone = missing_fields(df, CANDIDATE_FIELDS)
    t = F.col("contrastive_target")
    absent = t["token_ids"].isNull() | t["tokens"].isNull() | t["weights"].isNull()
    return _first([
        (F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ","))),
        (F.col("schema_version") != CANDIDATE_VERSION, F.lit("unsupported version")),
        (absent, F.lit("incomplete target")),
        (~_same(t["token_ids"], t["weights"]) | ~_same(t["tokens"], t["token_ids"]), F.lit("target arrays differ in length")),
    ])


def trainer_error(df: DataFrame, vocabulary: int | None = None) -> Column:
    """First reason why a trainer can't take a sample, null if it can."""
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    checks = [
        (sample_error(df).isNotNull(), sample_error(df)),
        (F.trim("prompt_id") == "", F.lit("blank prompt_id")),
        (F.abs(total - 1.0) > 1e-3, F.lit("weights don't sum to 1")),
        (F.size("token_ids") == 0, F.lit("no token ids")),
    ]
    if vocabulary is not None:
        checks.append((F.array_max("token_ids") >= vocabulary, F.lit("token id beyond the vocabulary")))
    return _first(checks)


def trainer_report(df: DataFrame, key: str, vocabulary: int | None = None, shown: int = 20) -> DataFrame:
    """One row: records, records with metadata, greatest id, errors, and the first ``shown`` failing records, by key, with their reason."""
    e = df.withColumn("_e", trainer_error(df, vocabulary))
    few = e.where("_e is not null").select(key, "_e").orderBy(key, "_e").limit(shown)
    text = F.transform(F.array_sort(F.collect_list(F.struct(key, "_e"))), lambda x: F.concat(x[key].cast("string"), F.lit(": "), x["_e"]))
    first = few.agg(F.array_join(text, "; ").alias("errors"))
    whole = e.agg(F.count("*").alias("records_checked"), F.count("selection_metadata").alias("metadata_records"), F.coalesce(F.max(F.array_max("token_ids")), F.lit(0)).alias("max_token_id"), F.count("_e").alias("error_count"), (F.count("_e") == 0).alias("compatible"))
    return whole.crossJoin(first)  # one row each


def all_valid(df: DataFrame, error: Column) -> DataFrame:
    """``df``, failing at run time on the first row with an error."""
    return df.where(F.assert_true(error.isNull(), F.concat(F.lit("invalid record: "), F.coalesce(error, F.lit("")))).isNull())


def dtype(name: str) -> str:
    """Canonical name of a number format."""
    try:
        return DTYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unsupported dtype {name}") from None
