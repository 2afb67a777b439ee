"""The model boundary: scorers that add next-token distributions to prefixes.

No model runs in this engine. A scorer is any function from a batch of prefixes to probabilities;
distributions computed elsewhere are read as a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Scorer = Callable[[list[str]], np.ndarray]


def hashed_scorer(vocabulary: int = 16, seed: str = "") -> Scorer:
    """A deterministic scorer for tests: the softmax of numbers drawn from a hash of each prefix."""

    def score(prefixes: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.blake2b((seed + p).encode(), digest_size=8).digest(), "big")).normal(size=vocabulary) for p in prefixes]
        z = np.exp(np.array(rows).reshape(len(prefixes), vocabulary))
        return z / z.sum(axis=1, keepdims=True)

    return score


def scored(df: DataFrame, make: Callable[[], Scorer], text: str = "prefix", output: str = "probabilities", batch: int = 64) -> DataFrame:
    """``df`` with the distribution after each text; the model is made once per task, batches go through Arrow.

    A null text has a null distribution. The result has a row per row of ``df``.
    """
    schema = StructType([*df.schema.fields, StructField(output, ArrayType(DoubleType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            texts, out = b.column(at).to_pylist(), []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                known = [t for t in part if t is not None]
                got = iter(score(known).tolist() if known else [])
                out.extend(next(got) if t is not None else None for t in part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, output])

    return df.mapInArrow(run, schema)


def precomputed(df: DataFrame, distributions: DataFrame, key: list[str], output: str = "probabilities") -> DataFrame:
    """``df`` with distributions from a table; rows without one have null."""
    return df.join(distributions.select(*key, F.col("probabilities").alias(output)), key, "left")


def greedy_generation(prompts: DataFrame, make: Callable[[], Scorer], steps: int, key: str = "prompt_id", text: str = "question") -> DataFrame:
    """``key``, ``step``, ``token_id``, ``probabilities``: greedy decoding with a scorer, all steps of a prompt in one task."""
    schema = f"{key} string, step int, token_id int, probabilities array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows: dict[str, list] = {key: [], "step": [], "token_id": [], "probabilities": []}
            for step in range(steps):
                p = score(texts)
                ids = p.argmax(axis=1) if len(texts) else []
                for i, (k, t) in enumerate(zip(keys, ids, strict=True)):
                    rows[key].append(k)
                    rows["step"].append(step)
                    rows["token_id"].append(int(t))
                    rows["probabilities"].append(p[i].tolist())
                    texts[i] = f"{texts[i]} {int(t)}"
            yield pa.RecordBatch.from_arrays([pa.array(rows[key], pa.string()), pa.array(rows["step"], pa.int32()), pa.array(rows["token_id"], pa.int32()), pa.array(rows["probabilities"], pa.list_(pa.float64()))], names=[key, "step", "token_id", "probabilities"])

    return prompts.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, schema)
