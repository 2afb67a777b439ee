"""Weak labels, the ordered logistic trainer, and a distributed one."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.features import FEATURE_NAMES, feature_array
from tracewell.operators.selectors import FixedKL, Rule

LABEL_SOURCES = ("rule", "fixed_kl", "candidate_fixed_kl_flag")


def weak_label(df: DataFrame, source: str, beta: float = 0.4) -> Column:
    """0 or 1 from the default rule, a fixed threshold, or the stored flag (null as 0)."""
    if source == "rule":
        return Rule().decide(df)["selected"].cast("int")
    if source == "fixed_kl":
        return FixedKL(beta).decide(df)["selected"].cast("int")
    if source == "candidate_fixed_kl_flag":
        return F.coalesce("fixed_kl_selected", F.lit(False)).cast("int")
    raise ValueError(f"unsupported label source {source}")


def _clean(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x))


def features_and_labels(df: DataFrame, source: str, beta: float, order: str) -> DataFrame:
    """``order``, ``x`` (33 features, NaN as 0) and ``y``."""
    f = feature_array(df["distribution_features"], df["token_features"]["token_category"], df["step_features"]["step_type"], df["normalized_position"])
    return df.select(order, _clean(f).alias("x"), weak_label(df, source, beta).alias("y"))


def sgd(x: np.ndarray, y: np.ndarray, epochs: int = 20, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Per-record descent in the order given; the penalty is inside each step and spares the bias."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        for row, label in zip(x, y, strict=True):
            z = b + row @ w
            p = 1.0 / (1.0 + np.exp(-z)) if z >= 0 else np.exp(z) / (1.0 + np.exp(z))
            b -= rate * (p - label)
            w = w - rate * ((p - label) * row + l2 * w)
    return w, b


def train_linear(df: DataFrame, source: str = "rule", beta: float = 0.4, order: str = "candidate_id", max_records: int = 5000, epochs: int = 20, rate: float = 0.05, l2: float = 1e-4, threshold: float = 0.5) -> dict[str, Any]:
    """The artifact of the ordered trainer, fitted on the first ``max_records`` rows by ``order``.

    The descent depends on the order of its rows and can't be split, so its input is bounded by this
    parameter; means and scales are those of all rows. An empty table is an error.
    """
    every = features_and_labels(df, source, beta, order)
    rows = every.orderBy(order).limit(max_records).toPandas()
    if rows.empty:
        raise ValueError("no candidate records")
    x = np.stack(rows["x"].to_numpy())
    y = rows["y"].to_numpy(dtype=float)
    at = range(x.shape[1])
    whole = every.agg(*[F.avg(F.col("x")[i]) for i in at], *[F.stddev_pop(F.col("x")[i]) for i in at]).first()
    means, scales = np.array(whole[: len(at)]), np.array(whole[len(at) :])
    scales[scales == 0] = 1.0
    z = (x - means) / scales
    w, b = sgd(z, y, epochs, rate, l2)
    right = ((1.0 / (1.0 + np.exp(-(z @ w + b))) >= threshold) == (y > 0)).mean()
    return {
        "name": f"learned_linear_{source}", "model_type": "linear_logistic_sgd", "feature_names": list(FEATURE_NAMES), "weights": w.tolist(), "bias": float(b), "threshold": threshold,
        "standardization": {"means": means.tolist(), "scales": scales.tolist()},
        "training": {"label_source": source, "beta": beta, "epochs": epochs, "learning_rate": rate, "l2": l2, "records": len(y), "positive_labels": int(y.sum()), "training_accuracy": float(right)},
    }


def train_distributed(df: DataFrame, source: str = "rule", beta: float = 0.4, order: str = "candidate_id", l2: float = 1e-4) -> dict[str, Any]:
    """An artifact of the same form from a distributed logistic regression over all rows; weights differ from the ordered one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features_and_labels(df, source, beta, order).select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    m = LogisticRegression(regParam=l2, maxIter=30).fit(rows)
    return {"name": f"distributed_linear_{source}", "model_type": "linear_logistic", "feature_names": list(FEATURE_NAMES), "weights": m.coefficients.toArray().tolist(), "bias": float(m.intercept), "threshold": 0.5, "standardization": None}


def save_artifact(artifact: dict[str, Any], path: str) -> None:
    """Write an artifact as JSON with sorted keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(artifact, indent=2, sort_keys=True) + "\n")


def load_artifact(path: str) -> dict[str, Any]:
    """Read an artifact; name, threshold and standardization have defaults."""
    a = json.loads(Path(path).read_text())
    return {"name": "learned_linear", "threshold": 0.5, "standardization": None} | a
