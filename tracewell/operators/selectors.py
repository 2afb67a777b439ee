"""Selectors: a decision (selected, score, reason) per candidate as a Column."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.features import FEATURE_NAMES, feature_array, standardized

# Defaults and the published configurations of the selectors.
DEFAULT_THRESHOLDS = {"setup": 0.30, "calculation": 0.20, "transformation": 0.35, "verification": 0.40, "final_answer": 0.25, "other": 0.50}
DEFAULT_ALLOWED = ("number", "operator", "equals", "variable", "currency_or_unit", "final_answer_marker")
DEFAULT_DENIED = ("punctuation", "space")
CONFIGS: dict[str, dict[str, Any]] = {
    "fixed_kl": {"name": "fixed_kl", "beta": 0.4},
    "rule": {"name": "rule_v1"},
    "rule_balanced": {"name": "rule_v2_balanced", "min_expert_confidence": 0.15, "max_expert_entropy": 2.5, "min_entropy_gap": 0.0, "allowed_token_categories": [*DEFAULT_ALLOWED, "word"], "step_type_thresholds": {"setup": 0.35, "calculation": 0.2, "transformation": 0.3, "verification": 0.35, "final_answer": 0.25, "other": 0.45}},
    "rule_focus": {"name": "rule_v3_reasoning_focus", "min_expert_confidence": 0.1, "max_expert_entropy": 3.0, "min_entropy_gap": -0.25, "denied_token_categories": [*DEFAULT_DENIED, "newline", "word"], "step_type_thresholds": {"setup": 0.2, "calculation": 0.1, "transformation": 0.2, "verification": 0.25, "final_answer": 0.15, "other": 0.3}},
}


class Selector(Protocol):
    """Anything with a name and a decision; own selectors plug in here."""

    name: str

    def decide(self, df: DataFrame) -> Column:
        """A struct of selected (boolean), score (double) and reason (string)."""
        ...


def _decision(selected: Column, score: Column, reason: Column) -> Column:
    return F.struct(selected.alias("selected"), score.cast("double").alias("score"), reason.alias("reason"))


def _kl(df: DataFrame) -> Column:
    return df["distribution_features"]["kl_expert_amateur"]


def reaches(kl: Column, threshold: Column | float) -> Column:
    """kl >= threshold, false for null and NaN (which Spark would order above every number)."""
    return F.coalesce(~F.isnan(kl) & (kl >= threshold), F.lit(False))


@dataclass(frozen=True)
class FixedKL:
    """Selects the steps whose divergence is at least ``beta``."""

    beta: float = 0.4
    name: str = "fixed_kl"

    def decide(self, df: DataFrame) -> Column:
        ok = reaches(_kl(df), self.beta)
        return _decision(ok, _kl(df), F.when(ok, "kl_above_beta").otherwise("kl_below_beta"))


@dataclass(frozen=True)
class Rule:
    """The first failing check gives the reason: denied, not allowed, confidence, entropy, gap, divergence.

    An empty allow list allows every category; an unknown step type uses the threshold of ``other``.
    Null and NaN features fail their check.
    """

    name: str = "rule_v1"
    min_expert_confidence: float = 0.30
    max_expert_entropy: float = 1.5
    min_entropy_gap: float = 0.5
    step_type_thresholds: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    allowed_token_categories: tuple[str, ...] = DEFAULT_ALLOWED
    denied_token_categories: tuple[str, ...] = DEFAULT_DENIED

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Rule:
        """Thresholds are merged over the defaults; the lists replace theirs."""
        c = dict(config)
        c["step_type_thresholds"] = DEFAULT_THRESHOLDS | c.get("step_type_thresholds", {})
        for k in ("allowed_token_categories", "denied_token_categories"):
            if k in c:
                c[k] = tuple(c[k])
        return cls(**{k: v for k, v in c.items() if k in cls.__dataclass_fields__})

    def decide(self, df: DataFrame) -> Column:
        d = df["distribution_features"]
        cat = F.coalesce(df["token_features"]["token_category"], F.lit("other"))
        step = F.coalesce(df["step_features"]["step_type"], F.lit("other"))
        need = F.lit(self.step_type_thresholds["other"])
        for name, t in self.step_type_thresholds.items():
            need = F.when(step == name, t).otherwise(need)
        not_allowed = ~cat.isin(*self.allowed_token_categories) if self.allowed_token_categories else F.lit(False)
        low = lambda c, t: ~F.coalesce(~F.isnan(c) & (c >= t), F.lit(False))
        high = lambda c, t: ~F.coalesce(~F.isnan(c) & (c <= t), F.lit(False))
        reason = (
            F.when(cat.isin(*self.denied_token_categories), F.concat(F.lit("denied_token_category:"), cat))
            .when(not_allowed, F.concat(F.lit("token_category_not_allowed:"), cat))
            .when(low(d["expert_top1_prob"], self.min_expert_confidence), "expert_confidence_too_low")
            .when(high(d["expert_entropy"], self.max_expert_entropy), "expert_entropy_too_high")
            .when(low(d["entropy_gap"], self.min_entropy_gap), "entropy_gap_too_low")
            .when(~reaches(d["kl_expert_amateur"], need), F.concat(F.lit("kl_below_step_threshold:"), step))
            .otherwise(F.concat(F.lit("selected:"), step, F.lit(":"), cat))
        )
        return _decision(F.startswith(reason, F.lit("selected:")), d["kl_expert_amateur"], reason)


@dataclass(frozen=True)
class Linear:
    """A logistic score over the features that its artifact names."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float = 0.0
    threshold: float = 0.5
    means: tuple[float, ...] | None = None
    scales: tuple[float, ...] | None = None
    name: str = "learned_linear"

    @classmethod
    def from_artifact(cls, a: dict[str, Any]) -> Linear:
        """Names may be in any order; unknown features count zero, and features not named play no part."""
        at = {n: i for i, n in enumerate(a["feature_names"])}
        names = tuple(n for n in FEATURE_NAMES if n in at)
        std = a.get("standardization") or {}
        pick = lambda v: tuple(float(v[at[n]]) for n in names)
        bias = float(a.get("bias", 0.0))
        for n, i in at.items():  # an unknown feature is zero before it is standardised
            if n not in FEATURE_NAMES and std:
                bias += a["weights"][i] * (0.0 - std["means"][i]) / std["scales"][i]
        return cls(names, pick(a["weights"]), bias, float(a.get("threshold", 0.5)), pick(std["means"]) if std else None, pick(std["scales"]) if std else None, a.get("name", "learned_linear"))

    def score(self, features: Column) -> Column:
        at = [FEATURE_NAMES.index(n) for n in self.features]
        used = features if len(at) == len(FEATURE_NAMES) else F.filter(features, lambda _, i: i.isin(at))
        x = standardized(used, list(self.means), list(self.scales)) if self.means is not None else used
        logit = F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(float(self.bias)), lambda s, v: s + v)
        return F.transform(F.array(logit), lambda z: F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z))))[0]

    def decide(self, df: DataFrame) -> Column:
        f = feature_array(df["distribution_features"], df["token_features"]["token_category"], df["step_features"]["step_type"], df["normalized_position"])
        s = self.score(f)
        ok = reaches(s, self.threshold)
        return _decision(ok, s, F.when(ok, "learned_score_above_threshold").otherwise("learned_score_below_threshold"))


def load_config(path: str) -> dict[str, Any]:
    """A selector configuration; an outer object ``selector`` is unwrapped."""
    c = json.loads(Path(path).read_text())
    return c.get("selector", c)


def build_selector(kind: str, config: dict[str, Any] | None = None, beta: float = 0.4) -> Selector:
    """A selector by kind; the configuration's beta goes before the argument's."""
    config = config or {}
    if kind == "fixed_kl":
        return FixedKL(float(config.get("beta", beta)), config.get("name", "fixed_kl"))
    if kind == "rule":
        return Rule.from_config(config)
    if kind == "learned":
        if not config:
            raise ValueError("a learned selector needs its artifact")
        return Linear.from_artifact(config)
    raise ValueError(f"unknown selector {kind}")


def shipped(name: str) -> Selector:
    """One of the published configurations."""
    return build_selector("fixed_kl" if name == "fixed_kl" else "rule", CONFIGS[name])


def with_decisions(df: DataFrame, selectors: dict[str, Selector]) -> DataFrame:
    """One row per candidate and selector (``selector``, ``decision``) from one scan."""
    made = F.array(*[F.struct(F.lit(n).alias("selector"), s.decide(df).alias("decision")) for n, s in selectors.items()])
    return df.withColumn("_d", F.explode(made)).select("*", "_d.selector", "_d.decision").drop("_d")
