"""Standardised logistic scoring as plain column arithmetic, with explanations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.operators.features import FEATURES


@dataclass
class LogisticModel:
    """weights . (x - mean) / std + bias. ``threshold`` decides ``is_malicious``."""

    weights: list[float]
    bias: float
    mean: list[float]
    std: list[float]
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    threshold: float = 0.5
    version: str = "1"
    metrics: dict = field(default_factory=dict)

    def __post_init__(self):
        if not len(self.features) == len(self.weights) == len(self.mean) == len(self.std):
            raise ValueError("weights, mean and std need a value for each feature")
        self.std = [s or 1.0 for s in self.std]

    def contributions(self) -> dict[str, Column]:
        return {n: F.lit(float(w)) * (F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, w, m, s in zip(self.features, self.weights, self.mean, self.std, strict=True)}

    def decision(self) -> Column:
        total = F.lit(float(self.bias))
        for part in self.contributions().values():
            total = total + part
        return total

    def probability(self) -> Column:
        return sigmoid(self.decision())

    def is_malicious(self) -> Column:
        return self.probability() >= self.threshold

    def explain(self, limit: int = 6, positive: int | None = None) -> Column:
        """(name, value) of the contributions by falling size; ``positive``: of those the first so many above zero."""
        parts = F.array(*(F.struct((-F.abs(c)).alias("size"), F.lit(n).alias("name"), c.alias("value")) for n, c in self.contributions().items()))
        top = F.transform(F.slice(F.array_sort(parts), 1, limit), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))
        return top if positive is None else F.slice(F.filter(top, lambda p: p["value"] > 0), 1, positive)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> LogisticModel:
        known = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**known)


def sigmoid(z: Column) -> Column:
    """Numerically stable on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_loss(p: Column, label: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(label * F.log(clipped) + (1 - label) * F.log(1 - clipped))
