"""Fuzzy membership functions and conjunctions as column expressions.

Inputs must be free of nulls and NaN: least() skips nulls, so a missing value would get full membership. ``operators.prepare.require_clean``
and ``operators.prepare.impute_median`` see to that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = ("low", "medium", "high")
AND_OPERATORS = ("min", "product", "softmin")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp_down(v: Column, a: float, b: float) -> Column:
    """1 up to a, falling to 0 at b; a step where the ramp has no width (chosen here, so no plan divides by zero)."""
    if b <= a:
        return F.when(v <= F.lit(float(a)), 1.0).otherwise(0.0)
    return clip01((F.lit(float(b)) - v) / F.lit(float(b) - float(a)))


def ramp_up(v: Column, a: float, b: float) -> Column:
    if b <= a:
        return F.when(v >= F.lit(float(b)), 1.0).otherwise(0.0)
    return clip01((v - F.lit(float(a))) / F.lit(float(b) - float(a)))


@dataclass(frozen=True)
class Partition:
    """The anchors of one feature's low, medium and high terms."""

    feature: str
    low: float
    medium: float
    high: float

    @property
    def strict(self) -> bool:
        return self.low < self.medium < self.high

    def term(self, name: str, column: Column | None = None) -> Column:
        v = F.col(self.feature) if column is None else column
        if name == "low":
            return ramp_down(v, self.low, self.medium)
        if name == "high":
            return ramp_up(v, self.medium, self.high)
        if name == "medium":
            return F.least(ramp_up(v, self.low, self.medium), ramp_down(v, self.medium, self.high))
        raise ValueError(f"term must be one of {TERMS}, not {name!r}")


def memberships(partitions: Sequence[Partition]) -> dict[tuple[int, str], Column]:
    """The expression of each (feature index, term)."""
    return {(i, t): p.term(t) for i, p in enumerate(partitions) for t in TERMS}


def degrees(x: np.ndarray, partitions: Sequence[Partition]) -> np.ndarray:
    """(rows, 3 features): the degrees of ``memberships``, feature by feature and in the order of the terms, for raw values (rows, features) within a task."""
    low, medium, high = (np.array([getattr(p, t) for p in partitions]) for t in TERMS)
    out = np.empty((len(x), len(partitions), 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        down = lambda a, b: np.where(b <= a, x <= a, np.fmax(0.0, np.fmin(1.0, (b - x) / (b - a))))
        up = lambda a, b: np.where(b <= a, x >= b, np.fmax(0.0, np.fmin(1.0, (x - a) / (b - a))))
        out[:, :, 0], out[:, :, 1], out[:, :, 2] = down(low, medium), np.minimum(up(low, medium), down(medium, high)), up(medium, high)
    return out.reshape(len(x), -1)


def membership_name(i: int, term: str) -> str:
    return f"f{i}__{term}"


def concept_map(partitions: Sequence[Partition]) -> Column:
    """feature name -> term -> degree, one map a row."""
    entries = []
    for p in partitions:
        inner = [x for t in TERMS for x in (F.lit(t), p.term(t))]
        entries += [F.lit(p.feature), F.create_map(*inner)]
    return F.create_map(*entries)


def softmin(values: Sequence[Column], temperature: float) -> Column:
    """-T (log of the mean of exp(-v / T)), clipped: softmin(v, v) is v."""
    scaled = [-v / F.lit(float(temperature)) for v in values]
    top = F.greatest(*scaled)
    total = sum((F.exp(s - top) for s in scaled[1:]), F.exp(scaled[0] - top))
    return clip01(-F.lit(float(temperature)) * (F.log(total / F.lit(float(len(values)))) + top))


def conjunction(values: Sequence[Column], and_operator: str = "min", temperature: float = 0.1) -> Column:
    """The degree of all values together; a single one passes through."""
    if and_operator not in AND_OPERATORS:
        raise ValueError(f"and_operator must be one of {AND_OPERATORS}")
    if len(values) == 1:
        return values[0]
    if and_operator == "min":
        return F.least(*values)
    if and_operator == "softmin":
        return softmin(values, temperature)
    out = values[0]
    for v in values[1:]:
        out = out * v
    return out


def violation_grades(slack: Column) -> dict[str, Column]:
    """How far a slack of max(0, 1 - y f) stands for a clean, a borderline and a strongly violated margin."""
    return {
        "cleanly_classified": ramp_down(slack, 0.0, 0.5),
        "borderline": F.least(ramp_up(slack, 0.0, 1.0), ramp_down(slack, 1.0, 2.0)),
        "strong_violation": ramp_up(slack, 1.0, 2.0),
    }
