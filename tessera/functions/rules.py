"""Conjunctive rules over fuzzy terms: the catalogue, its activations and its text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.membership import AND_OPERATORS, TERMS, Partition, conjunction, memberships

CONDITION = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("term", T.StringType())])


@dataclass(frozen=True, order=True)
class Condition:
    feature: int
    term: str


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    @property
    def length(self) -> int:
        return len(self.conditions)


def enumerate_rules(n_features: int, max_length: int, terms: Sequence[str] = TERMS) -> list[Rule]:
    """All conjunctions of up to max_length different features, shorter first, features and then terms in order."""
    found = []
    for k in range(1, min(max_length, n_features) + 1):
        for features in combinations(range(n_features), k):
            found += [Rule(tuple(map(Condition, features, chosen))) for chosen in product(terms, repeat=k)]
    return found


def activation(rule: Rule, degrees: dict[tuple[int, str], Column], and_operator: str = "min", temperature: float = 0.1) -> Column:
    return conjunction([degrees[c.feature, c.term] for c in rule.conditions], and_operator, temperature)


def activations(rules: Sequence[Rule], partitions: Sequence[Partition], and_operator: str = "min", temperature: float = 0.1) -> list[Column]:
    degrees = memberships(partitions)
    return [activation(r, degrees, and_operator, temperature) for r in rules]


def activation_array(rules: Sequence[Rule], partitions: Sequence[Partition], and_operator: str = "min", temperature: float = 0.1) -> Column:
    """The activation vector as one array column, never as hundreds of columns."""
    if not rules:
        return F.array().cast("array<double>")
    return F.array(*activations(rules, partitions, and_operator, temperature))


def rule_degrees(m: np.ndarray, rules: Sequence[Rule], and_operator: str = "min", temperature: float = 0.1) -> np.ndarray:
    """(rows, rules): the ``activations`` of rules within a task, from the degrees of all terms (``membership.degrees``)."""
    if and_operator not in AND_OPERATORS:
        raise ValueError(f"and_operator must be one of {AND_OPERATORS}")
    out = np.empty((len(m), len(rules)))
    for k in {r.length for r in rules}:
        places = [i for i, r in enumerate(rules) if r.length == k]
        values = [m[:, [3 * rules[i].conditions[j].feature + TERMS.index(rules[i].conditions[j].term) for i in places]] for j in range(k)]
        if k == 1:
            out[:, places] = values[0]
        elif and_operator == "min":
            out[:, places] = reduce(np.minimum, values)
        elif and_operator == "product":
            out[:, places] = reduce(np.multiply, values)
        else:
            scaled = [-v / temperature for v in values]
            top = reduce(np.maximum, scaled)
            total = sum(np.exp(x - top) for x in scaled)
            out[:, places] = np.clip(-temperature * (np.log(total / k) + top), 0.0, 1.0)
    return out


def rule_text(rule: Rule, names: Sequence[str], consequent: str | None = None) -> str:
    body = " AND ".join(f"{names[c.feature]} is {c.term}" for c in rule.conditions)
    return f"IF {body}" + (f" THEN {consequent}" if consequent is not None else "")


def rule_table(spark, rules: Sequence[Rule], names: Sequence[str]):
    """enum_idx, length, conditions, rule: a catalogue as a table."""
    rows = [(i, r.length, [(c.feature, c.term) for c in r.conditions], rule_text(r, names)) for i, r in enumerate(rules)]
    schema = T.StructType([
        T.StructField("enum_idx", T.IntegerType()), T.StructField("length", T.IntegerType()),
        T.StructField("conditions", T.ArrayType(CONDITION)), T.StructField("rule", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)
