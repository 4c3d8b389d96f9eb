"""Serving with given coefficients: margins, decisions, violations, support rules and additive explanations, all projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.membership import violation_grades
from tessera.functions.rules import Rule, rule_text


def margin(acts: Sequence[Column], coefficients: Sequence[float], intercept: float = 0.0) -> Column:
    """The intercept and the terms whose coefficient isn't zero."""
    out = F.lit(float(intercept))
    for a, c in zip(acts, coefficients, strict=True):
        if c:
            out = out + F.lit(float(c)) * a
    return out


def decision(margin_: Column, classes: Sequence) -> Column:
    return F.when(margin_ >= 0, F.lit(classes[1])).otherwise(F.lit(classes[0]))


def checked_sign(label: Column, classes: Sequence) -> Column:
    """1 for the second class, -1 for the first; another label raises."""
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label.cast("string"))).cast("double")
    return F.when(label == F.lit(classes[1]), 1.0).when(label == F.lit(classes[0]), -1.0).otherwise(unknown)


def violations(margin_: Column, y: Column) -> Column:
    """functional margin, slack and the grades of the violation, as a struct."""
    functional = y * margin_
    slack = F.greatest(F.lit(0.0), 1 - functional)
    return F.struct(functional.alias("functional_margin"), slack.alias("slack"), *[c.alias(n) for n, c in violation_grades(slack).items()])


def contributions(acts: Sequence[Column], coefficients: Sequence[float], rules: Sequence[str]) -> Column:
    """An array of (idx, rule, coefficient, activation, contribution) over rules with a coefficient."""
    items = [
        F.struct(F.lit(i).alias("idx"), F.lit(r).alias("rule"), F.lit(float(c)).alias("coefficient"), a.alias("activation"), (F.lit(float(c)) * a).alias("contribution"))
        for i, (a, c, r) in enumerate(zip(acts, coefficients, rules, strict=True)) if c
    ]
    kind = "array<struct<idx:int,rule:string,coefficient:double,activation:double,contribution:double>>"
    return F.array(*items).cast(kind) if items else F.array().cast(kind)


def strongest(items: Column, n: int, least: float = 0.0, sign: int = 0) -> Column:
    """The n largest contributions: by size, or among those of one sign; ties by place."""
    keep = F.filter(items, lambda x: (F.abs(x["contribution"]) >= least) & ((x["contribution"] * sign > 0) if sign else F.lit(True)))
    ordered = F.array_sort(keep, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(a["idx"] - b["idx"]))
    return F.slice(ordered, 1, n)


def explain(df: DataFrame, acts: Sequence[Column], coefficients: Sequence[float], rules: Sequence[Rule], names: Sequence[str], intercept: float, classes: Sequence, top_n: int = 5, least: float = 0.0) -> DataFrame:
    """df with margin, prediction, intercept, net contribution of all rules, and the strongest, supporting and opposing rules."""
    if top_n < 1:
        raise ValueError("top_n must be positive")
    texts = [rule_text(r, names, str(classes[1] if c > 0 else classes[0])) for r, c in zip(rules, coefficients, strict=True)]
    with_items = df.withColumn("_items", contributions(acts, coefficients, texts))
    m = margin(acts, coefficients, intercept)
    net = F.aggregate("_items", F.lit(0.0), lambda s, x: s + x["contribution"])
    return with_items.withColumn("margin", m).withColumn("prediction", decision(F.col("margin"), classes)).withColumns({
        "intercept": F.lit(float(intercept)), "net_rule_contribution": net, "top_rules": strongest(F.col("_items"), top_n, least),
        "positive_rules": strongest(F.col("_items"), top_n, least, 1), "negative_rules": strongest(F.col("_items"), top_n, least, -1),
    }).drop("_items")


def support_rules(coefficients: Sequence[float], rules: Sequence[Rule], names: Sequence[str], classes: Sequence, least: float = 1e-8) -> list[dict]:
    """Rules whose coefficient counts, the largest first."""
    found = [(abs(c), i, c, r) for i, (c, r) in enumerate(zip(coefficients, rules, strict=True)) if abs(c) >= least]
    return [{"rule": rule_text(r, names, str(classes[1] if c > 0 else classes[0])), "coefficient": float(c), "length": r.length} for _, _, c, r in sorted(found, key=lambda x: (-x[0], x[1]))]
