import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.membership import Partition, conjunction, ramp_down, ramp_up, violation_grades
from tessera.functions.rules import Condition, Rule, enumerate_rules, rule_text
from tessera.operators import prepare


def values(spark, xs, *cols):
    return [tuple(r) for r in spark.createDataFrame([(float(x),) for x in xs], "v double").select(*[c.cast("double") for c in cols]).collect()]


def test_terms_sum_to_one_and_have_their_corners(spark):
    p = Partition("v", 0.0, 1.0, 2.0)
    xs = np.linspace(-0.5, 2.5, 31)
    for x, (low, mid, high) in zip(xs, values(spark, xs, *[p.term(t) for t in ("low", "medium", "high")]), strict=True):
        assert low + mid + high == pytest.approx(1)
        assert low == pytest.approx(min(1, max(0, 1 - x))) and high == pytest.approx(min(1, max(0, x - 1)))


def test_ramps_without_width_are_steps(spark):
    assert values(spark, [0, 1, 2], ramp_down(F.col("v"), 1, 1), ramp_up(F.col("v"), 1, 1)) == [(1, 0), (1, 1), (0, 1)]


def test_unknown_term_raises():
    with pytest.raises(ValueError, match="term"):
        Partition("v", 0, 1, 2).term("tall")


def test_conjunctions(spark):
    a, b = F.lit(0.3) + 0 * F.col("v"), F.lit(0.6)
    got = values(spark, [0], conjunction([a, b]), conjunction([a, b], "product"), conjunction([a, b], "softmin"), conjunction([a, a], "softmin"), conjunction([a]))[0]
    soft = -0.1 * math.log((math.exp(-3) + math.exp(-6)) / 2)
    assert got == pytest.approx((0.3, 0.18, soft, 0.3, 0.3))
    with pytest.raises(ValueError, match="and_operator"):
        conjunction([a, b], "or")


def test_violation_grades(spark):
    got = values(spark, [0, 0.25, 1, 1.5, 3], *violation_grades(F.col("v")).values())
    assert got == [(1, 0, 0), (0.5, 0.25, 0), (0, 1, 0), (0, 0.5, 0.5), (0, 0, 1)]


def test_rules_in_order():
    rules = enumerate_rules(3, 2)
    assert len(rules) == 9 + 27 and rules[0] == Rule((Condition(0, "low"),)) and rules[9].length == 2
    assert rule_text(rules[9], ["a", "b", "c"], "yes") == "IF a is low AND b is low THEN yes"


def test_anchors_are_numpy_quantiles(spark):
    x = np.random.default_rng(1).normal(size=101)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    p = prepare.anchors(df, ["v"])[0]
    assert (p.low, p.medium, p.high) == pytest.approx(tuple(np.quantile(x, prepare.QUANTILES)))


def test_missing_values_are_found_and_imputed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "v double")
    with pytest.raises(ValueError, match="missing"):
        prepare.require_clean(df, ["v"])
    assert sorted(r[0] for r in prepare.impute_median(df, ["v"]).collect()) == [1, 2, 2, 2, 4]


def test_weights_folds_and_subsets(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "id long, y string")
    assert prepare.class_weights(df, "y", "balanced") == {"a": pytest.approx(2 / 3), "b": pytest.approx(2)}
    assert prepare.class_weights(df, "y", {"a": 3}) == {"a": 3, "b": 1}
    counts = prepare.stratified_folds(df, "y", "id", 5).groupBy("fold", "y").count().collect()
    assert {(r["y"], r["count"]) for r in counts} == {("a", 6), ("b", 2)}
    with pytest.raises(ValueError, match="two rows"):
        prepare.stratified_folds(df.filter("id < 4"), "y", "id")
    assert {r[0]: r[1] for r in prepare.stratified_subset(df, "y", "id", 12).groupBy("y").count().collect()} == {"a": 9, "b": 3}


def test_screening(spark):
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b), float(c), int(a + b > 0)) for a, b, c in rng.normal(size=(120, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    x, y = np.array(rows)[:, 0], np.array(rows)[:, 3]
    groups = [x[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert dict(prepare.anova_f(df, ["a", "b", "c"], "y"))["a"] == pytest.approx(between / (within / 118))
    assert prepare.screen(df, ["a", "b", "c"], "y", "anova", 2) == ["a", "b"] == prepare.screen(df, ["a", "b", "c"], "y", "mutual_info", 2)
