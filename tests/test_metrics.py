import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import metrics, prepare, statistics


def test_confusion_metrics_with_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    r = metrics.confusion_metrics(df, "y", "p").first()
    assert r["accuracy"] == pytest.approx(0.6) and r["balanced_accuracy"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert r["precision_macro"] == pytest.approx((1 + 1 / 3 + 0) / 3)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.normal(size=80), 1), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert metrics.roc_auc(df, F.col("y") == 1, "s").first()[0] == pytest.approx(np.mean(pairs))
    assert metrics.roc_auc(df.filter("y = 1"), F.col("y") == 1, "s").first()[0] is None


def test_shares_and_cover(spark):
    df = spark.createDataFrame([([0.5, -0.4, 0.1],), ([0.0, 0.0],), ([],)], "c array<double>")
    got = [tuple(r) for r in df.select(metrics.top_share(F.col("c"), 1), metrics.rules_to_cover(F.col("c"))).collect()]
    assert got[0] == (pytest.approx(0.5), 2) and got[1:] == [(0, 0), (0, 0)]


def test_jaccard_and_roll_up(spark):
    sets = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, [])], "f int, s array<string>")
    assert metrics.jaccard_stability(sets, "f", "s").first()[0] == pytest.approx((0.5 + 0 + 0) / 3)
    assert metrics.jaccard_stability(sets.filter("f = 2"), "f", "s").first()[0] == 1
    df = spark.createDataFrame([("m", "x", 1.0), ("m", "x", 3.0), ("m", "y", 2.0), ("m", "x", float("nan"))], "model string, metric string, value double")
    rows = {r["metric"]: r for r in metrics.roll_up(df, ["model"]).collect()}
    assert rows["x"]["mean"] == 2 and rows["x"]["std"] == pytest.approx(math.sqrt(2)) and rows["y"]["std"] == 0


def test_holm_golden():
    assert statistics.holm([0.04, 0.01, 0.03]) == pytest.approx([0.06, 0.03, 0.06])


def test_wilcoxon():
    assert statistics.wilcoxon([0.0, 1e-9]) == 1.0
    assert statistics.wilcoxon([1, 2, 3, 4, 5]) == pytest.approx(2 / 32)
    assert math.isnan(statistics.wilcoxon([]))
    assert 0 < statistics.wilcoxon([1, 1, -1, 2, 3, 3]) < 0.2


def test_friedman_and_ranks(spark):
    rows = [(d, m, s) for d, ss in enumerate([(3, 2, 1), (3, 2, 1), (3, 1, 2), (3, 2, 1)]) for m, s in zip("abc", map(float, ss), strict=True)]
    df = spark.createDataFrame(rows, "d int, m string, s double")
    chi, p = statistics.friedman(df, "d", "m", "s")
    assert chi == pytest.approx(6.5) and p == pytest.approx(math.exp(-3.25))
    assert statistics.cliques({"a": 1.0, "b": 1.5, "c": 3.0}, 0.6) == [["a", "b"]]
    assert statistics.nemenyi_cd(3, 4) == pytest.approx(2.343 * math.sqrt(12 / 24))


def test_policy():
    assert statistics.recommend_model(8) == "FuzzyRuleSVM length-2"
    assert statistics.recommend_model(200, 0.1) == "MembershipSVM or EBM"
    assert statistics.recommend_model(8, None, {"FuzzyRuleSVM": 0.8, "x": 0.9}) == "x"


def test_bootstrap_query_returns_the_interval(spark, tmp_path):
    x = np.random.default_rng(2).normal(5, 2, 2000)
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    r = catalogue.QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()
    half = 1.96 * x.std() / len(x) ** 0.5
    assert abs(r["mean"] - x.mean()) < 1e-5 and abs(r["low"] - x.mean() + half) < 0.15 * half and abs(r["high"] - x.mean() - half) < 0.15 * half


def test_rule_metrics_against_plain_arrays(spark):
    rng = np.random.default_rng(9)
    z, c, b = rng.random((40, 5)), np.array([0.7, -0.4, 0.0, 1.2, -0.9]), -0.3
    y, lengths = np.where(rng.random(40) < 0.5, 1.0, -1.0), [1, 1, 2, 2, 1]
    served = z @ c + b + np.where(np.arange(40) == 7, 0.25, 0.0)  # a margin that explanations miss by 0.25 once
    df = spark.createDataFrame([(list(map(float, a)), float(s), float(m)) for a, s, m in zip(z, y, served, strict=True)], "z array<double>, y double, m double")
    got = metrics.rule_metrics(df, F.col("z"), c, lengths, b, F.col("y"), 20, 4, 3, F.col("m")).first().asDict()
    parts = z * c
    along = parts * np.where(served >= 0, 1, -1)[:, None]
    plus, minus = np.maximum(along, 0).sum(1), np.maximum(-along, 0).sum(1)
    order = -np.sort(-np.abs(parts), axis=1)
    mass = order.sum(1)
    slack = np.maximum(0, 1 - y * served)
    own = {
        "candidate_rules": 20, "n_rules": 5, "retained_rule_ratio": 0.25, "screened_features": 3, "screened_feature_ratio": 0.75, "support_rule_count": 4, "support_rule_ratio": 0.8,
        "avg_rule_length": 1.4, "avg_support_rule_length": 1.25, "weighted_rule_length": (np.abs(c) @ lengths) / np.abs(c).sum(), "coef_l1": np.abs(c).sum(), "coef_l2": np.linalg.norm(c),
        "length_weighted_complexity": np.abs(c) @ lengths, "mean_rule_activation": z.mean(), "mean_fired_rules_per_sample": (z > 1e-6).sum(1).mean(),
        "mean_contributing_rules_per_sample": (np.abs(parts) > 1e-8).sum(1).mean(), "mean_rules_for_90pct_contribution": ((np.cumsum(order, 1) < 0.9 * mass[:, None]).sum(1) + 1).mean(),
        "top1_abs_contribution_share": (order[:, 0] / mass).mean(), "top5_abs_contribution_share": 1.0, "explanation_fidelity_max_abs_error": 0.25, "explanation_fidelity_mean_abs_error": 0.25 / 40,
        "mean_abs_margin": np.abs(served).mean(), "mean_supporting_contribution": plus.mean(), "mean_opposing_contribution": minus.mean(), "mean_contrastive_gap": (plus - minus).mean(),
        "mean_contrastive_ratio": (plus / (plus + minus)).mean(), "mean_slack": slack.mean(), "cleanly_classified_membership": np.clip((0.5 - slack) / 0.5, 0, 1).mean(),
        "borderline_membership": np.minimum(np.clip(slack, 0, 1), np.clip(2 - slack, 0, 1)).mean(), "strong_violation_membership": np.clip(slack - 1, 0, 1).mean(),
    }
    assert len(own) == 30 and set(got) == set(own)
    for k, v in own.items():
        assert got[k] == pytest.approx(float(v), abs=1e-12), k


def test_quantiles_narrow_to_the_exact_values(spark, monkeypatch):
    monkeypatch.setattr(prepare, "DISTINCT", 50)
    monkeypatch.setattr(prepare, "ACCURACY", 200)
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=5000), np.round(rng.normal(size=5000)), rng.integers(0, 3, 5000) * 1e9, np.full(5000, 4.0)]).T
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, None, None, 4.0)], "a double, b double, c double, d double").repartition(5)
    fractions = [0.0, 0.05, 0.5, 0.777, 0.95, 1.0]
    got = prepare.exact_quantiles(df, ["a", "b", "c", "d"], fractions)
    for i, c in enumerate("abcd"):
        assert got[c] == pytest.approx(np.quantile(x[:, i], fractions).tolist(), rel=1e-12, abs=1e-12)
    assert prepare.exact_quantiles(df.filter("a is null"), ["a"], [0.5]) == {"a": [None]}


def test_turns_number_each_label_without_gaps(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(3000)], "row_id long, y string")
    rows = prepare.turns(df, "y", "row_id", 3).collect()
    for y in "ab":
        ids = sorted((((r["row_id"] * 7925 + 104729 * 4) % 1_000_003, r["row_id"]), r["_turn"]) for r in rows if r["y"] == y)
        assert [t for _, t in ids] == list(range(len(ids)))


def test_pareto_and_keep_first(spark):
    rows = [(1.0, 5.0, "x"), (1.0, 6.0, "y"), (2.0, 6.0, "z"), (3.0, 7.0, "u"), (-4.0, 1.0, "v"), (0.0, 2.0, "w"), (3000.0, 7.5, "t"), (3.1, 6.5, "s")]
    df = spark.createDataFrame(rows, "cost double, gain double, name string")
    assert sorted(tuple(r) for r in metrics.pareto(df, "cost", "gain").collect()) == [(-4.0, 1.0), (0.0, 2.0), (1.0, 6.0), (3.0, 7.0), (3000.0, 7.5)]
    assert sorted(r["name"] for r in metrics.keep_first(df, ["cost"], ["gain"]).collect()) == ["s", "t", "u", "v", "w", "x", "z"]


def test_critical_differences_of_any_number_of_models():
    for k, q in statistics.NEMENYI_Q.items():
        assert statistics.range_quantile(k) == pytest.approx(q, abs=1.1e-3)
    q = statistics.range_quantile(30)
    # By plain sums on another grid: the chance of a larger range is 0.05 there.
    z = np.linspace(-10, 10, 20001)
    below = np.vectorize(lambda v: math.erfc(-v / math.sqrt(2)) / 2)
    tail = 1 - 30 * np.sum(np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (below(z) - below(z - q * math.sqrt(2))) ** 29) * (z[1] - z[0])
    assert tail == pytest.approx(0.05, abs=1e-7)
    assert q * math.sqrt(2) == pytest.approx(5.30, abs=0.01) and statistics.range_quantile(20) * math.sqrt(2) == pytest.approx(5.01, abs=0.01)
    assert statistics.nemenyi_cd(30, 12) == pytest.approx(q * math.sqrt(30 * 31 / 72)) and statistics.nemenyi_cd(5, 9, 0.1) < statistics.nemenyi_cd(5, 9)
    with pytest.raises(ValueError, match="two models"):
        statistics.nemenyi_cd(1, 4)
