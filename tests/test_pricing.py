import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import membership
from tessera.functions.membership import TERMS
from tessera.functions.rules import Condition, Rule, activation_array, activations
from tessera.operators import explain, prepare
from tessera.operators.estimators import FuzzyRuleSVM
from tessera.plans import solver


def rows(spark, z, y, u):
    return spark.createDataFrame([(list(map(float, a)), float(b), float(c)) for a, b, c in zip(z, y, u, strict=True)], "z array<double>, y double, s double").repartition(3)


@pytest.mark.parametrize("local", [True, False])
def test_duals_close_the_gap(spark, monkeypatch, local):
    rng = np.random.default_rng(3)
    z = np.c_[rng.random((80, 5)), np.ones(80)]
    y = np.sign(z[:, 0] - z[:, 1] + 0.2 * rng.normal(size=80))
    u = rng.uniform(0.5, 2, 80)
    if not local:
        monkeypatch.setattr(solver, "LOCAL_CELLS", 0)
        z, y, u = z[:12, [0, 1, 5]], y[:12], u[:12]
    df = rows(spark, z, y, u)
    d = solver.hinge_duals(df, z.shape[1])
    assert d.gap < 1e-6 and d.infeasible < 1e-5
    margin = sum(F.col("z")[i] * float(v) for i, v in enumerate(d.coef))
    got = df.select("z", "y", "s", (F.col("s") * d.of_row(1 - F.col("y") * margin)).alias("a")).collect()
    zz, yy, uu, a = (np.array([r[c] for r in got]) for c in ("z", "y", "s", "a"))
    slack = 1 - yy * (zz @ d.coef)
    primal = np.abs(d.coef[:-1]).sum() + uu @ np.maximum(0, slack)
    assert primal == pytest.approx(d.primal, rel=1e-9) and a.sum() == pytest.approx(d.dual, rel=1e-7)
    # Optimality of both: complementary slackness on rows and on columns.
    assert np.all((a > uu - 1e-4) | (slack < 1e-5)) and np.all((a < 1e-4) | (slack > -1e-5))
    price = (a * yy) @ zz[:, :-1]
    assert np.all(np.abs(price) < 1 + 1e-5) and np.all(np.abs(price[d.coef[:-1] != 0]) > 1 - 1e-4)


def test_a_programme_solved_by_hand(spark):
    """One column, weights 1: min |g| + sum of hinges over z = 1, 1, 0 with y = 1, 1, -1 and the constant. g = 2, b = -1 costs 2, as does what is cheaper in no way; the duals are 1/2, 1/2 and 1."""
    d = solver.hinge_duals(rows(spark, [[1, 1], [1, 1], [0, 1]], [1, 1, -1], [1, 1, 1]), 2)
    assert d.primal == pytest.approx(2.0, abs=1e-5) and d.dual == pytest.approx(2.0, abs=1e-5)
    three = solver.hinge_duals(rows(spark, [[1, 1]] * 4 + [[0, 1]] * 2, [1] * 4 + [-1] * 2, [1] * 6), 2)
    a = [three.of_row(F.lit(float(1 - y * (np.array(z) @ three.coef)))) for z, y in (([1, 1], 1), ([0, 1], -1))]
    of_one, of_other = spark.range(1).select(*a).first()
    # g = 2, b = -1: four equal duals that sum to 1 (the price of the column), two that balance them.
    assert three.primal == pytest.approx(2.0, abs=1e-5) and of_one == pytest.approx(0.25, abs=1e-4) and of_other == pytest.approx(0.5, abs=1e-4)


@pytest.mark.parametrize("how", ["min", "product", "softmin"])
def test_pricing_equals_all_pairs(spark, how):
    """Every pair is priced by its product and by its own activation, row by row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))
    y = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0), "p", "n")
    df = spark.createDataFrame([(*map(float, a), str(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, y string").repartition(2).cache()
    model = FuzzyRuleSVM(C=1.0, and_operator=how, rule_generation="column_generation", max_rules=6, min_rule_coverage=0.03)
    names = model._begin(df, "y", ["a", "b", "c", "d"], None)
    model.partitions_ = prepare.anchors(df, names)
    s, sc = model._weights(df)
    rules = [Rule((Condition(f, t),)) for f in range(4) for t in TERMS]
    done = set()
    for _ in range(2):
        before = set(done)
        got = model._price(df, rules, model._sign(), s, sc, 3, done)
        margin = explain.margin(activations(rules, model.partitions_, how, 0.1), model.dual_.coef[:-1], model.dual_.coef[-1])
        pairs = [(3 * f + i, 3 * g + j) for f in range(4) for g in range(f + 1, 4) for i in range(3) for j in range(3)]
        all_ = [Rule((Condition(i // 3, TERMS[i % 3]), Condition(j // 3, TERMS[j % 3]))) for i, j in pairs]
        w = model.dual_.of_row(1 - model._sign() * margin) * model._sign()
        data = df.select(activation_array(all_, model.partitions_, how, 0.1).alias("z"), activation_array(all_, model.partitions_, "product").alias("p"), w.alias("w")).collect()
        z, p, w = (np.array([r[c] for r in data]) for c in "zpw")
        price, product, cover = np.abs(w @ z), np.abs(w @ p), z.mean(0)
        by_product = [k for k in sorted(range(len(pairs)), key=lambda k: -product[k])[:60] if product[k] > 1 + model.tol and pairs[k] not in before]
        fit = [k for k in by_product if price[k] > 1 + model.tol and cover[k] >= 0.03][:12]
        want = [all_[k] for k in sorted(fit, key=lambda k: -price[k])[:3]]
        assert set(got) == set(want) and (got or not want)
        rules = rules + got
    assert len(rules) > 12
    assert FuzzyRuleSVM(and_operator=how, rule_generation="column_generation", max_rules=2).fit(df).rules_


def test_duals_where_labels_follow_nothing(spark):
    """A whole class lies on the corner, and the columns add up to the constant: every width used to start with that class off the corner, which took over 100 passes, and on 150,000 rows ended far from the optimum."""
    rng = np.random.default_rng(8)
    x, y = rng.random((3000, 2)), np.where(rng.random(3000) < 0.33, 1.0, -1.0)
    z = np.c_[membership.degrees(x, [membership.Partition("a", 0.05, 0.5, 0.95), membership.Partition("b", 0.1, 0.4, 0.9)]), np.ones(3000)]
    d = solver.hinge_duals(rows(spark, z, y, np.ones(3000)), 7)
    assert d.primal == pytest.approx(2 * (y > 0).sum(), rel=1e-6) and abs(d.gap) < 1e-6 and d.infeasible < 1e-5
    assert d.passes < 40
