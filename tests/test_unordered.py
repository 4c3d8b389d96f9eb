from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import unordered
from tessera.operators.unordered import UnorderedFuzzyRules


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        k = i % 3
        x = rng.normal((0, 0, 0), 1)
        x[0] += 2.5 * (k == 1)
        x[1] += 2.5 * (k == 2)
        rows.append((*(float(round(v, 2)) for v in x), "abc"[k if rng.random() > 0.03 else (k + 1) % 3]))
    return spark.createDataFrame(rows, "p double, q double, r double, y string").repartition(3).cache()


def plain_crisp(x, y, part, k, n_folds=3):
    """Covering on the values themselves: every condition at every value is tried by looking at all rows."""
    mine, left, rules = y == k, np.ones(len(y), bool), []
    hold = lambda t: x[:, t[0]] <= t[2] if t[1] else x[:, t[0]] >= t[2]
    n_conditions = sum(2 * len(np.unique(c)) for c in x.T)
    least, keep, theory = unordered.error_bits(0, len(y), 0, mine.sum()), 0, 0.0
    while True:
        on, tests = left & (part != 0), []
        while (on & mine).any() and (on & ~mine).any():
            base, best = log2(((on & mine).sum() + 1) / (on.sum() + 1)), (0.0, None)
            for f in range(x.shape[1]):
                for at_most in (True, False):
                    for v in np.unique(x[:, f]):
                        now = on & hold((f, at_most, v))
                        p, t = (now & mine).sum(), now.sum()
                        gain = round(p * (log2((p + 1) / (t + 1)) - base), 9) if t < on.sum() else 0.0
                        if gain > best[0]:
                            best = gain, (f, at_most, v)
            if best[1] is None or (on & hold(best[1])).sum() < 2:
                break
            tests.append(best[1])
            on &= hold(best[1])
        if not tests:
            break
        on, worth, sums = left & (part == 0), [], []
        for t in [None, *tests]:
            on = on & hold(t) if t else on
            sums.append(((on & mine).sum(), (on & ~mine).sum()))
            worth.append(round((sums[-1][0] + 1) / (sum(sums[-1]) + 2), 12))
        length = max(1, worth.index(max(worth)))
        if sum(sums[length]) and sums[length][1] >= sums[length][0]:
            break
        rule = tests[:length]
        cover = np.all([hold(t) for t in rule], axis=0)
        left &= ~cover
        theory += unordered.theory_bits(length, n_conditions)
        bits = theory + unordered.error_bits((~left).sum(), left.sum(), (~left & ~mine).sum(), (left & mine).sum())
        if bits > least + 64:
            break
        rules.append(rule)
        if bits < least:
            least, keep = bits, len(rules)
        if not (left & mine).any():
            break
    return rules[: max(keep, min(1, len(rules)))]


def plain_slopes(x, y, k, rule):
    """Edges by trying every value beyond the core on all rows."""
    now = [[*t, t[2]] for t in rule]

    def degree(t, v):
        f, at_most, core, edge = t
        inside = v <= core if at_most else v >= core
        return np.where(inside, 1.0, 0.0 if core == edge else np.clip((edge - v) / (edge - core), 0, 1))

    left = list(range(len(now)))
    while left:
        best = None
        for j in left:
            others = np.all([degree(t, x[:, t[0]]) > 0 for i, t in enumerate(now) if i != j] or [np.ones(len(y), bool)], axis=0)
            f, at_most, core, _ = now[j]
            values = np.unique(x[others, f])
            tries = [core, *(v for v in (values if at_most else values[::-1]) if (v > core if at_most else v < core))]
            for edge in tries:
                d = degree((f, at_most, core, edge), x[:, f])[others]
                p, n = d[y[others] == k].sum(), d[y[others] != k].sum()
                purity = round(p / (p + n), 12) if p + n else 0.0
                if best is None or purity > best[0] or purity == best[0] and best[1] == j:
                    best = purity, j, edge
        now[best[1]][3] = best[2]
        left.remove(best[1])
    return [tuple(t) for t in now]


def test_rules_equal_a_plain_version(table):
    model = UnorderedFuzzyRules(max_cuts=600).fit(table)
    rows = model._rows(table, "y", None).collect()
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["c"] for r in rows]), np.array([r["part"] for r in rows])
    for k in range(3):
        want = plain_crisp(x, y, part, k)
        got = [[(f, a, float(model.cuts_[f][c])) for f, a, c in tests] for tests in model.crisp_[k]]
        assert got == [[(f, a, float(v)) for f, a, v in r] for r in want] and want
        mine = [r for r in model.rules_ if r.label == "abc"[k]]
        for r, w in zip(mine, want, strict=True):
            sloped = plain_slopes(x, y, k, w)
            assert [(i.feature, i.at_most, i.core, i.edge) for i in r.conditions] == [pytest.approx(t) for t in sloped]
            d = np.prod([i.degrees(x[:, i.feature]) for i in r.conditions], axis=0)
            assert r.certainty == pytest.approx((2 * (y == k).mean() + d[y == k].sum()) / (2 + d.sum()))


def test_predictions_equal_the_definition(table):
    model = UnorderedFuzzyRules().fit(table)
    rows = model.predict(model.decision_function(table)).collect()
    assert sum(r["prediction"] == r["y"] for r in rows) > 400
    far = table.sparkSession.createDataFrame([(50.0, 50.0, 0.0), (-50.0, 50.0, 0.0), (0.0, -50.0, 90.0)], "p double, q double, r double").union(table.select("p", "q", "r"))
    sizes = {c: n for c, n in zip(model.classes_, model.counts_, strict=True)}
    uncovered = 0
    for r in model.predict(far).collect():
        v = [r["p"], r["q"], r["r"]]
        votes, reach = dict.fromkeys("abc", 0.0), dict.fromkeys("abc", 0.0)
        for rule in model.rules_:
            on = [float(i.degrees(np.array([v[i.feature]]))[0]) for i in rule.conditions]
            votes[rule.label] += np.prod(on) * rule.certainty
            k = next((j for j, d in enumerate(on) if d == 0), len(on))
            reach[rule.label] = max(reach[rule.label], rule.stretched[k] if k else 0.0)
        by = votes if max(votes.values()) > 0 else reach if max(reach.values()) > 0 else sizes
        uncovered += by is not votes
        assert r["prediction"] in {c for c in by if by[c] == pytest.approx(max(by.values()))}
    assert uncovered
    assert all("=>" in t for t in model.rule_texts())


def test_edge_cases(spark, table):
    with pytest.raises(ValueError, match="two classes"):
        UnorderedFuzzyRules().fit(table.filter("y = 'a'"))
    with pytest.raises(ValueError, match="n_folds"):
        UnorderedFuzzyRules(n_folds=1).fit(table)
    more = table.withColumn("same", F.lit(1.0)).union(table.limit(1).withColumn("y", F.lit(None).cast("string")).select("p", "q", "r", "y", F.lit(1.0)))
    model = UnorderedFuzzyRules(max_cuts=20).fit(more, "y", ["p", "same", "q"])
    assert model.counts_.sum() == 500 and model.predict(more).filter("prediction = y").count() > 350
    assert max(map(len, model.cuts_)) <= 20
