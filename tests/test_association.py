from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import association
from tessera.operators.association import FuzzyAssociationClassifier


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 3, 2))])
    return spark.createDataFrame([(*map(float, v), "abc"[i // 60]) for i, v in enumerate(x)], "p double, q double, r double, y string").repartition(3).cache()


def plain(df, n_labels):
    """Degrees (rows, features, labels) and labels of a table, by the definition."""
    rows = df.collect()
    x = np.array([[r["p"], r["q"], r["r"]] for r in rows])
    centres = [np.linspace(c.min(), c.max(), n_labels) for c in x.T]
    m = np.array([[[max(0.0, 1 - abs(v - c) / (of[1] - of[0])) for c in of] for v, of in zip(row, centres, strict=True)] for row in x])
    return m, np.array([r["y"] for r in rows])


def all_rules(m, y, depth, least, most):
    """Every set of features and labels is looked at; a set's subsets must be frequent and not sure themselves."""
    out = {}
    for c in sorted(set(y)):
        found = {}
        for k in range(1, depth + 1):
            for fs in combinations(range(m.shape[1]), k):
                for ts in product(range(m.shape[2]), repeat=k):
                    items = tuple(zip(fs, ts, strict=True))
                    parts = [items[:i] + items[i + 1 :] for i in range(k)] if k > 1 else []
                    if all(p in found and found[p][1] <= most for p in parts):
                        d = np.prod([m[:, f, t] for f, t in items], axis=0)
                        if d[y == c].sum() >= least * (y == c).sum():
                            found[items] = d[y == c].sum() / len(y), d[y == c].sum() / d.sum()
        out |= {(c, i): v for i, v in found.items()}
    return out


@pytest.mark.parametrize(("depth", "least", "most"), [(2, 0.05, 0.8), (3, 0.02, 0.9), (2, 0.3, 1.0)])
def test_search_finds_what_all_sets_give(clouds, depth, least, most):
    model = FuzzyAssociationClassifier(max_depth=depth, min_support=least, max_confidence=most)
    found = model.search(model._rows(clouds, "y", ["p", "q", "r"]))
    want = all_rules(*plain(clouds, 5), depth, least, most)
    assert {(r.label, r.items) for r in found} == set(want)
    for r in found:
        assert (r.support, r.confidence) == pytest.approx(want[r.label, r.items], abs=1e-12)


def test_prescreening_equals_a_plain_loop(clouds):
    model = FuzzyAssociationClassifier(cover=2)
    rows = model._rows(clouds, "y", ["p", "q", "r"])
    rules = model.search(rows)
    got = [(r.label, r.items) for r in model.prescreen(rows, rules)]
    m, y = plain(clouds, 5)
    want = []
    for c in sorted(set(y)):
        left, times = [r for r in rules if r.label == c], np.zeros(len(y))
        while left:
            w = np.where(y == c, np.where(times > 2, 0.0, 1 / (times + 1)), 1.0)
            if w[y == c].sum() <= 0:
                break
            d = [np.prod([m[:, f, t] for f, t in r.items], axis=0) for r in left]
            worth = [round((w * v)[y == c].sum() / w[y == c].sum() * ((w * v)[y == c].sum() / (w * v).sum() - (y == c).mean()), 12) for v in d]
            k = int(np.argmax(worth))
            times += (y == c) & (d[k] > 0)
            want.append((c, left.pop(k).items))
    assert got == want and len(got) < len(rules)


def test_a_population_is_scored_at_once(clouds):
    model = FuzzyAssociationClassifier(n_labels=4)
    rows = model._rows(clouds, "y", ["p", "q", "r"])
    rules = model.prescreen(rows, model.search(rows))
    rng = np.random.default_rng(1)
    people = [(rng.uniform(-0.5, 0.5, (3, 4)), rng.integers(0, 2, len(rules)).astype(bool)) for _ in range(5)]
    got = model.hits(rows, rules, people)
    for (shifts, on), h in zip(people, got, strict=True):
        model.shifts_, model.rules_ = shifts, [r for r, k in zip(rules, on, strict=True) if k]
        assert model.predict(clouds).filter("prediction = y").count() == h


def test_fit_tunes_and_predicts(clouds):
    plain_fit = FuzzyAssociationClassifier(evaluations=0).fit(clouds)
    tuned = FuzzyAssociationClassifier(population=8, evaluations=40).fit(clouds)
    right = [m.predict(clouds).filter("prediction = y").count() for m in (plain_fit, tuned)]
    assert right[0] > 140 and right[1] > 140 and len(tuned.rules_) <= len(plain_fit.rules_)
    assert all(t.startswith("IF ") for t in tuned.rule_texts())
    assert tuned.decision_function(clouds).first()["margin"][0] >= 0
    again = FuzzyAssociationClassifier(population=8, evaluations=40).fit(clouds)
    assert again.rules_ == tuned.rules_ and (again.shifts_ == tuned.shifts_).all()


def test_edge_cases(spark, clouds):
    with_null = clouds.withColumn("same", F.lit(2.0)).union(clouds.limit(1).select("p", "q", "r", F.lit(None).cast("string").alias("y"), F.lit(2.0).alias("same")))
    model = FuzzyAssociationClassifier(evaluations=0).fit(with_null, "y", ["p", "same"])
    assert model.counts_.sum() == 180 and model.predict(with_null.withColumn("p", F.col("p") * 100)).filter("prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="two classes"):
        FuzzyAssociationClassifier().fit(clouds.filter("y = 'a'"))
    with pytest.raises(ValueError, match="min_support"):
        FuzzyAssociationClassifier(min_support=0).fit(clouds)
    assert association.hamming_share(np.array([-0.5]), np.array([0.5]), 8) == 1
