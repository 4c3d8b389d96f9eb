import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions.rules import Condition, Rule
from tessera.operators.estimators import CSRQClassifier, FuzzyRuleSVM, MembershipLogisticL1, MembershipSVM, OneVsRest, QuotientAtomicSVM
from tessera.plans import artifact
from tessera.plans import quotient as qt
from tessera.plans import solver


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal((-1, -0.8), 0.18, (40, 2)), rng.normal((1, 0.9), 0.18, (40, 2))]
    rows = [(i, float(a), float(b), "low_risk" if i < 40 else "high_risk") for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, glucose double, bmi double, y string").coalesce(2).cache()


def accuracy(model, df, label="y"):
    return model.predict(df).select(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


@pytest.mark.parametrize("options", [{}, {"penalty": "l2"}, {"and_operator": "product"}, {"rule_generation": "column_generation"}])
def test_rules_separate_blobs(blobs, options):
    model = FuzzyRuleSVM(C=10, max_rules=24, **options).fit(blobs, exclude=["row_id"])
    assert accuracy(model, blobs) > 0.95 and model.solution_.kkt < 1e-3


def test_explanations_add_up(blobs):
    model = FuzzyRuleSVM(C=10, max_rules=24).fit(blobs, exclude=["row_id"])
    for r in model.explain(blobs, 3).collect():
        assert r["intercept"] + r["net_rule_contribution"] == pytest.approx(r["margin"], abs=1e-10)
        assert len(r["top_rules"]) <= 3 and all(x["contribution"] > 0 for x in r["positive_rules"])
    assert model.support_rules() and len(model.feature_names_out()) == len(model.rules_)
    v = model.fuzzy_violations(blobs).select("violation.*").first()
    assert v["slack"] == pytest.approx(max(0, 1 - v["functional_margin"]))


@pytest.mark.parametrize(("options", "word"), [({"C": 0}, "C"), ({"penalty": "l3"}, "penalty"), ({"and_operator": "or"}, "and_operator"), ({"max_rule_length": 0}, "max_rule_length"), ({"rule_generation": "x"}, "rule_generation")])
def test_bad_options_raise(blobs, options, word):
    with pytest.raises(ValueError, match=word):
        FuzzyRuleSVM(**options).fit(blobs, exclude=["row_id"])


def test_three_classes_and_missing_columns_raise(spark, blobs):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(9)], "x double, y int")
    with pytest.raises(ValueError, match="two classes"):
        FuzzyRuleSVM().fit(df)
    with pytest.raises(ValueError, match="missing"):
        FuzzyRuleSVM(max_rules=4).fit(blobs, exclude=["row_id"]).predict(blobs.drop("bmi"))
    assert accuracy(OneVsRest(lambda: FuzzyRuleSVM(max_rule_length=1)).fit(df), df) > 0.3


def test_memberships_models(blobs):
    m = MembershipSVM().fit(blobs, exclude=["row_id"])
    assert accuracy(m, blobs) > 0.95 and m.nonzero_coef_count() <= 2
    assert accuracy(MembershipLogisticL1().fit(blobs, exclude=["row_id"]), blobs) > 0.95


def atoms(*terms):
    return [qt.Atom(Rule((Condition(f, t),))) for f in (0, 1) for t in terms]


def test_dictionaries_of_one_span_give_one_function(blobs):
    complete = CSRQClassifier(max_rule_length=1).fit(blobs, exclude=["row_id"]).c_
    for d in (atoms("low", "high"), atoms("low", "medium", "high"), atoms("high", "low")[::-1], atoms("low", "medium")):
        c = CSRQClassifier(max_rule_length=1, semantic_space="dictionary", rule_dictionary=d).fit(blobs, exclude=["row_id"]).c_
        assert np.abs(c - complete).max() < 1e-6


def test_decoding_and_artifacts(blobs, tmp_path):
    m = CSRQClassifier(max_rule_length=1, semantic_space="dictionary", rule_dictionary=atoms("low", "medium", "high")).fit(blobs, exclude=["row_id"])
    exact = m.decode("rref")
    assert exact["status"] == "CERTIFIED" and qt.verify(exact["certificate"], exact["map"], list(map(float, m.c_)))
    assert m.decode("minimum_l2")["status"] == "OK" and "1" in m.decode()["coefficients"]
    assert m.decode("rref", atoms("low"))["status"] == "REJECTED"
    text = m.export_artifact(blobs)
    assert artifact.verify_artifact(text)
    found = json.loads(text)
    assert found["floating_point_audit"]["prediction_disagreements"] == 0 and 0 <= found["floating_point_audit"]["max_abs_difference"] < 1e-9
    assert found["selected_feature_indices"] == [0, 1] and found["equality_certificate"]["atom_costs"] == ["1/1"] * 6
    for key, value in (("classes", ["a", "b"]), ("version", "0")):
        with pytest.raises(ValueError, match="hash"):
            artifact.verify_artifact(json.dumps(found | {key: value}))
    # A forger who renews the hashes is told by the residual.
    forged = json.loads(text)
    cert = forged["equality_certificate"]
    cert["gamma_exact"][1] = "1/3"
    cert["sha256"] = artifact.digest({k: v for k, v in cert.items() if k != "sha256"})
    forged["sha256"] = artifact.digest({k: v for k, v in forged.items() if k != "sha256"})
    with pytest.raises(ValueError, match="residual isn't 0"):
        artifact.verify_artifact(json.dumps(forged))
    (tmp_path / "model.json").write_text(text)
    assert artifact.main([str(tmp_path / "model.json")]) == 0
    complete = json.loads(CSRQClassifier(max_rule_length=1).fit(blobs, exclude=["row_id"]).export_artifact())
    assert "equality_certificate" not in complete and all(good for _, good, _ in artifact.checks(complete))


def test_tied_anchors(spark):
    df = spark.createDataFrame([(0.0, float(i * 37 % 50), i % 2) for i in range(50)], "a double, b double, y int")
    with pytest.raises(ValueError, match="tied"):
        CSRQClassifier().fit(df)
    m = CSRQClassifier(strict_anchor_policy="drop").fit(df)
    assert m.dropped_features_ == [0] and len(m.partitions_) == 1
    with pytest.raises(ValueError, match="max_semantic_terms"):
        CSRQClassifier(strict_anchor_policy="drop", max_semantic_terms=1).fit(df)


def test_atomic_weights_are_optimal(blobs):
    m = QuotientAtomicSVM(atoms("low", "high"), max_rule_length=1).fit(blobs, exclude=["row_id"])
    assert accuracy(m, blobs) > 0.95 and m.solution_.kkt < 1e-3


def test_distributed_passes_equal_local_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z, y = rng.random((200, 5)), np.sign(rng.normal(size=200))
    df = spark.createDataFrame([(list(map(float, a)), float(b), 1.0) for a, b in zip(z, y, strict=True)], "z array<double>, y double, s double").repartition(3)
    for lam, q in ((1.0, 0.0), (0.0, 1.0)):
        a = solver.solve(df, 5, 1.0, lam, q)
        with monkeypatch.context() as m:
            m.setattr(solver, "LOCAL_CELLS", 0)
            b = solver.solve(df, 5, 1.0, lam, q)
        assert a.objective == pytest.approx(b.objective) and a.kkt < 1e-4
        trial = [a.coef + 1e-3 * rng.normal(size=5) for _ in range(20)]
        value = lambda g: 0.5 * q * g @ g + lam * np.abs(g).sum() + (np.maximum(0, 1 - y * (z @ g)) ** 2).sum()  # noqa: B023, E731
        assert all(value(t) >= a.objective - 1e-9 for t in trial)


def test_one_vs_rest_query_fits_all_labels_and_dimensions(spark, tmp_path):
    # The first four of eight dimensions are noise; dimension 4 + c is high for class c.
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 0.3 + 3 * (np.arange(8) == 4 + i % 4) * (np.arange(8) > 3)], i % 4) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalogue.one_vs_rest_fit(spark, str(tmp_path)).first()["accuracy"] > 0.95


@pytest.mark.parametrize(("local", "options", "weight"), [(True, {}, None), (False, {"class_weight": "balanced", "max_rules": 7, "C": 3.0}, "w"), (False, {"penalty": "l2"}, None)])
def test_classes_fitted_together_equal_each_alone(spark, monkeypatch, local, options, weight):
    # Each class had anchors, scores, passes and margins of its own, so the query over 10 classes and 64 dimensions ran out of time on 500 rows.
    rng = np.random.default_rng(6)
    rows = [(*(float(x) for x in rng.normal(size=3) + (np.arange(3) == i % 4)), float(rng.uniform(0.5, 2)), "abcd"[i % 4]) for i in range(150)]
    df = spark.createDataFrame(rows, "p double, q double, r double, w double, y string").repartition(3).cache()
    if not local:
        monkeypatch.setattr(solver, "LOCAL_CELLS", 0)
    together = OneVsRest(lambda: FuzzyRuleSVM(max_rule_length=1, **options)).fit(df, "y", ["p", "q", "r"], weight)
    assert together.shared_
    margins = together.decision_function(df).select("p", "margins").toPandas().set_index("p")["margins"]
    monkeypatch.undo()
    for i, c in enumerate("abcd"):
        one = FuzzyRuleSVM(max_rule_length=1, **options).fit(df.withColumn("_is", (F.col("y") == c).cast("int")), "_is", ["p", "q", "r"], weight)
        m = together.models_[i]
        assert m.rules_ == one.rules_ and m.partitions_ == one.partitions_ and m.solution_.converged and m.rule_scores_ == pytest.approx(one.rule_scores_)
        assert m.solution_.objective == pytest.approx(one.solution_.objective, rel=1e-8)
        own = one.decision_function(df).select("p", "margin").toPandas().set_index("p")["margin"]
        assert max(abs(own[p] - margins[p][i]) for p in own.index) < 1e-5
    best = {p: "abcd"[int(np.argmax(v))] for p, v in margins.items()}
    assert all(r["prediction"] == best[r["p"]] for r in together.predict(df).collect())
