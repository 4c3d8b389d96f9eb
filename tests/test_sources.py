import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import synthetic
from tessera.operators import comparators
from tessera.operators.estimators import FuzzyRuleSVM, OneVsRest
from tessera.plans import evaluation
from tessera.sources import datasets
from tessera.sources import prepare as preparation
from tessera.streaming.scoring import score_stream, windowed_decisions


def test_registry_and_manifest(spark, tmp_path):
    assert len(datasets.list_datasets()) == 20 == datasets.registry(spark).count()
    preparation.main(["--manifest", str(tmp_path / "m.json")])
    assert len(json.loads((tmp_path / "m.json").read_text())["datasets"]) == 20
    assert datasets.spec_of("diabetic_retinopathy_debrecen").n_features == 19 and {s.slug for s in datasets.DATASETS} == set(preparation.LAYOUTS)
    for slug, layout in preparation.LAYOUTS.items():
        assert not layout.features or len(layout.features) == datasets.spec_of(slug).n_features
    with pytest.raises(KeyError, match="unknown data set"):
        datasets.spec_of("nothing")


def test_sets_are_prepared_from_raw_files(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "breast-cancer-wisconsin.data").write_text("".join(f"{1000 + i},{i % 10},2,3,4,5,{'?' if i == 3 else 6},7,8,9,{2 if i % 3 else 4}\n" for i in range(12)))
    (raw / "heart.dat").write_text("".join(" ".join(f"{i}.0" for _ in range(13)) + f" {1 + i % 2}\n" for i in range(8)))
    (raw / "SPECT.train").write_text("1," + ",".join("01" * 11) + "\n0," + ",".join("10" * 11) + "\n")
    (raw / "SPECT.test").write_text("0," + ",".join("11" * 11) + "\n")
    (raw / "Indian Liver Patient Dataset (ILPD).csv").write_text("65,Female,0.7,0.1,187,16,18,6.8,3.3,0.9,1\n62,Male,10.9,5.5,699,64,100,7.5,3.2,,2\n")
    (raw / "messidor_features.arff").write_text("@relation r\n@data\n" + "".join(",".join(["1"] * 19 + [str(i % 2)]) + "\n" for i in range(4)))
    (raw / "parkinsons.data").write_text("name," + ",".join(f"MDVP:f{i}" for i in range(22)) + ",status\n" + "".join(f"s{i}," + ",".join(["0.5"] * 22) + f",{i % 2}\n" for i in range(4)))
    (raw / "iris.csv").write_text("a,b,c,d,target\n1,2,3,4,setosa\n2,3,4,5,virginica\n")
    with zipfile.ZipFile(raw / "vertebral_column_data.zip", "w") as z:
        z.writestr("column_2C.dat", "1 2 3 4 5 6 AB\n2 3 4 5 6 7 NO\n")
    seen = {}
    for slug in ("breast_cancer_original", "statlog_heart", "spect_heart", "ilpd", "diabetic_retinopathy_debrecen", "parkinsons", "iris", "vertebral_column_2c"):
        preparation.prepare_dataset(spark, slug, str(raw), out)
        df, spec, names = datasets.load_dataset(spark, slug, out)
        assert len(names) == spec.n_features
        seen[slug] = (df.count(), sorted({r["target"] for r in df.collect()}))
    assert seen["breast_cancer_original"] == (12, ["benign", "malignant"]) and seen["statlog_heart"] == (8, ["absent", "present"]) and seen["spect_heart"] == (3, ["abnormal", "normal"])
    assert seen["ilpd"] == (2, ["liver_patient", "non_liver_patient"]) and seen["diabetic_retinopathy_debrecen"] == (4, ["no_retinopathy", "retinopathy"])
    assert seen["parkinsons"] == (4, ["healthy", "parkinsons"]) and seen["iris"] == (2, ["setosa", "virginica"]) and seen["vertebral_column_2c"] == (2, ["abnormal", "normal"])
    cells = datasets.load_dataset(spark, "breast_cancer_original", out)[0]
    assert cells.filter(F.isnan("bare_nuclei")).count() == 1
    assert [r["gender_male"] for r in datasets.load_dataset(spark, "ilpd", out)[0].orderBy("age").collect()] == [1.0, 0.0]
    with pytest.raises(ValueError, match="features"):
        datasets.validate(cells, "target", ["mitoses"], datasets.spec_of("breast_cancer_original"))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1, x\n\n?,y\n")
    (tmp_path / "b.txt").write_text("  1   2\n3 4\n\n")
    (tmp_path / "c.arff").write_text("% note\n@relation r\n@data\n1,0\n2,1\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in.dat", "1 2 a\n3 4 b\n")
    assert [tuple(r) for r in datasets.read_csv(spark, str(tmp_path / "a.csv"), names=["v", "y"]).collect()] == [("1", "x"), (None, "y")]
    assert datasets.read_whitespace(spark, str(tmp_path / "b.txt"), ["v", "w"]).count() == 2
    assert [r["y"] for r in datasets.read_arff(spark, str(tmp_path / "c.arff"), ["v", "y"], {0: "no", 1: "yes"}).collect()] == ["no", "yes"]
    assert [tuple(r) for r in datasets.read_zip(spark, str(tmp_path / "d.zip"), "in.dat", ["a", "b", "y"]).collect()] == [("1", "2", "a"), ("3", "4", "b")]
    df = datasets.recode(spark.createDataFrame([("1",), ("?",)], "v string"), "y", [(F.col("v") == "1", "one")], "other")
    assert [r["y"] for r in df.collect()] == ["one", "other"]


def test_prepare_load_evaluate(spark, tmp_path):
    made = synthetic.additive_main_effects(spark, 90, 0, 3)
    spec = datasets.DatasetSpec("tiny", "Tiny", "local", 90, 3, "binary", "0 vs 1")
    datasets.save_prepared(made.data, str(tmp_path), spec, "y", made.feature_names)
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, "wine", str(tmp_path))
    with pytest.raises(KeyError):
        datasets.load_dataset(spark, "absent", str(tmp_path))
    result = evaluation.evaluate(spark, ["tiny"], str(tmp_path), str(tmp_path / "out"), {"one": lambda: FuzzyRuleSVM(max_rule_length=1, max_rules=6)}, k=2)
    assert len(result.folds) == 2 and all(r["accuracy"] > 0.6 for r in result.folds)
    assert (tmp_path / "out" / "metrics.csv").exists() and (tmp_path / "out" / "fold_metrics.csv").exists()


def test_harness_reports_rule_metrics(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal((-1.0, -1.0), 0.2, (18, 2)), rng.normal((1.0, 1.0), 0.2, (18, 2))])
    df = spark.createDataFrame([(float(a), float(b), "negative" if i < 18 else "positive") for i, (a, b) in enumerate(x)], "a double, b double, y string")
    datasets.save_prepared(df, str(tmp_path), datasets.DatasetSpec("synthetic", "Synthetic", "test", 36, 2, "binary", "negative vs positive", "test"), "y", ["a", "b"])
    one = evaluation.evaluate(spark, ["synthetic"], str(tmp_path), str(tmp_path / "out"), {"frs": lambda: FuzzyRuleSVM(C=10.0, penalty="l2", max_rule_length=1, max_rules=6)}, k=3).summary[0]
    assert one["accuracy_mean"] > 0.9 and one["rule_support_rule_count_mean"] > 0 and one["n_folds"] == 3 and 0 <= one["support_rule_jaccard"] <= 1
    assert one["rule_explanation_fidelity_max_abs_error_mean"] < 1e-10 and one["rule_mean_contrastive_gap_mean"] > 0 and "roc_auc_mean" in one


def test_harness_of_several_classes_and_nested_choice(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *(float(v) for v in rng.normal((2.0 * (i % 3), -1.0 * (i % 3)), 0.3)), "abc"[i % 3]) for i in range(45)]
    df = spark.createDataFrame(rows, "row_id long, p double, q double, y string")
    build = lambda **o: OneVsRest(lambda: FuzzyRuleSVM(max_rule_length=1, max_rules=6, **o))
    got = evaluation.nested(df, "y", "row_id", ["p", "q"], build, [{"C": 1.0}, {"C": 1e-6}], outer=3, inner=2)
    assert all(o == {"C": 1.0} for o in got.chosen) and len(got.folds) == 3
    assert all(r["accuracy"] > 0.8 and 0.9 < r["roc_auc"] <= 1 and r["mean_margin_gap"] > 0 and r["rule_n_rules"] == 6 for r in got.folds)
    table = evaluation.ablate(df.filter("y <> 'c'"), "y", "row_id", ["p", "q"], {"full": lambda: FuzzyRuleSVM(), "one": lambda: FuzzyRuleSVM(max_rule_length=1)}, k=2)
    assert [r["variant"] for r in table] == ["full", "one"] and table[0]["delta"] == 0


def test_generators(spark):
    for f in (synthetic.additive_main_effects, synthetic.pairwise_fuzzy_interaction, synthetic.xor_interaction, synthetic.sparse_rule_ground_truth):
        made = f(spark, 50, 3, 1)
        assert made.data.count() == 50 and made.data.agg(F.sum("y")).first()[0] == 25
    assert len(synthetic.add_noise_features(made, 2).feature_names) == len(made.feature_names) + 2


def test_streams_are_scored(spark, tmp_path):
    made = synthetic.additive_main_effects(spark, 60, 0, 3)
    model = FuzzyRuleSVM(max_rule_length=1, max_rules=6).fit(made.data, features=made.feature_names)
    made.data.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(made.data.schema).parquet(str(tmp_path / "in")), model)
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 60


def test_comparators_fit_and_score(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *(float(v) for v in rng.normal((2.0 * (i % 3), -1.0 * (i % 3)), 0.3)), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, p double, q double, y string").coalesce(1).cache()
    two = df.filter("y <> 'c'").withColumn("prediction", F.lit("x"))
    small = {"n_trees": 3, "max_depth": 2, "max_iter": 10}
    for kind in comparators.KINDS:
        got = comparators.Comparator(kind, **small).fit(two, "y", ["p", "q"]).predict(two)
        assert got.columns == two.columns and got.filter("y = prediction").count() > 36, kind
    for kind in ("logistic_l2", "linear_svm", "gradient_boosting", "random_forest"):
        model = comparators.Comparator(kind, **small).fit(df, "y", ["p", "q"])
        assert evaluation.score_figures(model.predict(df), model, "y")["roc_auc"] > 0.8
        assert model.decision_function(df).filter(F.size("margin") == 3).count() == 60, kind
    with pytest.raises(ValueError, match="kind"):
        comparators.Comparator("rbf").fit(df, "y", ["p", "q"])


def test_decisions_are_counted_by_window(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", p, float(h)) for h in (0, 1) for m, p in ((0, 1), (10, 0), (59, 1))]
    df = spark.createDataFrame(rows, "at string, prediction int, margin double").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["window"]["start"].hour, r["prediction"], r["n"], r["mean_margin"]) for r in spark.table("windows").collect())
    assert got == [(0, 0, 1, 0.0), (0, 1, 2, 0.0), (1, 0, 1, 1.0), (1, 1, 2, 1.0)]
