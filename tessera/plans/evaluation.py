"""Cross-validation of estimators over data sets: folds, imputation within the fold, metrics, roll-ups, nested selection."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics, prepare
from tessera.operators.comparators import KINDS, Comparator
from tessera.operators.explain import checked_sign
from tessera.operators.estimators import CSRQClassifier, FuzzyRuleSVM, MembershipLogisticL1, MembershipSVM, OneVsRest
from tessera.sources import datasets


@dataclass(frozen=True)
class Result:
    folds: list[dict]
    summary: list[dict]


def default_model(n_features: int, n_classes: int = 2):
    """Rules of two terms up to 32 features, else of one; about three rules a feature."""
    model = lambda: FuzzyRuleSVM(max_rule_length=2 if n_features <= 32 else 1, max_rules=min(256, max(24, 3 * n_features)), min_rule_coverage=0.01, rule_length_penalty=0.35, class_weight="balanced")
    return model() if n_classes == 2 else OneVsRest(model)


#: Models on raw features, by name.
COMPARATORS: dict[str, Callable] = {kind: (lambda kind=kind: Comparator(kind)) for kind in KINDS}


def grid(**options: Sequence) -> list[dict]:
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


#: One design knob each against the default.
ABLATIONS: dict[str, Callable] = {
    "frs": FuzzyRuleSVM, "no_length_penalty": lambda: FuzzyRuleSVM(rule_length_penalty=0.0), "l2": lambda: FuzzyRuleSVM(penalty="l2"), "product": lambda: FuzzyRuleSVM(and_operator="product"),
    "softmin": lambda: FuzzyRuleSVM(and_operator="softmin"), "wide_quantiles": lambda: FuzzyRuleSVM(quantiles=(0.25, 0.5, 0.75)), "one_term": lambda: FuzzyRuleSVM(max_rule_length=1),
    "membership_svm": MembershipSVM, "membership_logistic": MembershipLogisticL1, "csrq": CSRQClassifier,
}


def binary_parts(model, label: str) -> list[tuple]:
    """(model, the sign of the truth, a prefix of its rules) for a binary model, or for each class of one against the rest."""
    if isinstance(model, OneVsRest):
        return [(m, F.when(F.col(label) == F.lit(c), 1.0).otherwise(-1.0), f"ovr={c}|" if len(model.models_) > 1 else "") for c, m in zip(model.classes_, model.models_, strict=True)]
    return [(model, checked_sign(F.col(label), model.classes_), "")] if len(model.classes_) == 2 else []


def rule_figures(model, test: DataFrame, label: str) -> dict:
    """The mean rule metrics of a model's binary parts, with the prefix rule_."""
    rows = []
    for m, y, _ in binary_parts(model, label):
        if hasattr(m, "rules_"):
            acts = F.array(*m.activation_columns())
            screened = len(getattr(m, "selected_", m.partitions_))
            made = metrics.rule_metrics(test, acts, m.coef_, [r.length for r in m.rules_], m.intercept_, y, getattr(m, "n_candidate_rules_", len(m.rules_)), m.n_features_in_, screened, m.margin_column())
            rows.append(made.first().asDict())
    return metrics.mean_of_dicts(rows, "rule_")


def support_set(model, label: str) -> set[str]:
    return {prefix + r["rule"] for m, _, prefix in binary_parts(model, label) if hasattr(m, "support_rules") for r in m.support_rules()}


def score_figures(scored: DataFrame, model, label: str) -> dict:
    """AUC and margins: of the positive class for binary models, the mean over classes and the gap of the two best scores for several."""
    if len(model.classes_) > 2:
        each = model.decision_function(scored, "margins")
        columns = {c: f"_score{i}" for i, c in enumerate(model.classes_)}
        each = each.withColumns({name: F.get("margins", F.lit(i)) for i, name in enumerate(columns.values())})
        return metrics.roc_auc_ovr(each, label, columns).first().asDict() | metrics.margin_gap_stats(each, F.col("margins"))
    each = model.decision_function(scored)
    return metrics.roc_auc(each, F.col(label) == F.lit(model.classes_[1]), "margin").first().asDict() | metrics.margin_stats(each, "margin")


def evaluate_fold(train: DataFrame, test: DataFrame, model, label: str, features: Sequence[str]) -> dict:
    middle = prepare.medians(train, features)
    train, test = prepare.impute_median(train, features, middle), prepare.impute_median(test, features, middle)
    began = time.perf_counter()
    model.fit(train, label, features)
    fitted = time.perf_counter()
    scored = model.predict(test)
    out = metrics.confusion_metrics(scored, label, "prediction").first().asDict()
    predicted = time.perf_counter()
    out |= score_figures(scored, model, label) | rule_figures(model, test, label)
    sizes = {"n_train": train.count(), "n_test": test.count(), "n_features": len(features), "n_classes": len(model.classes_)}
    return sizes | {k: v for k, v in out.items() if v is not None} | {"fit_seconds": fitted - began, "predict_seconds": predicted - fitted}


def cross_validate(df: DataFrame, label: str, row_id: str, features: Sequence[str], factory: Callable, k: int = 5, seed: int = 0) -> tuple[list[dict], list[set]]:
    """Metrics and support rules of each fold."""
    folded = prepare.stratified_folds(df, label, row_id, k, seed).persist()
    try:
        rows, supports = [], []
        for fold in range(folded.agg(F.max("fold")).first()[0] + 1):
            model = factory()
            rows.append({"fold": fold, **evaluate_fold(folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold), model, label, features)})
            supports.append(support_set(model, label))
        return rows, supports
    finally:
        folded.unpersist()


def jaccard(sets: Sequence[set]) -> float:
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    return sum(len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs) / len(pairs) if pairs else 1.0


def select(df: DataFrame, label: str, row_id: str, features: Sequence[str], build: Callable, options: Sequence[dict], k: int = 3, seed: int = 0) -> dict:
    """The options of the best mean balanced accuracy, then macro F1, then the first; a single one isn't tried."""
    if len(options) == 1:
        return options[0]
    best = None
    for i, o in enumerate(options):
        rows, _ = cross_validate(df, label, row_id, features, lambda o=o: build(**o), k, seed)
        key = (sum(r["balanced_accuracy"] for r in rows) / len(rows), sum(r["f1_macro"] for r in rows) / len(rows), -i)
        best = max(best, (key, i)) if best else (key, i)
    return options[best[1]]


#: What isn't summed up over folds.
_PLACES = ("fold", "n_train", "n_test", "n_features", "n_classes")


def summarise(spark: SparkSession, rows: Sequence[dict], by: Sequence[str] = ("dataset", "model")) -> list[dict]:
    """One dict for each data set and model: mean, std, median, q25 and q75 of each metric over its folds, as metric_mean and so on."""
    long = [(*[str(r[b]) for b in by], m, float(v)) for r in rows for m, v in r.items() if m not in (*by, *_PLACES) and isinstance(v, int | float)]
    df = spark.createDataFrame(long, ", ".join(f"{b} string" for b in by) + ", metric string, value double")
    found: dict[tuple, dict] = {}
    for r in metrics.roll_up(df, list(by)).orderBy(*by, "metric").collect():
        key = tuple(r[b] for b in by)
        found.setdefault(key, dict(zip(by, key, strict=True))).update({f"{r['metric']}_{k}": r[k] for k in ("mean", "std", "median", "q25", "q75")})
    return list(found.values())


def evaluate(spark: SparkSession, slugs: Sequence[str], directory: str, out: str | None = None, factories: dict[str, Callable] | None = None, k: int = 5, seed: int = 0, max_samples: int | None = None) -> Result:
    """Each model on each prepared data set, on a stratified subset where there are more than max_samples rows; writes fold_metrics.csv, metrics.csv, metrics.json and run.json where out is given."""
    rows, extra = [], {}
    known = [s.slug for s in datasets.list_datasets()]
    for slug in slugs:
        df, spec, names = datasets.load_dataset(spark, slug, directory)
        df = df.withColumn("row_id", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))
        own = prepare.dataset_seed(seed, slug, known)
        if max_samples is not None:
            df = prepare.stratified_subset(df, "target", "row_id", max_samples, own)
        classes = df.select("target").distinct().count()
        for key, factory in (factories or {"default": lambda n=len(names), c=classes: default_model(n, c)}).items():
            found, supports = cross_validate(df, "target", "row_id", names, factory, k, own)
            rows += [{"dataset": slug, "model": key, **r} for r in found]
            extra[slug, key] = {"dataset_name": spec.name, "task": spec.task, "n_samples": df.count(), "n_features": len(names), "n_classes": classes, "n_folds": len(found), "support_rule_jaccard": jaccard(supports)}
    summary = [s | extra[s["dataset"], s["model"]] for s in summarise(spark, rows)]
    if out:
        os.makedirs(out, exist_ok=True)
        datasets.write_csv_rows(rows, f"{out}/fold_metrics.csv")
        datasets.write_csv_rows(summary, f"{out}/metrics.csv")
        datasets.write_json(f"{out}/metrics.json", {"folds": rows, "summary": summary})
        datasets.write_run_metadata(spark, f"{out}/run.json", {"slugs": list(slugs), "k": k, "seed": seed})
    return Result(rows, summary)


@dataclass(frozen=True)
class Nested:
    folds: list[dict]
    chosen: list[dict]


def nested(df: DataFrame, label: str, row_id: str, features: Sequence[str], build: Callable, options: Sequence[dict], outer: int = 5, inner: int = 3, repeats: int = 1, seed: int = 0) -> Nested:
    """Nested cross-validation: in each outer fold the options are chosen on its training rows alone, and the model they make is measured on its test rows."""
    rows, chosen = [], []
    for repeat in range(repeats):
        folded = prepare.stratified_folds(df, label, row_id, outer, seed + repeat).persist()
        try:
            for fold in range(folded.agg(F.max("fold")).first()[0] + 1):
                train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
                best = select(train, label, row_id, features, build, options, inner, seed + 100 * repeat + fold)
                rows.append({"repeat": repeat, "fold": fold, **evaluate_fold(train, test, build(**best), label, features)})
                chosen.append(best)
        finally:
            folded.unpersist()
    return Nested(rows, chosen)


def ablate(df: DataFrame, label: str, row_id: str, features: Sequence[str], variants: dict[str, Callable] | None = None, k: int = 3, seed: int = 0) -> list[dict]:
    """One row a variant: the mean of each metric over folds, and its balanced accuracy less that of the first variant."""
    out = []
    for name, factory in (variants or ABLATIONS).items():
        rows, supports = cross_validate(df, label, row_id, features, factory, k, seed)
        mean = metrics.mean_of_dicts([{m: v for m, v in r.items() if m not in _PLACES} for r in rows])
        out.append({"variant": name, "support_rule_jaccard": jaccard(supports), **mean, "delta": mean["balanced_accuracy"] - (out[0]["balanced_accuracy"] if out else mean["balanced_accuracy"])})
    return out


def budget_sweep(df: DataFrame, label: str, row_id: str, features: Sequence[str], budgets: Sequence[int] = (8, 16, 32, 64), k: int = 3, seed: int = 0) -> list[dict]:
    """Accuracy and complexity by the number of rules that may stay."""
    rows = ablate(df, label, row_id, features, {str(b): (lambda b=b: FuzzyRuleSVM(max_rules=b)) for b in budgets}, k, seed)
    return [{"max_rules": int(r.pop("variant")), **r} for r in rows]


def screening_sweep(df: DataFrame, label: str, row_id: str, features: Sequence[str], sizes: Sequence[int], method: str = "anova", k: int = 3, seed: int = 0) -> list[dict]:
    """Accuracy by the number of features that screening lets through, for tables of many features."""
    rows = ablate(df, label, row_id, features, {str(n): (lambda n=n: FuzzyRuleSVM(feature_screening=method, screen_top_k=n)) for n in sizes}, k, seed)
    return [{"screen_top_k": int(r.pop("variant")), **r} for r in rows]


def main(args: Sequence[str] | None = None) -> None:
    """python -m tessera.plans.evaluation --data DIR --out DIR SLUG...: evaluates the default model."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("slugs", nargs="+")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--folds", type=int, default=5)
    a = p.parse_args(args)
    evaluate(SparkSession.builder.getOrCreate(), a.slugs, a.data, a.out, k=a.folds)


if __name__ == "__main__":
    main()
