"""Evaluation metrics as aggregates: confusion family, ROC AUC, margins, rule metrics, stability and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.membership import violation_grades
from tessera.operators.prepare import exact_quantiles


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall of true classes), macro and weighted F1, macro precision and recall (0 where undefined)."""
    cells = confusion(df, truth, predicted)
    by = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")),
    )).alias("x")).groupBy("x.c").agg(F.sum("x.t").alias("t"), F.sum("x.q").alias("q"), F.sum("x.h").alias("h"))
    recall = F.when(F.col("t") > 0, F.col("h") / F.greatest(F.col("t"), F.lit(1))).otherwise(0.0)
    precision = F.when(F.col("q") > 0, F.col("h") / F.greatest(F.col("q"), F.lit(1))).otherwise(0.0)
    f1 = F.when(F.col("t") + F.col("q") > 0, 2.0 * F.col("h") / F.greatest(F.col("t") + F.col("q"), F.lit(1))).otherwise(0.0)
    return by.withColumns({"r": recall, "pr": precision, "f": f1}).agg(
        (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("r"))).alias("balanced_accuracy"), F.avg("f").alias("f1_macro"),
        (F.sum(F.col("f") * F.col("t")) / F.sum("t")).alias("f1_weighted"), F.avg("pr").alias("precision_macro"), F.avg("r").alias("recall_macro"),
    )


def number_range(x: Column) -> Column:
    """A number that grows with x in steps: 64 ranges for each power of two, some hundred thousand in all."""
    step = F.floor(F.log2(F.abs(F.nullif(x.cast("double"), F.lit(0.0)))) * 64)
    return F.when(x == 0, 0.0).otherwise(F.signum(x.cast("double")) * (100_000 + step))


def roc_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row: the rank-sum AUC with average ranks. Ties are grouped first, so the running sum is over different scores.

    The running sum is cut in two levels by score range, so that no task holds all scores; null if a class is absent.
    """
    tied = df.groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    tied = tied.withColumn("cell", number_range(F.col("s")))
    cells = tied.groupBy("cell").agg(F.sum(F.col("n") - F.col("p")).alias("neg"), F.min("s").alias("first"))
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("cell", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("cell").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(inside), F.lit(0))
    each = tied.withColumn("below", below).join(starts, "cell")
    wins = F.sum(F.col("p") * (F.col("start") + F.col("below") + (F.col("n") - F.col("p")) / 2))
    pairs = F.sum("p").cast("double") * F.sum(F.col("n") - F.col("p"))
    return each.agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, truth: str, scores: dict) -> DataFrame:
    """One row: the mean AUC of each class against the rest; scores: class -> score column."""
    out = None
    for c, s in scores.items():
        one = roc_auc(df, F.col(truth) == F.lit(c), s)
        out = one if out is None else out.union(one)
    return out.agg(F.avg("roc_auc").alias("roc_auc"))


def margin_stats(df: DataFrame, margin: str) -> dict[str, float]:
    """The mean and the exact median of the margins' sizes."""
    sizes_ = df.select(F.abs(margin).alias("m"))
    return {"mean_abs_margin": sizes_.agg(F.avg("m")).first()[0], "median_abs_margin": exact_quantiles(sizes_, ["m"], [0.5])["m"][0]}


def margin_gap_stats(df: DataFrame, scores: Column) -> dict[str, float]:
    """The mean and the exact median of the gap between the best and the second score."""
    gaps = df.select(margin_gap(scores).alias("g"))
    return {"mean_margin_gap": gaps.agg(F.avg("g")).first()[0], "median_margin_gap": exact_quantiles(gaps, ["g"], [0.5])["g"][0]}


def margin_gap(scores: Column) -> Column:
    """The best score less the second, for an array of class scores."""
    ordered = F.sort_array(scores, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def sizes(contributions: Column) -> Column:
    return F.sort_array(F.transform(contributions, F.abs), asc=False)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def top_share(contributions: Column, k: int) -> Column:
    """The share of the k largest contributions in all of them, 0 without any."""
    s = sizes(contributions)
    return F.when(total(s) > 0, total(F.slice(s, 1, k)) / F.nullif(total(s), F.lit(0.0))).otherwise(0.0)


def rules_to_cover(contributions: Column, mass: float = 0.9) -> Column:
    """How many of the largest contributions reach the share of all."""
    s = sizes(contributions)
    goal = total(s) * mass
    fold = F.aggregate(s, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x < goal, 1).otherwise(0)).alias("n")))
    return F.when(total(s) > 0, F.least(fold["n"] + 1, F.size(s))).otherwise(0)


def safe_weighted_mean(values: Sequence[float], weights: Sequence[float]) -> float:
    total_ = sum(weights)
    return sum(v * w for v, w in zip(values, weights, strict=True)) / total_ if total_ > 0 else 0.0


def rule_metrics(df: DataFrame, activation: Column, coefficients: Sequence[float], lengths: Sequence[int], intercept: float, y: Column, n_candidates: int, n_features: int, n_screened: int, served: Column | None = None) -> DataFrame:
    """One row: thirty figures of complexity, activity, concentration, fidelity, contrast and violation of one binary model.

    Contributions are coefficient times activation. ``served`` is the margin that the model answers with; fidelity holds it against intercept plus contributions, which are
    summed here on their own. Contributions support a decision if they have its sign, a margin of 0 counting as positive. An empty df gives nulls where rows are needed."""
    c, size = list(map(float, coefficients)), [abs(float(x)) for x in coefficients]
    support = [i for i, x in enumerate(size) if x > 1e-10]
    fixed = {
        "candidate_rules": float(n_candidates), "n_rules": float(len(c)), "retained_rule_ratio": len(c) / max(1, n_candidates),
        "screened_features": float(n_screened), "screened_feature_ratio": n_screened / max(1, n_features),
        "support_rule_count": float(len(support)), "support_rule_ratio": len(support) / max(1, len(c)),
        "avg_rule_length": sum(lengths) / len(lengths) if lengths else 0.0, "avg_support_rule_length": sum(lengths[i] for i in support) / len(support) if support else 0.0,
        "weighted_rule_length": safe_weighted_mean(lengths, size), "coef_l1": sum(size), "coef_l2": sum(x * x for x in size) ** 0.5,
        "length_weighted_complexity": float(sum(x * n for x, n in zip(size, lengths, strict=True))),
    }
    beta = F.array(*map(F.lit, c)).cast("array<double>")
    summed = total(F.col("c")) + float(intercept)
    rows = df.select(activation.alias("z"), y.alias("y"), *([served.alias("m")] if served is not None else [])).withColumn("c", F.zip_with("z", beta, lambda a, b: a * b))
    rows = rows if served is not None else rows.withColumn("m", summed)
    slack = F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("m"))
    grades = violation_grades(slack)
    sign = F.when(F.col("m") >= 0, 1.0).otherwise(-1.0)
    along = F.transform("c", lambda x: x * sign)
    supporting = total(F.transform(along, lambda x: F.greatest(x, F.lit(0.0))))
    opposing = total(F.transform(along, lambda x: F.greatest(-x, F.lit(0.0))))
    error = F.abs(F.col("m") - summed)
    each = rows.select("z", "c", "m", slack.alias("slack"), supporting.alias("supporting"), opposing.alias("opposing"), error.alias("error"), *[g.alias(n) for n, g in grades.items()])
    both = F.col("supporting") + F.col("opposing")
    parts = {
        "mean_rule_activation": F.avg(total(F.col("z")) / max(len(c), 1)), "mean_fired_rules_per_sample": F.avg(F.size(F.filter("z", lambda x: x > 1e-6))),
        "mean_contributing_rules_per_sample": F.avg(F.size(F.filter("c", lambda x: F.abs(x) > 1e-8))), "mean_rules_for_90pct_contribution": F.avg(rules_to_cover(F.col("c"))),
        "top1_abs_contribution_share": F.avg(top_share(F.col("c"), 1)), "top5_abs_contribution_share": F.avg(top_share(F.col("c"), 5)),
        "explanation_fidelity_max_abs_error": F.max("error"), "explanation_fidelity_mean_abs_error": F.avg("error"), "mean_abs_margin": F.avg(F.abs("m")),
        "mean_supporting_contribution": F.avg("supporting"), "mean_opposing_contribution": F.avg("opposing"), "mean_contrastive_gap": F.avg(F.col("supporting") - F.col("opposing")),
        "mean_contrastive_ratio": F.avg(F.when(both > 0, F.col("supporting") / F.nullif(both, F.lit(0.0))).otherwise(0.0)),
        "mean_slack": F.avg("slack"), **{f"{n}_membership": F.avg(n) for n in grades},
    }
    return each.agg(*[v.alias(k) for k, v in parts.items()]).select(*[F.lit(v).alias(k) for k, v in fixed.items()], *parts)


def mean_of_dicts(rows: Sequence[dict], prefix: str = "") -> dict:
    """The mean of each key over the dicts that have it."""
    keys = sorted({k for r in rows for k in r})
    found = {k: [r[k] for r in rows if r.get(k) is not None] for k in keys}
    return {f"{prefix}{k}": sum(v) / len(v) for k, v in found.items() if v}


def jaccard_stability(sets: DataFrame, fold: str, items: str) -> DataFrame:
    """One row: the mean Jaccard index of item sets over pairs of folds; two empty sets and a single fold give 1. Folds are few."""
    a, b = sets.select(F.col(fold).alias("f"), F.col(items).alias("x")), sets.select(F.col(fold).alias("g"), F.col(items).alias("y"))
    union = F.size(F.array_union("x", "y"))
    index = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / F.greatest(union, F.lit(1)))
    return a.join(b, F.col("f") < F.col("g")).agg(F.coalesce(F.avg(index), F.lit(1.0)).alias("jaccard"))


def roll_up(folds: DataFrame, by: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, sample standard deviation (0 for one fold), median and quartiles of each metric; NaN counts as missing."""
    v = F.nullif(F.col(value), F.lit(float("nan")))
    return folds.groupBy(*by, metric).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.median(v).alias("median"),
        F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.count(v).alias("n"),
    )


def best_per_group(df: DataFrame, group: str, score: str, *ties: str) -> DataFrame:
    w = W.partitionBy(group).orderBy(F.desc(score), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def pareto(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """The rows that no cheaper or equally cheap row matches in gain. The best gain of each cost comes first, then the best before it, within a range of costs
    and over the ranges, so that no task holds all costs."""
    best = df.groupBy(cost).agg(F.max(gain).alias(gain)).withColumn("_range", number_range(F.col(cost)))
    tops = best.groupBy("_range").agg(F.max(gain).alias("_top"))
    below = F.max("_top").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = tops.select(F.col("_range").alias("_of"), below.alias("_below"))  # one row a range
    before = F.max(gain).over(W.partitionBy("_range").orderBy(cost).rowsBetween(W.unboundedPreceding, -1))
    both = best.withColumn("_before", before).join(ranges, F.col("_range") == F.col("_of"))
    most = F.greatest("_before", "_below")
    return both.filter(most.isNull() | (F.col(gain) > most)).drop("_range", "_of", "_before", "_below")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order (distinct on)."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def nonzero_features(coefficients: DataFrame, feature: str = "feature", value: str = "coef") -> DataFrame:
    return coefficients.filter(F.abs(value) > 1e-12).agg(F.countDistinct(feature).alias("nonzero_features"))


def rule_set_complexity(rules: DataFrame, conditions: str = "conditions") -> DataFrame:
    n = F.size(conditions)
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.sum(n).alias("total_antecedents"), F.avg(n).alias("avg_antecedents"))


def most_common(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value (of ties the first seen) and how many there are."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.count(F.lit(1)).alias("n_distinct"))
