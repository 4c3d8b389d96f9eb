"""What comes before a fit: anchors, imputation, screening, class weights, folds and subsets. One aggregate each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.membership import Partition

QUANTILES = (0.05, 0.5, 0.95)


def feature_names(df: DataFrame, given: Sequence[str] | None = None, label: str | None = None, other: Sequence[str] = ()) -> list[str]:
    """The given names if df has them all, else df's columns without the label and others."""
    if given is None:
        return [c for c in df.columns if c != label and c not in other]
    if missing := [c for c in given if c not in df.columns]:
        raise ValueError(f"feature_names: columns {missing} are missing")
    return list(given)


def require_clean(df: DataFrame, features: Sequence[str]) -> None:
    """Raises if a feature has nulls, NaN or infinities, as clipping would hide them."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in features]
    counts = df.agg(*bad).first().asDict()
    if found := {c: n for c, n in counts.items() if n}:
        raise ValueError(f"missing or infinite values: {found}")


def missing_to_null(c: str) -> Column:
    """NaN becomes null: percentiles take it for the largest value otherwise."""
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


#: How many different values a last pass may hold for a quantile, and the accuracy of the sketch that brackets it.
DISTINCT, ACCURACY = 20_000, 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, by a bracket for each that narrows until it holds few different values.

    A pass counts what lies below and in each bracket; where there are more than ``DISTINCT`` different values, a sketch of the bracket's values narrows it by some thousand
    times. The last pass takes the two order statistics. So no task ever holds the values of a continuous column. Nulls are left out; a column without values gives None.
    """
    asked = [(c, q) for c in columns for q in fractions]
    bracket = dict.fromkeys(asked, (-math.inf, math.inf))
    inside = lambda k: F.when((F.col(k[0]) >= bracket[k][0]) & (F.col(k[0]) <= bracket[k][1]), F.col(k[0]).cast("double"))
    total: dict[str, int] = {}
    while True:
        parts = [F.count(c).alias(f"n_{c}") for c in columns]
        different = {b: i for i, b in enumerate(dict.fromkeys((k[0], *bracket[k]) for k in asked))}
        for (c, *b), i in different.items():
            x = inside(next(k for k in asked if (k[0], *bracket[k]) == (c, *b)))
            parts += [F.count_if(F.col(c) < b[0]).alias(f"b{i}"), F.count(x).alias(f"m{i}"), F.approx_count_distinct(x).alias(f"d{i}")]
        row = df.agg(*parts).first()
        total = {c: row[f"n_{c}"] for c in columns}
        at = {k: different[k[0], *bracket[k]] for k in asked}
        place = {k: k[1] * (total[k[0]] - 1) - row[f"b{at[k]}"] for k in asked}
        size = {k: row[f"m{at[k]}"] for k in asked}
        wide = [k for k in asked if bracket[k][0] < bracket[k][1] and row[f"d{at[k]}"] > DISTINCT]
        if not wide:
            break
        ends = []
        for i, k in enumerate(wide):
            r, e = place[k] / (size[k] - 1), 3 / ACCURACY + 2 / size[k]
            ends.append(F.percentile_approx(inside(k), [max(0.0, r - e), min(1.0, r + e)], ACCURACY).alias(f"e{i}"))
        row = df.agg(*ends).first()
        bracket |= {k: tuple(row[f"e{i}"]) for i, k in enumerate(wide)}
    parts = []
    for i, k in enumerate(asked):
        for j in (0, 1):
            n = min(math.floor(place[k]) + j, size[k] - 1) if size[k] else 0
            # The n-th value of m is the least that a share of (n + 0.5) / m reaches.
            parts.append(F.expr(f"percentile_disc({(n + 0.5) / max(size[k], 1)!r}) WITHIN GROUP (ORDER BY {_between(k[0], *bracket[k])})").alias(f"x{i}_{j}"))
    row = df.agg(*parts).first()
    out: dict[str, list] = {c: [] for c in columns}
    for i, k in enumerate(asked):
        lo, hi = row[f"x{i}_0"], row[f"x{i}_1"]
        out[k[0]].append(None if lo is None else float(lo + (hi - lo) * (place[k] - math.floor(place[k]))))
    return out


def _between(c: str, lo: float, hi: float) -> str:
    """SQL for the values of a column within a bracket, null outside."""
    ends = [f"`{c}` {op} {x!r}D" for op, x in ((">=", lo), ("<=", hi)) if math.isfinite(x)]
    return f"CASE WHEN {' AND '.join(ends) or 'true'} THEN CAST(`{c}` AS DOUBLE) END"


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    found = exact_quantiles(df.select(*[missing_to_null(c).alias(c) for c in features]), features, [0.5])
    return {c: x[0] for c, x in found.items()}


def impute_median(df: DataFrame, features: Sequence[str], found: dict[str, float] | None = None) -> DataFrame:
    """Nulls and NaN become the training median; found holds that of another fold."""
    found = medians(df, features) if found is None else found
    return df.withColumns({c: F.coalesce(missing_to_null(c), F.lit(found[c])) for c in features})


def anchors(df: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> list[Partition]:
    """Exact linear-interpolation quantiles of all features, together."""
    q1, q2, q3 = map(float, quantiles)
    if not 0 <= q1 < q2 < q3 <= 1:
        raise ValueError("quantiles must increase within [0, 1]")
    found = exact_quantiles(df, features, [q1, q2, q3])
    if any(None in found[c] for c in features):
        raise ValueError("a feature has no values")
    return [Partition(c, *found[c]) for c in features]


def class_weights(df: DataFrame, label: str, class_weight: str | dict | None) -> dict:
    """As class_weights_of, by the label's counts."""
    return class_weights_of({r[0]: r[1] for r in df.groupBy(label).count().collect()}, class_weight)


def class_weights_of(counts: dict, class_weight: str | dict | None) -> dict:
    """balanced: n / (k n_c); a dict keeps 1 for classes that it lacks."""
    if class_weight is None:
        return dict.fromkeys(counts, 1.0)
    if isinstance(class_weight, dict):
        return {c: float(class_weight.get(c, 1.0)) for c in counts}
    if class_weight != "balanced":
        raise ValueError("class_weight must be None, 'balanced' or a dict")
    n = sum(counts.values())
    return {c: n / (len(counts) * max(k, 1)) for c, k in counts.items()}


def lookup(label: Column, values: dict, default: float = 1.0) -> Column:
    out = F.lit(float(default))
    for k, v in values.items():
        out = F.when(label == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> list[tuple[str, float]]:
    """The one-way F of each feature; not a number or infinite counts as 0, as the scores only rank.

    Sums are taken of values less the overall mean: sums of squares of far-off values would cancel.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    parts = []
    for i, c in enumerate(features):
        x = F.col(c) - F.lit(means[c])
        parts += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *parts).collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    out = []
    for i, c in enumerate(features):
        grand = sum(r[f"s{i}"] for r in rows) ** 2 / n if n else 0.0
        between = sum(r[f"s{i}"] ** 2 / r["n"] for r in rows) - grand
        within = sum(r[f"q{i}"] - r[f"s{i}"] ** 2 / r["n"] for r in rows)
        f = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within > 0 else 0.0
        out.append((c, f if math.isfinite(f) else 0.0))
    return out


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 16) -> list[tuple[str, float]]:
    """Mutual information (nats) of each feature's quantile bin with the label: a binned estimate. The cuts of all features are found together, and one grouped pass counts all bins."""
    cuts = exact_quantiles(df, features, [i / bins for i in range(1, bins)])
    bin_ = lambda c: sum((F.when(F.col(c) > F.lit(x), 1).otherwise(0) for x in sorted(set(cuts[c]) - {None})), F.lit(0))
    each = F.posexplode(F.array(*[bin_(c) for c in features])).alias("f", "b")
    rows = df.select(F.col(label).alias("y"), each).groupBy("f", "b", "y").count().collect()  # features * bins * classes rows at most
    out = []
    for i, c in enumerate(features):
        own = [r for r in rows if r["f"] == i]
        n = sum(r["count"] for r in own)
        by_b, by_y = {}, {}
        for r in own:
            by_b[r["b"]] = by_b.get(r["b"], 0) + r["count"]
            by_y[r["y"]] = by_y.get(r["y"], 0) + r["count"]
        mi = sum(r["count"] / n * math.log(r["count"] * n / (by_b[r["b"]] * by_y[r["y"]])) for r in own)
        out.append((c, max(0.0, mi)))
    return out


def screen(df: DataFrame, features: Sequence[str], label: str, method: str = "none", top_k: int | None = None) -> list[str]:
    """The top_k features by score, in their own order; of equal scores the later feature is taken first."""
    if method not in ("none", "anova", "mutual_info"):
        raise ValueError("feature_screening must be none, anova or mutual_info")
    if top_k is not None and top_k < 1:
        raise ValueError("screen_top_k must be positive")
    if method == "none" or top_k is None or top_k >= len(features):
        return list(features)
    scores = anova_f(df, features, label) if method == "anova" else mutual_information(df, features, label)
    best = sorted(range(len(features)), key=lambda i: (-scores[i][1], -i))[:top_k]
    return [features[i] for i in sorted(best)]


#: The modulus of the shuffle, and the ranges of it in which rows are numbered.
PRIME, CELLS = 1_000_003, 4096


def portable_order(row_id: str, seed: int = 0) -> Column:
    """A shuffle that any SQL engine can repeat: a multiple of the id modulo a prime, then the id."""
    return F.pmod(F.col(row_id).cast("long") * F.lit(7919 + 2 * seed) + F.lit(104729 * (seed + 1)), F.lit(PRIME))


def turns(df: DataFrame, label: str, row_id: str, seed: int = 0) -> DataFrame:
    """df with _turn: 0, 1, ... of a label's rows in portable order.

    Rows are numbered within ranges of the order, and each range starts where those before it end, so no task holds all rows of a label."""
    rows = df.withColumn("_order", portable_order(row_id, seed)).withColumn("_cell", F.floor(F.col("_order") * CELLS / PRIME))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_cell").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_label").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_label", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # CELLS rows a label
    inside = F.row_number().over(W.partitionBy(label, "_cell").orderBy("_order", row_id)) - 1
    both = rows.withColumn("_at", inside).join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_cell") == F.col("_of")))
    return both.withColumn("_turn", F.col("_start") + F.col("_at")).drop("_order", "_cell", "_label", "_of", "_start", "_at")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold: rows of a label are dealt out in turn; folds are at most as many as the smallest class has rows."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    folds = min(k, least)
    if folds < 2:
        raise ValueError("the smallest class has fewer than two rows")
    return turns(df, label, row_id, seed).withColumn("fold", F.pmod("_turn", F.lit(folds)).cast("int")).drop("_turn")


def subset_sizes(counts: dict, size: int) -> dict:
    """Rows of each class in a subset: max(2, floor of its share), shrinking the largest until they fit."""
    n = sum(counts.values())
    give = {c: min(k, max(2, math.floor(size * k / n))) for c, k in sorted(counts.items())}
    while sum(give.values()) > size and max(give.values()) > 2:
        most = max(give, key=lambda c: (give[c], str(c)))
        give[most] -= 1
    return give


def stratified_subset(df: DataFrame, label: str, row_id: str, size: int, seed: int = 0) -> DataFrame:
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if sum(counts.values()) <= size:
        return df
    give = subset_sizes(counts, size)
    return turns(df, label, row_id, seed).filter(F.col("_turn") < lookup(F.col(label), give, 0)).drop("_turn")


def dataset_seed(seed: int, slug: str, known: Sequence[str]) -> int:
    return seed + 1000 * (list(known).index(slug) if slug in known else 0)
