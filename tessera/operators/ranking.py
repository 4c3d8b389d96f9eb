"""Coverage and association scores of rules, and their ranking. Scores of any number of rules take one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import Rule, activation_array, activations, enumerate_rules, rule_text

#: Beyond so many rules the sums are taken in Arrow batches: one aggregate expression for each would make too much code.
WIDE = 120


def signed(label: Column, positive) -> Column:
    return F.when(label == F.lit(positive), 1.0).otherwise(-1.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """The weighted mean of an aggregate, 0 where no weight is left."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(weight * value) / F.greatest(total, F.lit(1e-300))).otherwise(0.0)


def rule_sums(df: DataFrame, rules: Sequence[Rule], partitions, y: Column, weight: Column, and_operator="min", temperature=0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weight of negatives, of positives) and the (2, rules) weighted activation sums of each."""
    positive = (y > 0).cast("int")
    if len(rules) <= WIDE:
        parts = [F.sum(weight * a).alias(f"a{i}") for i, a in enumerate(activations(rules, partitions, and_operator, temperature))]
        rows = df.groupBy(positive.alias("p")).agg(F.sum(weight).alias("w"), *parts).collect()
        totals, sums = np.zeros(2), np.zeros((2, len(rules)))
        for r in rows:
            totals[r["p"]] = r["w"] or 0.0
            sums[r["p"]] = [r[f"a{i}"] or 0.0 for i in range(len(rules))]
        return totals, sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, sums = np.zeros(2), np.zeros((2, len(rules)))
        for b in batches:
            if len(b):
                z, p, w = np.stack(b["z"].to_numpy()), b["p"].to_numpy(), b["w"].to_numpy()
                for k in (0, 1):
                    totals[k] += w[p == k].sum()
                    sums[k] += w[p == k] @ z[p == k]
        yield pd.DataFrame({"p": [0, 1], "w": totals, "s": list(sums)})

    z = activation_array(rules, partitions, and_operator, temperature)
    parts = df.select(z.alias("z"), positive.alias("p"), weight.cast("double").alias("w")).mapInPandas(run, "p int, w double, s array<double>")
    # Summed by place on the executors: one row a rule comes back.
    flat = parts.select("p", "w", F.posexplode("s").alias("i", "v")).groupBy("p", "i").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).collect()
    totals, sums = np.zeros(2), np.zeros((2, len(rules)))
    for r in flat:
        totals[r["p"]], sums[r["p"], r["i"]] = r["w"], r["v"]
    return totals, sums


def scores(totals: np.ndarray, sums: np.ndarray, rules: Sequence[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Coverage, the weighted mean activation, and the association score |mean+ - mean-| * coverage / length."""
    if totals.sum() <= 0:
        raise ValueError("the weights sum to zero")
    coverage = sums.sum(0) / totals.sum()
    means = np.divide(sums, totals[:, None], out=np.zeros_like(sums), where=totals[:, None] > 0)
    length = np.array([r.length for r in rules], float)
    return coverage, np.abs(means[1] - means[0]) * coverage / length


def ranked(rules: Sequence[Rule], coverage: np.ndarray, score: np.ndarray, max_rules: int | None, least: float) -> tuple[list[int], int]:
    """The places of the best rules, and how many passed the coverage; ties keep the order of enumeration."""
    passed = [i for i in range(len(rules)) if coverage[i] >= least]
    passed.sort(key=lambda i: (-score[i], -coverage[i], rules[i].length, i))
    return passed[:max_rules] if max_rules is not None else passed, len(passed)


def generate(df: DataFrame, partitions, y: Column, weight: Column, max_length=2, max_rules=256, least=0.02, and_operator="min", temperature=0.1) -> tuple[list[Rule], list[float], int]:
    """The ranked rules, their scores and the number of candidates; if none passes the coverage, all rules of one term are ranked."""
    rules = enumerate_rules(len(partitions), max_length)
    coverage, score = scores(*rule_sums(df, rules, partitions, y, weight, and_operator, temperature), rules)
    chosen, n = ranked(rules, coverage, score, max_rules, least)
    if not chosen:
        single = [i for i, r in enumerate(rules) if r.length == 1]
        chosen, n = ranked([rules[i] for i in single], coverage[single], score[single], max_rules, -1.0)
        chosen = [single[i] for i in chosen]
    return [rules[i] for i in chosen], [float(score[i]) for i in chosen], n


def ranking_table(df: DataFrame, partitions, y: Column, weight: Column, max_length=2, max_rules=256, least=0.02, and_operator="min", temperature=0.1) -> DataFrame:
    """rank, rule, length, coverage, score as a plan: wide aggregate, one row a rule, ordered and cut."""
    rules = enumerate_rules(len(partitions), max_length)
    acts = activations(rules, partitions, and_operator, temperature)
    up, down = F.when(y > 0, weight).otherwise(0.0), F.when(y > 0, 0.0).otherwise(weight)
    sums = df.agg(F.sum(up).alias("wp"), F.sum(down).alias("wn"), F.array(*[F.struct(F.sum(up * a).alias("p"), F.sum(down * a).alias("n")) for a in acts]).alias("s"))
    names = [p.feature for p in partitions]
    text = F.array(*[F.struct(F.lit(rule_text(r, names)).alias("rule"), F.lit(r.length).alias("length")) for r in rules])
    each = sums.select("wp", "wn", F.posexplode(F.arrays_zip("s", text.alias("t"))).alias("enum_idx", "x"))
    mean = lambda s, w: F.when(F.col(w) > 0, s / F.greatest(F.col(w), F.lit(1e-300))).otherwise(0.0)
    coverage = (F.col("x.s.p") + F.col("x.s.n")) / (F.col("wp") + F.col("wn"))
    score = F.abs(mean(F.col("x.s.p"), "wp") - mean(F.col("x.s.n"), "wn")) * coverage / F.col("x.t.length")
    out = each.select("enum_idx", F.col("x.t.rule").alias("rule"), F.col("x.t.length").alias("length"), coverage.alias("coverage"), score.alias("score"))
    return out.filter(F.col("coverage") >= least).orderBy(F.desc("score"), F.desc("coverage"), "length", "enum_idx").limit(max_rules)
