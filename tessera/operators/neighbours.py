"""Mutual information of continuous features with a class by nearest neighbours on one axis (Ross 2014), within ranges of values.

A value's radius is its distance to the k-th neighbour of its own class; m counts all rows that lie nearer than that, or on the value itself. The
estimate is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), at least 0.

Equal values of a class are one row with a count from the start, so ties are no skew. Values are sorted within ``cells`` ranges; each range knows the k values
of the class on either side of it, and how many rows lie before it. No task holds a whole feature or class, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

CELLS = 1024


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1 to some 1e-13: the asymptotic series at x + 10 less the steps to there."""
    z = x.cast("double") + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum((1 / (x + i) for i in range(10)), F.lit(0.0))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _doubles(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits).view(np.float64)


def reach(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest double h with h - x < radius as doubles are subtracted, or x itself where radius is 0; by bisection, as x + radius is rounded."""
    x = x + 0.0
    with np.errstate(over="ignore"):
        least, most = _ordered(x), _ordered(np.nextafter(np.minimum(x + 2 * radius, np.finfo(np.float64).max), np.inf))
    for _ in range(65):
        middle = (least & most) + ((least ^ most) >> 1)
        inside = _doubles(middle) - x < radius
        least, most = np.where(inside, middle, least), np.where(inside, most, middle)
    return np.where(radius > 0, _doubles(least), x)


def _cell_of(cuts: dict[int, np.ndarray]):
    @F.pandas_udf(IntegerType())
    def cell(f: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(f), np.int32)
        for i in f.unique():
            own = (f == i).to_numpy()
            out[own] = np.searchsorted(cuts[i], x.to_numpy()[own])
        return pd.Series(out)

    return cell


def radii(values: DataFrame, k: int) -> DataFrame:
    """values (f, y, x, n, k, cell) with r: the distance to the k-th neighbour in the row's class, equal values counted n times."""
    own = W.partitionBy("f", "y", "cell").orderBy("x")
    rows = values.withColumns({
        "_near": F.collect_list(F.struct("x", "n")).over(own.rowsBetween(-k, k)),
        "_up": F.row_number().over(own),
        "_down": F.row_number().over(W.partitionBy("f", "y", "cell").orderBy(F.desc("x"))),
    })
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) <= k, F.struct("x", "n"))))
    ends = rows.filter((F.col("_up") <= k) | (F.col("_down") <= k)).groupBy("f", "y", "cell").agg(pick("_up").alias("_first"), pick("_down").alias("_last"))
    # Every range that is there has a value, so k of them suffice on either side; at most ``cells`` rows in a window.
    by = W.partitionBy("f", "y").orderBy("cell")
    beside = ends.select(
        "f", "y", "cell",
        F.concat(F.flatten(F.collect_list("_last").over(by.rowsBetween(-k, -1))), F.flatten(F.collect_list("_first").over(by.rowsBetween(1, k)))).alias("_beside"),
    )
    both = rows.join(beside, ["f", "y", "cell"])
    others = F.transform(F.concat("_near", "_beside"), lambda v: F.struct(F.abs(v["x"] - F.col("x")).alias("d"), (v["n"] - (v["x"] == F.col("x")).cast("long")).alias("n")))
    # The first distance within which k others lie.
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    kth = F.aggregate(F.array_sort(others), start, lambda a, v: F.when(a["seen"] >= F.col("k"), a).otherwise(F.struct((a["seen"] + v["n"]).alias("seen"), v["d"].alias("r"))))
    return both.select("f", "y", "x", "n", "k", kth["r"].alias("r"))


def within(rows: DataFrame, cell) -> DataFrame:
    """rows (f, y, x, n, r) with m, how many rows of any class lie within reach: the running counts at both ends, in ranges that start where those before them end."""
    both_ends = StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())])

    @F.pandas_udf(both_ends)
    def ends(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        x, r = x.to_numpy(np.float64), r.to_numpy(np.float64)
        return pd.DataFrame({"lo": -reach(-x, r), "hi": reach(x, r)})

    # At one place the lower end comes before the values and the upper end behind them.
    points = rows.withColumn("_e", ends("x", "r")).select(
        "f", "y", "x", "n", "k",
        F.explode(F.array(
            F.struct(F.col("_e.lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("x").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("_e.hi").alias("at"), F.lit(2).alias("kind")),
        )).alias("_p"),
    ).select("f", "y", "x", "n", "k", "_p.at", "_p.kind")
    points = points.withColumn("_c", cell("f", "at")).withColumn("_w", F.when(F.col("kind") == 1, F.col("n")).otherwise(F.lit(0)))
    sizes = points.groupBy("f", "_c").agg(F.sum("_w").alias("_s"))
    starts = sizes.select("f", "_c", F.coalesce(F.sum("_s").over(W.partitionBy("f").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    running = F.sum("_w").over(W.partitionBy("f", "_c").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    counted = points.withColumn("_run", running).join(F.broadcast(starts), ["f", "_c"])  # cells rows a feature
    sign = F.when(F.col("kind") == 2, 1).when(F.col("kind") == 0, -1).otherwise(0)
    return counted.groupBy("f", "y", "x", "n", "k").agg(F.sum(sign * (F.col("_start") + F.col("_run"))).alias("m"))


def knn_mutual_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3, cells: int = CELLS) -> list[tuple[str, float]]:
    """The estimate (nats) for each feature. Rows of a null label or value and classes of one row are left out; a feature without rows gives 0. Values aren't scaled and get no noise."""
    if k < 1 or cells < 1:
        raise ValueError("k and cells must be positive")
    each = F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("f", "x")
    rows = df.select(F.col(label).alias("y"), each).filter(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    values = rows.groupBy("f", "y", "x").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        sizes = values.groupBy("f", "y").agg(F.sum("n").alias("size")).filter("size > 1")  # features x classes rows
        fractions = [i / cells for i in range(1, cells)]
        found = values.groupBy("f").agg(F.percentile_approx("x", fractions or [0.5], 10 * cells).alias("cuts")).collect()
        cuts = {r["f"]: np.unique(np.array(r["cuts"] if fractions else [], np.float64)) for r in found}
        cell = _cell_of(cuts)
        known = values.join(F.broadcast(sizes), ["f", "y"]).withColumn("k", F.least(F.lit(k), F.col("size") - 1)).withColumn("cell", cell("f", "x"))
        counted = within(radii(known, k), cell).join(F.broadcast(sizes), ["f", "y"])
        mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
        out = counted.groupBy("f").agg((digamma(F.sum("n")) + mean("k") - mean("size") - mean("m")).alias("mi")).collect()
        by_feature = {r["f"]: max(0.0, r["mi"]) for r in out}
        return [(c, by_feature.get(i, 0.0)) for i, c in enumerate(features)]
    finally:
        values.unpersist()
