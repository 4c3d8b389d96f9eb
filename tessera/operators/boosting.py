"""Explainable boosting: an additive logistic model of one step function a feature, and of one table for each of a few pairs, learnt by boosting on bins.

Rows become the numbers of their features' quantile bins. A pass sums, within tasks, the loss and each bin's gradient, curvature and weight at the model so far; from these sums every feature takes a
small tree over its ordered bins, and all move at once by the learning rate. If the loss of the next pass is higher, the step is halved and taken again, so the loss never rises. Then one pass sums
the cells of all pairs of features on a coarser grid; the pairs that a cut of each axis explains best are boosted likewise. Only sums reach the driver: bins x features, and cells x pairs.

Where the grid of all bins is small (``CELLS``), rows of a cell are added up first: the grid, not the number of rows, then bounds the work of a pass. Sums are the same either way.

Nulls, NaN and infinities raise in a fit; when serving, a row with a null or NaN has a null margin. Repeated rows count as often as they occur, ties share a bin, and a column with one value has a flat
shape. A label without exactly two classes raises, so an empty table does. Columns of any other name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import explain as ex
from tessera.operators import prepare

#: A grid of at most so many cells is summed before the passes.
CELLS = 1 << 16
#: Gains that differ by less than this share count as equal; the earlier cut is taken.
EQUAL = 1e-9


def bin_number(c: str, cuts: Sequence[float]) -> Column:
    """How many cuts lie below the value; null for null and NaN."""
    x = F.col(c).cast("double")
    n = sum((F.when(x > F.lit(float(v)), 1).otherwise(0) for v in cuts), F.lit(0))
    return F.when(x.isNotNull() & ~F.isnan(x), n)


def _score(g, h, ridge: float):
    return g * g / (h + ridge)


def ordered_tree(g: np.ndarray, h: np.ndarray, w: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """A value for each of the ordered bins: the piece with the best cut is cut until there are ``leaves`` pieces, each with at least the weight ``least``."""
    pieces = [(0, len(g))]
    while len(pieces) < leaves:
        best = None
        for k, (a, b) in enumerate(pieces):
            whole = _score(g[a:b].sum(), h[a:b].sum(), ridge)
            for c in range(a + 1, b):
                if min(w[a:c].sum(), w[c:b].sum()) < least:
                    continue
                gain = _score(g[a:c].sum(), h[a:c].sum(), ridge) + _score(g[c:b].sum(), h[c:b].sum(), ridge) - whole
                if gain > EQUAL and (best is None or gain > best[0] * (1 + EQUAL)):
                    best = gain, k, c
        if best is None:
            break
        _, k, c = best
        a, b = pieces[k]
        pieces[k : k + 1] = [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in pieces:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, w: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The gain of the best cut of both axes, and the value of its quadrant for each cell; quadrants below the weight ``least`` keep 0."""
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(slice(*a), slice(*b)) for a in ((0, i), (i, None)) for b in ((0, j), (j, None))]
            on = [p for p in parts if w[p].sum() >= least]
            gain = sum(_score(g[p].sum(), h[p].sum(), ridge) for p in on) - _score(g.sum(), h.sum(), ridge)
            if gain > EQUAL and gain > best * (1 + EQUAL):
                best, out = gain, np.zeros_like(g)
                for p in on:
                    out[p] = g[p].sum() / (h[p].sum() + ridge)
    return best, out


@dataclass
class ExplainableBoosting:
    bins: int = 16
    pair_bins: int = 8
    interactions: int = 3
    rounds: int = 60
    pair_rounds: int = 30
    learning_rate: float = 0.3
    leaves: int = 3
    ridge: float = 1.0
    least_weight: float = 2.0
    tol: float = 1e-5
    class_weight: str | dict | None = None

    def _validate(self) -> None:
        for name, low in (("bins", 2), ("pair_bins", 2), ("interactions", 0), ("rounds", 1), ("pair_rounds", 0), ("leaves", 2), ("ridge", 0), ("least_weight", 0)):
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}")
        if not 0 < self.learning_rate <= 1:
            raise ValueError("learning_rate must be within (0, 1]")

    def prepare_rows(self, df: DataFrame, label: str, features: Sequence[str] | None, weight: str | None = None, exclude=()) -> DataFrame:
        """b (bin of each feature), s0 and s1 (weight of the rows of either class), after setting features, classes and cuts."""
        self.features_ = prepare.feature_names(df, features, label, [*exclude, *([weight] if weight else [])])
        prepare.require_clean(df, self.features_)
        of_class = prepare.class_weights(df.filter(F.col(label).isNotNull()), label, self.class_weight)
        self.classes_ = sorted(of_class)
        if len(self.classes_) != 2:
            raise ValueError("exactly two classes are needed")
        found = prepare.exact_quantiles(df, self.features_, [i / self.bins for i in range(1, self.bins)])
        self.cuts_ = [sorted(set(found[c])) for c in self.features_]
        self.sizes_ = [len(c) + 1 for c in self.cuts_]
        # The coarser bin of each bin, for pairs.
        self.coarse_ = [np.arange(n) * min(n, self.pair_bins) // n for n in self.sizes_]
        s = (F.col(weight).cast("double") if weight else F.lit(1.0)) * prepare.lookup(F.col(label), of_class)
        second = F.col(label) == F.lit(self.classes_[1])
        b = F.array(*[bin_number(c, cuts) for c, cuts in zip(self.features_, self.cuts_, strict=True)])
        rows = df.filter(F.col(label).isNotNull()).select(b.alias("b"), F.when(second, 0.0).otherwise(s).alias("s0"), F.when(second, s).otherwise(0.0).alias("s1"))
        if math.prod(self.sizes_) <= CELLS:
            rows = rows.groupBy("b").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
        return rows

    def _margins(self, b: np.ndarray, shapes, pairs, tables) -> np.ndarray:
        m = np.full(len(b), self.start_)
        for f, v in enumerate(shapes):
            m += v[b[:, f]]
        for (i, j), t in zip(pairs, tables, strict=True):
            m += t[self.coarse_[i][b[:, i]], self.coarse_[j][b[:, j]]]
        return m

    def sums(self, rows: DataFrame, shapes, pairs, tables, asked) -> tuple[float, list[np.ndarray]]:
        """The loss, and for each asked term (a feature or a pair) its gradients, curvatures and weights as an array (3, bins...)."""
        coarse, sizes, margins = self.coarse_, self.sizes_, self._margins
        width = [int(c[-1]) + 1 for c in coarse]
        shape = [(sizes[t],) if isinstance(t, int) else (width[t[0]], width[t[1]]) for t in asked]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + 3 * sum(map(math.prod, shape)))
            for batch in batches:
                if not len(batch):
                    continue
                b, s0, s1 = np.stack(batch["b"].to_numpy()).astype(np.int64), batch["s0"].to_numpy(), batch["s1"].to_numpy()
                m = margins(b, shapes, pairs, tables)
                p, s = 1 / (1 + np.exp(-np.clip(m, -500, 500))), s0 + s1
                total[0] += s1 @ np.logaddexp(0, -m) + s0 @ np.logaddexp(0, m)
                at = 1
                for t, cells in zip(asked, shape, strict=True):
                    code = b[:, t] if isinstance(t, int) else coarse[t[0]][b[:, t[0]]] * cells[1] + coarse[t[1]][b[:, t[1]]]
                    n = math.prod(cells)
                    for v in (s1 - s * p, s * p * (1 - p), s):
                        total[at : at + n] += np.bincount(code, weights=v, minlength=n)
                        at += n
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        flat = np.zeros(1 + 3 * sum(map(math.prod, shape)))
        for r in rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]
        out, at = [], 1
        for cells in shape:
            n = 3 * math.prod(cells)
            out.append(flat[at : at + n].reshape(3, *cells))
            at += n
        return float(flat[0]), out

    def _boost(self, run: Callable, terms: list[np.ndarray], direction: Callable, rounds: int) -> list[np.ndarray]:
        """Steps that don't raise the loss, one pass each, until one lowers it by less than ``tol`` of it."""
        rate, step, best = self.learning_rate, None, math.inf
        for _ in range(rounds + 1):
            trial = terms if step is None else [t + rate * d for t, d in zip(terms, step, strict=True)]
            loss, found = run(trial)
            if loss > best:
                rate /= 2
                if rate < 1e-6:
                    break
                continue
            terms, small = trial, best - loss <= self.tol * max(loss, 1e-12)
            self.losses_.append(loss)
            if small:
                break
            best, step = loss, [direction(x) for x in found]
        return terms

    def fit(self, df: DataFrame, label: str = "y", features: Sequence[str] | None = None, weight: str | None = None, exclude=()) -> ExplainableBoosting:
        self._validate()
        rows = self.prepare_rows(df, label, features, weight, exclude).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            s0, s1 = rows.agg(F.sum("s0"), F.sum("s1")).first()
            if min(s0, s1) <= 0:
                raise ValueError("both classes need weight")
            self.start_, self.losses_ = math.log(s1 / s0), []
            d = len(self.features_)
            tree = lambda x: ordered_tree(*x, self.leaves, self.ridge, self.least_weight)
            shapes = self._boost(lambda t: self.sums(rows, t, [], [], range(d)), [np.zeros(n) for n in self.sizes_], tree, self.rounds)
            pairs, tables = [], []
            if self.interactions and d > 1 and self.pair_rounds:
                every = list(combinations(range(d), 2))
                _, found = self.sums(rows, shapes, [], [], every)
                gains = [quadrants(*x, self.ridge, self.least_weight)[0] for x in found]
                order = sorted(range(len(every)), key=lambda k: (-round(gains[k], 9), k))
                pairs = [every[k] for k in order[: self.interactions] if gains[k] > EQUAL]
                corner = lambda x: quadrants(*x, self.ridge, self.least_weight)[1]
                start = [np.zeros(x.shape[1:]) for k in order[: len(pairs)] for x in [found[k]]]
                if pairs:
                    tables = self._boost(lambda t: self.sums(rows, shapes, pairs, t, pairs), start, corner, self.pair_rounds)
            _, weights = self.sums(rows, shapes, pairs, tables, [*range(d), *pairs])
        finally:
            rows.unpersist()
        # Terms have mean 0 over the training rows; what they had goes to the intercept.
        means = [float((x[2] * t).sum() / x[2].sum()) for x, t in zip(weights, [*shapes, *tables], strict=True)]
        centred = [t - m for t, m in zip([*shapes, *tables], means, strict=True)]
        self.intercept_, self.pairs_ = self.start_ + sum(means), pairs
        self.shapes_, self.tables_ = centred[:d], centred[d:]
        return self

    def term_columns(self) -> list[tuple[str, Column]]:
        """Name and value of each term."""
        number = [bin_number(c, cuts) for c, cuts in zip(self.features_, self.cuts_, strict=True)]
        values = lambda v: F.array(*[F.lit(float(x)) for x in v])
        out = [(c, F.get(values(v), n)) for c, v, n in zip(self.features_, self.shapes_, number, strict=True)]
        for (i, j), t in zip(self.pairs_, self.tables_, strict=True):
            a, b = (F.get(F.array(*[F.lit(int(x)) for x in self.coarse_[f]]), number[f]) for f in (i, j))
            out.append((f"{self.features_[i]} x {self.features_[j]}", F.get(values(t.ravel()), a * t.shape[1] + b)))
        return out

    def margin_column(self) -> Column:
        return sum((c for _, c in self.term_columns()), F.lit(float(self.intercept_)))

    def decision_function(self, df: DataFrame, to: str = "margin") -> DataFrame:
        prepare.feature_names(df, self.features_)
        return df.withColumn(to, self.margin_column())

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        prepare.feature_names(df, self.features_)
        return df.withColumn(to, ex.decision(self.margin_column(), self.classes_))

    def predict_proba(self, df: DataFrame, to: str = "probability") -> DataFrame:
        """The probability of the second class."""
        prepare.feature_names(df, self.features_)
        return df.withColumn(to, 1 / (1 + F.exp(-self.margin_column())))

    def explain(self, df: DataFrame, to: str = "terms") -> DataFrame:
        """What each term adds to the margin, as an array of (term, contribution); they sum to the margin less the intercept."""
        prepare.feature_names(df, self.features_)
        return df.withColumn(to, F.array(*[F.struct(F.lit(n).alias("term"), c.alias("contribution")) for n, c in self.term_columns()]))

    def shape_table(self) -> list[tuple[str, int, float]]:
        """Term, bin (of pairs: row-wise number of the cell) and value."""
        names = [*self.features_, *(f"{self.features_[i]} x {self.features_[j]}" for i, j in self.pairs_)]
        return [(n, k, float(v)) for n, t in zip(names, [*self.shapes_, *self.tables_], strict=True) for k, v in enumerate(np.ravel(t))]
