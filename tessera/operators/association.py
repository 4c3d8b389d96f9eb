"""A classifier of fuzzy association rules: levelwise search, prescreening by reweighted coverage, and genetic selection with lateral tuning.

Every feature has ``n_labels`` triangular labels, evenly spaced between its least and greatest value; a conjunction is the product of its degrees.

1. Item sets grow level by level. A set is frequent for a class if the sum of its degrees over the class's rows reaches ``min_support`` of them; one whose confidence (the class's share in the sum over all rows)
   exceeds ``max_confidence`` is not extended. All sets of a level are counted for all classes in one pass.
2. For each class rules are chosen one after the other by weighted relative accuracy. A row of the class that i chosen rules cover weighs 1 / (i + 1), and nothing from more than ``cover`` rules on. A round is one pass for all classes.
3. A population of chromosomes (a lateral shift for each label, a bit for each rule) evolves by crossover between parents that differ enough; each generation's rows are scored in one pass. Fitness is the share of hits less a penalty for many rules.

A pass sums within each task first, and only sums (sets x classes, or one number a chromosome) reach the driver. A row goes to the class of the largest sum of degree times confidence, of ties to the first; one that no rule covers to the most frequent class.

Defined results: rows of a null label are left out; null and NaN features raise; a constant feature has its one value as the middle label; values outside the fitted range count as its ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import prepare

#: Rows and sets that are multiplied at once.
ROWS, SETS = 2048, 2048

Items = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class AssociationRule:
    """A conjunction of (feature, label) pairs, its class, and its figures over the rows that it was found on."""

    items: Items
    label: object
    support: float
    confidence: float


def degrees(x: np.ndarray, low: np.ndarray, high: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """(rows, features, labels): triangular degrees; shifts (features, labels) move a label by shares of the distance to its neighbour."""
    n_labels = shifts.shape[1]
    step = np.where(high > low, high - low, 1.0) / (n_labels - 1)
    places = (np.clip(x, low, high) - low) / step
    places = np.where(high > low, places, (n_labels - 1) / 2)
    return np.maximum(0.0, 1 - np.abs(places[:, :, None] - np.arange(n_labels) - shifts))


def products(m: np.ndarray, sets: Sequence[Items]) -> np.ndarray:
    """(rows, sets): the degree of each conjunction; m as from degrees."""
    n_labels = m.shape[2]
    flat = np.concatenate([m.reshape(len(m), -1), np.ones((len(m), 1))], axis=1)
    depth = max(map(len, sets), default=1)
    at = np.array([[f * n_labels + t for f, t in s] + [-1] * (depth - len(s)) for s in sets], dtype=int).reshape(len(sets), depth)
    out = flat[:, at[:, 0]]
    for k in range(1, depth):
        out = out * flat[:, at[:, k]]
    return out


def summed(rows: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (x: array, c: class number) of part(x, c), an array of a size: added up within each task, then by place."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for k in range(0, len(b), ROWS):
                piece = b.iloc[k : k + ROWS]
                total += part(np.stack(piece["x"].to_numpy()), piece["c"].to_numpy())
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for i, v in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def extended(frequent: set[Items]) -> set[Items]:
    """Sets of one item more, all of whose subsets are among the frequent ones; a set has a feature once."""
    by_start: dict[Items, list] = {}
    for s in frequent:
        by_start.setdefault(s[:-1], []).append(s[-1])
    out = set()
    for start, ends in by_start.items():
        for a, b in combinations(sorted(ends), 2):
            made = (*start, a, b)
            if a[0] != b[0] and all(made[:i] + made[i + 1 :] in frequent for i in range(len(made))):
                out.add(made)
    return out


def hamming_share(a: np.ndarray, b: np.ndarray, bits: int) -> int:
    """How many bits differ between two arrays of shifts in [-0.5, 0.5], written in Gray code."""
    whole = (1 << bits) - 1
    x, y = (np.rint((np.clip(v, -0.5, 0.5) + 0.5) * whole).astype(np.int64) for v in (a, b))
    return int(np.bitwise_count((x ^ (x >> 1)) ^ (y ^ (y >> 1))).sum())


@dataclass
class FuzzyAssociationClassifier:
    n_labels: int = 5
    max_depth: int = 2
    min_support: float = 0.05
    max_confidence: float = 0.8
    cover: int = 2
    population: int = 50
    evaluations: int = 200
    bits: int = 30
    delta: float = 0.2
    seed: int = 0
    classes_: list = field(default_factory=list, init=False)

    def _validate(self) -> None:
        for ok, what in (
            (self.n_labels >= 2, "n_labels must be at least 2"), (self.max_depth >= 1, "max_depth must be at least 1"), (0 < self.min_support <= 1, "min_support must be in (0, 1]"),
            (0 <= self.max_confidence <= 1, "max_confidence must be in [0, 1]"), (self.cover >= 0, "cover mustn't be negative"), (self.population >= 2, "population must be at least 2"),
            (self.evaluations >= 0, "evaluations mustn't be negative"), (1 <= self.bits <= 60, "bits must be within 1 and 60"), (self.delta >= 0, "delta mustn't be negative"),
        ):
            if not ok:
                raise ValueError(what)

    def _rows(self, df: DataFrame, label: str, features) -> DataFrame:
        """x and c of the rows with a label; sets classes, features and their ranges."""
        self.features_ = prepare.feature_names(df, features, label)
        prepare.require_clean(df, self.features_)
        counts = {v: n for v, n in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1))).collect()}
        if len(counts) < 2:
            raise ValueError("at least two classes are needed")
        self.classes_ = sorted(counts)
        self.counts_ = np.array([counts[c] for c in self.classes_], float)
        ends = df.agg(*[f(F.col(c).cast("double")) for c in self.features_ for f in (F.min, F.max)]).first()
        self.low_, self.high_ = np.array(ends[::2]), np.array(ends[1::2])
        self.shifts_ = np.zeros((len(self.features_), self.n_labels))
        number = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(label)) - 1
        return df.filter(F.col(label).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in self.features_]).alias("x"), number.cast("int").alias("c"))

    def set_sums(self, rows: DataFrame, sets: Sequence[Items]) -> np.ndarray:
        """(sets, classes): the sum of each set's degrees over each class's rows, in one pass."""
        low, high, shifts, k = self.low_, self.high_, self.shifts_, len(self.classes_)

        def part(x, c):
            m, of = degrees(x, low, high, shifts), np.eye(k)[c]
            return np.concatenate([products(m, sets[a : a + SETS]).T @ of for a in range(0, len(sets), SETS)]).ravel()

        return summed(rows, len(sets) * k, part).reshape(len(sets), k)

    def search(self, rows: DataFrame) -> list[AssociationRule]:
        """All rules of frequent sets, by class, then by length and items."""
        n, found = self.counts_.sum(), []
        open_ = [{((f, t),) for f in range(len(self.features_)) for t in range(self.n_labels)} for _ in self.classes_]
        for _ in range(self.max_depth):
            sets = sorted(set().union(*open_))
            if not sets:
                break
            sums = dict(zip(sets, self.set_sums(rows, sets), strict=True))
            for k, c in enumerate(self.classes_):
                frequent = {s for s in open_[k] if sums[s][k] >= self.min_support * self.counts_[k]}
                sure = {s: sums[s][k] / sums[s].sum() for s in frequent}
                found += [AssociationRule(s, c, float(sums[s][k] / n), float(sure[s])) for s in frequent]
                open_[k] = extended({s for s in frequent if sure[s] <= self.max_confidence})
        return sorted(found, key=lambda r: (self.classes_.index(r.label), len(r.items), r.items))

    def prescreen(self, rows: DataFrame, rules: Sequence[AssociationRule]) -> list[AssociationRule]:
        """The rules chosen for each class while any of its rows is covered by no more than ``cover`` of them, in the order of choice."""
        low, high, shifts, cover = self.low_, self.high_, self.shifts_, self.cover
        left = [[r for r in rules if r.label == c] for c in self.classes_]
        chosen: list[list] = [[] for _ in self.classes_]
        # Rows of other classes weigh 1 throughout, so their sums follow from support and confidence.
        n = self.counts_.sum()
        others = [{r.items: r.support * n / r.confidence - r.support * n for r in of} for of in left]
        while any(left):
            sets, before = [[r.items for r in of] for of in left], [[r.items for r in of] for of in chosen]
            starts = np.cumsum([0, *(len(s) + 1 for s in sets)])

            def part(x, c, sets=sets, before=before, starts=starts):
                out = np.zeros(starts[-1])
                for k in range(len(sets)):
                    if sets[k] and (c == k).any():
                        m = degrees(x[c == k], low, high, shifts)
                        times = (products(m, before[k]) > 0).sum(1) if before[k] else np.zeros(len(m))
                        w = np.where(times > cover, 0.0, 1 / (times + 1))
                        out[starts[k]] = w.sum()
                        out[starts[k] + 1 : starts[k + 1]] = np.concatenate([w @ products(m, sets[k][a : a + SETS]) for a in range(0, len(sets[k]), SETS)])
                return out

            sums = summed(rows, int(starts[-1]), part)
            for k in range(len(self.classes_)):
                if not left[k]:
                    continue
                total, own = sums[starts[k]], sums[starts[k] + 1 : starts[k + 1]]
                if total <= 0:
                    left[k] = []
                    continue
                all_ = own + np.array([others[k][r.items] for r in left[k]])
                worth = np.where(all_ > 0, own / total * (own / np.maximum(all_, 1e-300) - self.counts_[k] / n), -np.inf)
                best = int(np.argmax(np.round(worth, 12)))  # of ties the first
                chosen[k].append(left[k].pop(best))
        return [r for of in chosen for r in of]

    def hits(self, rows: DataFrame, rules: Sequence[AssociationRule], population: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """How many rows each chromosome (shifts, selected rules) puts right, all in one pass."""
        low, high, sets, k = self.low_, self.high_, [r.items for r in rules], len(self.classes_)
        votes = np.array([np.eye(k)[self.classes_.index(r.label)] * r.confidence for r in rules]).reshape(len(rules), k)
        default = int(np.argmax(self.counts_))

        def part(x, c):
            return np.array([(decided(degrees(x, low, high, shifts), sets, votes * on[:, None], default) == c).sum() for shifts, on in population], float)

        return summed(rows, len(population), part)

    def evolve(self, rows: DataFrame, rules: Sequence[AssociationRule]) -> tuple[np.ndarray, np.ndarray]:
        """The fittest shifts and selection: generations of crossover between parents that differ by more than a threshold, which falls where nothing new comes in; then all but the best start anew."""
        rng, n, r = np.random.default_rng(self.seed), self.counts_.sum(), len(rules)
        shape = self.shifts_.shape
        random = lambda: (rng.uniform(-0.5, 0.5, shape), rng.integers(0, 2, r).astype(bool))
        spent = 0

        def fitness(of):
            nonlocal spent
            spent += len(of)
            return [h / n - self.delta * r / (r - on.sum() + 1.0) / max(r, 1) if on.any() else -np.inf for h, (_, on) in zip(self.hits(rows, rules, of), of, strict=True)]

        people = [(np.zeros(shape), np.ones(r, bool)), *(random() for _ in range(min(self.population, max(self.evaluations, 1)) - 1))]
        ranked = sorted(zip(fitness(people), range(len(people)), people, strict=True), key=lambda t: (-t[0], t[1]))
        start = threshold = (shape[0] * shape[1] * self.bits + r) / 4
        while spent < self.evaluations:
            children = []
            order = rng.permutation(len(ranked))
            for i, j in zip(order[::2], order[1::2], strict=False):
                (a, on), (b, also) = ranked[i][2], ranked[j][2]
                if (hamming_share(a, b, self.bits) + (on != also).sum()) / 2 > threshold:
                    reach = np.abs(a - b)
                    shifts = [np.clip(rng.uniform(v - reach, v + reach), -0.5, 0.5) for v in (a, b)]
                    swap = (on != also) & (rng.random(r) < 0.5)
                    children += [(shifts[0], np.where(swap, also, on)), (shifts[1], np.where(swap, on, also))]
            children = children[: self.evaluations - spent]
            before = [t[2] for t in ranked]
            if children:
                fit = fitness(children)
                ranked = sorted([*ranked, *((f, len(before) + i, c) for i, (f, c) in enumerate(zip(fit, children, strict=True)))], key=lambda t: (-t[0], t[1]))[: len(before)]
                ranked = [(f, i, c) for i, (f, _, c) in enumerate(ranked)]
            if not children or all(any(c is b for b in before) for _, _, c in ranked):
                threshold -= self.bits
            if threshold < 0:
                people = [random() for _ in range(min(len(ranked) - 1, self.evaluations - spent))]
                if people:
                    ranked = [ranked[0], *((f, i + 1, c) for i, (f, c) in enumerate(zip(fitness(people), people, strict=True)))]
                threshold = start
        return ranked[0][2]

    def fit(self, df: DataFrame, label: str = "y", features: Sequence[str] | None = None) -> FuzzyAssociationClassifier:
        self._validate()
        rows = self._rows(df, label, features).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.candidates_ = self.search(rows)
            rules = self.prescreen(rows, self.candidates_)
            if rules and self.evaluations:
                self.shifts_, on = self.evolve(rows, rules)
                rules = [r for r, keep in zip(rules, on, strict=True) if keep]
            self.rules_ = rules
        finally:
            rows.unpersist()
        return self

    def degree_column(self, items: Items) -> Column:
        out = None
        for f, t in items:
            low, high = float(self.low_[f]), float(self.high_[f])
            value = F.least(F.greatest(F.col(self.features_[f]).cast("double"), F.lit(low)), F.lit(high))
            place = (value - low) / ((high - low) / (self.n_labels - 1)) if high > low else F.lit((self.n_labels - 1) / 2)
            one = F.greatest(F.lit(0.0), 1 - F.abs(place - float(t) - float(self.shifts_[f, t])))
            out = one if out is None else out * one
        return out

    def decision_function(self, df: DataFrame, to: str = "margin") -> DataFrame:
        """The sum of degree times confidence for each class."""
        votes = [[self.degree_column(r.items) * r.confidence for r in self.rules_ if r.label == c] for c in self.classes_]
        return df.withColumn(to, F.array(*[sum(v[1:], v[0]) if v else F.lit(0.0) for v in votes]))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        scored = self.decision_function(df, "__votes")
        most = F.array_max("__votes")
        default = self.classes_[int(np.argmax(self.counts_))]
        best = F.get(F.array(*map(F.lit, self.classes_)), (F.array_position("__votes", most) - 1).cast("int"))
        return scored.withColumn(to, F.when(most > 0, best).otherwise(F.lit(default))).drop("__votes")

    def rule_texts(self) -> list[str]:
        return [f"IF {' AND '.join(f'{self.features_[f]} IS {t + 1}/{self.n_labels}' for f, t in r.items)} THEN {r.label} ({r.confidence:.3f})" for r in self.rules_]


def decided(m: np.ndarray, sets: Sequence[Items], votes: np.ndarray, default: int) -> np.ndarray:
    """The class number of each row."""
    total = products(m, sets) @ votes
    return np.where(total.max(1) > 0, total.argmax(1), default)
