"""Unordered fuzzy rules by sequential covering: crisp rules are grown and pruned for each class against the rest, then their intervals are made fuzzy.

Values are looked at through at most ``max_cuts`` cuts of each feature (all its values if they are no more, else quantiles), so the gain of every condition follows from one histogram of the rows that a rule covers.
For each class, rule after rule:

* grow, on two of three parts of the rows: the condition (feature at most or at least a cut) of the largest information gain is added until no row of another class is covered or nothing is gained,
* prune, on the third: the last conditions go as long as the accuracy there, (p + 1) / (n + 2), doesn't fall,
* stop where the rule is wrong as often as right, or the description length of the rules and their errors exceeds the least so far by 64 bits; rules beyond the least are dropped.

Then each interval gets a slope at its ends: of the values beyond, the one at which the share of the class in the degrees over the rows that satisfy the other conditions is largest; of a rule's conditions
the purest is done first. A rule's certainty is (2 N_c / N + sum of degrees over its class) / (2 + sum of degrees). A row that no rule covers is given to stretched rules: of each, the conditions before the first that the row fails.

The classes' searches are generators that ask for sums; a pass over the rows answers what all of them ask at that time. Sums are taken within each task first, so histograms and counts are all that reaches the driver.
Optimisation rounds that rewrite rules after the covering aren't made.

Defined results: rows of a null label are left out; null and NaN features raise; equal rows lie in one part; of equal gains the first feature, the lower cut and "at most" come first.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import prepare

#: A condition: feature, whether it is "at most" (else "at least"), and the cut's number.
Test = tuple[int, bool, int]
EXCESS_BITS = 64.0


@dataclass(frozen=True)
class FuzzyInterval:
    """A condition with its slope: full up to (or from) core, nothing at and beyond edge; edge equal to core is crisp."""

    feature: int
    at_most: bool
    core: float
    edge: float

    def degrees(self, x: np.ndarray) -> np.ndarray:
        inside = x <= self.core if self.at_most else x >= self.core
        if self.edge == self.core:
            return inside.astype(float)
        return np.where(inside, 1.0, np.clip((self.edge - x) / (self.edge - self.core), 0.0, 1.0))

    def column(self, x: Column) -> Column:
        inside = x <= self.core if self.at_most else x >= self.core
        if self.edge == self.core:
            return inside.cast("double")
        return F.when(inside, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(self.edge) - x) / (self.edge - self.core))))


@dataclass(frozen=True)
class UnorderedRule:
    label: object
    conditions: tuple[FuzzyInterval, ...]
    certainty: float
    stretched: tuple[float, ...]  # the worth of the first 0, 1, 2... conditions alone


def subset_bits(t: float, k: float, p: float) -> float:
    """Bits that tell k of t things, if each is one of them with chance p."""
    return (-k * log2(p) if k > 0 and p > 0 else 0.0) + (-(t - k) * log2(1 - p) if t > k and p < 1 else 0.0)


def theory_bits(conditions: int, possible: int) -> float:
    if not conditions:
        return 0.0
    bits = log2(conditions)
    bits += 2 * log2(bits) if bits > 1 else 0.0
    return 0.5 * (bits + subset_bits(possible, conditions, conditions / possible))


def error_bits(covered: float, left: float, wrong: float, missed: float) -> float:
    """Bits that tell the errors among covered and uncovered rows."""
    half = 0.5 * (wrong + missed)
    if covered > left:
        parts = subset_bits(covered, wrong, min(1.0, half / covered)) + (subset_bits(left, missed, missed / left) if left else 0.0)
    else:
        parts = (subset_bits(covered, wrong, wrong / covered) if covered else 0.0) + (subset_bits(left, missed, min(1.0, half / left)) if left else 0.0)
    return log2(covered + left + 1) + parts


def covered(bins: np.ndarray, tests: Sequence[Test]) -> np.ndarray:
    on = np.ones(len(bins), bool)
    for f, at_most, cut in tests:
        on &= bins[:, f] <= cut if at_most else bins[:, f] >= cut
    return on


def best_test(hist: np.ndarray, cuts: Sequence[np.ndarray]) -> tuple[float, Test | None, np.ndarray | None]:
    """The condition of the largest gain, its gain and what it covers; hist (features, bins, 2): rows of the class and others."""
    total = hist[0].sum(0)
    base = log2((total[0] + 1) / (total.sum() + 1))
    best: tuple[float, Test | None, np.ndarray | None] = (0.0, None, None)
    for f, of in enumerate(cuts):
        below = np.cumsum(hist[f, : len(of)], axis=0)
        above = total - below + hist[f, : len(of)]
        for at_most, sums in ((True, below), (False, above)):
            gain = sums[:, 0] * (np.log2((sums[:, 0] + 1) / (sums.sum(1) + 1)) - base)
            gain[sums.sum(1) >= total.sum()] = 0.0  # covers the same rows
            k = int(np.argmax(np.round(gain, 9)))
            if round(float(gain[k]), 9) > round(best[0], 9):
                best = float(gain[k]), (f, at_most, k), sums[k]
    return best


@dataclass
class UnorderedFuzzyRules:
    n_folds: int = 3
    min_cover: float = 2.0
    max_cuts: int = 255
    check_error_rate: bool = True
    stretch: bool = True
    seed: int = 0
    classes_: list = field(default_factory=list, init=False)

    def _rows(self, df: DataFrame, label: str, features) -> DataFrame:
        """x, c and part (0: pruned on, others: grown on) of the rows with a label."""
        for ok, what in ((self.n_folds >= 2, "n_folds must be at least 2"), (self.min_cover >= 1, "min_cover must be at least 1"), (self.max_cuts >= 1, "max_cuts must be at least 1")):
            if not ok:
                raise ValueError(what)
        self.features_ = prepare.feature_names(df, features, label)
        prepare.require_clean(df, self.features_)
        df = df.filter(F.col(label).isNotNull())
        counts = {v: n for v, n in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
        if len(counts) < 2:
            raise ValueError("at least two classes are needed")
        self.classes_ = sorted(counts)
        self.counts_ = np.array([counts[c] for c in self.classes_], float)
        number = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(label)) - 1
        x = F.array(*[F.col(c).cast("double") for c in self.features_])
        return df.select(x.alias("x"), number.cast("int").alias("c"), F.pmod(F.xxhash64(F.lit(self.seed), x, number), F.lit(self.n_folds)).cast("int").alias("part"))

    def _cuts(self, df: DataFrame) -> list[np.ndarray]:
        """All different values of a feature where they are no more than ``max_cuts``, else its quantiles at as many even places."""
        near = df.agg(*[F.approx_count_distinct(F.col(c).cast("double")) for c in self.features_]).first()
        few = [c for c, n in zip(self.features_, near, strict=True) if n <= 1.3 * self.max_cuts]
        sets = dict(zip(few, df.agg(*[F.collect_set(F.col(c).cast("double")) for c in few]).first(), strict=True)) if few else {}
        many = [c for c in self.features_ if len(sets.get(c, range(self.max_cuts + 1))) > self.max_cuts]
        places = [(k + 1) / (self.max_cuts + 1) for k in range(self.max_cuts)]
        found = prepare.exact_quantiles(df, many, places) if many else {}
        return [np.unique(found[c] if c in found else sets[c]) for c in self.features_]

    def _pass(self, rows: DataFrame, size: int, part: Callable) -> np.ndarray:
        """The sum of part(x, bins, c, fold) over all rows."""
        cuts = self.cuts_

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                if len(b):
                    x = np.stack(b["x"].to_numpy())
                    bins = np.stack([np.searchsorted(of, x[:, f], "left") for f, of in enumerate(cuts)], axis=1)
                    total += part(x, bins, b["c"].to_numpy(), b["part"].to_numpy())
            yield pd.DataFrame({"i": np.arange(size), "v": total})

        out = np.zeros(size)
        for i, v in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[i] = v
        return out

    def histogram(self, rows: DataFrame) -> np.ndarray:
        """(classes, features, bins, 2): the rows of each class and of the others by bin, over all rows."""
        shape = (len(self.classes_), len(self.features_), max(map(len, self.cuts_)) + 1)

        def part(x, bins, c, fold):
            own = np.zeros(shape)
            for k in range(shape[0]):
                for f in range(shape[1]):
                    own[k, f] = np.bincount(bins[c == k, f], minlength=shape[2])
            return own.ravel()

        own = self._pass(rows, int(np.prod(shape)), part).reshape(shape)
        return np.stack([own, own.sum(0) - own], axis=-1)

    def _learner(self, k: int) -> Generator:
        """Yields (what, rules so far, tests) and is sent sums; returns the class's rules. what: grow (histogram over the growing rows that the rules leave and the tests cover),
        prune (for each prefix of the tests its rows of the class and others among the pruning ones), judge (rows of the class and others that all rules cover)."""
        possible = sum(2 * len(c) for c in self.cuts_)
        n, own = self.counts_.sum(), self.counts_[k]
        rules: list[tuple[Test, ...]] = []
        least = best = error_bits(0.0, n, 0.0, own)
        keep, theory = 0, 0.0
        while True:
            tests: list[Test] = []
            while True:
                hist = yield "grow", rules, tuple(tests)
                if hist[0, :, 0].sum() == 0 or hist[0, :, 1].sum() == 0:
                    break
                _, test, sums = best_test(hist, self.cuts_)
                if test is None or sums.sum() < self.min_cover:
                    break
                tests.append(test)
            if not tests:
                break
            sums = yield "prune", rules, tuple(tests)
            worth = [round((p + 1) / (p + q + 2), 12) for p, q in sums]
            length = max(1, int(np.argmax(worth)))  # of ties the shortest
            rule, (p, q) = tuple(tests[:length]), sums[length]
            if self.check_error_rate and p + q > 0 and q >= p:
                break
            hit, wrong = yield "judge", [*rules, rule], ()
            theory += theory_bits(length, possible)
            best = theory + error_bits(hit + wrong, n - hit - wrong, wrong, own - hit)
            if best > least + EXCESS_BITS:
                break
            rules.append(rule)
            if best < least:
                least, keep = best, len(rules)
            if hit >= own:
                break
        return rules[: max(keep, min(1, len(rules)))]

    def _learn(self, rows: DataFrame) -> list[list[tuple[Test, ...]]]:
        """The crisp rules of all classes: each pass answers what all learners ask."""
        learners = {k: self._learner(k) for k in range(len(self.classes_))}
        asked = {k: next(g) for k, g in learners.items()}
        done: dict[int, list] = {}
        shape = (len(self.features_), max(map(len, self.cuts_)) + 1, 2)
        while asked:
            sizes = {k: int(np.prod(shape)) if what == "grow" else 2 * (len(tests) + 1) if what == "prune" else 2 for k, (what, _, tests) in asked.items()}

            def part(x, bins, c, fold, asked=dict(asked)):
                out = []
                for k, (what, rules, tests) in asked.items():
                    mine = c == k
                    before = np.zeros(len(c), bool)
                    for r in rules:
                        before |= covered(bins, r)
                    if what == "judge":
                        out.append(np.array([(before & mine).sum(), (before & ~mine).sum()], float))
                    elif what == "prune":
                        on = (fold == 0) & ~before
                        counts = []
                        for i in range(len(tests) + 1):
                            on = on & (covered(bins, tests[i - 1 : i]) if i else True)
                            counts += [(on & mine).sum(), (on & ~mine).sum()]
                        out.append(np.array(counts, float))
                    else:
                        on = (fold != 0) & ~before & covered(bins, tests)
                        hist = np.zeros(shape)
                        for f in range(shape[0]):
                            for j, of in enumerate((on & mine, on & ~mine)):
                                hist[f, :, j] = np.bincount(bins[of, f], minlength=shape[1])
                        out.append(hist.ravel())
                return np.concatenate(out)

            sums = self._pass(rows, sum(sizes.values()), part)
            at = 0
            for k in list(asked):
                mine = sums[at : at + sizes[k]]
                at += sizes[k]
                what = asked[k][0]
                try:
                    asked[k] = learners[k].send(mine.reshape(shape) if what == "grow" else mine.reshape(-1, 2) if what == "prune" else mine)
                except StopIteration as end:
                    done[k] = end.value
                    del asked[k]
        return [done[k] for k in range(len(self.classes_))]

    def _sloped(self, rows: DataFrame, crisp: list[tuple[int, tuple[Test, ...]]]) -> list[tuple[FuzzyInterval, ...]]:
        """Fuzzy intervals of the rules (class, tests): in each pass the purest of every rule's conditions that are still crisp gets its slope."""
        cuts, wide = self.cuts_, max(map(len, self.cuts_)) + 1
        sure = [[FuzzyInterval(f, at_most, v := float(cuts[f][cut] if at_most else self._from(f, cut)), v) for f, at_most, cut in tests] for _, tests in crisp]
        open_ = [set(range(len(r))) for r in sure]
        while any(open_):
            cells = [(i, j) for i, left in enumerate(open_) for j in sorted(left)]

            def part(x, bins, c, fold, cells=cells, now=[list(r) for r in sure]):
                out = np.zeros((len(cells), wide, 4))
                on = [[r.degrees(x[:, r.feature]) > 0 for r in of] for of in now]
                for a, (i, j) in enumerate(cells):
                    others = np.ones(len(c), bool)
                    for b, o in enumerate(on[i]):
                        others &= o if b != j else True
                    f, mine = now[i][j].feature, c == crisp[i][0]
                    for s, of in enumerate((others & mine, others & ~mine)):
                        out[a, :, 2 * s] = np.bincount(bins[of, f], minlength=wide)
                        out[a, :, 2 * s + 1] = np.bincount(bins[of, f], weights=x[of, f], minlength=wide)
                return out.ravel()

            sums = self._pass(rows, len(cells) * wide * 4, part).reshape(len(cells), wide, 4)
            chosen: dict[int, tuple[float, int, FuzzyInterval]] = {}
            for (i, j), h in zip(cells, sums, strict=True):
                test = crisp[i][1][j]
                purity, interval = purest(h, sure[i][j], test[2], cuts[sure[i][j].feature])
                if i not in chosen or purity > chosen[i][0]:
                    chosen[i] = purity, j, interval
            for i, (_, j, interval) in chosen.items():
                sure[i][j] = interval
                open_[i].discard(j)
        return [tuple(r) for r in sure]

    def _from(self, f: int, cut: int) -> float:
        """The least value of a bin: the cut itself where bins are single values, else just above the cut before."""
        return float(self.cuts_[f][cut]) if self.exact_[f] or not cut else float(np.nextafter(self.cuts_[f][cut - 1], np.inf))

    def fit(self, df: DataFrame, label: str = "y", features: Sequence[str] | None = None) -> UnorderedFuzzyRules:
        rows = self._rows(df, label, features).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.cuts_ = self._cuts(df.filter(F.col(label).isNotNull()))
            self.exact_ = [len(c) < self.max_cuts for c in self.cuts_]
            self.crisp_ = self._learn(rows)
            flat = [(k, tests) for k, of in enumerate(self.crisp_) for tests in of]
            sloped = self._sloped(rows, flat)
            most = max((len(t) for _, t in flat), default=0)

            def part(x, bins, c, fold):
                """For each rule: degrees over its class and others, and the rows of both that each prefix covers."""
                out = np.zeros((len(sloped), most + 2, 2))
                for i, ((k, _), of) in enumerate(zip(flat, sloped, strict=True)):
                    mine, degree = c == k, np.ones(len(c))
                    out[i, 1] = mine.sum(), (~mine).sum()
                    for j, r in enumerate(of):
                        degree = degree * r.degrees(x[:, r.feature])
                        out[i, j + 2] = (mine & (degree > 0)).sum(), (~mine & (degree > 0)).sum()
                    out[i, 0] = degree[mine].sum(), degree[~mine].sum()
                return out.ravel()

            sums = self._pass(rows, len(flat) * (most + 2) * 2, part).reshape(len(flat), most + 2, 2) if flat else []
            self.rules_ = []
            for (k, _), of, s in zip(flat, sloped, sums, strict=True):
                prior, m = self.counts_[k] / self.counts_.sum(), len(of)
                worth = tuple(float((s[j + 1, 0] + 1) / (s[j + 1].sum() + 2) * (j + 1) / (m + 2)) for j in range(m + 1))
                self.rules_.append(UnorderedRule(self.classes_[k], of, float((2 * prior + s[0, 0]) / (2 + s[0].sum())), worth))
        finally:
            rows.unpersist()
        return self

    def decision_function(self, df: DataFrame, to: str = "margin") -> DataFrame:
        """For each class the sum of degree times certainty."""
        votes: dict = {c: F.lit(0.0) for c in self.classes_}
        for r in self.rules_:
            degree = F.lit(1.0)
            for i in r.conditions:
                degree = degree * i.column(F.col(self.features_[i.feature]).cast("double"))
            votes[r.label] = votes[r.label] + degree * r.certainty
        return df.withColumn(to, F.array(*[votes[c] for c in self.classes_]))

    def _stretched(self) -> Column:
        """For each class the largest worth of its rules' conditions before the first that the row fails."""
        best: dict = {c: [] for c in self.classes_}
        for r in self.rules_:
            worth = F.lit(r.stretched[-1])
            for j in reversed(range(len(r.conditions))):
                i = r.conditions[j]
                worth = F.when(i.column(F.col(self.features_[i.feature]).cast("double")) > 0, worth).otherwise(F.lit(r.stretched[j] if j else 0.0))
            best[r.label].append(worth)
        return F.array(*[F.greatest(*b, F.lit(0.0)) if b else F.lit(0.0) for b in best.values()])

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        """The class of the largest sum, else of the best stretched rule, else the most frequent one; of ties the more frequent class."""
        order = sorted(range(len(self.classes_)), key=lambda k: (-self.counts_[k], k))
        by_size = lambda scores: F.array(*[F.get(scores, F.lit(k)) for k in order])
        names = F.array(*[F.lit(self.classes_[k]) for k in order])
        named = lambda scores: F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
        scored = self.decision_function(df, "__votes").withColumn("__votes", by_size(F.col("__votes")))
        if self.stretch:
            scored = scored.withColumn("__reach", by_size(self._stretched()))
            other = F.when(F.array_max("__reach") > 0, named(F.col("__reach"))).otherwise(F.get(names, F.lit(0)))
        else:
            other = F.get(names, F.lit(0))
        return scored.withColumn(to, F.when(F.array_max("__votes") > 0, named(F.col("__votes"))).otherwise(other)).drop("__votes", "__reach")

    def rule_texts(self) -> list[str]:
        def one(i: FuzzyInterval) -> str:
            return f"{self.features_[i.feature]} {'<=' if i.at_most else '>='} {i.core:.6g}" + ("" if i.edge == i.core else f" (-> {i.edge:.6g})")

        return [f"{' and '.join(map(one, r.conditions))} => {r.label} (CF = {r.certainty:.2f})" for r in self.rules_]


def purest(h: np.ndarray, crisp: FuzzyInterval, cut: int, cuts: np.ndarray) -> tuple[float, FuzzyInterval]:
    """The slope of the largest purity; h (bins, 4): count and sum of values of the class's rows, then of the others'. Of equal purities the widest."""
    if not crisp.at_most:
        # The same with the values turned around.
        turned = h[: len(cuts)][::-1] * np.array([1, -1, 1, -1])
        extra = h[len(cuts) :].sum(0) * np.array([1, -1, 1, -1])
        turned[0] += extra
        purity, found = purest(np.concatenate([turned, np.zeros((1, 4))]), FuzzyInterval(crisp.feature, True, -crisp.core, -crisp.edge), len(cuts) - 1 - cut, -cuts[::-1])
        return purity, FuzzyInterval(crisp.feature, False, crisp.core, -found.edge)
    inside, beyond = h[: cut + 1].sum(0), h[cut + 1 : len(cuts)]
    purity = lambda p, n: round(p / (p + n), 12) if p + n > 0 else 0.0
    best = purity(inside[0], inside[2]), crisp
    run = np.cumsum(beyond, axis=0)
    for b in range(len(beyond)):
        if beyond[b, 0] + beyond[b, 2] == 0:
            continue  # only values of covered rows are edges
        edge = float(cuts[cut + 1 + b])
        p, n = (inside[s] + (edge * run[b, s] - run[b, s + 1]) / (edge - crisp.core) for s in (0, 2))
        if purity(p, n) >= best[0]:
            best = purity(p, n), FuzzyInterval(crisp.feature, True, crisp.core, edge)
    return best
