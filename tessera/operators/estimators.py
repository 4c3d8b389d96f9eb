"""Classifiers over fuzzy terms and rules. A fit takes a DataFrame; what is fitted serves as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.membership import AND_OPERATORS, TERMS, concept_map, degrees
from tessera.functions.rules import Condition, Rule, activation_array, activations, rule_degrees, rule_text
from tessera.operators import explain as ex
from tessera.operators import prepare, ranking
from tessera.plans import artifact
from tessera.plans import quotient as qt
from tessera.plans.solver import hinge_duals, solve, solve_classes

#: Pairs that are added at once, and how many times as many are priced by their own activations.
BATCH, SHORTLIST = 20, 20


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class _Binary:
    """What the binary models share: names, classes, weights, serving. Fitted: partitions_, rules_, coef_, intercept_, classes_."""

    label = "y"

    def _begin(self, df: DataFrame, label: str, features, weight, exclude=()) -> list[str]:
        self.label, self.weight = label, weight
        names = prepare.feature_names(df, features, label, [*exclude, *([weight] if weight else [])])
        classes = sorted(r[0] for r in df.select(label).distinct().limit(3).collect())
        _check(len(classes) == 2, "binary models need exactly two classes")
        prepare.require_clean(df, names)
        if weight and (df.agg(F.min(weight)).first()[0] or 0) < 0:
            raise ValueError("sample weights mustn't be negative")
        self.classes_, self.n_features_in_, self.feature_names_in_ = classes, len(names), names
        return names

    def _weights(self, df: DataFrame) -> tuple[Column, Column]:
        """The sample weight, and the weight with the class weight."""
        s = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        of_class = prepare.class_weights(df, self.label, self.class_weight)
        return s, s * prepare.lookup(F.col(self.label), of_class)

    def _sign(self) -> Column:
        return ex.checked_sign(F.col(self.label), self.classes_)

    def activation_columns(self) -> list[Column]:
        return activations(self.rules_, self.partitions_, self.and_operator, getattr(self, "softmin_temperature", 0.1))

    def transform(self, df: DataFrame, to: str = "activations") -> DataFrame:
        prepare.feature_names(df, [p.feature for p in self.partitions_])
        return df.withColumn(to, F.array(*self.activation_columns()))

    def margin_column(self) -> Column:
        return ex.margin(self.activation_columns(), self.coef_, self.intercept_)

    def decision_function(self, df: DataFrame, to: str = "margin") -> DataFrame:
        prepare.feature_names(df, [p.feature for p in self.partitions_])
        return df.withColumn(to, self.margin_column())

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        prepare.feature_names(df, [p.feature for p in self.partitions_])
        return df.withColumn(to, ex.decision(self.margin_column(), self.classes_))

    def concept_memberships(self, df: DataFrame, to: str = "concepts") -> DataFrame:
        return df.withColumn(to, concept_map(self.partitions_))

    def fuzzy_violations(self, df: DataFrame, to: str = "violation") -> DataFrame:
        return df.withColumn(to, ex.violations(self.margin_column(), self._sign()))

    def explain(self, df: DataFrame, top_n: int = 5, min_abs_contribution: float = 0.0) -> DataFrame:
        return ex.explain(df, self.activation_columns(), self.coef_, self.rules_, [p.feature for p in self.partitions_], self.intercept_, self.classes_, top_n, min_abs_contribution)

    def support_rules(self, least: float = 1e-8) -> list[dict]:
        return ex.support_rules(self.coef_, self.rules_, [p.feature for p in self.partitions_], self.classes_, least)

    def feature_names_out(self) -> list[str]:
        return [rule_text(r, [p.feature for p in self.partitions_]) for r in self.rules_]


@dataclass
class FuzzyRuleSVM(_Binary):
    """Sparse max-margin rules: screened features, quantile terms, ranked or priced conjunctions, a squared-hinge fit.

    Activations are divided by 1 + penalty (length - 1); the intercept is a constant column that is penalised like the rest. With
    column generation, ``max_rules`` bounds the rules of two terms that are added, not those of one.
    """

    C: float = 1.0
    penalty: str = "l1"
    max_rule_length: int = 2
    max_rules: int | None = 256
    min_rule_coverage: float = 0.02
    and_operator: str = "min"
    softmin_temperature: float = 0.1
    quantiles: tuple = prepare.QUANTILES
    rule_length_penalty: float = 0.25
    feature_screening: str = "none"
    screen_top_k: int | None = None
    rule_generation: str = "enumeration"
    class_weight: str | dict | None = None
    max_iter: int = 100
    tol: float = 1e-6

    def _validate(self) -> None:
        _check(self.C > 0, "C must be positive")
        _check(self.penalty in ("l1", "l2"), "penalty must be l1 or l2")
        _check(self.max_rule_length >= 1, "max_rule_length must be at least 1")
        _check(self.max_rules is None or self.max_rules >= 1, "max_rules must be positive or None")
        _check(0 <= self.min_rule_coverage <= 1, "min_rule_coverage must be within [0, 1]")
        _check(self.and_operator in AND_OPERATORS, f"and_operator must be one of {AND_OPERATORS}")
        _check(self.softmin_temperature > 0, "softmin_temperature must be positive")
        _check(self.rule_length_penalty >= 0, "rule_length_penalty mustn't be negative")
        _check(self.rule_generation in ("enumeration", "column_generation"), "rule_generation must be enumeration or column_generation")

    def fit(self, df: DataFrame, label: str = "y", features: Sequence[str] | None = None, weight: str | None = None, exclude=()) -> FuzzyRuleSVM:
        self._validate()
        if self.rule_generation == "enumeration":
            return self._fit(df, label, features, weight, exclude)
        # Every pass reads these few columns again, so what they come from is run once.
        names = prepare.feature_names(df, features, label, [*exclude, *([weight] if weight else [])])
        kept = df.select(*dict.fromkeys([*names, label, *([weight] if weight else [])])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(kept, label, names, weight, exclude)
        finally:
            kept.unpersist()

    def _fit(self, df: DataFrame, label: str, features: Sequence[str] | None, weight: str | None, exclude) -> FuzzyRuleSVM:
        names = self._begin(df, label, features, weight, exclude)
        self.selected_ = prepare.screen(df, names, label, self.feature_screening, self.screen_top_k)
        self.partitions_ = prepare.anchors(df, self.selected_, self.quantiles)
        s, sc = self._weights(df)
        make = self._priced if self.rule_generation == "column_generation" else self._enumerated
        self.rules_, self.n_candidate_rules_ = make(df, s, sc)
        weights = self._fit_rules(df, self.rules_, sc)
        self.coef_, self.intercept_ = weights[:-1], weights[-1]
        self.n_active_rules_ = int(np.sum(np.abs(self.coef_) > 1e-12))
        return self

    def _shares(self, names: Sequence[str]) -> bool:
        """Whether nothing but the fit itself depends on the label: rules of one term over all features."""
        return self.max_rule_length == 1 and self.rule_generation == "enumeration" and (self.feature_screening == "none" or self.screen_top_k is None or self.screen_top_k >= len(names))

    def _scale(self, rules: Sequence[Rule]) -> np.ndarray:
        return np.array([1 + self.rule_length_penalty * (r.length - 1) for r in rules] + [1.0])

    def _fit_rules(self, df: DataFrame, rules: Sequence[Rule], weight: Column) -> np.ndarray:
        p = self._scale(rules)
        lam, q = (1.0, 0.0) if self.penalty == "l1" else (0.0, 1.0)
        if self.rule_generation == "column_generation":
            data, widen = df.select(self._raw().alias("z"), self._sign().alias("y"), weight.alias("s")), self._widened(rules)
            self.solution_ = solve(data, len(rules) + 1, self.C, lam, q, self.tol, self.max_iter, lambda x: widen(x) / p, thorough=True)
            return self.solution_.coef / p
        acts = activations(rules, self.partitions_, self.and_operator, self.softmin_temperature)
        z = F.array(*[a / F.lit(float(x)) for a, x in zip(acts, p, strict=False)], F.lit(1.0))
        data = df.select(z.alias("z"), self._sign().alias("y"), weight.alias("s"))
        self.solution_ = solve(data, len(rules) + 1, self.C, lam, q, self.tol, self.max_iter)
        return self.solution_.coef / p

    def _raw(self) -> Column:
        """The features' values, of which tasks make activations."""
        return F.array(*[F.col(p.feature).cast("double") for p in self.partitions_])

    def _widened(self, rules: Sequence[Rule]):
        """Makes the rules' activations and the constant of raw values within a task."""
        parts, how, temperature = self.partitions_, self.and_operator, self.softmin_temperature
        return lambda x: np.hstack([rule_degrees(degrees(x, parts), rules, how, temperature), np.ones((len(x), 1))])

    def _enumerated(self, df, s, sc):
        rules, self.rule_scores_, n = ranking.generate(df, self.partitions_, self._sign(), s, self.max_rule_length, self.max_rules, self.min_rule_coverage, self.and_operator, self.softmin_temperature)
        return rules, n

    def _priced(self, df, s, sc):
        """Rules of one term, then batches of pairs that the duals of the L1 hinge programme over the rules so far price above 1.

        All pairs are priced by one product Gram; of the dearest ``SHORTLIST`` times as many as may be added, the activations are then priced in one pass, and pairs below the least coverage are refused for good."""
        d, sign = len(self.partitions_), self._sign()
        singles = [Rule((Condition(f, t),)) for f in range(d) for t in TERMS]
        coverage, _ = ranking.scores(*ranking.rule_sums(df, singles, self.partitions_, sign, s, self.and_operator, self.softmin_temperature), singles)
        rules = [r for r, c in zip(singles, coverage, strict=True) if c >= self.min_rule_coverage] or singles
        most = self.max_rules if self.max_rules is not None else 9 * d * (d - 1) // 2
        added, done = 0, set()
        mean = df.agg(F.avg(sc)).first()[0] or 1.0
        while self.max_rule_length > 1 and added < most:
            fresh = self._price(df, rules, sign, s, self.C * sc / mean, min(BATCH, most - added), done)
            if not fresh:
                break
            rules, added = rules + fresh, added + len(fresh)
        return rules, len(rules)

    def _price(self, df: DataFrame, rules: Sequence[Rule], sign: Column, s: Column, upper: Column, top: int, done: set) -> list[Rule]:
        """Up to ``top`` pairs, dearest first; done: pairs that were added or refused, to which these are added."""
        d, parts, widen = len(self.partitions_), self.partitions_, self._widened(rules)
        data = df.select(self._raw().alias("z"), sign.cast("double").alias("y"), upper.cast("double").alias("u"), s.cast("double").alias("s"))
        self.dual_ = dual = hinge_duals(data.select("z", "y", F.col("u").alias("s")), len(rules) + 1, widen=widen)
        coef, mu = dual.coef, dual.mu
        signed = lambda x, y, u: u * y * np.clip((1 - y * (widen(x) @ coef)) / mu, 0.0, 1.0)

        def products(x, y, u, s):
            m = degrees(x, parts)
            return ((m * signed(x, y, u)[:, None]).T @ m).ravel()

        gram = np.abs(_summed(data, products, 9 * d * d)).reshape(3 * d, 3 * d)
        pairs = sorted((-gram[i, j], i, j) for i in range(3 * d) for j in range(i + 1, 3 * d) if i // 3 != j // 3)
        short = [(i, j) for v, i, j in pairs[: SHORTLIST * top] if -v > 1 + self.tol and (i, j) not in done]
        if not short:
            return []
        made = [Rule((Condition(i // 3, TERMS[i % 3]), Condition(j // 3, TERMS[j % 3]))) for i, j in short]
        of_made = self._widened(made)

        def priced(x, y, u, s):
            a = of_made(x)[:, :-1]
            return np.r_[signed(x, y, u) @ a, s @ a, s.sum()]

        sums = _summed(data, priced, 2 * len(made) + 1)
        prices, covered = sums[: len(made)], sums[len(made) : -1] / max(sums[-1], 1e-300)
        found = []
        for k, pair in enumerate(short):
            if abs(prices[k]) <= 1 + self.tol:
                continue
            if covered[k] < self.min_rule_coverage:
                done.add(pair)
                continue
            found.append((-abs(prices[k]), k))
            if len(found) >= 4 * top:
                break
        best = [k for _, k in sorted(found)[:top]]
        done.update(short[k] for k in best)
        return [made[k] for k in best]


def _summed(data: DataFrame, sums, k: int) -> np.ndarray:
    """The k sums over rows that ``sums`` takes of raw values, signs, upper bounds and weights, in one pass; data: z, y, u, s."""

    def run(batches):
        total = np.zeros(k)
        for b in batches:
            if b.num_rows:
                total += sums(b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), *[b.column(c).to_numpy() for c in "yus"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(k)
    found = data.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


class MembershipSVM(FuzzyRuleSVM):
    """A linear max-margin model on all low, medium and high memberships."""

    def _enumerated(self, df, s, sc):
        rules = [Rule((Condition(f, t),)) for f in range(len(self.partitions_)) for t in TERMS]
        return rules, len(rules)

    def nonzero_coef_count(self) -> int:
        return len({r.conditions[0].feature for r, c in zip(self.rules_, self.coef_, strict=True) if abs(c) > 1e-12})


@dataclass
class MembershipLogisticL1(_Binary):
    """L1 logistic regression on the memberships, by Spark ML."""

    C: float = 1.0
    quantiles: tuple = prepare.QUANTILES
    class_weight: str | dict | None = None
    max_iter: int = 200
    tol: float = 1e-6
    and_operator: str = "min"

    def fit(self, df: DataFrame, label: str = "y", features=None, weight=None, exclude=()) -> MembershipLogisticL1:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        names = self._begin(df, label, features, weight, exclude)
        self.partitions_ = prepare.anchors(df, names, self.quantiles)
        self.rules_ = [Rule((Condition(f, t),)) for f in range(len(names)) for t in TERMS]
        _, sc = self._weights(df)
        data = df.select(array_to_vector(activation_array(self.rules_, self.partitions_)).alias("features"), (self._sign() > 0).cast("double").alias("label"), sc.alias("w"))
        total = data.agg(F.sum("w")).first()[0]
        model = LogisticRegression(elasticNetParam=1.0, regParam=1 / (self.C * total), standardization=False, weightCol="w", maxIter=self.max_iter, tol=self.tol).fit(data)
        self.coef_, self.intercept_ = np.array(model.coefficients.toArray()), float(model.intercept)
        return self


@dataclass
class CSRQClassifier(_Binary):
    """A classifier in the canonical low/high basis, whose result doesn't depend on how a rule dictionary is written.

    Coefficients c of the monomials minimise sum p_q^2 c_q^2 / 2 + C sum s hinge^2; p is ``intercept_penalty`` for the constant and 1 + eta
    (degree - 1) else. In dictionary mode c is kept in the span of the dictionary's columns. Class weights count once.
    """

    C: float = 1.0
    max_rule_length: int = 2
    quantiles: tuple = prepare.QUANTILES
    degree_penalty: float = 0.35
    intercept_penalty: float = 1.0
    semantic_space: str = "complete"
    rule_dictionary: Sequence[qt.Atom] | None = None
    strict_anchor_policy: str = "raise"
    feature_screening: str = "none"
    screen_top_k: int | None = None
    max_semantic_terms: int = 4096
    class_weight: str | dict | None = None
    max_iter: int = 100
    tol: float = 1e-9
    and_operator: str = "product"

    def fit(self, df: DataFrame, label: str = "y", features=None, weight=None, exclude=()) -> CSRQClassifier:
        _check(self.C > 0 and self.intercept_penalty > 0, "C and intercept_penalty must be positive")
        _check(self.degree_penalty >= 0, "degree_penalty mustn't be negative")
        _check(self.semantic_space in ("complete", "dictionary"), "semantic_space must be complete or dictionary")
        _check(self.strict_anchor_policy in ("raise", "drop"), "strict_anchor_policy must be raise or drop")
        _check(self.semantic_space == "complete" or self.rule_dictionary, "dictionary mode needs a rule_dictionary")
        names = self._begin(df, label, features, weight, exclude)
        chosen = prepare.screen(df, names, label, self.feature_screening, self.screen_top_k)
        parts = prepare.anchors(df, chosen, self.quantiles)
        tied = [p.feature for p in parts if not p.strict]
        _check(not tied or self.strict_anchor_policy == "drop", f"anchors are tied: {tied}")
        self.dropped_features_ = [names.index(f) for f in tied]
        self.partitions_ = [p for p in parts if p.strict]
        _check(bool(self.partitions_), "all features have tied anchors")
        d = len(self.partitions_)
        dimension = qt.canonical_dimension(d, self.max_rule_length)
        _check(dimension <= self.max_semantic_terms, f"{dimension} terms are over max_semantic_terms")
        self.basis_ = qt.canonical_basis(d, self.max_rule_length)
        self.rules_ = [Rule(m) for m in self.basis_.monomials[1:]]
        p = np.array([self.intercept_penalty] + [1 + self.degree_penalty * (len(m) - 1) for m in self.basis_.monomials[1:]])
        _, sc = self._weights(df)
        psi = qt.feature_arrays(self.basis_, self.partitions_)
        data = lambda z: df.select(z.alias("z"), self._sign().alias("y"), sc.alias("s"))
        self.semantic_map_ = None
        if self.semantic_space == "complete":
            z = F.array(*[a / F.lit(float(x)) for a, x in zip(psi, p, strict=True)])
            self.solution_ = solve(data(z), dimension, self.C, 0.0, 1.0, self.tol, self.max_iter)
            c = self.solution_.coef / p
        else:
            self.semantic_map_ = qt.semantic_map(self.rule_dictionary, self.basis_)
            r = np.array([[float(x) for x in row] for row in qt.span_rows(self.semantic_map_)]).T
            lower = np.linalg.cholesky(r.T @ (p[:, None] ** 2 * r))
            to_c = np.linalg.solve(lower, r.T).T  # R L^-T
            z = F.array(*[ex.margin(psi, list(col)) for col in to_c.T])
            self.solution_ = solve(data(z), to_c.shape[1], self.C, 0.0, 1.0, self.tol, self.max_iter)
            c = to_c @ self.solution_.coef
        self.c_, self.coef_, self.intercept_ = c, c[1:], float(c[0])
        self.contract_sha256_ = qt.contract_hash(self.partitions_, self.basis_, [names.index(p.feature) for p in self.partitions_], {"degree": self.degree_penalty, "intercept": self.intercept_penalty})
        return self

    def transform(self, df: DataFrame, to: str = "activations") -> DataFrame:
        return df.withColumn(to, F.array(*qt.feature_arrays(self.basis_, self.partitions_)))

    def feature_names_out(self) -> list[str]:
        return list(map(qt.monomial_text, self.basis_.monomials))

    def semantic_map(self):
        return self.semantic_map_

    def decode(self, method: str = "canonical", target_dictionary: Sequence[qt.Atom] | None = None) -> dict:
        """The function as coefficients of monomials, or as weights of a dictionary with a certificate."""
        if method == "canonical":
            return {"status": "OK", "coefficients": qt.decode_canonical(self.c_, self.basis_)}
        atoms = target_dictionary or self.rule_dictionary
        _check(bool(atoms), "decode needs a dictionary")
        m = qt.semantic_map(atoms, self.basis_)
        names = ["intercept", *(rule_text(a.rule, [p.feature for p in self.partitions_]) for a in atoms)]
        if method == "rref":
            cert = qt.decode_rref(m, list(map(float, self.c_)))
            return {"status": cert.status, "gamma": cert.gamma, "atoms": names, "certificate": cert, "map": m}
        if method == "minimum_l2":
            status, gamma = qt.decode_minimum_l2(m, self.c_)
            return {"status": status, "gamma": gamma, "atoms": names, "map": m}
        raise ValueError("method must be canonical, rref or minimum_l2")

    def certificate(self, atoms: Sequence[qt.Atom]) -> dict:
        """What the dictionary's exact weights of this function are, with all that a check of them needs, and a hash."""
        cert = self.decode("rref", atoms)["certificate"]
        out = {
            "status": cert.status, "exact_zero_residual": cert.status == "CERTIFIED", "map_sha256": cert.map_sha256, "target_sha256": cert.target_sha256, "basis_sha256": self.basis_.sha256, "semantic_contract_sha256": self.contract_sha256_,
            "atom_rules": [{"conditions": [{"feature": c.feature, "term": c.term} for c in a.rule.conditions]} for a in atoms],
            "atom_scales": qt.fractions_to_text([Fraction(a.scale) for a in atoms]), "atom_costs": qt.fractions_to_text([Fraction(a.cost) for a in atoms]),
            "c_exact": qt.fractions_to_text([Fraction(float(x)) for x in self.c_]), "gamma_exact": qt.fractions_to_text(cert.gamma or ()), "witness": qt.fractions_to_text(cert.witness or ()),
        }
        return out | {"sha256": artifact.digest(out)}

    def export_artifact(self, validation: DataFrame | None = None) -> str:
        """JSON of anchors, exact coefficients, hashes and the fit's report; with a dictionary also its exact weights, and the greatest difference that they make on the validation rows.

        ``tessera.plans.artifact`` checks it from the file alone."""
        names = [p.feature for p in self.partitions_]
        out = {
            "version": artifact.VERSION, "semantic_space": self.semantic_space, "anchors": [asdict(p) for p in self.partitions_], "classes": [str(c) for c in self.classes_], "n_features_total": self.n_features_in_,
            "selected_feature_indices": [self.feature_names_in_.index(n) for n in names], "dropped_feature_indices": self.dropped_features_, "max_degree": self.max_rule_length,
            "monomials": [[[c.feature, c.term] for c in m] for m in self.basis_.monomials], "basis_sha256": self.basis_.sha256, "contract_sha256": self.contract_sha256_,
            "coefficients": qt.fractions_to_text([Fraction(float(x)) for x in self.c_]),
            "optimization": {"objective": self.solution_.objective, "kkt": self.solution_.kkt, "passes": self.solution_.passes, "converged": bool(self.solution_.converged)},
        }
        if self.rule_dictionary:
            out["equality_certificate"] = self.certificate(self.rule_dictionary)
        if validation is not None:
            direct, decoded = self.margin_column(), None
            if out.get("equality_certificate", {}).get("status") == "CERTIFIED":
                gamma = [float(Fraction(x)) for x in out["equality_certificate"]["gamma_exact"]]
                acts = activations([a.rule for a in self.rule_dictionary], self.partitions_, "product")
                decoded = ex.margin(acts, [g * a.scale for g, a in zip(gamma[1:], self.rule_dictionary, strict=True)], gamma[0])
            gap = F.abs(direct - decoded) if decoded is not None else F.lit(None).cast("double")
            other = (ex.decision(direct, [0, 1]) != ex.decision(decoded, [0, 1])) if decoded is not None else F.lit(False)
            row = validation.agg(F.max(gap), F.count_if(other), F.count_if(F.abs(direct) < 1e-3), F.count(F.lit(1))).first()
            out["floating_point_audit"] = {"max_abs_difference": row[0], "prediction_disagreements": row[1], "near_zero": row[2], "rows": row[3]}
        return json.dumps(out | {"sha256": artifact.digest(out)}, sort_keys=True)


@dataclass
class QuotientAtomicSVM(_Binary):
    """Weights of dictionary atoms with L1 costs and a small quadratic tie-break in the canonical metric; only c = B g is unique."""

    atom_dictionary: Sequence[qt.Atom] = ()
    C: float = 1.0
    max_rule_length: int = 2
    quantiles: tuple = prepare.QUANTILES
    degree_penalty: float = 0.35
    intercept_cost: float = 1.0
    intercept_penalty: float = 1.0
    atomic_tie_break: float = 1e-6
    class_weight: str | dict | None = None
    max_semantic_terms: int = 1024
    max_iter: int = 200
    tol: float = 1e-6
    and_operator: str = "product"

    def fit(self, df: DataFrame, label: str = "y", features=None, weight=None, exclude=()) -> QuotientAtomicSVM:
        _check(bool(self.atom_dictionary), "atom_dictionary is empty")
        names = self._begin(df, label, features, weight, exclude)
        self.partitions_ = prepare.anchors(df, names, self.quantiles)
        _check(all(p.strict for p in self.partitions_), "anchors are tied")
        dimension = qt.canonical_dimension(len(names), self.max_rule_length)
        _check(dimension <= self.max_semantic_terms, f"{dimension} terms are over max_semantic_terms")
        self.basis_ = qt.canonical_basis(len(names), self.max_rule_length)
        self.rules_ = [Rule(m) for m in self.basis_.monomials[1:]]
        b = qt.semantic_map(self.atom_dictionary, self.basis_).dense()
        p = np.array([self.intercept_penalty] + [1 + self.degree_penalty * (len(m) - 1) for m in self.basis_.monomials[1:]])
        psi = qt.feature_arrays(self.basis_, self.partitions_)
        _, sc = self._weights(df)
        data = df.select(F.array(*[ex.margin(psi, list(col)) for col in b.T]).alias("z"), self._sign().alias("y"), sc.alias("s"))
        costs = [self.intercept_cost, *(a.cost for a in self.atom_dictionary)]
        q = self.atomic_tie_break * b.T @ (p[:, None] ** 2 * b)
        self.solution_ = solve(data, b.shape[1], self.C, costs, q, self.tol, self.max_iter)
        self.gamma_ = self.solution_.coef
        self.c_ = b @ self.gamma_
        self.coef_, self.intercept_ = self.c_[1:], float(self.c_[0])
        return self


class OneVsRest:
    """A binary model for each class; the largest margin wins, the first class among equals.

    Models of rules of one term over all features share what doesn't depend on the class: anchors, the pass of the scores and those of the fits."""

    def __init__(self, factory):
        self.factory = factory

    def fit(self, df: DataFrame, label: str = "y", features=None, weight=None, exclude=()) -> OneVsRest:
        names = prepare.feature_names(df, features, label, [*exclude, *([weight] if weight else [])])
        self.classes_ = sorted(r[0] for r in df.select(label).distinct().collect())
        models = [self.factory() for _ in self.classes_]
        self.shared_ = len(models) > 1 and all(type(m) is FuzzyRuleSVM and m == models[0] and m._shares(names) for m in models)
        if self.shared_:
            self.models_ = self._fit_together(models, df, label, names, weight)
        else:
            self.models_ = [m.fit(df.withColumn("_is", (F.col(label) == F.lit(c)).cast("int")), "_is", names, weight) for c, m in zip(self.classes_, models, strict=True)]
        return self

    def _fit_together(self, models: list, df: DataFrame, label: str, names: list[str], weight) -> list:
        first, k = models[0], len(models)
        first._validate()
        prepare.require_clean(df, names)
        if weight and (df.agg(F.min(weight)).first()[0] or 0) < 0:
            raise ValueError("sample weights mustn't be negative")
        parts = prepare.anchors(df, names, first.quantiles)
        of = F.lit(None).cast("int")
        for i, c in enumerate(self.classes_):
            of = F.when(F.col(label) == F.lit(c), i).otherwise(of)
        data = df.select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), of.alias("of"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("s"))
        count, totals, sums = _class_activations(data, parts, k)
        rules = [Rule((Condition(f, t),)) for f in range(len(names)) for t in TERMS]
        columns, weights = [], []
        for i, m in enumerate(models):
            m.label, m.weight, m.classes_, m.n_features_in_, m.feature_names_in_, m.selected_, m.partitions_ = "_is", weight, [0, 1], len(names), names, names, parts
            two = np.array([totals.sum() - totals[i], totals[i]])
            coverage, score = ranking.scores(two, np.stack([sums.sum(0) - sums[i], sums[i]]), rules)
            chosen, m.n_candidate_rules_ = ranking.ranked(rules, coverage, score, m.max_rules, m.min_rule_coverage)
            if not chosen:
                chosen, m.n_candidate_rules_ = ranking.ranked(rules, coverage, score, m.max_rules, -1.0)
            m.rules_, m.rule_scores_ = [rules[j] for j in chosen], [float(score[j]) for j in chosen]
            columns.append([*chosen, len(rules)])
            of_class = prepare.class_weights_of({0: int(count.sum() - count[i]), 1: int(count[i])}, m.class_weight)
            weights.append((of_class[0], of_class[1]))
        lam, q = (1.0, 0.0) if first.penalty == "l1" else (0.0, 1.0)
        widen = lambda x: np.hstack([degrees(x, parts), np.ones((len(x), 1))])
        for m, found in zip(models, solve_classes(data, len(names), widen, columns, weights, first.C, lam, q, first.tol, first.max_iter), strict=True):
            m.solution_, m.coef_, m.intercept_ = found, found.coef[:-1], found.coef[-1]
            m.n_active_rules_ = int(np.sum(np.abs(m.coef_) > 1e-12))
        return models

    def _margins(self, df: DataFrame) -> Column:
        """The margins of all classes: one product in Arrow batches where the models share their terms, which as columns would be as many expressions as classes times terms."""
        if not self.shared_:
            return F.array(*[m.margin_column() for m in self.models_])
        parts = self.models_[0].partitions_
        names = prepare.feature_names(df, [p.feature for p in parts])
        coef = np.zeros((3 * len(parts), len(self.models_)))
        for i, m in enumerate(self.models_):
            for r, v in zip(m.rules_, m.coef_, strict=True):
                coef[3 * r.conditions[0].feature + TERMS.index(r.conditions[0].term), i] = v
        intercept = np.array([m.intercept_ for m in self.models_])

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            out = [degrees(np.stack(x.iloc[at : at + 4096].to_numpy()).astype(float), parts) @ coef + intercept for at in range(0, len(x), 4096)]
            return pd.Series([row for part in out for row in part])

        return margins(F.array(*[F.col(n).cast("double") for n in names]))

    def decision_function(self, df: DataFrame, to: str = "margins") -> DataFrame:
        return df.withColumn(to, self._margins(df))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        m, classes = F.col("__margins"), F.array(*map(F.lit, self.classes_))
        with_margins = df.withColumn("__margins", self._margins(df))
        return with_margins.withColumn(to, F.element_at(classes, F.array_position(m, F.array_max(m)).cast("int"))).drop("__margins")


def _class_activations(data: DataFrame, partitions, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weight and the weighted sums of all degrees, of each class; data: x, of, s."""
    width = 3 * len(partitions) + 2

    def run(batches):
        total = np.zeros((classes, width))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(partitions))
            of, s = b.column("of").to_numpy(), b.column("s").to_numpy()
            for at in range(0, len(x), 4096):
                w, c = s[at : at + 4096], of[at : at + 4096]
                z = np.hstack([degrees(x[at : at + 4096], partitions) * w[:, None], w[:, None], np.ones((len(w), 1))])
                total += (np.arange(classes)[:, None] == c).astype(float) @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["of", "v"])

    flat = data.mapInArrow(run, "of int, v array<double>").select("of", F.posexplode("v").alias("i", "v")).groupBy("of", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((classes, width))
    out[flat.column("of").to_numpy(), flat.column("i").to_numpy()] = flat.column("v").to_numpy()
    return out[:, -1], out[:, -2], out[:, :-2]
