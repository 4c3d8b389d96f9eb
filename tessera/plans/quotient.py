"""The canonical low/high basis of product rules and exact algebra over it. Catalogues are small; numbers are fractions.

As low + medium + high = 1 for strict anchors, medium is 1 - low - high, so any product rule is an integer combination of monomials in low and
high. Two dictionaries of rules are equal in what they can say just if their columns span one space.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import combinations, product
from math import comb, isfinite

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.membership import Partition
from tessera.functions.rules import Condition, Rule

Monomial = tuple[Condition, ...]
MAX_CELLS = 10_000_000


def monomial_text(m: Monomial) -> str:
    return " * ".join(f"{c.term}[{c.feature}]" for c in m) or "1"


@dataclass(frozen=True)
class Basis:
    n_features: int
    max_degree: int
    monomials: tuple[Monomial, ...]
    sha256: str
    index: dict = field(compare=False, hash=False, repr=False, default_factory=dict)

    @property
    def dimension(self) -> int:
        return len(self.monomials)


def stable_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def canonical_dimension(d: int, r: int) -> int:
    return sum(comb(d, k) * 2**k for k in range(min(d, r) + 1))


def original_grammar_size(d: int, r: int) -> int:
    return sum(comb(d, k) * 3**k for k in range(min(d, r) + 1))


def canonical_basis(d: int, r: int) -> Basis:
    """Monomials of different features by degree, then features, then terms with low before high; the empty one is first."""
    if d < 0 or r < 0:
        raise ValueError("n_features and max_degree mustn't be negative")
    found: list[Monomial] = []
    for k in range(min(d, r) + 1):
        for features in combinations(range(d), k):
            found += [tuple(map(Condition, features, terms)) for terms in product(("low", "high"), repeat=k)]
    digest = stable_hash({"n_features": d, "max_degree": r, "monomials": [monomial_text(m) for m in found]})
    return Basis(d, r, tuple(found), digest, {m: i for i, m in enumerate(found)})


def expand_rule(rule: Rule, basis: Basis) -> dict[int, int]:
    """Coefficients of a product rule by place in the basis."""
    features = [c.feature for c in rule.conditions]
    if len(set(features)) != len(features):
        raise ValueError("a rule has two conditions on one feature")
    if any(not 0 <= f < basis.n_features for f in features):
        raise ValueError("a rule's feature is outside the basis")
    if len(features) > basis.max_degree:
        raise ValueError("a rule is longer than the basis' degree")
    terms: dict[Monomial, int] = {(): 1}
    for c in sorted(rule.conditions):
        if c.term not in ("low", "medium", "high"):
            raise ValueError(f"unknown term {c.term!r}")
        options = [((), 1), ((Condition(c.feature, "low"),), -1), ((Condition(c.feature, "high"),), -1)] if c.term == "medium" else [((c,), 1)]
        new: dict[Monomial, int] = {}
        for m, k in terms.items():
            for add, sign in options:
                new[m + add] = new.get(m + add, 0) + sign * k
        terms = new
    return {basis.index[m]: k for m, k in terms.items() if k}


@dataclass(frozen=True)
class Atom:
    """A dictionary's rule with its scale and its cost."""

    rule: Rule
    scale: float = 1.0
    cost: float = 1.0


@dataclass(frozen=True)
class SemanticMap:
    """Columns over the basis: the intercept, then each atom; exact."""

    basis: Basis
    columns: tuple[dict[int, Fraction], ...]
    rank: int
    sha256: str

    @property
    def nullity(self) -> int:
        return len(self.columns) - self.rank

    def matrix(self) -> list[list[Fraction]]:
        return [[c.get(i, Fraction(0)) for c in self.columns] for i in range(self.basis.dimension)]

    def dense(self) -> np.ndarray:
        return np.array([[float(x) for x in row] for row in self.matrix()])


def rref(rows: list[list[Fraction]]) -> tuple[list[list[Fraction]], list[int]]:
    """Reduced row echelon form and its pivot columns."""
    a = [list(map(Fraction, r)) for r in rows]
    pivots, r = [], 0
    for c in range(len(a[0]) if a else 0):
        p = next((i for i in range(r, len(a)) if a[i][c]), None)
        if p is None:
            continue
        a[r], a[p] = a[p], a[r]
        lead = a[r][c]
        a[r] = [x / lead for x in a[r]] if lead != 1 else a[r]
        live = [j for j, x in enumerate(a[r]) if x]
        for i in range(len(a)):
            if i != r and (k := a[i][c]):
                row = a[i]
                for j in live:
                    row[j] -= k * a[r][j]
        pivots.append(c)
        r += 1
    return a, pivots


def kernel(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """A basis of the null space, one vector for each column without a pivot."""
    a, pivots = rref(rows)
    n = len(rows[0]) if rows else 0
    out = []
    for free in (j for j in range(n) if j not in set(pivots)):
        v = [Fraction(0)] * n
        v[free] = Fraction(1)
        for i, p in enumerate(pivots):
            v[p] = -a[i][free]
        out.append(v)
    return out


def semantic_map(atoms: Sequence[Atom], basis: Basis) -> SemanticMap:
    if basis.dimension * (len(atoms) + 1) > MAX_CELLS:
        raise ValueError("the dictionary is too large for an exact map")
    columns: list[dict[int, Fraction]] = [{0: Fraction(1)}]
    for a in atoms:
        if not (isfinite(a.scale) and a.scale) or not (isfinite(a.cost) and a.cost > 0):
            raise ValueError("an atom's scale must be finite and not zero, its cost positive")
        columns.append({i: Fraction(a.scale) * k for i, k in expand_rule(a.rule, basis).items()})
    matrix = [[c.get(i, Fraction(0)) for i in range(basis.dimension)] for c in columns]
    rank = len(rref(matrix)[1])
    digest = stable_hash([[[i, str(x)] for i, x in sorted(c.items())] for c in columns])
    return SemanticMap(basis, tuple(columns), rank, digest)


def span_rows(m: SemanticMap) -> list[list[Fraction]]:
    """The reduced rows that span the dictionary's space: one form for all dictionaries of a span."""
    a, pivots = rref([[c.get(i, Fraction(0)) for i in range(m.basis.dimension)] for c in m.columns])
    return a[: len(pivots)]


def feature_arrays(basis: Basis, partitions: Sequence[Partition]) -> list[Column]:
    """The value of each monomial: 1, or a product of memberships."""
    out = []
    for m in basis.monomials:
        x = F.lit(1.0)
        for c in m:
            x = partitions[c.feature].term(c.term) if x is None or not m.index(c) else x * partitions[c.feature].term(c.term)
        out.append(x)
    return out


def decode_canonical(c: Sequence[float], basis: Basis, least: float = 1e-15) -> dict[str, float]:
    return {monomial_text(m): float(x) for m, x in zip(basis.monomials, c, strict=True) if abs(x) > least}


@dataclass(frozen=True)
class Certificate:
    """Whether A g = c exactly. A rejected one has a witness w with w'A = 0 and w'c not 0."""

    status: str
    gamma: tuple[Fraction, ...] | None
    witness: tuple[Fraction, ...] | None
    map_sha256: str
    target_sha256: str


def decode_rref(m: SemanticMap, c: Sequence) -> Certificate:
    """Dictionary weights that say exactly c, free ones 0; floats count as the fractions they are."""
    target = [Fraction(x) for x in c]
    digest = stable_hash(list(map(str, target)))
    if len(target) != m.basis.dimension:
        return Certificate("INVALID", None, None, m.sha256, digest)
    rows = m.matrix()
    a, pivots = rref([r + [t] for r, t in zip(rows, target, strict=True)])
    n = len(m.columns)
    if n in pivots:
        transposed = [[rows[i][j] for i in range(len(rows))] for j in range(n)]
        w = next(v for v in kernel(transposed) if sum(x * t for x, t in zip(v, target, strict=True)))
        return Certificate("REJECTED", None, tuple(w), m.sha256, digest)
    gamma = [Fraction(0)] * n
    for i, p in enumerate(pivots):
        gamma[p] = a[i][n]
    return Certificate("CERTIFIED", tuple(gamma), None, m.sha256, digest)


def verify(cert: Certificate, m: SemanticMap, c: Sequence) -> bool:
    """Recomputes a certificate's claim, hashes included."""
    target = [Fraction(x) for x in c]
    if cert.map_sha256 != m.sha256 or cert.target_sha256 != stable_hash(list(map(str, target))):
        return False
    if cert.status == "CERTIFIED":
        return all(sum(x * g for x, g in zip(row, cert.gamma, strict=True)) == t for row, t in zip(m.matrix(), target, strict=True))
    if cert.status == "REJECTED":
        rows = m.matrix()
        zero = all(sum(w * rows[i][j] for i, w in enumerate(cert.witness)) == 0 for j in range(len(m.columns)))
        return zero and sum(w * t for w, t in zip(cert.witness, target, strict=True)) != 0
    return False


def decode_minimum_l2(m: SemanticMap, c: Sequence[float]) -> tuple[str, np.ndarray | None]:
    """The least weights by Euclidean norm; UNREPRESENTABLE where they miss c, NUMERICAL_ERROR where none are found."""
    c = np.asarray(c, float)
    try:
        gamma = np.linalg.lstsq(m.dense(), c, rcond=None)[0]
    except np.linalg.LinAlgError:
        return "NUMERICAL_ERROR", None
    residual = np.linalg.norm(m.dense() @ gamma - c)
    return ("OK", gamma) if residual <= 1e-8 * (1 + np.linalg.norm(c)) else ("UNREPRESENTABLE", gamma)


def contract_hash(partitions: Sequence[Partition], basis: Basis, selected: Sequence[int], penalties: dict[str, float]) -> str:
    """A hash of what a coefficient vector means: anchors, features and their places, penalties and basis."""
    return stable_hash({"selected": list(selected), "penalties": {k: list(float(v).as_integer_ratio()) for k, v in penalties.items()}, "basis": basis.sha256, "anchors": [[p.feature, *(list((x).as_integer_ratio()) for x in (p.low, p.medium, p.high))] for p in partitions]})


def fractions_to_text(values: Sequence[Fraction]) -> list[str]:
    return [f"{x.numerator}/{x.denominator}" for x in values]


def text_to_fractions(values: Sequence[str]) -> list[Fraction]:
    return [Fraction(*map(int, v.split("/"))) for v in values]


def _simplex(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction] | None:
    """x >= 0 with A x = b, by the first phase with Bland's rule, exact; None if there is none."""
    m, n = len(a), len(a[0]) if a else 0
    rows = [[(-x if t < 0 else x) for x in r] + [Fraction(int(i == j)) for j in range(m)] + [abs(t)] for i, (r, t) in enumerate(zip(a, b, strict=True))]
    basic = list(range(n, n + m))
    cost = [-sum(r[j] for r in rows) if j < n else Fraction(0) for j in range(n + m)] + [-sum(r[-1] for r in rows)]
    while (j := next((j for j in range(n) if cost[j] < 0), None)) is not None:
        ratios = [(r[-1] / r[j], basic[i], i) for i, r in enumerate(rows) if r[j] > 0]
        if not ratios:
            break
        i = min(ratios)[2]
        p = rows[i][j]
        rows[i] = [x / p for x in rows[i]]
        for k, r in enumerate(rows):
            if k != i and r[j]:
                q = r[j]
                rows[k] = [x - q * y for x, y in zip(r, rows[i], strict=True)]
        q = cost[j]
        cost = [x - q * y for x, y in zip(cost, rows[i], strict=True)]
        basic[i] = j
    if cost[-1] != 0:
        return None
    x = [Fraction(0)] * n
    for i, j in enumerate(basic):
        if j < n:
            x[j] = rows[i][-1]
    return x


def hull_equality(first: Sequence[Atom], second: Sequence[Atom], basis: Basis) -> tuple[str, dict]:
    """Whether two dictionaries have one atomic hull, that of 0 and of plus and minus each column over its cost.

    Each generator of either is written as a combination of the other's with weights of at most 1 in all, exactly; one that can't be is named.
    """
    def generators(atoms):
        if any(not (isfinite(x.cost) and x.cost > 0 and isfinite(x.scale) and x.scale) for x in atoms):
            return None
        return [{i: Fraction(x.scale) * k / Fraction(x.cost) for i, k in expand_rule(x.rule, basis).items()} for x in atoms]

    a, b = generators(first), generators(second)
    if a is None or b is None:
        return "INVALID", {"reason": "scales must be finite and not zero, costs positive"}
    proofs = {}
    for side, inner, outer in (("first", a, b), ("second", b, a)):
        for n, g in enumerate(inner):
            rows = [[o.get(i, Fraction(0)) * s for o in outer for s in (1, -1)] + [Fraction(0)] for i in range(basis.dimension)]
            rows.append([Fraction(1)] * (2 * len(outer) + 1))
            x = _simplex(rows, [g.get(i, Fraction(0)) for i in range(basis.dimension)] + [Fraction(1)])
            if x is None:
                return "CERTIFIED_DIFFERENT", {"side": side, "atom": n}
            proofs[f"{side}:{n}"] = fractions_to_text(x)
    return "CERTIFIED_EQUAL", proofs
