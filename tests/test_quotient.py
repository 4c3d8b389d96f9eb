from fractions import Fraction
from itertools import product

import pytest

from tessera.functions.rules import Condition, Rule
from tessera.plans import quotient as qt


def rule(*terms):
    return Rule(tuple(Condition(i, t) for i, t in enumerate(terms)))


@pytest.mark.parametrize(("d", "r", "n"), [(2, 1, 5), (2, 2, 9), (3, 1, 7), (3, 2, 19), (0, 2, 1), (8, 2, 129)])
def test_dimensions(d, r, n):
    assert qt.canonical_dimension(d, r) == n == qt.canonical_basis(d, r).dimension


def test_expansion_agrees_with_values():
    basis = qt.canonical_basis(2, 2)
    for a, b in product(("low", "medium", "high"), repeat=2):
        for low, high in ((Fraction(1, 3), Fraction(1, 5)), (Fraction(0), Fraction(2, 7))):
            of = {"low": low, "high": high, "medium": 1 - low - high}
            total = sum(k * _value(basis.monomials[i], of) for i, k in qt.expand_rule(rule(a, b), basis).items())
            assert total == of[a] * of[b]


def _value(m, of):
    out = Fraction(1)
    for c in m:
        out *= of[c.term]
    return out


def test_rejected_expansions():
    basis = qt.canonical_basis(2, 1)
    for bad in (rule("low", "low"), Rule((Condition(5, "low"),)), Rule((Condition(0, "tall"),))):
        with pytest.raises(ValueError):
            qt.expand_rule(bad, basis)


def test_rank_kernel_and_span():
    basis = qt.canonical_basis(1, 1)
    atoms = [qt.Atom(rule(t)) for t in ("low", "medium", "high")]
    m = qt.semantic_map(atoms, basis)
    assert (m.rank, m.nullity) == (3, 1)
    (v,) = qt.kernel(m.matrix())
    assert all(sum(x * y for x, y in zip(row, v, strict=True)) == 0 for row in m.matrix())
    assert qt.span_rows(m) == qt.span_rows(qt.semantic_map(atoms[::-1], basis))
    with pytest.raises(ValueError):
        qt.semantic_map([qt.Atom(rule("low"), scale=0)], basis)


def test_certificates_are_recomputed():
    basis = qt.canonical_basis(1, 1)
    m = qt.semantic_map([qt.Atom(rule("low"))], basis)
    good, bad = qt.decode_rref(m, [1, 2, 0]), qt.decode_rref(m, [0, 0, 1])
    assert good.status == "CERTIFIED" and qt.verify(good, m, [1, 2, 0]) and not qt.verify(good, m, [1, 3, 0])
    assert bad.status == "REJECTED" and qt.verify(bad, m, [0, 0, 1])
    assert qt.text_to_fractions(qt.fractions_to_text([Fraction(1, 3)])) == [Fraction(1, 3)]


def test_hulls():
    basis = qt.canonical_basis(2, 1)
    a = [qt.Atom(Rule((Condition(f, t),))) for f in (0, 1) for t in ("low", "high")]
    assert qt.hull_equality(a, a[::-1], basis)[0] == "CERTIFIED_EQUAL"
    assert qt.hull_equality(a, [*a, qt.Atom(a[0].rule, 1, 2)], basis)[0] == "CERTIFIED_EQUAL"
    assert qt.hull_equality(a, a[:3], basis)[0] == "CERTIFIED_DIFFERENT"
    assert qt.hull_equality(a, [qt.Atom(a[0].rule, 1, 0)], basis)[0] == "INVALID"
