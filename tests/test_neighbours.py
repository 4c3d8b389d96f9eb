import math
import random

import numpy as np
import pytest

from tessera.operators import neighbours


def psi(n):
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, int(n)))


def plain(x, y, k):
    """The estimate by its definition, over all pairs."""
    rows = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None and a == a]
    size = {b: sum(d == b for _, d in rows) for _, b in rows}
    rows = [r for r in rows if size[r[1]] > 1]
    if not rows:
        return 0.0
    total = 0.0
    for i, (a, b) in enumerate(rows):
        own = min(k, size[b] - 1)
        r = sorted(abs(a - c) for j, (c, d) in enumerate(rows) if d == b and j != i)[own - 1]
        m = sum(abs(a - c) < r or a == c for c, _ in rows)
        total += psi(own) - psi(size[b]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("cells", [1, 7, 64])
def test_equals_the_definition_over_all_pairs(spark, cells):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        y = rng.choice(["a", "a", "a", "b", "c"])
        # Continuous, tied, mostly one value, of very different sizes, far from zero, and with nulls.
        x = rng.gauss({"a": 0, "b": 1, "c": 3}[y], 1)
        rows.append((y, x, float(rng.randint(0, 6)), 0.0 if rng.random() < 0.7 else x, x * 10 ** rng.randint(-8, 8), 1e6 + round(x, 1), None if i % 9 == 0 else round(x, 2)))
    rows += [("alone", 0.5, 1.0, 0.0, 1.0, 1e6, 1.0), (None, 0.1, 1.0, 0.0, 1.0, 1e6, 1.0), ("two", float("nan"), 1.0, 2.0, 1.0, 1e6, 1.0), ("two", -1.0, 1.0, 0.5, 1.0, 1e6, 1.0)]
    names = ["u", "t", "o", "w", "h", "z"]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in names))
    for c, got in neighbours.knn_mutual_information(df, names, "y", 3, cells):
        at = 1 + names.index(c)
        assert got == pytest.approx(plain([r[at] for r in rows], [r[0] for r in rows], 3), abs=1e-9), c


def test_reach_is_the_last_double_that_is_nearer():
    rng = np.random.default_rng(2)
    x = np.r_[rng.standard_normal(500), -1.0, 0.0, 1e16, -1e-300, 3.0]
    r = np.r_[np.abs(rng.standard_normal(500)) * 10.0 ** rng.integers(-12, 4, 500), 1.0, 5e-324, 2.0, 1e-300, 0.0]
    h = neighbours.reach(x, r)
    some = r > 0
    assert (h[some] - x[some] < r[some]).all() and (np.nextafter(h[some], np.inf) - x[some] >= r[some]).all() and (h[~some] == x[~some]).all()


def test_empty_tables_and_wrong_parameters(spark):
    df = spark.createDataFrame([], "y int, a double")
    assert neighbours.knn_mutual_information(df, ["a"], "y") == [("a", 0.0)]
    with pytest.raises(ValueError):
        neighbours.knn_mutual_information(df, ["a"], "y", 0)
