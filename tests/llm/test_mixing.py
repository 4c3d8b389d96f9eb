import math
import random

import pytest

from tessera.llm import mixing
from tests.llm.helpers import DOC_SCHEMA, documents


def corpus(spark):
    texts = ["word " * 50] * 120 + ["word " * 50] * 30 + ["word " * 50] * 6 + [None, "", "one"]
    return documents(spark, texts, ["big"] * 120 + ["mid"] * 30 + ["small"] * 6 + [None, None, "small"])


def test_tokens(spark):
    df = spark.createDataFrame([(" a\tb\nc  d",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(mixing.tokens(df["t"])).collect()] == [4, 0, 0, 1]


def exponents(shares, good):
    return [a / 10_000 for a in range(10_001) if good([p ** (a / 10_000) for p in shares], a / 10_000)]


def test_exponent_meets_its_limits(spark):
    t = [600, 300, 90, 10]
    p = [x / 1000 for x in t]
    df = spark.createDataFrame([(x,) for x in t], "tokens long")

    def entropy(w, _):
        z = sum(w)
        return -sum(x / z * math.log(x / z) for x in w)

    a = mixing.exponent(df, None, 1.2)
    assert a == pytest.approx(max(exponents(p, lambda w, e: entropy(w, e) >= 1.2)), abs=2e-4)
    r = mixing.exponent(df, 3.0)
    assert r == pytest.approx(min(exponents(p, lambda w, e: max(x / q for x, q in zip(w, p)) / min(x / q for x, q in zip(w, p)) <= 3)), abs=2e-4)
    assert mixing.exponent(df, 1e9) == 0 and mixing.exponent(df, None, 0.1) == 1 and mixing.exponent(df, None, 9.0) == 0


def test_each_row_is_visited_and_weights_are_met(spark):
    df = corpus(spark)
    rows = mixing.stream(df, repeats=4.0, block_tokens=100).collect()
    assert {r["doc_id"] for r in rows} == set(range(159))
    weight, got, total = {}, {}, sum(r["n_tokens"] for r in rows)
    for r in rows:
        weight[r["source"]] = r["weight"]
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"]
    assert sum(weight.values()) == pytest.approx(1)
    for s, w in weight.items():
        assert got[s] / total == pytest.approx(w, abs=0.03)
    half = [r for r in rows if r["place"] < 0.5]
    for s, w in weight.items():
        assert sum(r["n_tokens"] for r in half if r["source"] == s) / sum(r["n_tokens"] for r in half) == pytest.approx(w, abs=0.1)
    times = {}
    for r in rows:
        times.setdefault((r["doc_id"], r["source"]), set()).add(r["epoch"])
    assert max(map(len, times.values())) <= 5


def test_mix_repeats_rows(spark):
    df = corpus(spark)
    mixed = mixing.mix(df, repeats=4.0, block_tokens=100)
    assert mixed.columns == df.columns and mixed.select("doc_id").distinct().count() == 159 and mixed.count() > 159
    budget = mixing.mix(df, repeats=None, budget=3000, block_tokens=100)
    assert 0 < budget.count() < 159
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert mixing.stream(empty).count() == 0 == mixing.mix(empty).count()


def test_places_are_running_sums_within_a_source_and_epoch(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 3 == 0], e, i, rng.randrange(-(1 << 63), 1 << 63), rng.randint(0, 9)) for e in (0, 1) for i in range(500)] + [(None, 0, 1, 5, 3)]
    df = spark.createDataFrame(rows, "source string, epoch int, block long, order long, size long")
    got = {(r["source"], r["epoch"], r["block"]): r["before"] for r in mixing.preceded(df).collect()}
    own = {}
    for s in ("a", "b", None):
        for e in (0, 1):
            total = 0
            for x in sorted((x for x in rows if x[0] == s and x[1] == e), key=lambda x: (x[3], x[2])):
                own[s, e, x[2]], total = total, total + x[4]
    assert got == own
