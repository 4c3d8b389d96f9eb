import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import ExplainableBoosting
from tessera.operators.estimators import OneVsRest


def rows(n, seed, xor=0.0):
    """Two features that count alone, two that count together by xor, one that doesn't; ties in the second."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = [r.gauss(0, 1), float(r.randrange(6)), r.random(), r.random(), r.random()]
        m = 1.5 * math.sin(2 * x[0]) + 0.5 * (x[1] - 2.5) + xor * (1 if (x[2] > 0.5) != (x[3] > 0.5) else -1)
        out.append((*x, int(r.random() < 1 / (1 + math.exp(-m)))))
    return out


COLS = ["a", "b", "c", "d", "e"]


def frame(spark, data):
    return spark.createDataFrame(data, ", ".join(f"{c} double" for c in COLS) + ", y int").repartition(3)


def plain(data, bins, rounds, rate, leaves, ridge, least, tol):
    """The boosting of single features, row by row."""
    d = len(data[0]) - 1
    cuts = []
    for f in range(d):
        v = sorted(r[f] for r in data)
        at = [i / bins * (len(v) - 1) for i in range(1, bins)]
        cuts.append(sorted({v[int(p)] + (v[min(int(p) + 1, len(v) - 1)] - v[int(p)]) * (p - int(p)) for p in at}))
    number = lambda f, x: sum(x > c for c in cuts[f])
    codes = [[number(f, r[f]) for f in range(d)] for r in data]
    ones = sum(r[-1] for r in data)
    start = math.log(ones / (len(data) - ones))
    shapes, step, best = [[0.0] * (len(c) + 1) for c in cuts], None, math.inf
    for _ in range(rounds + 1):
        trial = shapes if step is None else [[x + rate * z for x, z in zip(s, t)] for s, t in zip(shapes, step)]
        loss, found = 0.0, [[[0.0, 0.0, 0] for _ in s] for s in shapes]
        for code, r in zip(codes, data):
            m = start + sum(trial[f][k] for f, k in enumerate(code))
            p = 1 / (1 + math.exp(-m))
            loss += math.log1p(math.exp(-m if r[-1] else m))
            for f, k in enumerate(code):
                cell = found[f][k]
                cell[0] += r[-1] - p
                cell[1] += p * (1 - p)
                cell[2] += 1
        if loss > best:
            rate /= 2
            continue
        shapes, small = trial, best - loss <= tol * loss
        if small:
            break
        best, step = loss, [grown(cells, leaves, ridge, least) for cells in found]
    return cuts, start, shapes


def grown(cells, leaves, ridge, least):
    total = lambda part: [sum(c[i] for c in part) for i in range(3)]
    worth = lambda part: total(part)[0] ** 2 / (total(part)[1] + ridge)
    pieces = [cells]
    while len(pieces) < leaves:
        options = [
            (worth(p[:c]) + worth(p[c:]) - worth(p), -k, -c)
            for k, p in enumerate(pieces) for c in range(1, len(p))
            if total(p[:c])[2] >= least and total(p[c:])[2] >= least
        ]
        gain, k, c = max(options, default=(0, 0, 0))
        if gain <= 1e-9:
            break
        p = pieces[-k]
        pieces[-k : -k + 1] = [p[:-c], p[-c:]]
    return [total(p)[0] / (total(p)[1] + ridge) for p in pieces for _ in p]


@pytest.mark.parametrize("cells", [1 << 30, 0])
def test_equals_a_plain_version(spark, monkeypatch, cells):
    """Both with rows added up by cell and without."""
    monkeypatch.setattr(boosting, "CELLS", cells)
    data = rows(500, 3)
    model = ExplainableBoosting(bins=8, interactions=0, rounds=12).fit(frame(spark, data), "y", COLS)
    cuts, start, shapes = plain(data, 8, 12, 0.3, 3, 1.0, 2.0, 1e-5)
    assert np.allclose(np.concatenate(model.cuts_), np.concatenate(cuts))
    margins = {tuple(r[c] for c in COLS): r["margin"] for r in model.decision_function(frame(spark, data)).collect()}
    for r in data:
        want = start + sum(shapes[f][sum(x > c for c in cuts[f])] for f, x in enumerate(r[:-1]))
        assert margins[r[:-1]] == pytest.approx(want, abs=1e-7)


def held_out(model, df):
    p = F.col("probability")
    return model.predict_proba(df).agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0]


def test_pairs_find_an_interaction_and_terms_sum_to_the_margin(spark):
    train, test = frame(spark, rows(3000, 1, 1.5)), frame(spark, rows(1500, 2, 1.5))
    alone = ExplainableBoosting(interactions=0, rounds=25).fit(train, "y", COLS)
    paired = ExplainableBoosting(interactions=1, rounds=25, pair_rounds=10).fit(train, "y", COLS)
    assert paired.pairs_ == [(2, 3)]
    assert all(b <= a for a, b in zip(alone.losses_, alone.losses_[1:]))
    assert held_out(paired, test) < held_out(alone, test) - 0.1 < math.log(2) - 0.1
    got = paired.explain(paired.decision_function(test))
    gap = F.abs(F.aggregate("terms", F.lit(float(paired.intercept_)), lambda a, t: a + t["contribution"]) - F.col("margin"))
    assert got.agg(F.max(gap)).first()[0] < 1e-9
    means = paired.explain(train).select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.avg("t.contribution")).collect()
    assert len(means) == 6 and all(abs(r[1]) < 1e-9 for r in means)


def test_weights_count_like_repeated_rows(spark, monkeypatch):
    data = rows(200, 5)
    df = frame(spark, data).withColumn("w", F.when(F.col("b") > 2, 2.0).otherwise(1.0))
    copies = df.unionByName(df.filter("b > 2")).drop("w")
    # Quantiles don't look at weights, so both take the same cuts.
    found = boosting.prepare.exact_quantiles(df, COLS, [0.25, 0.5, 0.75])
    monkeypatch.setattr(boosting.prepare, "exact_quantiles", lambda *_: found)
    model = lambda: ExplainableBoosting(bins=4, interactions=1, rounds=5, pair_rounds=3)
    one, two = model().fit(df, "y", COLS, weight="w"), model().fit(copies, "y", COLS)
    assert one.pairs_ == two.pairs_ and one.intercept_ == pytest.approx(two.intercept_, abs=1e-9)
    assert np.allclose([v for *_, v in one.shape_table()], [v for *_, v in two.shape_table()], atol=1e-9)


def test_defined_results(spark):
    data = [(1.0, None, 1), (2.0, 5.0, 0)]
    schema = "a double, b double, y int"
    with pytest.raises(ValueError, match="missing"):
        ExplainableBoosting().fit(spark.createDataFrame(data, schema), "y")
    with pytest.raises(ValueError, match="two classes"):
        ExplainableBoosting().fit(spark.createDataFrame([], schema), "y")
    with pytest.raises(ValueError, match="learning_rate"):
        ExplainableBoosting(learning_rate=0).fit(spark.createDataFrame(data, schema), "y")
    flat = spark.createDataFrame([(float(i), 7.0, int(i > 5)) for i in range(12)], schema)
    model = ExplainableBoosting(bins=4).fit(flat, "y")
    assert not np.any(np.abs(model.shapes_[1]) > 1e-12)
    assert [r["prediction"] for r in model.predict(flat).orderBy("a").collect()] == [0] * 6 + [1] * 6
    served = model.decision_function(spark.createDataFrame([(None, 7.0, 0), (float("nan"), 7.0, 0), (3.0, 7.0, 0)], schema).withColumn("b_x", F.lit("kept")))
    assert [r["margin"] is None for r in served.collect()] == [True, True, False] and "b_x" in served.columns


def test_several_classes(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), i // 20) for i in range(60)], "a double, b double, y int")
    model = OneVsRest(lambda: ExplainableBoosting(bins=12, interactions=0, rounds=10)).fit(df, "y", ["a", "b"])
    assert model.predict(df).filter("prediction = y").count() >= 56
