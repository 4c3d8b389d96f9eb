import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts, shaken


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnrst"]
    texts, labels = [], []
    for i in range(n):
        t = shaken(rng, words, rng.randint(5, 120)).split()
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["scum", "vequ" + rng.choice(words)])
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng, {})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, rows, y = rng.standard_normal((20, toxicity.INPUT)), rng.integers(0, 20, (5, 6)), np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = net.forward(*net.gates(x), rows)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    z, seen = net.forward(*net.gates(x), rows, keep=True)
    g, places = net.backward(seen, rows, 1 / (1 + np.exp(-z)) - y)
    g |= {"gf": places["f"].sum((0, 1)), "gb": places["b"].sum((0, 1))}
    for k, v in g.items():
        i = np.unravel_index(min(3, v.size - 1), v.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert v[i] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=1e-4), k


def test_windows_cover_all_words():
    for n in (1, 5, 16, 17, 40, 100):
        rows, of = toxicity.window_rows(np.array([n, 0, n]))
        assert set(rows[of == 0].ravel()) == set(range(n)) and set(rows[of == 2].ravel()) == set(range(n, 2 * n))


def test_held_out_accuracy_and_edges(spark):
    texts, y = corpus()
    fitted = toxicity.fit(texts, y)
    new, truth = corpus(200, 2)
    scores = toxicity.Scorer(fitted).score(new)
    assert np.mean((scores >= 0.3) == np.array(truth, bool)) > 0.93
    unseen = toxicity.Scorer(fitted).score(["ban vequdald lorem " * 3, "", None, "..."])
    assert unseen[0] > 0.3 and unseen[1:].tolist() == [0, 0, 0]


def test_query_columns(spark):
    texts, y = corpus(120)
    texts += edge_texts()
    labels = spark.createDataFrame([*((i, 1, v) for i, v in enumerate(y)), (None, 1, 1), (3, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in toxicity.scored(df, toxicity.train(df, labels)).collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert rows[len(y)]["score"] == 0
    none = toxicity.train(df, labels.filter("toxic = 0"))
    kept = toxicity.reject(df, none)
    assert kept.count() == len(texts) and kept.columns == df.columns
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert toxicity.scored(empty, toxicity.train(empty, labels)).count() == 0


def test_long_texts_give_windows_of_their_own_from_all_of_them(spark):
    ws = [f"w{i}" for i in range(30_000)]
    own = {" ".join(ws[s : s + toxicity.WINDOW]) for s in toxicity.starts(len(ws)).tolist()}
    df = spark.createDataFrame([(0, "Short text"), (1, None), (2, " ".join(ws)), (3, "- " * 50_000)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", toxicity.drawn("t")).collect()}
    assert got[0] == ["short text"] and got[1] == got[3] == [""]
    assert len(set(got[2])) == toxicity.DRAWN and set(got[2]) <= own
    # Over texts that differ in one word, each tenth of the text is drawn from about as often.
    places = [int(p.split()[0][1:]) for j in range(20) for p in toxicity.pieces(" ".join([*ws, f"end{j}"]))]
    shares = np.histogram(places, 10, (0, len(ws)))[0] / len(places)
    assert abs(shares - 0.1).max() < 0.025


def test_a_toxic_passage_anywhere_in_a_long_text_is_learnt():
    texts, y = corpus(200)
    rng = random.Random(4)
    calm = [t for t, v in zip(texts, y, strict=True) if not v]
    long, truth = [], []
    for i in range(40):
        body = " ".join(rng.choice(calm) for _ in range(60)).split()
        if i % 2:
            for at in range(0, len(body), 12):
                body[at] = "scum"
        long.append(toxicity.pieces(" ".join(body)))
        truth.append(i % 2)
    assert all(len(p) == toxicity.DRAWN for p in long)
    scores = toxicity.Scorer(toxicity.fit(long + calm, truth + [0] * len(calm))).score(["scum " + calm[0], calm[1]])
    assert scores[0] > 0.3 > scores[1]


def plain_logit(net, vectors):
    """One window's logit by the gates' definitions, a word and a number at a time."""
    p, h = net.p, toxicity.HIDDEN
    squash = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(vectors), 2 * h))
    for name, order, at in (("f", range(len(vectors)), 0), ("b", reversed(range(len(vectors))), h)):
        s, w, g, u = np.zeros(h), p["W" + name].astype(float), p["g" + name].astype(float), p["U" + name].astype(float)
        for i in order:
            x = vectors[i] @ w + g
            z, r = squash(x[:h] + s @ u[:, :h]), squash(x[h : 2 * h] + s @ u[:, h : 2 * h])
            n = np.tanh(x[2 * h :] + r * (s @ u[:, 2 * h :]))
            s = (1 - z) * n + z * s
            states[i, at : at + h] = s
    e = np.array([np.tanh(s @ p["A"] + p["c"]) @ p["v"] for s in states])
    return float((np.exp(e) / np.exp(e).sum()) @ states @ p["o"] + p["b"][0])


def test_scores_are_those_of_plain_windows():
    texts, y = corpus(120)
    fitted = toxicity.fit(texts, y)
    net = fitted.network

    def vector(word):
        parts = toxicity.grams(word)
        out = sum((net.E[net.known[g]] / len(parts) for g in parts if g in net.known), np.zeros(toxicity.INPUT))
        return out + (net.E[net.known["=" + word]] if "=" + word in net.known else 0)

    new = corpus(25, 3)[0] + ["scum " * 3, "one", "Scum! " * 40, "x" * 500]
    got = toxicity.Scorer(fitted).score(new)
    for text, score in zip(new, got, strict=True):
        ws = toxicity.words(text)
        ws = ws if len(ws) >= toxicity.WINDOW else [ws[i % len(ws)] for i in range(toxicity.WINDOW)]
        starts = sorted({*range(0, len(ws) - toxicity.WINDOW, toxicity.STRIDE), len(ws) - toxicity.WINDOW})
        top = max(plain_logit(net, [vector(w) for w in ws[s : s + toxicity.WINDOW]]) for s in starts)
        assert score == pytest.approx(1 / (1 + np.exp(-(fitted.slope * top + fitted.shift))), abs=1e-4)
