"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy.

A word's input is the sum of an embedding of the word and the mean of embeddings of its character n-grams (starts, ends and all of
four), so that unseen forms of a stem are read by their letters. Words and n-grams in fewer than ``LEAST_DOCS`` training texts have none. Every text is scored in all windows of ``WINDOW`` words that start
each ``STRIDE`` words, which overlap by half; the largest window decides, and is calibrated to a probability.

Training is bounded: at most ``SAMPLE`` labelled rows, a text of more than ``DRAWN`` windows by so many of them, drawn from all of it by a hash of the text; a third of them toxic if there are so many, chosen by hash of the id. Labels hold for
documents, so windows are chosen in rounds: first any of a document, then those that the network itself finds worst.

Defined results: a null or empty text, or one without words, scores 0; texts under a window are repeated to fill it; repeated
rows get equal scores; without labels of both kinds all scores are the share of toxic labels (0 without any); of repeated labels the largest
counts, null labels and ids teach nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.llm.common import table

WINDOW, STRIDE, SAMPLE, DRAWN = 16, 8, 2400, 200
LEAST_DOCS, INPUT, HIDDEN, ATTENTION = 4, 12, 8, 8
FOLDS, HELD_OUT, REJECT, CACHED, LEAST_STEPS, TOGETHER, SEED = 4, 2, 0.3, 150_000, 60, 2_000_000, 11
_WORD = re.compile(r"\w{1,40}")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str) -> set[str]:
    """The character n-grams of a word between ^ and $: its start of 2 to 5 letters, its end of 3 and 4, and all of four."""
    edged = f"^{word}$"
    return {edged[:k] for k in (3, 4, 5, 6)} | {edged[-k:] for k in (4, 5)} | {edged[i : i + 4] for i in range(1, len(edged) - 4)}


def starts(n: int) -> np.ndarray:
    """The first words of all windows over n words; the last one ends with the text."""
    return np.array([0]) if n <= WINDOW else np.unique(np.r_[0 : n - WINDOW : STRIDE, n - WINDOW])


def window_rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words lie end to end: (windows, WINDOW) word places, and each window's text."""
    rows, of, at = [], [], 0
    step = np.arange(WINDOW)
    for i, n in enumerate(lengths.tolist()):
        if n:
            s = starts(n)
            rows.append(at + ((s[:, None] + step) if n >= WINDOW else (step % n)[None, :]))
            of.append(np.full(len(s), i))
        at += n
    if not rows:
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(of)


class Network:
    """Weights and passes. Gates are ordered update, reset, candidate; the halves of the state are read forwards and backwards."""

    def __init__(self, rng: np.random.Generator, known: dict[str, int]):
        h, d = HIDDEN, INPUT
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"A": draw(2 * h, ATTENTION), "c": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION), "o": draw(2 * h), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {"W" + k: draw(d, 3 * h), "g" + k: np.zeros(3 * h, np.float32), "U" + k: draw(h, 3 * h)}
        self.known = known
        self.E = (0.01 * rng.standard_normal((len(known), d))).astype(np.float32)

    def table(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows, weights and the place of each word's first row, with an end. A word's own row comes last and weighs 1."""
        get, flat, ends, shares, own = self.known.get, [], [], [], []
        for w in words_:
            parts = grams(w)
            flat += [i for i in map(get, parts) if i is not None]
            if (i := get("=" + w)) is not None:
                own.append(len(flat))
                flat.append(i)
            ends.append(len(flat))
            shares.append(len(parts))
        places = np.r_[0, np.array(ends, np.int64)]
        weights = np.repeat(1 / np.array(shares, np.float32), np.diff(places)) if shares else np.zeros(0, np.float32)
        weights[own] = 1
        return np.array(flat, np.int64), weights, places

    def inputs(self, flat: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, INPUT): the weighted sum of each word's rows."""
        sums = np.zeros((len(flat) + 1, INPUT), np.float64)
        np.cumsum(self.E[flat] * weights[:, None], axis=0, out=sums[1:])
        return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.float32)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["gf"], x @ self.p["Wb"] + self.p["gb"]

    @staticmethod
    def _step(g: np.ndarray, h: np.ndarray, u: np.ndarray):
        k = HIDDEN
        hu = h @ u
        zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * k] + hu[:, : 2 * k])) + 0.5
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(g[:, 2 * k :] + r * hu[:, 2 * k :])
        return n + z * (h - n), z, r, hu[:, 2 * k :], n

    def forward(self, gf: np.ndarray, gb: np.ndarray, rows: np.ndarray, keep: bool = False):
        """The logit of each window (rows: windows by words)."""
        t, b, k = rows.shape[1], len(rows), HIDDEN
        states, kept = np.empty((t, b, 2 * k), np.float32), {}
        for name, g, order, at in (("f", gf, range(t), slice(0, k)), ("b", gb, range(t - 1, -1, -1), slice(k, 2 * k))):
            h = np.zeros((b, k), np.float32)
            for i in order:
                before = h
                h, *rest = self._step(g[rows[:, i]], h, self.p["U" + name])
                states[i, :, at] = h
                if keep:
                    kept[name, i] = (before, *rest)
        a = np.tanh(states @ self.p["A"] + self.p["c"])
        e = a @ self.p["v"]
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbk->bk", w, states)
        logit = pooled @ self.p["o"] + self.p["b"][0]
        return (logit, (states, kept, a, w, pooled)) if keep else logit

    def backward(self, seen, rows: np.ndarray, dlogit: np.ndarray):
        """Gradients of the weights, and of the gates' inputs by place (windows, words, 3 * HIDDEN) and direction."""
        states, kept, a, w, pooled = seen
        k, p, g = HIDDEN, self.p, {}
        g["o"], g["b"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["o"]
        dw = np.einsum("bk,tbk->tb", dpool, states)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["v"] = np.einsum("tb,tbk->k", de, a)
        g["A"], g["c"] = np.einsum("tbi,tbj->ij", states, da), da.sum((0, 1))
        dstates = w[:, :, None] * dpool + da @ p["A"].T
        places = {}
        for name, order, at in (("f", range(len(states) - 1, -1, -1), slice(0, k)), ("b", range(len(states)), slice(k, 2 * k))):
            u = p["U" + name]
            du, dh = np.zeros_like(u), np.zeros((len(rows), k), np.float32)
            out = np.empty((len(rows), len(states), 3 * k), np.float32)
            for i in order:
                before, z, r, hn, n = kept[name, i]
                d = dh + dstates[i, :, at]
                dn = d * (1 - z) * (1 - n * n)
                dz, dr = d * (before - n) * z * (1 - z), dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ dhu
                dh = d * z + dhu @ u.T
                out[:, i] = np.concatenate([dz, dr, dn], 1)
            g["U" + name], places[name] = du, out
        return g, places


class _Fitted:
    """What scoring needs: the network, the calibration, and the share of toxic labels."""

    def __init__(self, network: Network | None, slope: float, shift: float, share: float):
        self.network, self.slope, self.shift, self.share = network, slope, shift, share


def pieces(text: str | None) -> list[str]:
    """A text's words as one piece, or, of a text with more than ``DRAWN`` windows, so many of its own windows: any of them may be drawn, and which ones depends on the text alone."""
    found = words(text or "")
    at = starts(len(found))
    if len(at) <= DRAWN:
        return [" ".join(found)]
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    return [" ".join(found[s : s + WINDOW]) for s in np.sort(rng.choice(at, DRAWN, replace=False)).tolist()]


def fit(texts: list[str | list[str]], labels: list[int], seed: int = SEED) -> _Fitted:
    """The classifier from labelled texts, each whole or as pieces; no window reaches over two pieces. A fifth of the texts only calibrates it."""
    share = float(np.mean(labels)) if labels else 0.0
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return _Fitted(None, 1.0, 0.0, share)
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    parts = [[t] if isinstance(t, str) else t for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    each = [np.array([known.setdefault(w, len(known)) for w in words(t)], np.int64) for t in chain.from_iterable(parts)]
    lengths = np.array([len(e) for e in each])
    if not lengths.any():
        return _Fitted(None, 1.0, 0.0, share)
    places, of = window_rows(lengths)
    of, ids = owner[of], np.concatenate(each)[places]
    flat = np.split(np.concatenate(each), np.cumsum(np.bincount(owner, lengths, len(texts)).astype(np.int64))[:-1])
    calibrates = rng.random(len(y)) < 0.2
    learns = ~calibrates[of]
    listed = list(known)
    # What a sketch of 2^22 counts finds in too few texts isn't counted: most n-grams are in one text.
    sketch, in_docs, in_toxic = np.zeros(1 << 22, np.uint16), Counter(), Counter()
    for counts in (False, True):
        for i, f in enumerate(flat):
            if calibrates[i]:
                continue
            own = {listed[j] for j in f.tolist()}
            found = {"=" + w for w in own}
            found.update(chain.from_iterable(map(grams, own)))
            if not counts:
                sketch[list({zlib.crc32(g.encode()) & 0x3FFFFF for g in found})] += 1
                continue
            found = [g for g in found if sketch[zlib.crc32(g.encode()) & 0x3FFFFF] >= LEAST_DOCS]
            in_docs.update(found)
            in_toxic.update(found if y[i] > 0 else ())
    del sketch
    net = Network(rng, {g: i for i, g in enumerate(sorted(g for g, n in in_docs.items() if n >= LEAST_DOCS))})
    # The first dimension starts from how much more often toxic texts have the word or n-gram: few labels then suffice.
    toxic, clean = y[~calibrates].sum(), (1 - y[~calibrates]).sum()
    for g, i in net.known.items():
        odds = np.log((in_toxic[g] + 0.5) / (toxic + 1)) - np.log((in_docs[g] - in_toxic[g] + 0.5) / (clean + 1))
        net.E[i, 0] += 0.5 * np.clip(odds, -4, 4)
    flat_rows, weights, ends = net.table(listed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares = np.full((len(net.known), 1), 1e-3, np.float32)
    steps = 0

    def learn(chosen: np.ndarray, epochs: int) -> None:
        nonlocal steps
        truth = y[of[chosen]]
        weight = np.where(truth > 0, 0.5 / max(truth.mean(), 1e-6), 0.5 / max(1 - truth.mean(), 1e-6)).astype(np.float32)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(chosen)), max(min(LEAST_STEPS, len(chosen) // 8 + 1), len(chosen) // 256)):
                used, local = np.unique(ids[chosen[batch]], return_inverse=True)
                local = local.reshape(len(batch), WINDOW)
                n_used = ends[used + 1] - ends[used]
                mine = np.repeat(ends[used] - np.r_[0, np.cumsum(n_used)[:-1]], n_used) + np.arange(n_used.sum())
                x = net.inputs(flat_rows[mine], weights[mine], np.r_[0, np.cumsum(n_used)])
                gf, gb = net.gates(x)
                logit, seen = net.forward(gf, gb, local, keep=True)
                d = weight[batch] * (1 / (1 + np.exp(-logit)) - truth[batch]) / len(batch)
                g, at = net.backward(seen, local, d.astype(np.float32))
                dx = np.zeros_like(x)
                for k in "fb":
                    by_word = np.stack([np.bincount(local.ravel(), at[k][:, :, j].ravel(), len(used)) for j in range(3 * HIDDEN)], 1).astype(np.float32)
                    g["W" + k], g["g" + k] = x.T @ by_word, by_word.sum(0)
                    dx += by_word @ net.p["W" + k].T
                steps += 1
                for k, v in g.items():
                    m, s = moments[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    net.p[k] -= 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)
                touched, back = np.unique(flat_rows[mine], return_inverse=True)
                to_rows = np.repeat(dx, n_used, axis=0) * weights[mine][:, None]
                grad = np.stack([np.bincount(back, to_rows[:, j], len(touched)) for j in range(INPUT)], 1).astype(np.float32)
                grad += 1e-5 * net.E[touched]
                squares[touched] += (grad * grad).mean(1, keepdims=True)
                net.E[touched] -= 0.1 * grad / np.sqrt(squares[touched])

    def logits() -> np.ndarray:
        cuts = [*range(0, len(listed), 20_000), len(listed)]
        parts = [net.gates(net.inputs(flat_rows[ends[a] : ends[b]], weights[ends[a] : ends[b]], ends[a : b + 1] - ends[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        gf, gb = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.concatenate([net.forward(gf, gb, part) for part in np.array_split(ids, max(1, len(ids) // 8192))])

    def worst(score: np.ndarray, most: int) -> np.ndarray:
        """The places of the ``most`` largest scores of each document."""
        order = np.lexsort((-score, of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        return order[rank < most]

    learn(np.array([i for i in worst(rng.random(len(of)), 8) if learns[i]]), 2)
    for most in (4, 2, 1):
        score = logits()
        hard = worst(score, most)
        spread = worst(rng.random(len(of)), 3)
        chosen = np.unique(np.r_[hard, spread[y[of[spread]] == 0]])
        learn(chosen[learns[chosen]], 3)
    score = logits()
    top = np.full(len(y), -1e9)
    np.maximum.at(top, of, score)
    seen = calibrates & (top > -1e8)
    if len(set(y[seen].tolist())) < 2:
        seen = top > -1e8
    slope, shift = _platt(top[seen], y[seen])
    return _Fitted(net, slope, shift, share)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps; the targets are drawn in a little, as for few rows."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, scale = z.mean(), z.std() + 1e-6
    u, w = (z - centre) / scale, np.zeros(2)
    x = np.stack([u, np.ones_like(u)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1, 2 / (np.abs(step).max() + 1e-9))
    slope = max(w[0], 1e-3) / scale
    return float(slope), float(w[1] - slope * centre)


class _Places(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores texts; the gates of words that were seen are kept until there are ``CACHED`` of them."""

    def __init__(self, fitted: _Fitted):
        self.fitted, self.known = fitted, _Places()
        self.gates = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The scores of texts, which are taken some ``TOGETHER`` characters at a time."""
        size = np.cumsum([len(t or "") for t in texts])
        cuts = np.r_[0, np.flatnonzero(np.diff(size // TOGETHER)) + 1, len(texts)]
        return np.concatenate([self._score(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a] or [np.zeros(0)])

    def _score(self, texts: list[str | None]) -> np.ndarray:
        lists = [words(t or "") for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        out, fitted = np.zeros(len(texts)), self.fitted
        if fitted.network is None:
            out[lengths > 0] = fitted.share
            return out
        if len(self.known) > CACHED:
            self.known, self.gates = _Places(), [g[:0] for g in self.gates]
        known, old = self.known, len(self.known)
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
        if len(known) > old:
            new = list(known)[old:]
            for at in range(0, len(new), 20_000):
                made = fitted.network.gates(fitted.network.inputs(*fitted.network.table(new[at : at + 20_000])))
                self.gates = [np.concatenate([g, m]) for g, m in zip(self.gates, made, strict=True)]
        top, at = np.full(len(texts), -np.inf), 0
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()) + 1, 40_000))
        for a, b in zip(np.r_[0, np.unique(cuts)], np.r_[np.unique(cuts), len(texts)], strict=True):
            rows, of = window_rows(lengths[a:b])
            rows += at
            for part in range(0, len(rows), 4096):
                piece = slice(part, part + 4096)
                np.maximum.at(top, a + of[piece], fitted.network.forward(*self.gates, ids[rows[piece]]))
            at += int(lengths[a:b].sum())
        has = lengths > 0
        out[has] = 1 / (1 + np.exp(-np.clip(fitted.slope * top[has] + fitted.shift, -50, 50)))
        return out


_SCORERS: dict[int, Scorer] = {}


def score_column(spark, fitted: _Fitted, text: Column) -> Column:
    """The score of a text column; the weights are broadcast, some 3 MB at any size of the table."""
    shared = spark.sparkContext.broadcast(pickle.dumps(fitted))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = zlib.crc32(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(pickle.loads(shared.value))
        for part in parts:
            yield pd.Series(_SCORERS[key].score(part.tolist()), dtype="float64")

    return scored(text)


def held_out(id_: Column) -> Column:
    """Whether the CRC-32 of the id, as text, leaves the remainder whose labels nothing learns from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def drawn(text: pd.Series) -> pd.Series:
    """pieces() of each text."""
    return text.map(pieces, na_action=None)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> _Fitted:
    """Fits on a bounded sample of the labelled rows that aren't held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    order = F.xxhash64(F.lit(SEED), "_i")
    chosen = None
    for y in (1, 0):
        # More ids than rows are wanted, for ids without a document; at most 2 * sample rows, so they may be broadcast.
        some = known.filter(F.col("_y") == y).orderBy(order, "_i").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    rows = short.join(F.broadcast(chosen), short["_id"] == chosen["_i"]).select("_i", drawn("_t").alias("_w"), "_y", order.alias("_o"))
    half = None
    for y, most in ((1, sample // 3), (0, sample - sample // 3)):
        some = rows.filter(F.col("_y") == y).orderBy("_o", "_i", "_w").limit(most)
        half = some if half is None else half.union(some)
    found = half.collect()  # sample rows at most
    return fit([r["_w"] for r in found], [r["_y"] for r in found])


def scored(docs: DataFrame, fitted: _Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    score = score_column(docs.sparkSession, fitted, F.col(text_col))
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def reject(docs: DataFrame, fitted: _Fitted, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches ``REJECT``."""
    rows = docs.withColumn("__toxicity", score_column(docs.sparkSession, fitted, F.col(text_col)))
    return rows.filter(F.col("__toxicity") < REJECT).select(*[docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
