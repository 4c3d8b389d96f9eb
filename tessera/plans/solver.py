"""Weighted squared-hinge fits with L1 and quadratic penalties, and duals of the L1 hinge programme, by proximal Newton steps over distributed passes.

Minimises 1/2 g'Qg + sum lam |g| + C sum s max(0, 1 - y z'g)^2. Rows stay where they are: a pass sums the loss at some trial points, and the gradient and the
active rows' Gram matrix at the first, within each partition, and only these sums (K x K) reach the driver. Data of at most ``LOCAL_CELLS`` numbers
are fetched once instead, as a job for each pass would cost more than the pass. A fit is accepted by its KKT residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_CELLS = 4_000_000
#: How many sums travel in one row.
CHUNK = 4096
#: What rounding leaves of a row's margin; divided by the width of the corner, of its dual.
ROUNDING = 2.0**-52
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3)


@dataclass
class Solution:
    coef: np.ndarray
    objective: float
    kkt: float
    passes: int
    converged: bool


def _sums(z: np.ndarray, y: np.ndarray, s: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Losses at the points, then gradient and Gram of the active rows at the first, in one flat array."""
    k = z.shape[1]
    slack = np.maximum(0.0, 1 - y[:, None] * (z @ points.T))
    losses = s @ (slack * slack)
    on = slack[:, 0] > 0
    za, w = z[on], s[on]
    grad = -2 * (w * y[on] * slack[on, 0]) @ za
    gram = 2 * (za * w[:, None]).T @ za
    return np.concatenate([losses, grad, gram.ravel()]).reshape(1, len(points) + k + k * k)[0]


def _hinge_sums(z: np.ndarray, y: np.ndarray, s: np.ndarray, points: np.ndarray, mu: float) -> np.ndarray:
    """As _sums, of the hinge with its corner rounded off over a width of mu; then the gradient's part from rows on the corner and the sum of the duals, both at the first point."""
    slack = np.maximum(0.0, 1 - y[:, None] * (z @ points.T))
    losses = s @ np.where(slack < mu, slack * slack / (2 * mu), slack - mu / 2)
    first = slack[:, 0]
    dual = s * np.minimum(first / mu, 1.0)
    grad = -(y * dual) @ z
    bent = (first > 0) & (first < mu)
    zb = z[bent]
    gram = (zb * (s[bent] / mu)[:, None]).T @ zb
    return np.concatenate([losses, grad, gram.ravel(), -(y[bent] * dual[bent]) @ zb, [dual.sum()]])


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of equal length as a matrix."""
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def data_pass(df: DataFrame, k: int, sums: Callable[..., np.ndarray] = _sums, more_sums: int = 0, widen: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[Callable[..., np.ndarray], Callable[[], None]]:
    """A function from trial points (and what else the sums take) to summed losses, gradient and Gram, and one that frees the data. df: z, y, s.

    widen makes the k numbers of rows from z within a task; then rows aren't kept here, as df is cheap to read again (the caller has it kept)."""
    rows = df.select("z", F.col("y").cast("double").alias("y"), F.col("s").cast("double").alias("s"))
    if rows.count() * max(k, 1) <= LOCAL_CELLS:
        data = rows.toPandas()
        z = np.stack(data["z"].to_numpy()) if len(data) else np.zeros((0, k))
        z = widen(z) if widen and len(data) else z
        y, s = data["y"].to_numpy(), data["s"].to_numpy()
        return (lambda points, *more: sums(z, y, s, points, *more)), (lambda: None)
    kept = rows if widen else rows.persist(StorageLevel.MEMORY_AND_DISK)

    def run(points: np.ndarray, *more) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(points) + k + k * k + more_sums)
            for b in batches:
                if b.num_rows:
                    z = _numbers(b, "z")
                    total += sums(widen(z) if widen else z, b.column("y").to_numpy(), b.column("s").to_numpy(), points, *more)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        found = kept.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(len(points) + k + k * k + more_sums)
        out[found.column("i").to_numpy()] = found.column("v").to_numpy()
        return out

    return run, (lambda: None) if widen else kept.unpersist


def _coordinate_descent(h: np.ndarray, g: np.ndarray, x: np.ndarray, lam: np.ndarray, sweeps: int = 500, tol: float = 1e-12) -> np.ndarray:
    """The step d that minimises g'd + 1/2 d'Hd + sum lam |x + d|."""
    d, hd = [0.0] * len(x), np.zeros_like(x)
    each = list(zip(range(len(x)), np.diag(h).tolist(), g.tolist(), x.tolist(), lam.tolist(), strict=True))
    for _ in range(sweeps):
        most = 0.0
        for j, a, gj, xj, lj in each:
            c = xj + d[j]
            new, edge = c - (gj + hd.item(j)) / a, lj / a
            new = new - edge if new > edge else new + edge if new < -edge else 0.0
            move = new - c
            if move:
                d[j] += move
                hd += h[:, j] * move
                most = max(most, abs(move) * a**0.5)
        if most < tol:
            break
    return np.array(d)


def _active_set(h: np.ndarray, g: np.ndarray, x: np.ndarray, lam: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The same step by solving for the numbers that aren't 0: those that change sign leave, the one that violates most enters. Ends early where rounding undoes a round."""
    d, scale = np.zeros(len(x)), 1 / np.sqrt(np.diag(h))
    sign, on = np.sign(x), (x != 0) | (lam == 0)
    for _ in range(rounds):
        for _ in range(rounds):
            if not on.any():
                break
            a = h[np.ix_(on, on)] * np.outer(scale[on], scale[on])
            new = d.copy()
            new[on] = scale[on] * np.linalg.solve(a, -scale[on] * (g[on] + lam[on] * sign[on] + h[np.ix_(on, ~on)] @ d[~on]))
            crossed = on & (lam > 0) & (sign * (x + new) < 0)
            if not crossed.any():
                d = new
                break
            share = np.full(len(x), np.inf)
            share[crossed] = np.clip((x + d)[crossed] / (d - new)[crossed], 0.0, 1.0)
            gone = share <= share.min()
            d = d + share.min() * (new - d)
            d[gone], sign[gone], on[gone] = -x[gone], 0.0, False
        grad = g + h @ d
        over = np.where(on, 0.0, np.abs(grad) - lam)
        j = int(over.argmax())
        if over[j] <= 1e-12 * (np.abs(g).max() + lam.max()):
            break
        on[j], sign[j] = True, -np.sign(grad[j])
    return d


def _thorough_step(h: np.ndarray, g: np.ndarray, x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The better of both: sweeps hardly move where columns depend on each other, and the other way can end early."""
    value = lambda d: g @ d + 0.5 * d @ h @ d + lam @ np.abs(x + d)
    return min(_active_set(h, g, x, lam), _coordinate_descent(h, g, x, lam, sweeps=100), key=value)


def _damped(h: np.ndarray, damping: float) -> np.ndarray:
    return h + damping * max(1.0, np.trace(h) / max(len(h), 1)) * np.eye(len(h))


def kkt_residual(gamma: np.ndarray, grad: np.ndarray, lam: np.ndarray) -> float:
    """The largest violation of the optimality conditions."""
    at_zero = np.maximum(np.abs(grad) - lam, 0.0)
    off = np.abs(grad + lam * np.sign(gamma))
    return float(np.where(gamma == 0, at_zero, off).max()) if len(gamma) else 0.0


def _newton(seen: Callable, *how, **options) -> tuple[np.ndarray, float, float, float]:
    """``_steps`` with what ``seen`` finds at its points."""
    steps = _steps(*how, **options)
    try:
        points = next(steps)
        while True:
            points = steps.send(seen(points))
    except StopIteration as end:
        return end.value


def _steps(gamma: np.ndarray, lam: np.ndarray, tol: float, max_iter: int, thorough: bool = False, least: float = 0.0, other: np.ndarray | None = None):
    """Steps from gamma until the KKT residual is tol of that at the start (or least), or no step goes down: gamma, objective, residual, residual at the start.

    thorough: also shorter steps, each by the better of two ways, and a whole step that halves the residual where rounding hides whether it goes down; other: a start to take instead if it is lower.
    A generator: it yields the points of a pass and is sent their values, and gradient and Hessian at the first."""
    value, grad, h = yield gamma[None] if other is None else np.stack([gamma, other])
    if other is not None and value[1] < value[0] - 1e-10 * abs(value[0]):
        gamma = other
        value, grad, h = yield gamma[None]
    start = max(kkt_residual(gamma, grad, lam), 1e-12)
    residual, value, damping = start, value[0], 1e-10
    for _ in range(max_iter):
        if residual <= max(tol * max(1.0, start), least):
            break
        damped = _damped(h, damping)
        if not lam.any():
            d = np.linalg.solve(damped, -grad)
        else:
            d = (_thorough_step if thorough else _coordinate_descent)(damped, grad, gamma, lam)
        down = grad @ d + np.abs(gamma + d) @ lam - np.abs(gamma) @ lam
        values, new_grad, new_h = yield gamma + np.outer(STEPS, d)
        good = [i for i, t in enumerate(STEPS) if values[i] <= value + 1e-4 * t * down + 1e-14 * abs(value)]
        if thorough and values[0] <= value + 1e-11 * abs(value) and kkt_residual(gamma + d, new_grad, lam) <= residual / 2:
            good = [0]
        if not good:
            # The quadratic holds too far: shorter steps, until none is left.
            if not thorough or damping > 1e4:
                break
            damping *= 100
            continue
        damping = max(1e-10, damping / 10)
        i = good[0]
        gamma = gamma + STEPS[i] * d
        if i:
            values, new_grad, new_h = yield gamma[None]
            i = 0
        value, grad, h = values[i], new_grad, new_h
        residual = kkt_residual(gamma, grad, lam)
    return gamma, float(value), residual, start


def solve(df: DataFrame, k: int, c: float = 1.0, lam: float | Sequence[float] = 0.0, q: np.ndarray | float = 0.0, tol: float = 1e-6, max_iter: int = 100, widen: Callable[[np.ndarray], np.ndarray] | None = None, thorough: bool = False) -> Solution:
    """df: z (array of k numbers, or of those that widen makes them from), y (-1 or 1), s (weight)."""
    lam = np.broadcast_to(np.asarray(lam, float), k).copy()
    q = np.eye(k) * q if np.isscalar(q) else np.asarray(q, float)
    run, free = data_pass(df, k, widen=widen)
    passes = 0

    def seen(points: np.ndarray):
        nonlocal passes
        passes += 1
        out, p = run(points), len(points)
        value = c * out[:p] + 0.5 * np.einsum("pi,ij,pj->p", points, q, points) + np.abs(points) @ lam
        return value, c * out[p : p + k] + q @ points[0], c * out[p + k :].reshape(k, k) + q

    try:
        gamma, value, residual, start = _newton(seen, np.zeros(k), lam, tol, max_iter, thorough=thorough)
    finally:
        free()
    return Solution(gamma, value, residual, passes, residual <= 10 * tol * max(1.0, start))


def _class_sums(z: np.ndarray, of: np.ndarray, s: np.ndarray, asked: Sequence[tuple], upper: tuple) -> list[np.ndarray]:
    """For each asked (class, points, weights of the rest and of the class) what ``_sums`` gives, the class against the rest; of the Gram its upper triangle.

    Most rows are active, so their Gram is that of all rows, which the classes share, less that of the others."""
    slack_of = z @ np.concatenate([points for _, points, *_ in asked]).T
    whole = (z * s[:, None]).T @ z
    out, at = [], 0
    for c, points, wn, wp in asked:
        mine = of == c
        y, w = np.where(mine, 1.0, -1.0), s * np.where(mine, wp, wn)
        slack = np.maximum(0.0, 1 - y[:, None] * slack_of[:, at : at + len(points)])
        at += len(points)
        on = slack[:, 0] > 0
        part = lambda rows, by: (z[rows] * by[rows, None]).T @ z[rows]
        if 2 * on.sum() < len(on):
            gram = part(on, w)
        else:
            gram = wn * (whole - part(~on, s))
            if wp != wn:
                gram += (wp - wn) * part(on & mine, s)
        out.append(np.concatenate([w @ (slack * slack), -2 * (w * y * slack[:, 0]) @ z, 2 * gram[upper]]))
    return out


def solve_classes(df: DataFrame, d: int, widen: Callable[[np.ndarray], np.ndarray], columns: Sequence[Sequence[int]], weights: Sequence[tuple[float, float]], c: float = 1.0, lam: float = 0.0, q: float = 0.0, tol: float = 1e-6, max_iter: int = 100) -> list[Solution]:
    """A fit of each class against the rest, as ``solve`` for each, but all classes move in the same passes.

    df: x (array of d numbers), of (the row's class, an int), s (weight). widen makes the k terms of rows from x within a task, so that no row is kept with its terms; columns: the terms of each class; weights: those of the
    rest and of the class, by class."""
    k = widen(np.zeros((1, d))).shape[1]
    upper = np.triu_indices(k)
    rows = df.select("x", F.col("of").cast("int").alias("of"), F.col("s").cast("double").alias("s"))
    numbers = lambda b: (b.column("x").combine_chunks() if hasattr(b, "to_batches") else b.column("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    taken = lambda b, asked: _class_sums(widen(numbers(b)), b.column("of").to_numpy(), b.column("s").to_numpy(), asked, upper)
    kept = None
    if rows.count() * k <= LOCAL_CELLS:
        data = rows.toArrow()
        run = lambda asked: taken(data, asked)
    else:
        kept = rows.persist(StorageLevel.DISK_ONLY)

        def run(asked):
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for b in batches:
                    if b.num_rows:
                        sums = _whole_batch(b)
                        total = sums if total is None else [x + y for x, y in zip(total, sums, strict=True)]
                for i, v in enumerate(total or []):
                    for at in range(0, len(v), CHUNK):
                        x = pa.array(v[at : at + CHUNK])
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)], names=["i", "at", "v"])

            def _whole_batch(b: pa.RecordBatch) -> list[np.ndarray]:
                sums = None
                for at in range(0, b.num_rows, 4096):  # the terms of so many rows at once
                    found = taken(b.slice(at, 4096), asked)
                    sums = found if sums is None else [x + y for x, y in zip(sums, found, strict=True)]
                return sums

            def added(group: pa.Table) -> pa.Table:
                v = group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
                return pa.table({"i": group.column("i")[:1], "at": group.column("at")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

            # Summed by chunk on the executors: the sums come back once.
            found = kept.mapInArrow(part, "i int, at int, v array<double>").groupBy("i", "at").applyInArrow(added, "i int, at int, v array<double>").toArrow()
            out = [np.zeros(len(points) + k + len(upper[0])) for _, points, *_ in asked]
            for i, at, v in zip(found.column("i").to_pylist(), found.column("at").to_pylist(), found.column("v"), strict=True):
                out[i][at : at + CHUNK] = v.values.to_numpy()
            return out

    lams = [np.full(len(x), float(lam)) for x in columns]
    fits = [_steps(np.zeros(len(x)), each, tol, max_iter) for x, each in zip(columns, lams, strict=True)]
    asked, passes, out = {n: next(f) for n, f in enumerate(fits)}, [0] * len(fits), [None] * len(fits)
    try:
        while asked:
            spread = {n: np.zeros((len(points), k)) for n, points in asked.items()}
            for n, points in asked.items():
                spread[n][:, columns[n]] = points
            sums, before, asked = run([(n, spread[n], *weights[n]) for n in spread]), asked, {}
            for (n, points), x in zip(before.items(), sums, strict=True):
                p, cols = len(points), np.array(columns[n])
                gram = np.zeros((k, k))
                gram[upper] = x[p + k :]
                gram = (gram + np.triu(gram, 1).T)[np.ix_(cols, cols)]
                passes[n] += 1
                value = c * x[:p] + 0.5 * q * (points**2).sum(1) + np.abs(points) @ lams[n]
                try:
                    asked[n] = fits[n].send((value, c * x[p : p + k][cols] + q * points[0], c * gram + q * np.eye(len(cols))))
                except StopIteration as end:
                    gamma, objective, residual, start = end.value
                    out[n] = Solution(gamma, objective, residual, passes[n], residual <= 10 * tol * max(1.0, start))
    finally:
        if kept is not None:
            kept.unpersist()
    return out


@dataclass
class HingeDual:
    """A solution of min sum |g| (but for the last) + sum s max(0, 1 - y z'g) with the width that its duals are read off at."""

    coef: np.ndarray
    mu: float
    primal: float
    dual: float
    infeasible: float  # how far |z' (a y)| exceeds 1, or |sum a y| exceeds 0
    passes: int

    @property
    def gap(self) -> float:
        return (self.primal - self.dual) / max(1.0, abs(self.primal))

    def of_row(self, slack):
        """The dual of a row with a slack max(0, 1 - y z'g), as a share of its weight; slack: a Column."""
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), slack / self.mu))


def hinge_duals(df: DataFrame, k: int, mu: float = 1e-6, max_iter: int = 60, widen: Callable[[np.ndarray], np.ndarray] | None = None) -> HingeDual:
    """df: z (array of k numbers, the last the constant 1, which isn't penalised, or of those that widen makes them from), y (-1 or 1), s (weight).

    The hinge's corner is rounded off over a width that falls from 4 to mu. A row's dual at the optimum is its weight times slack / width, at most 1, so it stays with the row as an expression of its margin, and at every width
    the duals are those of a nearby programme: their sum is at most mu / 2 times the sum of weights below the optimum. Each fit starts from where the optimum goes if the rows on the corner stay the same; the width falls
    fourfold, and by ever more while that start is the optimum."""
    lam = np.r_[np.ones(k - 1), 0.0]
    run, free = data_pass(df, k, _hinge_sums, 1 + k, widen)
    passes, gamma, other, width, factor = 0, np.zeros(k), None, 4.0, 4.0
    at: dict[bytes, tuple] = {}

    def seen(points: np.ndarray):
        nonlocal passes
        passes += 1
        out, p = run(points, width), len(points)
        grad, h = out[p : p + k], out[p + k : p + k + k * k].reshape(k, k)
        at[points[0].tobytes()] = grad, h, out[-1 - k : -1], out[-1]
        return out[:p] + np.abs(points) @ lam, grad, h

    try:
        total = run(gamma[None], 1e-12)[0]  # of the weights
        while True:
            at.clear()
            before, last = passes, width <= mu * 1.5
            gamma, *_ = _newton(seen, gamma, lam, 0.0, max_iter, thorough=True, least=max(1e-9, (ROUNDING / width if last else 1e-7) * total), other=other)
            grad, h, bent, dual = at[gamma.tobytes()]
            if last:
                break
            factor = 4 * factor if passes == before + 1 else 4.0
            new = max(width / factor, mu)
            ratio, other = width / new, gamma
            gamma = gamma + _thorough_step(_damped(ratio * h, 1e-10), grad + (ratio - 1) * bent, gamma, lam)
            width = new
        primal = run(gamma[None], 1e-12)[0] + np.abs(gamma) @ lam
        infeasible = max(float(np.max(np.abs(grad[:-1]), initial=0.0)) - 1.0, abs(float(grad[-1])), 0.0)
    finally:
        free()
    return HingeDual(gamma, width, float(primal), float(dual), infeasible, passes)
