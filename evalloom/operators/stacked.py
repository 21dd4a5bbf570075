"""Any number of wide logistic heads fitted together by gradients alone.

Rows are packed once into blocks of plain numbers that stay cached. A step is one pass over them: a task multiplies its
blocks with the stacked coefficients of all heads (scaling, centring and projection are folded into those, so no scaled or reduced copy of
the rows is made), and returns one loss and one gradient per head; those are summed on the executors. The driver keeps the
last few steps of each head (limited-memory BFGS) and moves every head at once, so the number of passes is that of the slowest head. What the
driver holds grows with heads x width x ``HISTORY``, never with rows or with the square of the width.

Principal axes come from the same blocks: a random block of directions is multiplied with the scaled rows and back,
orthogonalised against all blocks before, and so on (block Lanczos); small eigenproblems give the axes. No width x width matrix exists.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .blocks import NO_FOLD, Slot, block_sums
from .checks import ContractError

HISTORY = 10
MAX_PASSES = 400
GRADIENT_TOLERANCE = 1e-8
OVERSAMPLE, AXIS_ROUNDS, AXIS_TOLERANCE = 10, 24, 1e-10

Scaler = tuple[np.ndarray, np.ndarray]  # mean and population deviation, 0 as 1
Facts = tuple[np.ndarray, list[Scaler], np.ndarray]  # per scaler: rows, scaling, columns that vary


def _used(fold: np.ndarray, w: np.ndarray, plan: Sequence[tuple[list[int], int | None]]) -> np.ndarray:
    """One column per scaler: rows with a usable label outside its excluded fold."""
    return np.stack([(w[:, c] > 0).any(axis=1) & (fold != (NO_FOLD if e is None else e)) for c, e in plan], axis=1).astype(float)


def scaler_facts(blocks: DataFrame, scalers: Sequence[tuple[Sequence[int], int | None]]) -> Facts:
    """Row counts, means and population deviations (0 as 1) and the number of varying columns per scaler, in two passes."""
    plan = [(list(columns), exclude) for columns, exclude in scalers]

    def first(x, fold, y, w):
        u = _used(fold, w, plan)
        return np.column_stack([u.sum(0), u.T @ x])

    sums = block_sums(blocks, first)
    n = sums[:, 0]
    if not (n > 0).all():
        raise ContractError("no supervised rows")
    means = sums[:, 1:] / n[:, None]

    def second(x, fold, y, w):
        return np.stack([u @ (x - m) ** 2 for u, m in zip(_used(fold, w, plan).T, means)])

    deviations = np.sqrt(block_sums(blocks, second) / n[:, None])
    # a constant column leaves only the rounding of its mean
    deviations = np.where(deviations <= 1e-14 * np.abs(means), 0, deviations)
    return n, [(m, np.where(s == 0, 1.0, s)) for m, s in zip(means, deviations)], (deviations > 0).sum(axis=1)


def principal_axes(
    blocks: DataFrame, scalers: Sequence[tuple[Sequence[int], int | None]], k: int, *, facts: Facts | None = None,
    rounds: int = AXIS_ROUNDS, tolerance: float = AXIS_TOLERANCE, seed: int = 0,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(axes, explained share)`` per scaler: the ``k`` leading directions of its scaled rows, as columns.

    Ends when each leading direction v leaves a residual |Gv - lv| of at most ``tolerance`` times the largest l, when the blocks span
    the whole width (then they are exact), or after ``rounds`` passes with the best directions so far.
    """
    plan = [(list(columns), exclude) for columns, exclude in scalers]
    n, scaled, varying = facts or scaler_facts(blocks, scalers)
    d, width = len(scaled[0][0]), min(k + OVERSAMPLE, len(scaled[0][0]))
    if not 1 <= k <= min(d, int(n.min())):
        raise ContractError("the number of components must fit the training rows and the width")
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, images = [start.copy() for _ in plan], [np.empty((d, 0)) for _ in plan]
    fresh = [start for _ in plan]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(rounds):
        now = fresh

        def products(x, fold, y, w):
            parts = []
            for u, (m, s), q in zip(_used(fold, w, plan).T, scaled, now):
                z = (x - m) / s
                parts.append((z.T @ ((z @ q) * u[:, None])).T)
            return np.concatenate(parts)

        sums = block_sums(blocks, products)
        sizes = np.cumsum([q.shape[1] for q in now])
        out, residuals, fresh = [], [], []
        for j, image in enumerate(np.split(sums, sizes[:-1])):
            images[j] = np.column_stack([images[j], image.T])
            small = basis[j].T @ images[j]
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            top = np.argsort(values)[::-1][:k]
            axes = basis[j] @ vectors[:, top]
            residuals.append(np.linalg.norm(images[j] @ vectors[:, top] - axes * values[top], axis=0).max() / max(values[top[0]], 1e-300))
            out.append((axes, np.maximum(values[top], 0) / (n[j] * max(varying[j], 1))))
            more = image.T
            for _ in range(2):
                more = np.linalg.qr(more - basis[j] @ (basis[j].T @ more))[0]
            fresh.append(more[:, : d - basis[j].shape[1]])
        if max(residuals) <= tolerance or all(b.shape[1] == d for b in basis):
            break
        basis = [np.column_stack([b, q]) for b, q in zip(basis, fresh)]
    return out


@dataclass
class _Search:
    """Limited-memory BFGS of one head, fed one evaluation at a time."""

    theta: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    trail: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def trial(self) -> np.ndarray:
        return self.theta if self.direction is None else self.theta + self.step * self.direction

    def take(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Use the value at ``trial``; whether the head is at its optimum."""
        if self.gradient is not None:
            slope = float(self.gradient @ self.direction)
            if loss > self.loss + 1e-4 * self.step * slope + 1e-13 * max(1.0, abs(self.loss)):
                bend = loss - self.loss - self.step * slope
                better = -slope * self.step**2 / (2 * bend) if bend > 0 else 0.5 * self.step
                self.step = min(max(better, 0.1 * self.step), 0.5 * self.step)
                if self.step < 1e-12:
                    raise ContractError("a head makes no progress")
                return False
            moved, turned = self.step * self.direction, gradient - self.gradient
            self.theta = self.theta + moved
            if moved @ turned > 1e-14 * np.linalg.norm(moved) * np.linalg.norm(turned):
                self.trail = [*self.trail, (moved, turned)][-HISTORY:]
        self.loss, self.gradient = loss, gradient
        if np.abs(gradient).max() <= tolerance:
            return True
        self.direction, self.step = -self._newton(gradient), 1.0
        return False

    def _newton(self, gradient: np.ndarray) -> np.ndarray:
        q, used = gradient.copy(), []
        for s, y in reversed(self.trail):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        if self.trail:
            s, y = self.trail[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y), a in zip(self.trail, reversed(used)):
            q += s * (a - y @ q / (s @ y))
        return q


def fit_stacked(
    blocks: DataFrame, slots: Sequence[Slot], scalers: Sequence[tuple[Sequence[int], int | None]], c: float, *,
    facts: Facts | None = None, axes: Sequence[np.ndarray] | None = None, tolerance: float = GRADIENT_TOLERANCE,
) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """``(intercept, coef, mean, scale)`` per slot, coefficients on scaled features; see ``joint.fit_joint`` for the objective.

    With ``axes`` (one matrix per scaler) the heads are fitted on the projections to those columns and returned in the input space.
    """
    _, scaled, _ = facts or scaler_facts(blocks, scalers)
    d = len(scaled[0][0])
    centre = np.mean([m for m, _ in scaled], axis=0)  # keeps sums of large features exact
    maps = [None if axes is None else axes[s.scaler] for s in slots]
    columns = np.array([s.column for s in slots])
    excluded = np.array([NO_FOLD if s.exclude is None else s.exclude for s in slots])
    searches = [_Search(np.zeros((d if m is None else m.shape[1]) + 1)) for m in maps]
    still = list(range(len(slots)))

    def in_space(i: int, theta: np.ndarray) -> np.ndarray:
        return theta if maps[i] is None else maps[i] @ theta

    for _ in range(MAX_PASSES):
        trials = [searches[i].trial for i in still]
        weights = np.stack([in_space(i, t[:-1]) / scaled[slots[i].scaler][1] for i, t in zip(still, trials)], axis=1)
        shifts = np.array([t[-1] - (scaled[slots[i].scaler][0] - centre) @ v for i, t, v in zip(still, trials, weights.T)])
        own, without = columns[still], excluded[still]

        def evaluate(x, fold, y, w):
            z = x - centre
            logit = z @ weights + shifts
            yy, ww = y[:, own], w[:, own] * (fold[:, None] != without)
            p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            loss = (ww * (np.maximum(logit, 0) - logit * yy + np.log1p(np.exp(-np.abs(logit))))).sum(0)
            off = ww * (p - yy)
            known = ww > 0
            return np.column_stack([loss, (known & (yy == 1)).sum(0), (known & (yy == 0)).sum(0), off.sum(0), (z.T @ off).T])

        sums, left = block_sums(blocks, evaluate), []
        for i, t, (loss, pos, neg, bias, *grad) in zip(still, trials, sums):
            if not pos or not neg:
                raise ContractError(f"{slots[i].name} needs both classes in training")
            mean, scale = scaled[slots[i].scaler]
            g = (np.array(grad) - (mean - centre) * bias) / scale
            g = c * np.append(g if maps[i] is None else maps[i].T @ g, bias)
            g[:-1] += t[:-1]
            value = 0.5 * float(t[:-1] @ t[:-1]) + c * loss
            if not searches[i].take(value, g, tolerance * max(1.0, c * (pos + neg))):
                left.append(i)
        still = left
        if not still:
            break
    else:
        raise ContractError(f"{slots[still[0]].name} did not converge in {MAX_PASSES} passes")
    return [(float(s.theta[-1]), in_space(i, s.theta[:-1]), *scaled[slots[i].scaler]) for i, s in enumerate(searches)]
