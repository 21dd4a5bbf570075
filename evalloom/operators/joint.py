"""Many narrow logistic heads fitted together: one pass over the rows per Newton step.

Recipes, folds and targets are separate heads over the same feature rows. Each step a
task turns its rows into one small vector per head (loss, gradient, curvature), those
are summed on the executors, and the driver solves systems of the feature width.
The number of passes does not grow with the number of heads.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Slot, block_sums
from .checks import ContractError

MAX_STEPS = 60
GRADIENT_TOLERANCE = 1e-9


def _scalers(blocks: DataFrame, scalers: Sequence[tuple[Sequence[int], int | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population deviation (0 as 1) over rows with any usable label, per scaler."""
    plan = [(list(columns), exclude) for columns, exclude in scalers]

    def used(fold, w):
        return [((w[:, c] > 0).any(axis=1) & ((fold != e) if e is not None else True)).astype(float) for c, e in plan]

    def first(x, fold, y, w):
        return np.stack([np.concatenate([[u.sum()], u @ x]) for u in used(fold, w)])

    sums = block_sums(blocks, first)
    n = sums[:, :1]
    if not (n > 0).all():
        raise ContractError("no supervised rows")
    mean = sums[:, 1:] / n

    def second(x, fold, y, w):
        return np.stack([u @ (x - m) ** 2 for u, m in zip(used(fold, w), mean)])

    std = np.sqrt(block_sums(blocks, second) / n)
    return n[:, 0], mean, np.where(std == 0, 1.0, std)


def fit_joint(
    blocks: DataFrame, slots: Sequence[Slot], scalers: Sequence[tuple[Sequence[int], int | None]], c: float
) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """``(intercept, coef, mean, scale)`` per slot, coefficients on scaled features.

    ``blocks`` are packed rows; their ``y`` and ``w`` hold one cell per label column,
    weight 0 where unknown. Minimizes half the squared norm plus ``c`` times the weighted
    loss; the intercept is free. Raises when a head lacks a class.
    """
    _, mean, scale = _scalers(blocks, scalers)
    d = mean.shape[1]
    plan = [(s.column, s.exclude, mean[s.scaler], scale[s.scaler]) for s in slots]
    theta = np.zeros((len(slots), d + 1))

    def evaluate(x, fold, y, w, theta):
        out = []
        for (column, exclude, m, s), t in zip(plan, theta):
            keep = w[:, column] > 0
            if exclude is not None:
                keep &= fold != exclude
            z = np.hstack([(x[keep] - m) / s, np.ones((int(keep.sum()), 1))])
            yy, ww = y[keep, column], w[keep, column]
            logit = z @ t
            p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            loss = (ww * (np.maximum(logit, 0) - logit * yy + np.log1p(np.exp(-np.abs(logit))))).sum()
            curve = (z * (ww * p * (1 - p))[:, None]).T @ z
            counts = [float((yy == 1).sum()), float((yy == 0).sum())]
            out.append(np.concatenate([[loss], counts, z.T @ (ww * (p - yy)), curve.ravel()]))
        return np.stack(out)

    penalty = np.append(np.ones(d), 0.0)
    best, accepted = np.full(len(slots), np.inf), theta.copy()
    open_slots = np.ones(len(slots), dtype=bool)
    for _ in range(MAX_STEPS):
        now = theta.copy()
        sums = block_sums(blocks, lambda x, fold, y, w: evaluate(x, fold, y, w, now))
        for i in np.flatnonzero(open_slots):
            if sums[i, 1] == 0 or sums[i, 2] == 0:
                raise ContractError(f"{slots[i].name} needs both classes in training")
            value = 0.5 * (penalty * theta[i] ** 2).sum() + c * sums[i, 0]
            if value > best[i] + 1e-10 * abs(best[i]):
                theta[i] = (theta[i] + accepted[i]) / 2  # the full step overshot
                continue
            best[i], accepted[i] = min(value, best[i]), theta[i].copy()
            gradient = penalty * theta[i] + c * sums[i, 3:d + 4]
            if np.abs(gradient).max() <= GRADIENT_TOLERANCE * max(1.0, c * (sums[i, 1] + sums[i, 2])):
                open_slots[i] = False
                continue
            curve = np.diag(penalty) + c * sums[i, d + 4:].reshape(d + 1, d + 1)
            theta[i] = theta[i] - np.linalg.solve(curve, gradient)
        if not open_slots.any():
            break
    else:
        raise ContractError(f"{slots[int(np.flatnonzero(open_slots)[0])].name} did not converge in {MAX_STEPS} steps")
    return [(float(t[-1]), t[:-1], mean[s.scaler], scale[s.scaler]) for t, s in zip(accepted, slots)]


def label_arrays(supervised: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """``(id, fold, y, w)``: one cell per (recipe, target) from long ``(id, fold, target, y, weight)`` rows."""
    rows = None
    for r, df in enumerate(supervised):
        part = df.select("id", "fold", "target", "y", "weight", F.lit(r).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    def cell(name: str, r: int, t: str):
        return F.coalesce(F.max(F.when((F.col("r") == r) & (F.col("target") == t), F.col(name))), F.lit(0.0))

    pairs = [(r, t) for r in range(len(supervised)) for t in names]
    return rows.groupBy("id").agg(
        F.max("fold").cast("int").alias("fold"), F.array(*[cell("y", r, t) for r, t in pairs]).alias("y"), F.array(*[cell("weight", r, t) for r, t in pairs]).alias("w")
    )
