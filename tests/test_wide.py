"""Wide heads and principal axes against dense linear algebra."""

import numpy as np
import pytest

from evalloom.operators import blocks as B
from evalloom.operators import heads as H
from evalloom.operators import labels as W
from evalloom.operators import stacked as S
from evalloom.operators.blocks import Slot, packed
from evalloom.operators.checks import ContractError


def frame(spark, n, d, seed, fold_by=3):
    """Correlated, shifted columns with a decaying spectrum, some constant; two label columns with unknown cells."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, min(n, d))) * 0.85 ** np.arange(min(n, d)) @ rng.standard_normal((min(n, d), d)) + 5 * rng.standard_normal(d)
    x[:, d // 2] = 3.25
    hidden = x[:, :3].sum(axis=1)
    y = np.stack([hidden > np.median(hidden), rng.random(n) > 0.6], axis=1).astype(float)
    w = rng.choice([0.0, 0.25, 1.0], (n, 2))
    fold = np.arange(n) % fold_by
    rows = [(x[i].tolist(), int(fold[i]), y[i].tolist(), w[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "x array<double>, fold int, y array<double>, w array<double>").repartition(3)
    return df, x, fold, y, w


def scaled(x, used):
    m, s = x[used].mean(axis=0), x[used].std(axis=0)
    return (x - m) / np.where(s <= 1e-12, 1, s)


SCALERS = [([0, 1], None), ([0, 1], 1)]
SLOTS = [Slot("a", 0, 0, None), Slot("b", 1, 0, None), Slot("a1", 0, 1, 1), Slot("b1", 1, 1, 1)]


@pytest.mark.parametrize("n,d", [(240, 64), (90, 700)])
def test_gradients_vanish(spark, monkeypatch, n, d):
    monkeypatch.setattr(B, "BLOCK_VALUES", 20 * d)
    df, x, fold, y, w = frame(spark, n, d, d)
    blocks = packed(df).cache()
    c = 0.1
    fitted = S.fit_stacked(blocks, SLOTS, SCALERS, c)
    for slot, (intercept, coef, mean, scale) in zip(SLOTS, fitted):
        seen = np.ones(n, bool) if slot.exclude is None else fold != slot.exclude
        z = scaled(x, seen & (w > 0).any(axis=1))
        assert np.allclose((x - mean) / scale, z)
        ww, yy = w[:, slot.column] * seen, y[:, slot.column]
        p = 1 / (1 + np.exp(-(z @ coef + intercept)))
        gradient = np.append(coef + c * z.T @ (ww * (p - yy)), c * (ww * (p - yy)).sum())
        assert np.abs(gradient).max() < 1e-6


def test_same_lines_as_newton(spark):
    from evalloom.operators.joint import fit_joint

    df, *_ = frame(spark, 200, 12, 4)
    for a, b in zip(fit_joint(packed(df).cache(), SLOTS, SCALERS, 0.1), S.fit_stacked(packed(df).cache(), SLOTS, SCALERS, 0.1)):
        assert a[0] == pytest.approx(b[0], abs=1e-6) and np.allclose(a[1], b[1], atol=1e-6) and np.allclose(a[3], b[3])


@pytest.mark.parametrize("n,d,k", [(300, 64, 5), (150, 2304, 16), (20, 6, 6)])
def test_principal_axes(spark, n, d, k):
    df, x, fold, y, w = frame(spark, n, d, k)
    found = S.principal_axes(packed(df).cache(), SCALERS, min(k, d), tolerance=1e-9)
    for (_, exclude), (axes, share) in zip(SCALERS, found):
        used = (w > 0).any(axis=1) & (True if exclude is None else fold != exclude)
        _, values, rows = np.linalg.svd(scaled(x, used)[used], full_matrices=False)
        exact = rows[:k].T
        assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-10)
        assert np.linalg.norm(exact - axes @ (axes.T @ exact), 2) < 1e-5 or values[k - 1] < 1e-8
        assert np.allclose(share, values[:k] ** 2 / (values**2).sum(), atol=1e-9)


def test_reduced_heads_are_lines_on_the_components(spark):
    df, x, fold, y, w = frame(spark, 200, 50, 9)
    blocks = packed(df).cache()
    axes = [a for a, _ in S.principal_axes(blocks, SCALERS, 4)]
    for slot, (intercept, coef, *_ ) in zip(SLOTS, S.fit_stacked(blocks, SLOTS, SCALERS, 0.1, axes=axes)):
        v = axes[slot.scaler]
        small = v.T @ coef
        assert np.allclose(v @ small, coef)
        seen = np.ones(200, bool) if slot.exclude is None else fold != slot.exclude
        z = scaled(x, seen & (w > 0).any(axis=1)) @ v
        ww, yy = w[:, slot.column] * seen, y[:, slot.column]
        p = 1 / (1 + np.exp(-(z @ small + intercept)))
        assert np.abs(np.append(small + 0.1 * z.T @ (ww * (p - yy)), 0.1 * (ww * (p - yy)).sum())).max() < 1e-6


def test_errors(spark):
    df, *_ = frame(spark, 30, 40, 1)
    with pytest.raises(ContractError, match="components"):
        S.principal_axes(packed(df), SCALERS, 41)
    with pytest.raises(ContractError, match="both classes"):
        S.fit_stacked(packed(df.filter("y[0] = 1")), SLOTS[:1], SCALERS, 0.1)
    with pytest.raises(ContractError, match="no supervised rows"):
        S.scaler_facts(packed(df.filter("false")), SCALERS)


def test_wide_recipes_match_single_fits(spark):
    """Cross-validated wide heads equal fits on the other folds alone."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 40))
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    labels = []
    for i in range(60):
        for t in range(2):
            y = int(x[i, t] + 0.5 * rng.standard_normal() > 0)
            labels.append((i, i % 3, f"t{t}", y, y if i % 2 else None, 0.9 if y else 0.1, "YES" if y else "NO", True, 0.9))
    table = spark.createDataFrame(labels, "id long, fold int, target string, value int, observed int, derived double, verdict string, mask boolean, confidence double")
    recipes = {"gold": 0.0, "quarter": 0.25}
    for pca in (None, 5):
        oof, heads = H.cross_validate(features, table, [0, 1, 2], ["t0", "t1"], recipes, pca=pca)
        assert oof.count() == 2 * 2 * 30
        for recipe, weight in recipes.items():
            alone = H.fit_heads(features, W.supervision(table.filter("fold <> 1"), weight), ["t0", "t1"], recipe=recipe, fold=1, pca=pca)
            both = [h for h in heads if h.recipe == recipe and h.fold == 1]
            for a, b in zip(alone, both):
                assert np.allclose(a.coef, b.coef, atol=1e-5) and (a.observed, a.derived) == (b.observed, b.derived) and np.allclose(a.explained, b.explained)
