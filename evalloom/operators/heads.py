"""Regularized per-target linear heads, out-of-fold prediction and recipe choice.

All heads of all recipes, folds and targets share their passes over the rows: by Newton steps up to
``JOINT_WIDTH`` features (``joint``), by gradients alone beyond that and behind principal components (``stacked``).
Only coefficients come back to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import broken_vector, guarded
from ..session import reuse
from .blocks import Slot, packed
from .checks import ContractError, check_key, check_subset, enforce, row_checks
from .joint import fit_joint, label_arrays
from .stacked import fit_stacked, principal_axes, scaler_facts
from .features import CATEGORIES, as_array, assemble_slots, count_features, count_names, mean_pool_windows
from .labels import supervision
from .ordering import join_rows, ranked
from .splits import PLANES, WINDOWS

# Inverse penalty strength and the supervision recipes.
INVERSE_PENALTY = 0.1
RECIPES = {"observed_only": 0.0, "silver_1.0": 1.0, "silver_0.25": 0.25}
JOINT_WIDTH = 32  # up to this width curvatures fit a task's answer, see ``joint``; beyond it gradients alone, with the same checks and optimum
MODEL_SCHEMA = (
    "recipe string, fold int, target string, intercept double, coef array<double>, mean array<double>, "
    "scale array<double>, observed bigint, derived bigint, explained array<double>"
)


@dataclass(frozen=True)
class Head:
    """One fitted head in input space: logit = intercept + coef . (x - mean) / scale."""

    recipe: str
    fold: int
    target: str
    intercept: float
    coef: list[float]
    mean: list[float]
    scale: list[float]
    observed: int
    derived: int
    explained: list[float]


def fit_scaler(features: DataFrame, supervised: DataFrame):
    """``(rows, mean, population std with 0 as 1)`` over ids with a usable target, plus the ML model."""
    used = supervised.filter("weight > 0").select("id").distinct()
    rows = join_rows(features, used, ["id"], "left_semi").select("id", array_to_vector("x").alias("raw"))
    model = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows)
    n = rows.count()
    std = np.asarray(model.std) * ((n - 1) / n) ** 0.5 if n > 1 else np.zeros(len(model.std))
    return n, np.asarray(model.mean), np.where(std == 0, 1.0, std), model


def _check_features(features: DataFrame, used: DataFrame, width: int) -> None:
    """Every vector is finite and of one width; every id of ``used`` has one."""
    enforce(row_checks(features, "features", {"finite": broken_vector(F.col("x"), width)}), check_subset(used, features, ["id"], "supervised ids"))


def _check_training(features: DataFrame, supervised: DataFrame, names: Sequence[str], width: int) -> dict[str, dict]:
    _check_features(features, supervised.filter("weight > 0"), width)
    active = supervised.filter("weight > 0").groupBy("target").agg(
        F.sum("weight").alias("w"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
        F.count("observed").alias("observed"), F.count_if(F.col("observed").isNull()).alias("derived"),
    )
    facts = {r["target"]: r.asDict() for r in active.collect()}  # one row per target
    for name in names:
        if name not in facts or not facts[name]["pos"] or not facts[name]["neg"]:
            raise ContractError(f"target {name} needs both classes in training")
    return facts


def _width(features: DataFrame) -> int:
    """The largest width of a vector; ``_check_features`` holds the others against it."""
    widest = features.filter("x is not null").agg(F.max(F.size("x")).alias("d")).first()["d"]
    if widest is None:
        raise ContractError("no features")
    return widest


def _all_heads(
    rows: DataFrame, recipes: Mapping[str, int], folds: Sequence[int], names: Sequence[str], c: float, *, width: int, pca: int | None, held_out: bool,
    counts: Mapping[tuple[str, int], Mapping[str, tuple[int, int]]],
) -> list[Head]:
    """All (recipe, fold, target) heads over ``rows(id, x, fold, y, w)`` in shared passes."""
    slots, scalers, tags = [], [], []
    for recipe, r in recipes.items():
        for fold in folds:
            scalers.append(([r * len(names) + t for t in range(len(names))], fold if held_out else None))
            for t, name in enumerate(names):
                slots.append(Slot(f"target {name}", r * len(names) + t, len(scalers) - 1, fold if held_out else None))
                tags.append((recipe, fold, name))
    explained: list[list[float]] = [[] for _ in scalers]
    narrow = pca is None and width <= JOINT_WIDTH
    rows = reuse(packed(rows))
    try:
        if narrow:
            fitted = fit_joint(rows, slots, scalers, c)
        else:
            facts, axes = scaler_facts(rows, scalers), None
            if pca is not None:
                found = principal_axes(rows, scalers, pca, facts=facts)
                axes, explained = [v for v, _ in found], [share.tolist() for _, share in found]
            fitted = fit_stacked(rows, slots, scalers, c, facts=facts, axes=axes)
    finally:
        rows.unpersist()
    out = []
    for (recipe, fold, name), slot, (intercept, coef, mean, scale) in zip(tags, slots, fitted):
        observed, derived = counts[(recipe, fold)].get(name, (0, 0))
        out.append(Head(recipe, fold, name, intercept, coef.tolist(), mean.tolist(), scale.tolist(), observed, derived, explained[slot.scaler]))
    return out


def fit_heads(
    features: DataFrame, supervised: DataFrame, names: Sequence[str], *, recipe: str = "observed_only", fold: int = -1,
    pca: int | None = None, c: float = INVERSE_PENALTY,
) -> list[Head]:
    """One L2 logistic head per target over its known rows; the intercept is not penalized.

    ``features(id, x)``, ``supervised(id, target, y, weight, observed)``. The penalty equals
    half the squared norm against ``c`` times the weighted loss on population-scaled
    features. With ``pca`` the heads are fitted on that many components and returned
    as the equivalent input-space line.
    """
    width = _width(features)
    facts = _check_training(features, supervised, names, width)
    rows = join_rows(features, label_arrays([supervised], names), ["id"])
    cells = {t: (f["observed"], f["derived"]) for t, f in facts.items()}
    return _all_heads(rows, {recipe: 0}, [fold], names, c, width=width, pca=pca, held_out=False, counts={(recipe, fold): cells})


def model_table(spark: SparkSession, heads: Sequence[Head]) -> DataFrame:
    """Heads as rows; their number is recipes x folds x targets."""
    return spark.createDataFrame([tuple(h.__dict__.values()) for h in heads], MODEL_SCHEMA)


def _lines(heads: Sequence[Head]) -> tuple[np.ndarray, np.ndarray]:
    weights = np.array([np.asarray(h.coef) / np.asarray(h.scale) for h in heads])
    offset = np.array([h.intercept for h in heads]) - np.array([w @ np.asarray(h.mean) for h, w in zip(heads, weights)])
    return weights, offset


def _probabilities(heads: Sequence[Head], x: str) -> Column:
    """Array of probabilities, one per head, in order; a broken vector is an error.

    Narrow lines are spelled out as arithmetic of the row; wide ones are one matrix product per Arrow batch.
    """
    weights, offset = _lines(heads)
    width = weights.shape[1]
    checked = guarded(F.col(x).cast("array<double>"), broken_vector(F.col(x), width), f"a feature vector is not {width} finite numbers")
    if width <= JOINT_WIDTH:

        def probability(w: np.ndarray, b: float) -> Column:
            logit = F.lit(float(b))
            for i, v in enumerate(w.tolist()):
                logit = logit + F.get(F.col(x), F.lit(i)).cast("double") * F.lit(v)
            return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), logit))))

        lines = F.array(*[probability(w, b) for w, b in zip(weights, offset)])
        return F.when(checked.isNotNull(), lines)

    def product(batch: pd.Series) -> pd.Series:
        logits = np.clip(np.stack(batch.to_numpy()) @ weights.T + offset, -700, 700)
        return pd.Series(list(1 / (1 + np.exp(-logits))))

    return F.pandas_udf(product, "array<double>")(checked)


def _exploded(rows: DataFrame, heads: Sequence[Head], keep: Sequence[str]) -> DataFrame:
    tags = F.array(*[F.struct(F.lit(h.recipe).alias("recipe"), F.lit(h.fold).alias("fold"), F.lit(h.target).alias("target")) for h in heads])
    return rows.select(*keep, F.explode(F.arrays_zip(tags.alias("t"), F.col("_p").alias("p"))).alias("c"))


def _check_heads(heads: Sequence[Head], names: Sequence[str]) -> None:
    if {h.target for h in heads} != set(names) or len({len(h.coef) for h in heads}) != 1:
        raise ContractError("heads do not match the targets")


def predict_heads(features: DataFrame, heads: Sequence[Head], names: Sequence[str] | None = None) -> DataFrame:
    """``(id, recipe, target, p)`` of every row under heads of one width; one pass, no join."""
    _check_heads(heads, list(names or dict.fromkeys(h.target for h in heads)))
    rows = features.select("id", _probabilities(heads, "x").alias("_p"))
    return _exploded(rows, heads, ["id"]).select("id", "c.t.recipe", "c.t.target", "c.p")


def cross_validate(
    features: DataFrame, labels: DataFrame, folds: Sequence[int], names: Sequence[str],
    recipes: Mapping[str, float] = RECIPES, *, pca: int | None = None, c: float = INVERSE_PENALTY,
) -> tuple[DataFrame, list[Head]]:
    """Fit each recipe on all folds but one, predict that fold's gold ids: ``(oof, heads)``.

    ``labels`` is a fused label table; both inputs are read several times, so persist expensive ones. The fold a head must not see is masked
    inside its pass, before scaling or fitting, so held-out labels never reach it.
    """
    width = _width(features)
    sups = [supervision(labels, weight) for weight in recipes.values()]
    every = None
    for name, sup in zip(recipes, sups):
        part = sup.filter("weight > 0").select(F.lit(name).alias("recipe"), "id", "fold", "target", "observed")
        every = part if every is None else every.unionByName(part)
    _check_features(features, every.select("id").distinct(), width)
    derived = F.count_if(F.col("observed").isNull())
    used = every.groupBy("recipe", "fold", "target").agg(F.count("observed").alias("o"), derived.alias("d")).collect()  # recipes x folds x targets
    tallies: dict[tuple[str, int], dict[str, tuple[int, int]]] = {(name, fold): {} for name in recipes for fold in folds}
    for (name, fold), cells in tallies.items():
        for r in used:
            if r["recipe"] == name and r["fold"] != fold:
                o, d = cells.get(r["target"], (0, 0))
                cells[r["target"]] = (o + r["o"], d + r["d"])
    rows = join_rows(features, label_arrays(sups, names), ["id"])
    heads = _all_heads(rows, {n: i for i, n in enumerate(recipes)}, folds, names, c, width=width, pca=pca, held_out=True, counts=tallies)
    return _out_of_fold(features, labels, heads, names), heads


def _out_of_fold(features: DataFrame, labels: DataFrame, heads: Sequence[Head], names: Sequence[str]) -> DataFrame:
    """Gold rows scored by the heads that did not see their fold, in one pass over the features."""
    _check_heads(heads, names)
    gold = labels.filter("observed is not null").select("id", "fold", "target", F.col("observed").cast("double").alias("y"))
    ids = gold.select("id", F.col("fold").alias("_fold")).distinct()
    scored = join_rows(features, ids, ["id"]).select("id", "_fold", _probabilities(heads, "x").alias("_p"))
    rows = _exploded(scored, heads, ["id", "_fold"]).filter("c.t.fold = _fold")
    rows = rows.select("id", F.col("_fold").alias("fold"), F.col("c.t.recipe").alias("model"), "c.t.target", "c.p")
    return join_rows(rows, gold.select("id", "target", "y"), ["id", "target"]).select("model", "fold", "id", "target", "y", "p")


def select_recipe(summary: DataFrame, order: Sequence[str]) -> str:
    """Best mean fold macro AUC; the earlier recipe wins a tie. One row per recipe."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("model"))
    best = summary.filter(F.col("model").isin(*order)).agg(F.max_by("model", F.struct("mean_macro_auc", (-place).alias("p"))).alias("m"))
    return best.first()["m"]


def score_new_ids(ids: DataFrame, children: DataFrame, heads: Sequence[Head], categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """Score runtime ids from their child rows alone; childless ids are allowed, foreign children are not."""
    enforce(check_key(ids, ["id"], "ids"), check_subset(children, ids, ["id"], "children in ids"))
    rows = as_array(count_features(ids.select("id"), children, categories), count_names(categories))
    return predict_heads(rows, heads)


def score_new_vectors(ids: DataFrame, vectors: DataFrame, heads: Sequence[Head], dim: int, planes: Sequence[str] = PLANES, windows: int = WINDOWS) -> DataFrame:
    """``(row_idx, id, recipe, target, p)`` of runtime ids from their window vectors ``(id, plane, window, vec)`` alone, numbered in id order.

    Foreign vectors, repeated ids and ids without any usable plane are errors; an absent plane counts as zeros with its flag off.
    """
    enforce(check_key(ids, ["id"], "ids"), check_subset(vectors, ids, ["id"], "vectors in ids"), check_usable_slots(ids, vectors))
    rows = assemble_slots(ids, mean_pool_windows(vectors, windows), dim, planes)
    numbered = ranked(ids.select("id"), [], ["id"]).select("id", (F.col("rn") - 1).alias("row_idx"))
    return join_rows(numbered, predict_heads(rows, heads), ["id"]).select("row_idx", "id", "recipe", "target", "p")


def check_usable_slots(ids: DataFrame, presence: DataFrame) -> DataFrame:
    """Ids without any usable plane cannot be scored from vectors."""
    return check_subset(ids, presence, ["id"], "ids with a usable plane")
