"""Scores within folds, errors and decisions; resampling is in ``resample``.

Predictions are long rows; models, folds and targets are grouping columns, so one job scores them all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import guarded
from .checks import check_key, check_set_equal, union
from .ordering import join_rows, tied, top_k
from .profile import count


def auc(rows: DataFrame, by: Sequence[str], score: str = "p", truth: str = "y", weight: str | None = None, **sizing: int) -> DataFrame:
    """Tie-exact ROC AUC per group; NULL truth is left out, a single class gives NULL.

    Equal scores collapse to one row with their class counts; half of the tied
    negatives count below each positive.
    """
    w = F.col(weight) if weight else F.lit(1)
    known = rows.filter(F.col(truth).isNotNull())
    run = tied(known, by, score, {
        "pos": F.when(F.col(truth) == 1, w).otherwise(F.lit(0)), "neg": F.when(F.col(truth) == 0, w).otherwise(F.lit(0)),
    }, **sizing)
    wins = F.col("pos").cast("double") * (2 * F.col("before_neg") + F.col("neg")) / 2.0
    out = run.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.max("total_pos").cast("bigint").alias("positive"), F.max("total_neg").cast("bigint").alias("negative")
    )
    pairs = F.col("positive").cast("double") * F.col("negative")
    return out.select(*by, "positive", "negative", F.when(pairs > 0, F.col("_wins") / pairs).alias("auc"))


def fold_macro(scores: DataFrame) -> DataFrame:
    """Mean over targets per (model, fold): the macro AUC of a fold. A target with one class is an error, never left out."""
    lacks = F.count_if(F.col("auc").isNull()) > 0
    return scores.groupBy("model", "fold").agg(guarded(F.avg("auc"), lacks, "an AUC needs both classes in every fold and target").alias("macro_auc"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds of the macro AUC. Folds are never pooled."""
    return fold_macro(scores).groupBy("model").agg(
        F.avg("macro_auc").alias("mean_macro_auc"), F.stddev_samp("macro_auc").alias("std_macro_auc"), F.count(F.lit(1)).alias("folds")
    )


def target_means(scores: DataFrame) -> DataFrame:
    """Mean over folds of each target's AUC. A fold with one class is an error, never left out."""
    lacks = F.count_if(F.col("auc").isNull()) > 0
    return scores.groupBy("model", "target").agg(guarded(F.avg("auc"), lacks, "an AUC needs both classes in every fold and target").alias("mean_auc"))


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared error per fold, then the mean of folds, per (model, target)."""
    known = rows.filter(F.col("y").isNotNull())
    per_fold = known.groupBy("model", "fold", "target").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("b"))
    return per_fold.groupBy("model", "target").agg(F.avg("b").alias("brier"))


def largest_errors(rows: DataFrame, k: int, references: Sequence[str] = (), models: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` squared errors per (model, target), ties to the smaller id, beside references.

    For each reference model: its prediction and the squared-error difference.
    """
    known = rows.filter(F.col("y").isNotNull()).withColumn("squared_error", (F.col("p") - F.col("y")) ** 2)
    picked = known.filter(F.col("model").isin(*models)) if models else known
    top = top_k(picked, ["model", "target"], [F.col("squared_error").desc(), F.col("id")], k, ["id"])
    for name in references:
        ref = known.filter(F.col("model") == name).select("id", "target", F.col("p").alias(f"{name}_p"), F.col("squared_error").alias("_e"))
        top = top.join(ref, ["id", "target"], "left").withColumn(f"brier_minus_{name}", F.col("squared_error") - F.col("_e")).drop("_e")
    return top


def study_error(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Mean squared probability error per (model, id) over observed targets; the ``k`` worst if given."""
    known = rows.filter(F.col("y").isNotNull())
    each = known.groupBy("model", "id").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("error"), F.count(F.lit(1)).alias("targets"))
    if k is None:
        return each
    return top_k(each, ["model"], [F.round("error", 12).desc(), F.col("id")], k, ["id"])


def calibration_profile(rows: DataFrame) -> DataFrame:
    """Confidently wrong cells, mean probability against prevalence, extreme cells, per (model, target)."""
    known = rows.filter(F.col("y").isNotNull())
    wrong = ((F.col("p") < 0.01) & (F.col("y") == 1)) | ((F.col("p") > 0.99) & (F.col("y") == 0))
    return known.groupBy("model", "target").agg(
        count(wrong).alias("confidently_wrong"), F.avg("p").alias("mean_probability"), F.avg("y").alias("prevalence"),
        count((F.col("p") < 0.05) | (F.col("p") > 0.95)).alias("extreme"), F.count(F.lit(1)).alias("cells"),
    )


def prediction_parity(a: DataFrame, b: DataFrame, atol: float, rtol: float = 0.0) -> DataFrame:
    """Largest difference, cells beyond tolerance and cells missing on either side."""
    left = a.select("id", "target", F.col("p").alias("_a"))
    right = b.select("id", "target", F.col("p").alias("_b"))
    both = join_rows(left, right, ["id", "target"], "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.max(gap).alias("max_abs_difference"), count(gap > atol + rtol * F.abs(F.col("_b"))).alias("beyond_tolerance"),
        count(F.col("_a").isNull()).alias("missing_a"), count(F.col("_b").isNull()).alias("missing_b"), F.count(F.lit(1)).alias("cells"),
    )


def promotion_rule(fold_scores: DataFrame, candidate: str, controls: Sequence[str], need: int = 2) -> DataFrame:
    """The candidate passes a control if its mean is higher and at least ``need`` folds improve."""
    mine = fold_scores.filter(F.col("model") == candidate).select("fold", F.col("macro_auc").alias("_c"))
    rows = fold_scores.filter(F.col("model").isin(*controls)).join(mine, "fold")
    out = rows.groupBy(F.col("model").alias("control")).agg(
        (F.avg("_c") - F.avg("macro_auc")).alias("mean_delta"), count(F.col("_c") > F.col("macro_auc")).alias("folds_improved")
    )
    return out.withColumn("passes", (F.col("mean_delta") > 0) & (F.col("folds_improved") >= need))


def target_deltas(auc_means: DataFrame, briers: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per-target AUC and Brier differences for each model pair."""
    rows = auc_means.join(briers, ["model", "target"])

    def of(model: str, col: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(col)))

    cells = [
        F.struct(F.lit(f"{a}_minus_{b}").alias("pair"), (of(a, "mean_auc") - of(b, "mean_auc")).alias("auc_difference"),
                 (of(a, "brier") - of(b, "brier")).alias("brier_difference"))
        for a, b in pairs
    ]
    return rows.groupBy("target").agg(F.array(*cells).alias("c")).select("target", F.explode("c").alias("c")).select("c.pair", "target", "c.auc_difference", "c.brier_difference")


def oof_coverage(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Each gold (id, target) is predicted exactly once."""
    return union([
        check_key(preds, ["id", "target"], "predictions"), check_set_equal(preds, gold, ["id", "target"], "predictions = gold"),
    ])


def prevalence_reference(labels: DataFrame) -> DataFrame:
    """Training-fold prevalence per (fold, target): all observed minus the fold's own, in one pass."""
    own = labels.groupBy("fold", "target").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    whole = own.groupBy("target").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = F.col("tn") - F.col("n")
    share = F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0)), rest)
    no_rest = F.concat(F.lit("no labels outside the fold for target "), F.col("target"))
    return own.join(whole, "target").select("fold", "target", F.when(rest > 0, share).otherwise(F.raise_error(no_rest)).alias("p"))


def reference_predictors(labels: DataFrame) -> DataFrame:
    """Rows of the ``constant`` and ``prevalence`` models for every labeled cell."""
    known = labels.filter(F.col("y").isNotNull())
    constant = known.select(F.lit("constant").alias("model"), "fold", "id", "target", "y", F.lit(0.5).alias("p"))
    # Folds x targets rows; without the hint adaptive execution may broadcast the labels instead.
    prevalence = known.join(F.broadcast(prevalence_reference(labels)), ["fold", "target"])
    return constant.unionByName(prevalence.select(F.lit("prevalence").alias("model"), "fold", "id", "target", "y", "p"))


def scored(models: Mapping[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Long rows of several models beside the truth ``(id, target, fold, y)``."""
    parts = [df.select(F.lit(name).alias("model"), "id", "target", "p") for name, df in models.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return join_rows(rows, truth.select("id", "target", "fold", "y"), ["id", "target"])
