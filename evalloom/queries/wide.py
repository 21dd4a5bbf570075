"""Wide heads on the embeddings: three recipes, three folds and a refit over twelve targets."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..operators import heads as H
from ..operators.labels import supervision
from ..operators.stacked import GRADIENT_TOLERANCE
from ..plans import jobs as J
from ..session import reuse
from .base import FOLDS, query, r6, table

WIDE_TARGETS = [f"t{k:02d}" for k in range(12)]


def vector_features(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def vector_labels(spark, sf):
    """Two of five vectors are gold, others carry a weak verdict; target k joins the vectors whose label is in k .. k + 3."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    truth = (F.pmod(F.col("label") - F.col("k"), F.lit(10)) < 4).cast("int")
    weak = F.when((F.col("id") + F.col("k")) % 7 == 0, 1 - truth).otherwise(truth)
    gold, known = F.col("id") % 5 < 2, (F.col("id") + F.col("k")) % 3 < 2
    observed = F.when(gold, truth)
    return rows.select(
        "id", F.pmod(F.floor(F.col("id") / 5), F.lit(3)).cast("int").alias("fold"), F.format_string("t%02d", "k").alias("target"),
        F.coalesce(observed, F.when(known, weak)).alias("value"), observed.alias("observed"), F.when(weak == 1, 0.82).otherwise(0.08).alias("derived"),
        F.when(~known, "UNK").when(weak == 1, "YES").otherwise("NO").alias("verdict"), (gold | known).alias("mask"), F.lit(0.9).alias("confidence"),
    )


_LABELS = """
    wl AS (SELECT vec_id AS id, ((vec_id // 5) % 3)::INT AS fold, 't' || lpad(k::VARCHAR, 2, '0') AS target, vec_id % 5 < 2 AS gold, (vec_id + k) % 3 < 2 AS known
           FROM embeddings CROSS JOIN range(12) r(k)),
    wr(recipe, weight) AS (VALUES ('observed_only', 0), ('silver_1.0', 1), ('silver_0.25', 1))"""


@query()
def wide_experiment(spark, sf):
    """The whole supervision experiment at the width of the embeddings: summary of every recipe and of the references."""
    x, labels = reuse(vector_features(spark, sf)), reuse(vector_labels(spark, sf))
    out = J.experiment(x, labels, FOLDS, WIDE_TARGETS, x)
    summary = out["summary"].select("model", r6("mean_macro_auc").alias("mean_macro_auc"), r6("std_macro_auc").alias("std_macro_auc"), "folds")
    return summary.withColumn("chosen", F.col("model") == out["chosen"])


@query(f"""
    WITH {_LABELS} SELECT recipe, f.fold, target, count(*) FILTER (WHERE gold) AS observed, count(*) FILTER (WHERE NOT gold AND known AND weight > 0) AS derived, TRUE AS solved
    FROM wl CROSS JOIN wr CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS fold) f WHERE wl.fold <> f.fold GROUP BY recipe, f.fold, target""")
def wide_heads(spark, sf):
    """Cells used by each wide head, and whether the objective's gradient vanishes at it, taken again from single rows.

    The objective is a sum over cells, so what counts as vanishing is the fit's own tolerance for that many cells, and a hundredth more for the other order of summation.
    """
    x, labels = reuse(vector_features(spark, sf)), reuse(vector_labels(spark, sf))
    _, heads = H.cross_validate(x, labels, FOLDS, WIDE_TARGETS)
    model = H.model_table(spark, heads)
    rows = None
    for name, weight in H.RECIPES.items():
        part = supervision(labels, weight).filter("weight > 0").select(F.lit(name).alias("recipe"), "id", F.col("fold").alias("own"), "target", "y", "weight")
        rows = part if rows is None else rows.unionByName(part)
    met = rows.join(x, "id").join(F.broadcast(model), ["recipe", "target"]).filter("own <> fold")  # 108 heads
    z = F.zip_with(F.zip_with("x", "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    met = met.withColumn("z", F.concat(z, F.array(F.lit(1.0))))
    logit = F.aggregate(F.zip_with("z", F.concat("coef", F.array("intercept")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    met = met.withColumn("r", H.INVERSE_PENALTY * F.col("weight") * (1 / (1 + F.exp(-logit)) - F.col("y")))
    pull = met.groupBy("recipe", "fold", "target").agg(Summarizer.sum(array_to_vector(F.transform("z", lambda v: v * F.col("r")))).alias("g"), F.first("coef").alias("coef"), F.first(F.col("observed") + F.col("derived")).alias("cells"))

    @F.udf("double")
    def largest(g, coef):
        return float(np.abs(g.toArray() + np.append(coef, 0.0)).max())

    bound = 1.01 * GRADIENT_TOLERANCE * F.greatest(F.lit(1.0), H.INVERSE_PENALTY * F.col("cells"))
    gradient = pull.select("recipe", "fold", "target", (largest("g", "coef") <= bound).alias("solved"))
    return model.select("recipe", "fold", "target", "observed", "derived").join(gradient, ["recipe", "fold", "target"])


@query()
def wide_reduced_heads(spark, sf):
    """Cross-validated heads on eight principal components of the embeddings: shares of variance and out-of-fold scores."""
    x, labels = reuse(vector_features(spark, sf)), reuse(vector_labels(spark, sf))
    oof, heads = H.cross_validate(x, labels, FOLDS, WIDE_TARGETS, {"observed_only": 0.0}, pca=8)
    shares = H.model_table(spark, [h for h in heads if h.target == WIDE_TARGETS[0]]).select("fold", F.posexplode("explained").alias("i", "share"))
    score = oof.groupBy("fold").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.count(F.lit(1)).alias("cells"))
    return shares.join(score, "fold").select("fold", "i", r6("share").alias("share"), F.round("brier", 4).alias("brier"), "cells")
