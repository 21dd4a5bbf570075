"""What the findings of round 3 asked for."""

import os

import numpy as np
from pyspark.sql import functions as F

from evalloom.operators import evaluate, heads, labels as weak, resample
from evalloom.operators.checks import check_key
from evalloom.queries import features


def _cells(spark, n=60):
    rows = [(i, t, (i * 7 + k) % 2 if i % 5 else None) for i in range(n) for k, t in enumerate(("a", "b"))]
    targets = spark.createDataFrame(rows, "id bigint, target string, value int")
    derived = targets.filter("value is null").select("id", "target", F.lit(0.9).alias("score"), F.lit(0.9).alias("conf"), F.lit("YES").alias("verdict"))
    folds = spark.range(n).select("id", F.col("id").cast("string").alias("group_id"), (F.col("id") % 3).cast("int").alias("fold"))
    return weak.fuse_labels(targets, derived, folds, "s", validate=False)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f2_rows_are_never_broadcast(spark):
    """Joins of tables that grow with the input are merged however small they look; only folds x targets rows are broadcast."""
    labels = _cells(spark)
    assert "BroadcastHashJoin" not in _plan(labels) and _plan(labels).count("SortMergeJoin") == 2
    features = spark.range(60).select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("x"))
    oof, _ = heads.cross_validate(features, labels, [0, 1, 2], ["a", "b"], {"observed_only": 0.0})
    assert "BroadcastHashJoin" not in _plan(oof)
    truth = labels.select("fold", "id", "target", F.col("observed").cast("double").alias("y"))
    plan = _plan(evaluate.reference_predictors(truth))
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_f9_inputs_read_several_times_are_kept(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    spark.catalog.clearCache()
    assert features.recipe_comparison(spark, sf).count() == 2
    assert features.document_features(spark, sf).storageLevel.useMemory
    spark.catalog.clearCache()


def test_f6_a_long_unit_leaves_the_others_together():
    lengths = np.array([6] * 500 + [4096] + [6] * 500)
    steps = list(resample._steps(lengths, 4194))
    assert [i for i, _ in steps] == [0, *np.cumsum([n for _, n in steps])[:-1]] and sum(n for _, n in steps) == len(lengths)
    assert all(n == 1 or lengths[i : i + n].sum() <= 4194 for i, n in steps) and len(steps) == 3


def test_f7_number_keys_meet_no_text_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (1, " b"), (None, "")], "n bigint, t string")
    found = {r["check"]: r["violations"] for r in check_key(rows, ["n"], "rows").collect()}
    assert found["null_key"] == 1 and found["duplicate_key"] == 1 and not found.get("blank_key") and not found.get("padded_key")
    assert "RLIKE" not in _plan(check_key(rows, ["n"], "rows"))
    both = {r["check"]: r["violations"] for r in check_key(rows, ["n", "t"], "rows").collect()}
    assert both["blank_key"] == 1 and both["padded_key"] == 1 and both["null_key"] == 1


def test_f7_no_source_equals_a_source_without_verdicts(spark):
    targets = spark.createDataFrame([(1, "a", 1), (2, "a", None)], "id bigint, target string, value int")
    folds = spark.createDataFrame([(1, 7, 0), (2, 8, 1)], "id bigint, group_id bigint, fold int")
    kinds = "id bigint, target string, score double, conf double, verdict string"
    nulls, none = spark.createDataFrame([(1, "a", None, None, None), (2, "a", None, None, None)], kinds), spark.createDataFrame([], kinds)
    made = [sorted(map(str, weak.fuse_labels(targets, d, folds, "none", validate=False).collect())) for d in (nulls, none)]
    assert made[0] == made[1] and len(made[0]) == 2
