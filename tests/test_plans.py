"""What the plans must and must not contain."""

import os
import re

import pytest

from evalloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")

LAZY = ["count_features", "target_summary", "fold_support", "auc_by_fold", "percentile_ranks", "key_overlap_audit", "sampled_slices", "exact_quantiles", "grouped_folds", "fused_labels"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_product_and_no_window_without_key(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for window in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        assert "ASC" not in window and "DESC" not in window, window


def test_text_is_not_read_for_counts(spark):
    plan = QUERIES["projected_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>", plan)


def test_sources_use_no_local_checkpoint_or_cross_join():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "evalloom")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "localCheckpoint" not in text and "crossJoin" not in text
