"""Strict forms: ids without slots, foreign vectors, drifting records, groups as units."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import features as G
from evalloom.operators import heads as H
from evalloom.operators.checks import ContractError
from evalloom.plans import jobs as J
from evalloom.queries.features import attention_params

VECTORS = "id string, plane string, window int, vec array<double>"


def test_scoring_needs_slots_of_known_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("a", "Top", 0, [1.0, 2.0]), ("a", "Top", 1, [3.0, 2.0]), ("b", "Side", 0, [0.0, 1.0])], VECTORS)
    head = [H.Head("f", -1, "t", 0.5, [1.0, 0.0, 0.0, 2.0, 0.0, 0.0], [0.0] * 6, [1.0] * 6, 0, 0, [])]
    got = [tuple(r) for r in H.score_new_vectors(ids, rows, head, 2, ["Top", "Side"], 2).orderBy("row_idx").collect()]
    assert [r[:4] for r in got] == [(0, "a", "f", "t"), (1, "b", "f", "t")]
    assert [r[4] for r in got] == pytest.approx([1 / (1 + 2.718281828459045 ** -(0.5 + 2.0)), 1 / (1 + 2.718281828459045 ** -(0.5 + 2.0))])
    for bad_ids, bad_rows in ((ids, rows.filter("id = 'a'")), (ids.filter("id = 'a'"), rows), (ids.union(ids), rows)):
        with pytest.raises(ContractError):
            H.score_new_vectors(bad_ids, bad_rows, head, 2, ["Top", "Side"], 2)


def test_attention_of_an_id_without_slots(spark):
    rows = spark.createDataFrame([("a", 0, 0, [0.1] * 64)], "id string, plane int, window int, vec array<double>")
    ids = spark.createDataFrame([("a",), ("gone",)], "id string")
    assert G.attention_pool(rows, attention_params(), ids=ids.filter("id = 'a'")).count() == 2
    with pytest.raises(Exception, match="no usable slot"):
        G.attention_pool(rows, attention_params(), ids=ids).collect()


def test_groups_as_units_and_recorded_values(spark):
    cells = [(m, i % 2, f"s{i:02d}", "t", (i // 2) % 2, 0.8 * ((i // 2) % 2) + 0.1 if m == "a" else (i * 7 % 5) / 5) for i in range(16) for m in ("a", "b")]
    rows = spark.createDataFrame(cells, "model string, fold int, id string, target string, y int, p double")
    folds = rows.select("id", F.concat(F.lit("g"), (F.substring("id", 2, 2).cast("int") % 6).cast("string")).alias("group_id"), "fold").distinct()
    args = (rows, folds, [("a", "b")], 2, 1, 30, 7)
    with pytest.raises(ContractError):
        J.paired_oof_analysis(*args)
    digests = spark.createDataFrame([("x", "1")], "path string, sha256 string")
    true = spark.createDataFrame([("a", 1.0)], "model string, mean_macro_auc double")
    report, _ = J.paired_oof_analysis(*args, by_group=True, manifest=(digests, digests), tolerance=2.0, recorded=true.union(spark.createDataFrame([("b", 0.5)], true.schema)))
    assert report.filter("section = 'intervals' AND metric = 'attempted'").first()["value"] == 30
    with pytest.raises(ContractError, match="drift"):
        J.paired_oof_analysis(*args, by_group=True, recorded=true.union(spark.createDataFrame([("b", 9.0)], true.schema)))
    with pytest.raises(ContractError, match="changed"):
        J.paired_oof_analysis(*args, by_group=True, manifest=(digests, digests.withColumn("sha256", F.lit("2"))))
    with pytest.raises(ContractError, match="missing"):
        J.paired_oof_analysis(rows.filter("model = 'a' OR id <> 's03'"), *args[1:], by_group=True)
