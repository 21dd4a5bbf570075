import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators.ordering import join_lookup, quantiles, ranked, tied, top_k


def skewed(spark, n=4000):
    """One key holds more than a third of the rows, hundreds hold a few."""
    rng = random.Random(3)
    rows = [("hot" if i % 5 < 2 else f"k{i % 300}", i, rng.randrange(50), f"s{rng.randrange(40):02d}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, id long, v long, s string").repartition(7)


def expected(df, order):
    rows = df.collect()
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r["k"], []).append(r)
    for members in groups.values():
        total = 0
        for i, r in enumerate(sorted(members, key=lambda r: tuple(r[o] for o in order))):
            out[r["id"]] = (i + 1, len(members), total)
            total += r["v"]
    return out


@pytest.mark.parametrize("order", [["id"], ["v", "id"], ["s", "id"]])
@pytest.mark.parametrize("sizing", [{}, {"min_rows": 1, "buckets": 16}, {"min_rows": 1, "buckets": 64}, {"min_rows": 200, "buckets": 3}])
def test_ranked_equals_plain_sort_for_any_boundaries(spark, order, sizing):
    df = skewed(spark)
    got = {r["id"]: (r["rn"], r["n"], r["before_v"]) for r in ranked(df, ["k"], order, {"v": "v"}, **sizing).collect()}
    assert got == expected(df, order)


def test_hot_key_is_split_and_cold_keys_are_not(spark):
    plan = ranked(skewed(spark), ["k"], ["id"], min_rows=100, buckets=16)._jdf.queryExecution().toString()
    assert "_bucket" in plan and "Broadcast" in plan
    plain = ranked(skewed(spark), ["k"], ["id"])._jdf.queryExecution().toString()
    assert "_bucket" not in plain


def test_ranked_on_whole_table_empty_and_single(spark):
    df = skewed(spark)
    got = ranked(df, [], ["id"], min_rows=1, buckets=32).collect()
    assert sorted(r["rn"] for r in got) == list(range(1, 4001)) and {r["n"] for r in got} == {4000}
    assert ranked(df.filter("false"), ["k"], ["id"], min_rows=0).count() == 0
    one = ranked(df.filter("id = 7"), ["k"], ["id"], min_rows=0).collect()
    assert [(r["rn"], r["n"]) for r in one] == [(1, 1)]


def test_ranked_null_key_and_repartition(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    a = {r["id"]: r["rn"] for r in ranked(df.repartition(3), ["k"], ["id"], min_rows=1, buckets=16).collect()}
    b = {r["id"]: r["rn"] for r in ranked(df.repartition(11, "v"), ["k"], ["id"], min_rows=1, buckets=40).collect()}
    assert a == b


def test_all_tied_values_are_one_row(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1.5).alias("v"))
    rows = tied(df, ["k"], "v", min_rows=1).collect()
    assert len(rows) == 1 and rows[0]["rows"] == 1000 and rows[0]["before_rows"] == 0


@pytest.mark.parametrize("sizing", [{}, {"min_rows": 1, "buckets": 16}])
def test_quantiles_are_linear(spark, sizing):
    df = skewed(spark)
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for r in quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], **sizing).collect():
        assert r["value"] == pytest.approx(np.quantile(values[r["k"]], r["q"]))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup_keeps_every_row(spark, how):
    df = skewed(spark)
    lookup = df.groupBy("k").agg(F.sum("v").alias("t")).filter("k <> 'k7'")
    got = join_lookup(df, lookup, ["k"], ["id"], how).select("id", "t").collect()
    plain = df.join(lookup, "k", how).select("id", "t").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain), key=str)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        with pytest.raises(ValueError, match="skewJoin"):
            join_lookup(df, lookup, ["k"], ["id"], how)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_top_k_is_exact(spark):
    df = skewed(spark)
    got = top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 3, ["id"]).select("k", "id", "place").collect()
    best = {}
    for r in sorted(df.collect(), key=lambda r: (-r["v"], r["id"])):
        best.setdefault(r["k"], []).append(r["id"])
    assert {(r["k"], r["place"]): r["id"] for r in got} == {(k, i + 1): x for k, ids in best.items() for i, x in enumerate(ids[:3])}
