"""Profiles of targets, children, texts and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.features import count_features
from ..operators.labels import supervision
from .base import FOLDS, TARGETS, event_series, fold_targets, label_table, query, r6, table, targets


@query("""
    SELECT count(*) FILTER (WHERE k = 2) AS fully_labeled, count(*) FILTER (WHERE k = 1) AS partially_labeled,
           count(*) FILTER (WHERE k = 0) AS unlabeled FROM (SELECT id, count(value) AS k FROM targets GROUP BY id)""", uses="targets")
def label_completeness(spark, sf):
    return P.label_completeness(targets(spark, sf), len(TARGETS))


@query("""
    SELECT target, count(value) AS observed, count(*) - count(value) AS unknown, count(*) FILTER (WHERE value = 1) AS positive,
           count(*) FILTER (WHERE value = 0) AS negative, round(avg(value), 6) AS prevalence FROM targets GROUP BY target""", uses="targets")
def target_summary(spark, sf):
    return P.target_summary(targets(spark, sf)).withColumn("prevalence", r6("prevalence"))


COOCCURRENCE = """
    SELECT a.target AS target_a, b.target AS target_b, count(*) FILTER (WHERE {met}) AS n
    FROM targets a JOIN targets b ON a.id = b.id GROUP BY a.target, b.target"""


@query(COOCCURRENCE.format(met="a.value = 1 AND b.value = 1"), uses="targets")
def positive_cooccurrence(spark, sf):
    return P.cooccurrence(targets(spark, sf), TARGETS, "positive")


@query(COOCCURRENCE.format(met="a.value IS NOT NULL AND b.value IS NOT NULL"), uses="targets")
def observed_cooccurrence(spark, sf):
    return P.cooccurrence(targets(spark, sf), TARGETS, "observed")


@query("""
    SELECT 'plane' AS "column", plane AS value, count(*) AS n FROM event_series GROUP BY plane
    UNION ALL SELECT 'fluid', fluid::VARCHAR, count(*) FROM event_series GROUP BY fluid
    UNION ALL SELECT 'quality', l.quality::VARCHAR, count(*) FROM event_series e LEFT JOIN labels l ON l.doc_id = e.id GROUP BY l.quality""", uses="event_series")
def value_frequency(spark, sf):
    rows = event_series(spark, sf).withColumn("plane", F.lower("plane"))
    rows = rows.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    return P.value_frequency(rows, ["plane", "fluid", "quality"])


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def keys_by_category(spark, sf):
    return P.keys_by_category(table(spark, sf, "events"), "event_type", "user_id")


@query("""
    WITH c AS (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_orderkey)
    SELECT unnest(['count', 'mean', 'std', 'min', 'max', 'q0.25', 'q0.5', 'q0.75']) AS metric,
           unnest([count(*)::DOUBLE, round(avg(n), 6), round(stddev_samp(n), 6), min(n), max(n), round(quantile_cont(n, 0.25), 6),
                   round(quantile_cont(n, 0.5), 6), round(quantile_cont(n, 0.75), 6)]) AS value FROM c""")
def children_per_parent(spark, sf):
    return P.children_per_parent(table(spark, sf, "lineitem"), "l_orderkey").withColumn("value", r6("value"))


@query("""
    WITH d AS (SELECT n_chars::DOUBLE AS n, unnest(['all', (l.doc_id IS NOT NULL)::VARCHAR]) AS scope FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT scope, unnest(['count', 'mean', 'std', 'min', 'max', 'q0.05', 'q0.25', 'q0.5', 'q0.75', 'q0.95']) AS metric,
           unnest([count(*)::DOUBLE, round(avg(n), 4), round(stddev_samp(n), 4), min(n), max(n), round(quantile_cont(n, 0.05), 4), round(quantile_cont(n, 0.25), 4),
                   round(quantile_cont(n, 0.5), 4), round(quantile_cont(n, 0.75), 4), round(quantile_cont(n, 0.95), 4)]) AS value FROM d GROUP BY scope""")
def text_length_profile(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left")
    docs = docs.select("text", F.coalesce("l", F.lit(False)).alias("labeled"))
    return P.text_length_profile(docs, "text", "labeled").withColumn("value", F.round("value", 4))


@query(r"""
    SELECT count(*) FILTER (WHERE regexp_matches(text, '[\x{0400}-\x{04ff}]')) AS containing_cyrillic,
           count(*) FILTER (WHERE regexp_matches(text, '[\x{4e00}-\x{9fff}]')) AS containing_cjk,
           count(*) FILTER (WHERE regexp_matches(text, '[^\x00-\x7f]')) AS containing_non_ascii FROM documents""")
def script_counts(spark, sf):
    return P.script_counts(table(spark, sf, "documents"), "text")


@query("""
    SELECT count(*) FILTER (WHERE fluid <> fat) = 0 AS equal, 'flags' AS pair FROM event_series
    UNION ALL SELECT count(*) FILTER (WHERE n_chars <> length(text)) = 0, 'lengths' FROM documents""", uses="event_series")
def columns_equal(spark, sf):
    docs = table(spark, sf, "documents").select("n_chars", F.length("text").alias("measured"))
    return P.columns_equal(event_series(spark, sf), "fluid", "fat").withColumn("pair", F.lit("flags")).unionByName(
        P.columns_equal(docs, "n_chars", "measured").withColumn("pair", F.lit("lengths"))
    )


@query("SELECT count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing_cells FROM targets", uses="targets")
def missing_cells(spark, sf):
    return P.missing_cells(targets(spark, sf), ["id", "target", "value"])


@query(r"SELECT count(*) FILTER (WHERE regexp_matches(text, '\S')) AS nonblank FROM documents")
def nonblank_count(spark, sf):
    return P.nonblank_count(table(spark, sf, "documents"), "text")


@query("""
    SELECT fold, target, count(value) AS observed, count(*) FILTER (WHERE value = 1) AS positive, count(*) FILTER (WHERE value = 0) AS negative
    FROM fold_targets GROUP BY fold, target""", uses="fold_targets")
def fold_support(spark, sf):
    return P.fold_support(fold_targets(spark, sf), FOLDS, TARGETS)


@query("""
    SELECT fold, count(*) AS ids, count(*) FILTER (WHERE k > 0) AS labeled
    FROM (SELECT fold, id, count(value) AS k FROM fold_targets GROUP BY fold, id) GROUP BY fold""", uses="fold_targets")
def fold_sizes(spark, sf):
    return P.fold_sizes(fold_targets(spark, sf))


@query("""
    WITH q AS (SELECT user_id, count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND value > 60 THEN event_type END) AS usable_planes,
                      count(*) FILTER (WHERE value > 100) AS large, count(*) FILTER (WHERE value < 1) AS tiny FROM events GROUP BY user_id)
    SELECT unnest(['large', 'tiny', 'ids_with_missing_planes', 'ids_with_zero_usable_planes']) AS metric,
           unnest([sum(large)::BIGINT, sum(tiny)::BIGINT, count(*) FILTER (WHERE usable_planes < 3), count(*) FILTER (WHERE usable_planes = 0)]) AS value FROM q""")
def quality_totals(spark, sf):
    kinds = F.when(F.col("event_type").isin("click", "view", "error") & (F.col("value") > 60), F.col("event_type"))
    quality = table(spark, sf, "events").groupBy("user_id").agg(
        F.countDistinct(kinds).alias("usable_planes"), F.count_if(F.col("value") > 100).alias("large"), F.count_if(F.col("value") < 1).alias("tiny")
    )
    return P.quality_totals(quality, ["large", "tiny"])


@query("""
    WITH x AS (SELECT t.id, d.lang, d.n_chars // 500 AS size, t.target, t.value FROM targets t JOIN documents d ON d.doc_id = t.id),
    g AS (SELECT lang, size, count(DISTINCT id) AS n FROM x GROUP BY lang, size),
    c AS (SELECT lang, size, max((hi > lo)::INT) AS conflict FROM (SELECT lang, size, target, max(value) AS hi, min(value) AS lo FROM x GROUP BY lang, size, target)
          GROUP BY lang, size)
    SELECT count(*) AS profiles, count(*) FILTER (WHERE n > 1) AS repeated_profiles, count(*) FILTER (WHERE n > 1 AND conflict = 1) AS conflicting_profiles,
           max(n) AS largest_profile FROM g JOIN c USING (lang, size)""", uses="targets")
def profile_conflicts(spark, sf):
    features = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.floor(F.col("n_chars") / 500).alias("size"))
    return P.profile_conflicts(features, ["lang", "size"], targets(spark, sf))


LINES = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}


@query("""
    WITH x AS (SELECT o.o_orderkey, count(l.l_orderkey)::DOUBLE AS total, count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS a,
                      count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS f FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
    SELECT unnest(['total', 'total', 'total', 'l_returnflag_A', 'l_returnflag_A', 'l_linestatus_F']) AS a,
           unnest(['total', 'l_returnflag_A', 'l_linestatus_F', 'l_returnflag_A', 'l_linestatus_F', 'l_linestatus_F']) AS b,
           unnest([sum(total * total), sum(total * a), sum(total * f), sum(a * a), sum(a * f), sum(f * f)]) AS gram FROM x""")
def feature_gram(spark, sf):
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linestatus")
    return P.feature_gram(count_features(parents, children, LINES), ["total", "l_returnflag_A", "l_linestatus_F"])


@query("""
    SELECT target, count(observed) AS observed_cells, count(*) FILTER (WHERE observed IS NULL AND mask) AS derived_cells
    FROM label_table GROUP BY target""", uses="label_table")
def target_source_counts(spark, sf):
    return P.target_source_counts(supervision(label_table(spark, sf), 0.25))
