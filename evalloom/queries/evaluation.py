"""Scores, resampling, errors, decisions, ranks and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blend as B
from ..operators import evaluate as E
from ..operators import resample as R
from ..operators.checks import union
from ..session import reuse
from .base import FOLDS, TARGETS, fold_targets, gold_scores, predictions, query, r6, table
from .contracts import check_sql, key_sql

REPLICATES = 1000
RESAMPLE_SEED = 20260916
PAIRS = [("wide", "coarse"), ("wide", "flat")]


@query("SELECT model, fold, target, positive, negative, round(auc, 8) AS auc FROM auc_scores", uses="auc_scores")
def auc_by_fold(spark, sf):
    return E.auc(gold_scores(spark, sf), ["model", "fold", "target"]).withColumn("auc", F.round("auc", 8))


@query("""
    SELECT l_linestatus AS grp, count(*) FILTER (WHERE y = 1) AS positive, count(*) FILTER (WHERE y = 0) AS negative,
           round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
                 / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)), 8) AS auc
    FROM (SELECT l_linestatus, (l_returnflag = 'R')::INT AS y,
                 rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem)
    GROUP BY l_linestatus""")
def auc_of_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return E.auc(rows, ["grp"]).withColumn("auc", F.round("auc", 8))


@query("""
    SELECT model, round(avg(m), 8) AS mean_macro_auc, round(stddev_samp(m), 8) AS std_macro_auc, count(*) AS folds
    FROM (SELECT model, fold, avg(auc) AS m FROM auc_scores GROUP BY model, fold) GROUP BY model""", uses="auc_scores")
def fold_summary(spark, sf):
    out = E.fold_summary(E.auc(gold_scores(spark, sf), ["model", "fold", "target"]))
    return out.withColumn("mean_macro_auc", F.round("mean_macro_auc", 8)).withColumn("std_macro_auc", F.round("std_macro_auc", 8))


_BRIER = "SELECT model, target, avg(b) AS brier FROM (SELECT model, fold, target, avg((p - y) * (p - y)) AS b FROM gold_scores GROUP BY model, fold, target) GROUP BY model, target"


@query(f"SELECT model, target, round(brier, 6) AS brier FROM ({_BRIER})", uses="gold_scores")
def brier_scores(spark, sf):
    return E.brier(gold_scores(spark, sf)).withColumn("brier", r6("brier"))


_DRAWS = f"""
    u AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY id) - 1 AS at, count(*) OVER (PARTITION BY fold) AS n FROM (SELECT DISTINCT fold, id FROM gold_scores)),
    k AS (SELECT r.r AS replicate, u.fold, ('0x' || substr(sha256('{RESAMPLE_SEED}:' || r.r || ':' || u.fold || ':' || u.at), 1, 15))::BIGINT % u.n AS at
          FROM u CROSS JOIN range({REPLICATES}) r(r)),
    m AS (SELECT k.replicate, u.fold, u.id FROM k JOIN u ON u.fold = k.fold AND u.at = k.at),
    d AS (SELECT m.replicate, g.model, g.fold, g.target, g.y, rank() OVER w + (count(*) OVER (PARTITION BY m.replicate, g.model, g.fold, g.target, g.p) - 1) / 2.0::DOUBLE AS r
          FROM m JOIN gold_scores g ON g.fold = m.fold AND g.id = m.id WINDOW w AS (PARTITION BY m.replicate, g.model, g.fold, g.target ORDER BY g.p)),
    a AS (SELECT replicate, model, fold, target, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) END AS auc
          FROM d GROUP BY replicate, model, fold, target),
    v AS (SELECT replicate FROM a WHERE model = 'wide' GROUP BY replicate HAVING count(auc) = {len(FOLDS) * len(TARGETS)}),
    t AS (SELECT replicate, target, model, avg(auc) AS s FROM a JOIN v USING (replicate) GROUP BY replicate, target, model),
    p AS (SELECT x.replicate, x.model || '_minus_' || y.model AS pair, x.target, x.s - y.s AS difference FROM t x JOIN t y ON y.replicate = x.replicate AND y.target = x.target
          WHERE x.model = 'wide' AND y.model IN ('coarse', 'flat')),
    boot AS (SELECT replicate, pair, target, difference FROM p UNION ALL SELECT replicate, pair, 'macro', avg(difference) FROM p GROUP BY replicate, pair)"""


@query(f"WITH {_DRAWS} SELECT replicate::INT AS replicate, pair, target, round(difference, 8) AS difference FROM boot", uses="gold_scores")
def paired_bootstrap(spark, sf):
    out = R.paired_bootstrap(reuse(gold_scores(spark, sf)), PAIRS, len(FOLDS), len(TARGETS), REPLICATES, RESAMPLE_SEED, exact=True)
    return out.select("replicate", "pair", "target", F.round("difference", 8).alias("difference"))


@query(f"""
    WITH {_DRAWS} SELECT pair, target, round(quantile_cont(difference, 0.025), 6) AS low, round(quantile_cont(difference, 0.975), 6) AS high, count(*) AS accepted, {REPLICATES}::BIGINT AS attempted
    FROM boot GROUP BY pair, target""", uses="gold_scores")
def bootstrap_interval(spark, sf):
    draws = R.paired_bootstrap(reuse(gold_scores(spark, sf)), PAIRS, len(FOLDS), len(TARGETS), REPLICATES, RESAMPLE_SEED, exact=True)
    out = R.percentile_interval(draws, REPLICATES, R.interval_cells(PAIRS, TARGETS))
    return out.withColumn("low", r6("low")).withColumn("high", r6("high"))


@query("""
    WITH e AS (SELECT *, (p - y) * (p - y) AS squared_error FROM gold_scores),
    t AS (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY squared_error DESC, id)::INT AS place FROM e WHERE model <> 'flat')
    SELECT t.model, t.fold, t.id, t.target, t.y, t.p, round(t.squared_error, 6) AS squared_error, t.place, f.p AS flat_p, round(t.squared_error - f.squared_error, 6) AS brier_minus_flat
    FROM t JOIN e f ON f.id = t.id AND f.target = t.target AND f.model = 'flat' WHERE place <= 5""", uses="gold_scores")
def largest_errors(spark, sf):
    out = E.largest_errors(gold_scores(spark, sf), 5, ["flat"], ["wide", "coarse"])
    return out.withColumn("squared_error", r6("squared_error")).withColumn("brier_minus_flat", r6("brier_minus_flat"))


@query("""
    SELECT model, id, round(error, 6) AS error, targets, place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(error, 12) DESC, id)::INT AS place FROM (
      SELECT model, id, avg((p - y) * (p - y)) AS error, count(*) AS targets FROM gold_scores GROUP BY model, id)) WHERE place <= 10""", uses="gold_scores")
def study_errors(spark, sf):
    return E.study_error(gold_scores(spark, sf), 10).withColumn("error", r6("error"))


@query("""
    SELECT model, target, count(*) FILTER (WHERE (p < 0.01 AND y = 1) OR (p > 0.99 AND y = 0)) AS confidently_wrong, round(avg(p), 6) AS mean_probability,
           round(avg(y), 6) AS prevalence, count(*) FILTER (WHERE p < 0.05 OR p > 0.95) AS extreme, count(*) AS cells FROM gold_scores GROUP BY model, target""", uses="gold_scores")
def calibration_profile(spark, sf):
    out = E.calibration_profile(gold_scores(spark, sf))
    return out.withColumn("mean_probability", r6("mean_probability")).withColumn("prevalence", r6("prevalence"))


@query("""
    SELECT round(max(abs(a.p - b.p)), 6) AS max_abs_difference, count(*) FILTER (WHERE abs(a.p - b.p) > 0.3 + 0.1 * abs(b.p)) AS beyond_tolerance,
           count(*) FILTER (WHERE a.id IS NULL) AS missing_a, count(*) FILTER (WHERE b.id IS NULL) AS missing_b, count(*) AS cells
    FROM (SELECT * FROM predictions WHERE model = 'wide') a FULL JOIN (SELECT id, target, p FROM gold_scores WHERE model = 'coarse') b ON a.id = b.id AND a.target = b.target""", uses="gold_scores")
def prediction_parity(spark, sf):
    a = predictions(spark, sf).filter("model = 'wide'")
    return E.prediction_parity(a, gold_scores(spark, sf).filter("model = 'coarse'"), 0.3, 0.1).withColumn("max_abs_difference", r6("max_abs_difference"))


@query("""
    WITH f AS (SELECT model, fold, avg(auc) AS m FROM auc_scores GROUP BY model, fold)
    SELECT c.model AS control, round(avg(w.m) - avg(c.m), 8) AS mean_delta, count(*) FILTER (WHERE w.m > c.m) AS folds_improved,
           avg(w.m) > avg(c.m) AND count(*) FILTER (WHERE w.m > c.m) >= 2 AS passes
    FROM f c JOIN f w ON w.fold = c.fold AND w.model = 'wide' WHERE c.model <> 'wide' GROUP BY c.model""", uses="auc_scores")
def promotion_rule(spark, sf):
    macro = E.fold_macro(E.auc(gold_scores(spark, sf), ["model", "fold", "target"]))
    return E.promotion_rule(macro, "wide", ["coarse", "flat"]).withColumn("mean_delta", F.round("mean_delta", 8))


@query(f"""
    WITH a AS (SELECT model, target, avg(auc) AS a FROM auc_scores GROUP BY model, target), x AS (SELECT * FROM a JOIN ({_BRIER}) b USING (model, target))
    SELECT w.model || '_minus_' || c.model AS pair, w.target, round(w.a - c.a, 8) AS auc_difference, round(w.brier - c.brier, 6) AS brier_difference
    FROM x w JOIN x c ON c.target = w.target WHERE w.model = 'wide' AND c.model <> 'wide'""", uses="auc_scores")
def target_deltas(spark, sf):
    rows = gold_scores(spark, sf)
    out = E.target_deltas(E.target_means(E.auc(rows, ["model", "fold", "target"])), E.brier(rows), PAIRS)
    return out.withColumn("auc_difference", F.round("auc_difference", 8)).withColumn("brier_difference", r6("brier_difference"))


@query(check_sql(
    *key_sql("predictions", "(SELECT id, target FROM predictions WHERE model = 'wide')", "id", "target"),
    ("missing_right", "predictions = gold", "SELECT count(*) FROM predictions p WHERE model = 'wide' AND NOT EXISTS (SELECT 1 FROM gold_scores g WHERE g.id = p.id AND g.target = p.target)"),
    ("missing_left", "predictions = gold", "SELECT 0"),
), uses="gold_scores")
def oof_coverage(spark, sf):
    gold = fold_targets(spark, sf).filter("value is not null")
    return E.oof_coverage(predictions(spark, sf).filter("model = 'wide'"), gold)


_RANKS = """
    SELECT model, id, target, (rank() OVER w + (count(*) OVER (PARTITION BY model, target, p) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model, target) AS pct_rank
    FROM predictions WINDOW w AS (PARTITION BY model, target ORDER BY p)"""


@query(f"SELECT model, id, target, round(pct_rank, 8) AS pct_rank FROM ({_RANKS})", uses="predictions")
def percentile_ranks(spark, sf):
    return B.percentile_rank(predictions(spark, sf), ["model", "target"]).select("model", "id", "target", F.round("pct_rank", 8).alias("pct_rank"))


def ids(spark, sf):
    return B.with_row_idx(table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query("""
    SELECT row_number() OVER (PARTITION BY target ORDER BY id) - 1 AS row_idx, id, target, p FROM predictions WHERE model = 'wide'""", uses="predictions")
def aligned_component(spark, sf):
    preds = predictions(spark, sf).filter("model = 'wide'").drop("model")
    return B.align_component(ids(spark, sf), preds, TARGETS)


_BLEND = f"""
    SELECT id, target, sum(pct_rank * CASE model WHEN 'wide' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END) AS p FROM ({_RANKS}) WHERE model IN ('wide', 'coarse') GROUP BY id, target"""


@query(f"SELECT id, target, round(p, 8) AS p FROM ({_BLEND})", uses="predictions")
def rank_blend(spark, sf):
    preds = predictions(spark, sf)
    parts = {m: preds.filter(F.col("model") == m).drop("model") for m in ("wide", "coarse")}
    return B.rank_blend(parts, {"wide": 0.9, "coarse": 0.1}).withColumn("p", F.round("p", 8))


@query("""
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id AS id, 0.5::DOUBLE AS quality, 0.125::DOUBLE AS toxic FROM documents""")
def constant_submission(spark, sf):
    return B.constant_submission(ids(spark, sf), {"quality": 0.5, "toxic": 0.125})


@query(check_sql(
    ("schema", "submission", "SELECT 0"), *key_sql("submission", "documents", "doc_id"), ("order", "submission", "SELECT 0"),
    ("probability:quality", "submission", "SELECT count(*) FROM predictions WHERE model = 'wide' AND target = 'quality' AND (p * 1.25 > 1)"),
    ("probability:toxic", "submission", "SELECT count(*) FROM predictions WHERE model = 'wide' AND target = 'toxic' AND (p * 1.25 > 1)"),
), uses="predictions")
def submission_checks(spark, sf):
    template = B.constant_submission(ids(spark, sf), {t: 0.5 for t in TARGETS})
    wide = B.to_wide(predictions(spark, sf).filter("model = 'wide'"), TARGETS)
    scaled = wide.select("id", *[(F.col(t) * 1.25).alias(t) for t in TARGETS])
    sub = template.select("row_idx", "id").join(scaled, "id").select("row_idx", "id", *TARGETS)
    return B.check_submission(sub, template, TARGETS)


@query(f"SELECT id, target, round(p, 8) AS p FROM ({_BLEND})", uses="predictions")
def gated_blend(spark, sf):
    """Members of a component are the document sources; its digest is the text digest count."""
    preds, everything = predictions(spark, sf), ids(spark, sf)
    parts = {m: preds.filter(F.col("model") == m).drop("model") for m in ("wide", "coarse")}
    docs = table(spark, sf, "documents")
    check = component_record(spark, sf, docs, everything, "wide")
    return B.blend_gate([check], everything, parts, {"wide": 0.9, "coarse": 0.1}).withColumn("p", F.round("p", 8))


def component_record(spark, sf, docs, everything, component):
    """A component's manifest and members as recorded from the rows, against the same found again by way of each source's languages."""
    named = lambda df: df.select(F.lit(component).alias("component"), F.col("source").alias("id"), F.sha2("source", 256).alias("sha256"), "windows")
    digest = lambda total: F.sha2(total.cast("string"), 256)
    members = named(docs.groupBy("source").agg(F.count(F.lit(1)).alias("windows")))
    parts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    expected = named(parts.groupBy("source").agg(F.sum("n").alias("windows")))
    facts = docs.agg(F.count(F.lit(1)).alias("rows"), digest(F.sum("n_chars")).alias("digest"))
    found = parts.agg(digest(F.sum("chars")).alias("found_digest"))
    manifest = facts.join(found).select(F.lit(component).alias("component"), F.lit("complete").alias("status"), "rows", "digest", "found_digest")  # one row each
    return B.check_component(manifest, members, expected, everything, 20)


@query("""
    SELECT 'status' AS "check", 'manifest' AS subject, 1::BIGINT AS violations UNION ALL SELECT 'rows', 'manifest', 1 UNION ALL SELECT 'digest', 'manifest', 1
    UNION ALL SELECT 'member_count', 'members', 1 UNION ALL SELECT 'missing_right', 'members = expected', 0
    UNION ALL SELECT 'missing_left', 'members = expected', count(DISTINCT source) FILTER (WHERE source = 'src0') FROM documents
    UNION ALL SELECT 'missing_right', 'manifest = expected', 0 UNION ALL SELECT 'missing_left', 'manifest = expected', 0
    UNION ALL SELECT 'empty', 'manifest', 0 UNION ALL SELECT 'null_key', 'manifest', 0 UNION ALL SELECT 'blank_key', 'manifest', 0
    UNION ALL SELECT 'padded_key', 'manifest', 0 UNION ALL SELECT 'duplicate_key', 'manifest', 0""")
def broken_gate(spark, sf):
    """What the gate reports of a component without status and row count, with another digest, and with a member missing."""
    docs = table(spark, sf, "documents")
    members = docs.groupBy("source").agg(F.count(F.lit(1)).alias("windows")).select(F.lit("wide").alias("component"), F.col("source").alias("id"), F.sha2("source", 256).alias("sha256"), "windows")
    manifest = docs.agg(F.sha2(F.sum("n_chars").cast("string"), 256).alias("digest")).select(
        F.lit("wide").alias("component"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("bigint").alias("rows"), "digest", F.lit("other").alias("found_digest")
    )
    return B.check_component(manifest, members.filter("id <> 'src0'"), members, ids(spark, sf), 20)
