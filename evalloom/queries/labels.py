"""Label fusion, supervision and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as W
from ..operators.ordering import join_rows
from .base import derived, folds, label_table, members, predictions, query, r6, table, targets
from .contracts import check_sql


@query("SELECT id, group_id, fold, target, value, observed, derived, verdict, confidence, mask, source FROM label_table", uses="label_table")
def fused_labels(spark, sf):
    keyed = members(spark, sf)
    known, weak = (join_rows(df, keyed.select("id"), ["id"], "left_semi") for df in (targets(spark, sf), derived(spark, sf)))
    return W.fuse_labels(known, weak, folds(spark, sf), "lengths-v1", groups=keyed)


@query("""
    SELECT target, count(observed) AS observed, count(*) FILTER (WHERE verdict = 'YES') AS verdict_yes, count(*) FILTER (WHERE verdict = 'NO') AS verdict_no,
           count(*) FILTER (WHERE verdict = 'UNK') AS verdict_unk, count(*) FILTER (WHERE observed IS NULL AND verdict IN ('YES', 'NO') AND confidence > 0) AS added,
           count(*) FILTER (WHERE NOT mask) AS masked,
           count(*) FILTER (WHERE observed IS NOT NULL AND verdict IN ('YES', 'NO') AND confidence > 0) AS agreement_denominator,
           count(*) FILTER (WHERE observed IS NOT NULL AND verdict IN ('YES', 'NO') AND confidence > 0 AND observed = (verdict = 'YES')::INT) AS agreement_matches
    FROM label_table GROUP BY target""", uses="label_table")
def label_source_audit(spark, sf):
    return W.label_source_audit(label_table(spark, sf))


_SUPERVISION = """
    SELECT id, fold, target, observed, verdict, derived, confidence, CASE WHEN mask THEN value ELSE 0 END::DOUBLE AS y,
           CASE WHEN observed IS NOT NULL THEN 1.0 WHEN mask THEN 0.25 ELSE 0.0 END::DOUBLE AS weight FROM label_table"""


@query(f"SELECT id, fold, target, observed, verdict, derived, y, weight FROM ({_SUPERVISION})", uses="label_table")
def weighted_supervision(spark, sf):
    return W.supervision(label_table(spark, sf), 0.25)


@query("""
    SELECT id, fold, target, observed, verdict, derived, COALESCE(observed, 0)::DOUBLE AS y, CASE WHEN observed IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS weight
    FROM label_table""", uses="label_table")
def gold_supervision(spark, sf):
    return W.supervision(label_table(spark, sf), 0.0)


@query(f"""
    SELECT id, fold, target, observed, verdict, derived, CASE WHEN weight = 0.25 THEN derived ELSE y END AS y, weight FROM ({_SUPERVISION})""", uses="label_table")
def soft_targets(spark, sf):
    rows = W.supervision(label_table(spark, sf), 0.25)
    W.enforce(W.check_soft_targets(rows))
    return W.soft_targets(rows)


@query(f"""
    SELECT round(sum(weight * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / count(*), 6) AS loss
    FROM (SELECT s.*, 4 * p.p - 2 AS z FROM ({_SUPERVISION}) s JOIN predictions p ON p.id = s.id AND p.target = s.target AND p.model = 'wide')""", uses="label_table predictions")
def masked_cross_entropy(spark, sf):
    logits = predictions(spark, sf).filter("model = 'wide'").select("id", "target", (F.col("p") * 4 - 2).alias("logit"))
    rows = W.supervision(label_table(spark, sf), 0.25).join(logits, ["id", "target"])
    return W.masked_bce(rows).withColumn("loss", r6("loss"))


_STATES = ["present", "absent", "unknown"]
_CELLS = ", ".join(f"count(*) FILTER (WHERE a = '{x}' AND b = '{y}') AS {x}_{y}" for x in _STATES for y in _STATES)


@query(f"""
    WITH x AS (SELECT COALESCE(o.target, d.target) AS target, COALESCE(o.lang, d.lang) AS lang, COALESCE(o.state, 'unknown') AS a, COALESCE(d.state, 'unknown') AS b
      FROM (SELECT t.id, t.target, g.lang, CASE t.value WHEN 1 THEN 'present' WHEN 0 THEN 'absent' ELSE 'unknown' END AS state FROM targets t JOIN documents g ON g.doc_id = t.id
            WHERE g.source <> 'src1') o
      FULL JOIN (SELECT d.id, d.target, g.lang, CASE d.verdict WHEN 'YES' THEN 'present' WHEN 'NO' THEN 'absent' ELSE 'unknown' END AS state FROM derived d
                 JOIN documents g ON g.doc_id = d.id) d ON d.id = o.id AND d.target = o.target)
    SELECT target, lang, {_CELLS}, count(*) AS cells, count(*) FILTER (WHERE a <> 'unknown') AS known_a, count(*) FILTER (WHERE b <> 'unknown') AS known_b,
           count(*) FILTER (WHERE a = b) AS three_state_matches, count(*) FILTER (WHERE a <> 'unknown' AND b <> 'unknown') AS both_known,
           count(*) FILTER (WHERE a <> 'unknown' AND b <> 'unknown' AND a = b) AS both_known_matches, count(*) FILTER (WHERE a = 'unknown' AND b <> 'unknown') AS only_b_known,
           count(*) FILTER (WHERE a <> 'unknown' AND b <> 'unknown' AND a <> b) AS opposite, (grouping(target) > 0)::INT AS total
    FROM x GROUP BY GROUPING SETS ((target, lang), ())""", uses="targets derived")
def tristate_agreement(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    state = F.when(F.col("value") == 1, "present").when(F.col("value") == 0, "absent").otherwise("unknown")
    a = targets(spark, sf).join(docs.filter("source <> 'src1'"), "id").select("id", "target", "lang", state.alias("state"))
    verdict = F.when(F.col("verdict") == "YES", "present").when(F.col("verdict") == "NO", "absent").otherwise("unknown")
    b = derived(spark, sf).join(docs, "id").select("id", "target", "lang", verdict.alias("state"))
    return W.tristate_agreement(a, b, ["target", "lang"])


_SPANS = "(SELECT item_id, text, s, substr(text, s::INT + 1, 40) AS evidence FROM (SELECT item_id, text, unnest(range(0, length(text), 40)) AS s FROM benchmark))"


@query(check_sql(
    ("no_text", "evidence", f"SELECT count(*) FROM {_SPANS} WHERE item_id NOT IN (SELECT doc_id FROM documents)"),
    ("evidence", "evidence", f"SELECT count(*) FROM {_SPANS} b JOIN documents d ON d.doc_id = b.item_id WHERE b.evidence <> substr(d.text, b.s::INT + 1, length(b.evidence)::INT)"),
    ("digest", "evidence", f"SELECT count(*) FROM {_SPANS} b JOIN documents d ON d.doc_id = b.item_id WHERE b.text <> d.text"),
))
def foreign_evidence(spark, sf):
    """Whole benchmark texts quoted in spans of 40 characters, against the documents of the same number: mostly wrong."""
    items = table(spark, sf, "benchmark").filter("length(text) > 0")
    spans = items.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(40))).alias("start"))
    evidence = F.substring(F.col("text"), F.col("start") + 1, F.lit(40))
    spans = spans.select(
        F.col("item_id").alias("id"), "start", (F.col("start") + F.length(evidence)).alias("end"), evidence.alias("evidence"), F.sha2("text", 256).alias("text_sha256")
    )
    return W.check_evidence_spans(spans, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""
    SELECT derived AS score, CASE WHEN observed IS NULL THEN 'unobserved' WHEN verdict = 'UNK' THEN 'unknown'
           WHEN observed = (verdict = 'YES')::INT THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n
    FROM label_table WHERE derived IS NOT NULL GROUP BY 1, 2""", uses="label_table")
def score_tiers(spark, sf):
    return W.score_tier_diagnostic(label_table(spark, sf))
