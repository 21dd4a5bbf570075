"""The composite jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance
from ..operators.checks import ContractError, union
from ..operators.evaluate import auc, fold_summary
from ..operators.labels import fuse_labels
from ..operators.ordering import join_rows
from ..operators.splits import PLANES
from ..plans import jobs as J
from ..session import reuse, scratch_dir
from .base import (
    FOLDS, TARGETS, derived, documents, event_series, folds, gold_scores, headers, label_table, members, predictions, query, r6, table, targets,
)
from .evaluation import PAIRS, REPLICATES, RESAMPLE_SEED, _BLEND, component_record, ids
from .features import document_features
from .linkage import audit_ids, link_keys
from .profiles import LINES


@query("""
    WITH t AS (SELECT target, count(value) AS observed, count(*) - count(value) AS unknown, count(*) FILTER (WHERE value = 1) AS positive,
                      count(*) FILTER (WHERE value = 0) AS negative FROM targets GROUP BY target),
    c AS (SELECT count(*) FILTER (WHERE k = 2) AS fully_labeled, count(*) FILTER (WHERE k = 1) AS partially_labeled, count(*) FILTER (WHERE k = 0) AS unlabeled
          FROM (SELECT id, count(value) AS k FROM targets GROUP BY id))
    SELECT 'completeness' AS section, metric, '' AS key, value::DOUBLE AS value FROM c UNPIVOT (value FOR metric IN (fully_labeled, partially_labeled, unlabeled))
    UNION ALL SELECT 'targets', metric, target, value::DOUBLE FROM t UNPIVOT (value FOR metric IN (observed, unknown, positive, negative))
    UNION ALL SELECT 'series', 'n', 'plane|' || upper(substr(plane, 1, 1)) || substr(plane, 2), count(*)::DOUBLE FROM event_series WHERE id IN (SELECT doc_id FROM documents) GROUP BY plane
    UNION ALL SELECT 'series', 'n', 'fluid|' || fluid, count(*)::DOUBLE FROM event_series WHERE id IN (SELECT doc_id FROM documents) GROUP BY fluid
    UNION ALL SELECT 'series', 'n', 'fat|' || fat, count(*)::DOUBLE FROM event_series WHERE id IN (SELECT doc_id FROM documents) GROUP BY fat
    UNION ALL SELECT 'texts', 'nonblank', '', count(*)::DOUBLE FROM documents""", uses="targets event_series")
def metadata_audit(spark, sf):
    test = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("id"))
    series = event_series(spark, sf).join(documents(spark, sf).select("id"), "id", "left_semi")  # users without a document are no part of the star
    items = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("id"), F.concat(F.lit("item-"), "item_id").alias("series_id"))
    sample = test.select("id", *[F.lit(0.5).alias(t) for t in TARGETS])
    return J.metadata_audit(documents(spark, sf), targets(spark, sf), series, test, len(TARGETS), items, sample)


@query("""
    SELECT * FROM (SELECT 'orphan_key' AS "check", 'series in train' AS subject, count(DISTINCT id) AS violations FROM event_series WHERE id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'shared_key', 'train, test', count(*) FROM (SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'missing_left', 'sample = test', count(*) FROM benchmark WHERE item_id % 2 = 1) WHERE violations > 0""", uses="event_series")
def star_violations(spark, sf):
    """What the star checks find without any filter: users that are no documents, items that share an id, a template of the even items."""
    test = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    checks = J.star_checks(documents(spark, sf), targets(spark, sf), event_series(spark, sf), test, None, test.filter("id % 2 = 0"))
    return union(checks).filter("violations > 0")


@query()
def profiled_split(spark, sf):
    path = f"{scratch_dir(spark)}/folds"
    _, out = J.profile_and_freeze(documents(spark, sf), targets(spark, sf), TARGETS, "toxic", len(FOLDS), 42, path, {"documents": str(provenance.fingerprint_of(documents(spark, sf)))})
    return out.withColumn("value", r6("value"))


@query("""
    WITH a AS (SELECT target, count(observed) AS observed, count(*) FILTER (WHERE verdict = 'YES') AS verdict_yes, count(*) FILTER (WHERE verdict = 'NO') AS verdict_no,
           count(*) FILTER (WHERE verdict = 'UNK') AS verdict_unk, count(*) FILTER (WHERE observed IS NULL AND verdict IN ('YES', 'NO') AND confidence > 0) AS added,
           count(*) FILTER (WHERE NOT mask) AS masked, count(*) FILTER (WHERE observed IS NOT NULL AND verdict IN ('YES', 'NO') AND confidence > 0) AS agreement_denominator,
           count(*) FILTER (WHERE observed IS NOT NULL AND verdict IN ('YES', 'NO') AND confidence > 0 AND observed = (verdict = 'YES')::INT) AS agreement_matches
      FROM label_table GROUP BY target),
    p AS (SELECT id, max(fold) AS fold, max(mask) AS usable FROM label_table GROUP BY id),
    h AS (SELECT h.fold AS fold, count(*) FILTER (WHERE p.fold <> h.fold AND usable) AS training_ids, count(*) FILTER (WHERE p.fold <> h.fold AND NOT usable) AS excluded_unlabeled
          FROM p CROSS JOIN (SELECT DISTINCT fold FROM p) h GROUP BY h.fold)
    SELECT 'source' AS section, metric, target AS key, value::DOUBLE AS value FROM a
      UNPIVOT (value FOR metric IN (observed, verdict_yes, verdict_no, verdict_unk, added, masked, agreement_denominator, agreement_matches))
    UNION ALL SELECT 'training', metric, fold::VARCHAR, value::DOUBLE FROM h UNPIVOT (value FOR metric IN (training_ids, excluded_unlabeled))
    UNION ALL SELECT 'tiers', 'n', derived::VARCHAR || '|' || CASE WHEN observed IS NULL THEN 'unobserved' WHEN verdict = 'UNK' THEN 'unknown'
           WHEN observed = (verdict = 'YES')::INT THEN 'agree' ELSE 'disagree' END, count(*)::DOUBLE FROM label_table WHERE derived IS NOT NULL GROUP BY 1, 2, 3""", uses="label_table")
def label_source_report(spark, sf):
    keyed = members(spark, sf)
    known, weak = (join_rows(df, keyed.select("id"), ["id"], "left_semi") for df in (targets(spark, sf), derived(spark, sf)))
    _, out = J.label_source_report(known, weak, folds(spark, sf), "lengths-v1", keyed)
    return out


@query("""
    SELECT 'written' AS step, count(*) AS rows, FALSE AS refused FROM documents UNION ALL SELECT 'reused', count(*), FALSE FROM documents
    UNION ALL SELECT 'other inputs', 0, TRUE""")
def freeze_steps(spark, sf):
    """A frozen table is written once, read again whatever a later call would write, and refused under another input digest."""
    rows = documents(spark, sf).select("id", F.sha2("text", 256).alias("digest"))
    path, inputs = f"{scratch_dir(spark)}/frozen", {"documents": str(provenance.fingerprint_of(rows))}
    written = provenance.freeze_once(rows, path, inputs)
    reused = provenance.freeze_once(rows.filter("false"), path, inputs)
    try:
        provenance.freeze_once(rows, path, {"documents": "other"})
        refused = False
    except ContractError:
        refused = True
    steps = [(written, "written"), (reused, "reused")]
    made = [df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("rows"), F.lit(False).alias("refused")) for df, step in steps]
    return made[0].unionByName(made[1]).unionByName(spark.range(1).select(F.lit("other inputs").alias("step"), F.lit(0).cast("bigint").alias("rows"), F.lit(refused).alias("refused")))


@query()
def overlap_report(spark, sf):
    """Documents as studies: three plane rows each, text and shape keys, text digests as pixels."""
    everything = audit_ids(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source", "lang")
    docs = join_rows(docs, members(spark, sf).select("id"), ["id"], "left_semi")
    quality = docs.select("id", (F.col("n_chars") % 4).cast("int").alias("usable_planes"), (F.col("n_chars") % 3).alias("header_failures"), F.lit(0).alias("decode_failures"))
    keys = link_keys(spark, sf).groupBy("id").agg(F.max(F.when(F.col("kind") == "text", F.col("key"))).alias("text_key"), F.max(F.when(F.col("kind") == "shape", F.col("key"))).alias("shape_key"))
    planes = F.explode(F.array(F.lit("Sagittal"), F.lit("Coronal"), F.lit("Axial"))).alias("plane")
    pixels = F.when(F.col("n_chars") < 200, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.col("text_key"), F.lit('", null]')))
    selected = docs.join(keys, "id").join(everything.select("id", "split"), "id").select(
        "id", "split", planes, F.when(F.col("n_chars") < 200, "no_dicom_files").otherwise("usable").alias("status"), "text_key", "shape_key", pixels.alias("pixel_sha256")
    )
    return J.overlap_report(everything, quality, selected, ["text_key", "shape_key"], "pixel_sha256", FOLDS, ["Sagittal", "Coronal", "Axial"], ["header_failures", "decode_failures"])


@query()
def document_experiment(spark, sf):
    """Three supervision recipes on document features, all results; the benchmark texts are the new rows; outputs are written once."""
    bench = table(spark, sf, "benchmark")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    cells = [F.length("text") / 1000.0, lines.cast("double"), F.length(F.regexp_replace("text", "[^a-z]", "")) / F.greatest(F.length("text"), F.lit(1)), F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    new = bench.select(F.col("item_id").alias("id"), F.array(*cells).alias("x"))
    digest = F.sha2(F.lit(str(provenance.fingerprint_of(documents(spark, sf)))), 256).alias("sha256")
    manifests = spark.range(2).select(F.element_at(F.array(F.lit("features"), F.lit("labels")), (F.col("id") + 1).cast("int")).alias("manifest"), F.lit("documents").alias("path"), digest)
    out = J.experiment(document_features(spark, sf), label_table(spark, sf), FOLDS, TARGETS, new, replicates=REPLICATES, manifests=manifests, path=f"{scratch_dir(spark)}/experiment")
    return J.experiment_report(out, TARGETS).withColumn("value", F.round("value", 5))


@query()
def order_count_experiment(spark, sf):
    """Count features of orders, all results: is an order urgent, is it open; folds by customer; new rows are all orders."""
    orders = table(spark, sf, "orders")
    cells = F.array(
        F.struct(F.lit("urgent").alias("target"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("value")),
        F.struct(F.lit("open").alias("target"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "O").cast("int")).alias("value")),
    )
    rows = orders.select(F.col("o_orderkey").alias("id"), F.explode(cells).alias("c")).select("id", "c.target", "c.value")
    split = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), (F.col("o_custkey") % 3).cast("int").alias("fold"))
    none = spark.createDataFrame([], "id bigint, target string, score double, conf double, verdict string")  # no weak source
    labels = fuse_labels(rows, none, split, "none", validate=False)
    parents = orders.select(F.col("o_orderkey").alias("id"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linestatus")
    out = J.count_feature_experiment(parents, children, labels, FOLDS, ["urgent", "open"], parents, children, LINES, replicates=REPLICATES, path=f"{scratch_dir(spark)}/experiment")
    return J.experiment_report(out, ["urgent", "open"]).withColumn("value", F.round("value", 5))


@query()
def paired_analysis(spark, sf):
    """All gold rows; copies of a text are drawn together. The recorded summary and digests are taken again from the same rows."""
    rows = reuse(gold_scores(spark, sf))
    recorded = fold_summary(auc(rows, ["model", "fold", "target"])).select("model", "mean_macro_auc")
    docs = table(spark, sf, "documents")
    digests = docs.select(F.lit("documents").alias("path"), F.sha2(F.lit(str(provenance.fingerprint_of(docs.select("doc_id", "n_chars")))), 256).alias("sha256")).limit(1)
    out, errors = J.paired_oof_analysis(
        rows, folds(spark, sf), PAIRS, len(FOLDS), len(TARGETS), REPLICATES, RESAMPLE_SEED, by_group=True, recorded=recorded, manifest=(digests, digests)
    )
    told = errors.select(F.lit("errors").alias("section"), F.lit("squared_error").alias("metric"), F.concat_ws("|", "model", "target", F.col("place").cast("string")).alias("key"), F.col("squared_error").alias("value"))
    return out.unionByName(told.select(*out.columns)).withColumn("value", r6("value"))


@query(f"SELECT id, target, round(p, 8) AS p FROM ({_BLEND})", uses="predictions")
def published_blend(spark, sf):
    preds, everything = predictions(spark, sf), ids(spark, sf)
    parts = {m: preds.filter(F.col("model") == m).drop("model") for m in ("wide", "coarse")}
    path = f"{scratch_dir(spark)}/blend"
    docs = table(spark, sf, "documents")
    J.blend_publish([component_record(spark, sf, docs, everything, m) for m in parts], everything, parts, {"wide": 0.9, "coarse": 0.1}, path)
    return spark.read.parquet(f"{path}/data").withColumn("p", F.round("p", 8))


@query()
def event_stack_features(spark, sf):
    """Users' events as slice stacks, three users to a study and its planes: ordered, sampled, filled, windowed, encoded and pooled."""
    import numpy as np

    events = table(spark, sf, "events")
    slices = events.select(
        F.col("user_id").alias("series"), F.col("event_id").alias("slice"), (F.col("event_type") != "signup").alias("ok"),
        F.array(F.col("value").cast("float"), F.hour("ts").cast("float"), F.length("props").cast("float")).alias("pixels"),
    )
    plane = F.get(F.array(*[F.lit(p) for p in PLANES]), F.pmod("series", F.lit(3)).cast("int")).alias("plane")
    planes = events.select(F.col("user_id").alias("series")).distinct().select(F.floor(F.col("series") / 3).alias("id"), plane, "series")
    weights = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(9)] for i in range(4)])
    out = J.stack_features(headers(spark, sf), slices, planes, lambda block: block.astype(float) @ weights.T, 4)
    return out["features"].select("id", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 3))


@query("""
    WITH f AS (SELECT model, fold, avg(auc) AS m FROM auc_scores GROUP BY model, fold)
    SELECT c.model AS control, round(avg(w.m) - avg(c.m), 8) AS mean_delta, count(*) FILTER (WHERE w.m > c.m) AS folds_improved,
           avg(w.m) > avg(c.m) AND count(*) FILTER (WHERE w.m > c.m) >= 2 AS passes
    FROM f c JOIN f w ON w.fold = c.fold AND w.model = 'wide' WHERE c.model = 'coarse' GROUP BY c.model""", uses="auc_scores")
def candidate_decision(spark, sf):
    rows = gold_scores(spark, sf)
    recorded = rows.filter("model = 'coarse'").select("id", "target", (F.col("p") + 1e-9).alias("p"))
    return J.candidate_decision(rows, recorded, "wide", "coarse", 1e-6).withColumn("mean_delta", F.round("mean_delta", 8))
