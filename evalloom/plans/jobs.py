"""Composite jobs: each is a plan of the operators, from checked inputs to small reports.

Inputs that several branches read are persisted for the length of a job. Nothing is
written before every check has passed, and no output is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blend, evaluate, heads, labels as weak, linkage, profile, provenance, resample, splits, stacks
from ..operators import features as feats
from ..operators.checks import (
    bad_binary, bad_count, bad_digest, bad_enum, check_complete_categories, check_cross_values, check_disjoint,
    check_distinct_groups, check_key, check_set_equal, check_subset, check_unique, check_class_support, check_fd, enforce, row_checks,
)
from ..operators.ordering import join_rows
from ..session import reuse
from ..sources.io import check_json_list, explode_json_list
from ..sources.reports import report


def star_checks(
    texts: DataFrame, targets: DataFrame, series: DataFrame, test: DataFrame, test_series: DataFrame | None = None, sample: DataFrame | None = None
) -> list[DataFrame]:
    """Contract checks over the star of tables: both splits, their child rows and the submission template."""
    checks = [
        check_key(texts, ["id"], "train"), check_key(test, ["id"], "test"), check_key(series, ["series_id"], "series"),
        check_disjoint(texts, test, ["id"], "train, test"), check_set_equal(texts, targets, ["id"], "targets = train"),
        check_subset(series, texts, ["id"], "series in train"),
        row_checks(targets, "targets", {"binary": bad_binary(F.col("value"))}),
    ]
    if test_series is not None:
        checks += [
            check_key(test_series, ["series_id"], "test series"), check_subset(test_series, test, ["id"], "series in test"),
            check_disjoint(series, test_series, ["series_id"], "series, test series"),
        ]
    if sample is not None:
        checks += [check_key(sample, ["id"], "sample"), check_set_equal(sample, test, ["id"], "sample = test")]
    return checks


def metadata_audit(
    texts: DataFrame, targets: DataFrame, series: DataFrame, test: DataFrame, n_targets: int, test_series: DataFrame | None = None, sample: DataFrame | None = None
) -> DataFrame:
    """``star_checks``, then completeness, targets, categories and texts.

    ``texts(id, text)``, ``targets(id, target, value)``, ``series(id, series_id, plane, fluid, fat)`` and the same of the test split,
    ``test(id)``, ``sample(id, ...)``. Read files with ``sources.io.read_contract``, which holds their headers to the schema.
    """
    enforce(*star_checks(texts, targets, series, test, test_series, sample))
    return report({
        "completeness": (profile.label_completeness(targets, n_targets), []),
        "targets": (profile.target_summary(targets).drop("prevalence"), ["target"]),
        "series": (profile.value_frequency(series, ["plane", "fluid", "fat"]), ["column", "value"]),
        "texts": (profile.nonblank_count(texts, "text"), []),
    })


def profile_and_freeze(
    texts: DataFrame, targets: DataFrame, names: Sequence[str], stratum: str, k: int, seed: int, path: str, inputs: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Freeze a grouped split (or verify and reuse it) and profile it: ``(folds, report)``."""
    members = reuse(linkage.text_group_key(texts).select("id", "group_id"))
    strata = targets.filter(F.col("target") == stratum).select("id", "value")
    folds = provenance.freeze_once(splits.grouped_stratified_folds(members, strata, k, seed), path, inputs)
    support = splits.validate_folds(members, folds, targets, names, k)
    labeled = targets.groupBy("id").agg((F.count("value") > 0).alias("labeled"))
    rows = texts.join(labeled, "id")
    out = report({
        "targets": (profile.target_summary(targets), ["target"]),
        "positives": (profile.cooccurrence(targets, names, "positive"), ["target_a", "target_b"]),
        "observed": (profile.cooccurrence(targets, names, "observed"), ["target_a", "target_b"]),
        "lengths": (profile.text_length_profile(rows, "text", "labeled"), ["scope", "metric"]),
        "scripts": (profile.script_counts(texts, "text"), []),
        "duplicates": (linkage.duplicate_groups(members, targets, names), []),
        "support": (support, ["fold", "target"]),
        "folds": (profile.fold_sizes(targets.join(folds, "id")), ["fold"]),
    })
    return folds, out


def label_source_report(targets: DataFrame, derived: DataFrame, folds: DataFrame, source: str, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fuse a weak source and report it: ``(label table, report)``; no text or id leaves in the report."""
    table = reuse(weak.fuse_labels(targets, derived, folds, source, groups=groups))
    out = report({
        "source": (weak.label_source_audit(table), ["target"]),
        "training": (splits.training_counts(table), ["heldout_fold"]),
        "tiers": (weak.score_tier_diagnostic(table), ["score", "outcome"]),
    })
    return table, out


def overlap_report(
    ids: DataFrame, quality: DataFrame, selected: DataFrame, key_cols: Sequence[str], pixel_col: str, folds: Sequence[int], planes: Sequence[str], failures: Sequence[str]
) -> DataFrame:
    """Check the extraction tables, then report quality and how keys cross the split.

    ``ids(id, split, fold, gold)``, ``quality(id, usable_planes, *failures)``,
    ``selected(id, split, plane, status, *key_cols, pixel_col)`` with a JSON list of pixel digests.
    """
    enforce(
        check_key(ids, ["id"], "ids"), row_checks(ids, "ids", {"split": bad_enum(F.col("split"), ["train", "test"]), "fold": (F.col("split") == "train") & bad_count(F.col("fold"))}),
        check_set_equal(quality, ids, ["id"], "quality = ids"), check_set_equal(selected, ids, ["id"], "selected = ids"),
        check_unique(quality, ["id"], "quality"), check_unique(selected, ["id", "plane"], "selected"),
        check_complete_categories(selected, "id", "plane", planes, "selected"), check_cross_values(selected, ids, ["id"], ["split"], "split"),
        row_checks(quality, "quality", {f"count:{c}": bad_count(F.col(c)) for c in failures}),
        row_checks(selected, "selected", {f"digest:{c}": bad_digest(F.col(c)) for c in key_cols}), check_json_list(selected, pixel_col),
    )
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in key_cols])
    keys = selected.select("id", F.explode(cells).alias("c")).select("c.kind", "id", "c.key")
    pixels = explode_json_list(selected, pixel_col, ["id"], "key").select(F.lit(pixel_col).alias("kind"), "id", "key")
    enforce(row_checks(pixels, pixel_col, {"digest": bad_digest(F.col("key"))}))
    return report({
        "overlap": (linkage.key_overlap_audit(keys.unionByName(pixels), ids, folds), ["kind", "metric"]),
        "quality": (profile.quality_totals(quality, failures, len(planes)), ["metric"]),
        "status": (profile.value_frequency(selected, ["status"]), ["column", "value"]),
    })


def paired_oof_analysis(
    rows: DataFrame, folds: DataFrame, pairs: Sequence[tuple[str, str]], n_folds: int, n_targets: int, replicates: int, seed: int,
    *, by_group: bool = False, recorded: DataFrame | None = None, manifest: tuple[DataFrame, DataFrame] | None = None, tolerance: float = 1e-9,
) -> tuple[DataFrame, DataFrame]:
    """Scores, differences and intervals of fixed out-of-fold predictions: ``(report, errors)``.

    ``rows(model, fold, id, target, y, p)`` on gold ids, ``folds(id, group_id, fold)``. The resampled unit is the gold id, which then must be the only one of its
    group, or with ``by_group`` the whole group. ``manifest`` holds the found and the recorded digests of the inputs, which must agree; the folds of
    the rows must be those of the split; every model must cover every gold cell once; ``recorded(model, mean_macro_auc)`` must come out again.
    """
    rows = reuse(rows)
    gold = join_rows(folds, rows.select("id").distinct(), ["id"], "left_semi")
    if manifest is not None:
        enforce(row_checks(provenance.verify_manifest(*manifest), "manifest", {"changed": F.col("state") != "same"}))
    models = F.array(*[F.lit(r[0]) for r in rows.select("model").distinct().collect()])  # a few names
    cells = rows.select("id", "target").distinct().withColumn("model", F.explode(models))
    enforce(
        check_cross_values(rows.select("id", "fold").distinct(), gold, ["id"], ["fold"], "folds"), check_set_equal(rows, cells, ["model", "id", "target"], "predictions = gold"),
        check_fd(folds, "group_id", "fold", "folds"), *([] if by_group else [check_distinct_groups(gold, "group_id", "gold")]), check_key(rows, ["model", "id", "target"], "predictions"),
        check_class_support(profile.fold_support(rows.select("fold", "id", "target", F.col("y").alias("value")).distinct(), list(range(n_folds)), [r[0] for r in rows.select("target").distinct().collect()])),
    )
    scores = reuse(evaluate.auc(rows, ["model", "fold", "target"]))
    if recorded is not None:
        found = evaluate.fold_summary(scores).select("model", F.col("mean_macro_auc").alias("_m")).join(recorded, "model", "full")
        enforce(row_checks(found, "summary", {"drift": F.abs(F.col("_m") - F.col("mean_macro_auc")) > tolerance}))
    names = [r[0] for r in rows.select("target").distinct().collect()]
    units = join_rows(rows, gold.select("id", "group_id"), ["id"]) if by_group else rows
    draws = resample.paired_bootstrap(units, pairs, n_folds, n_targets, replicates, seed, unit="group_id" if by_group else "id")
    out = report({
        "summary": (evaluate.fold_summary(scores), ["model"]), "targets": (evaluate.target_means(scores), ["model", "target"]),
        "brier": (evaluate.brier(rows), ["model", "target"]),
        "differences": (evaluate.target_deltas(evaluate.target_means(scores), evaluate.brier(rows), pairs), ["pair", "target"]),
        "intervals": (resample.percentile_interval(draws, replicates, resample.interval_cells(pairs, names)), ["pair", "target"]),
    })
    return out, evaluate.largest_errors(rows, 5, sorted({b for _, b in pairs}))


def experiment(
    features: DataFrame, labels: DataFrame, folds: Sequence[int], names: Sequence[str], new: DataFrame, *,
    recipes: Mapping[str, float] = heads.RECIPES, pca: int | None = None, replicates: int = 1000, seed: int = splits.SEED,
    manifests: DataFrame | None = None, path: str | None = None,
) -> dict:
    """Cross-validate recipes, choose one, refit it on everything and score new rows.

    ``features(id, x)`` and ``new(id, x)``; ``labels`` is a fused label table. The sources named in ``manifests(manifest, path,
    sha256)`` must agree before anything is fitted. The heads of the first recipe are compared with constant 0.5 by ``replicates`` paired resamples. The submission
    is held against the template of the new ids; with ``path`` predictions, heads, summary and submission are written there once.
    """
    if manifests is not None:
        enforce(row_checks(provenance.source_consistency(manifests), "manifests", {"sources": F.col("differs")}))
    features, labels = reuse(features), reuse(labels)
    oof, fitted = heads.cross_validate(features, labels, folds, names, recipes, pca=pca)
    truth = labels.select("fold", "id", "target", F.col("observed").cast("double").alias("y"))
    rows = reuse(oof.unionByName(evaluate.reference_predictors(truth)))
    scores = reuse(evaluate.auc(rows, ["model", "fold", "target"]))
    summary = reuse(evaluate.fold_summary(scores))
    chosen = heads.select_recipe(summary, list(recipes))
    final = heads.fit_heads(features, weak.supervision(labels, recipes[chosen]), names, recipe=chosen, pca=pca)
    submission = reuse(heads.predict_heads(new, final, names).drop("recipe"))
    sample = blend.constant_submission(blend.with_row_idx(new.select("id")), {t: 0.5 for t in names})
    wide = join_rows(sample.select("row_idx", "id"), blend.to_wide(submission, names), ["id"]).select("row_idx", "id", *names)
    enforce(blend.check_submission(wide, sample, names))
    first = list(recipes)[0]
    pairs = [(first, "constant")]
    draws = resample.paired_bootstrap(rows.filter(F.col("model").isin(*pairs[0])), pairs, len(folds), len(names), replicates, seed)
    out = {
        "oof": rows, "scores": scores, "summary": summary, "targets": evaluate.target_means(scores), "chosen": chosen, "fold_heads": fitted, "final_heads": final,
        "submission": submission, "errors": evaluate.study_error(rows.filter(F.col("model") == first), 10),
        "interval": reuse(resample.percentile_interval(draws, replicates, resample.interval_cells(pairs, names))),
    }
    if path:
        spark = features.sparkSession
        written = {"oof": rows, "heads": heads.model_table(spark, [*fitted, *final]), "summary": summary, "interval": out["interval"], "errors": out["errors"], "submission": wide}
        for name, df in written.items():
            provenance.write_once(df, f"{path}/{name}")
    return out


def experiment_report(out: Mapping, names: Sequence[str]) -> DataFrame:
    """All results of an experiment as long rows: summary, targets, interval, largest errors, submission totals, choice."""
    sent = out["submission"].groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))
    chosen = out["summary"].select("model", (F.col("model") == out["chosen"]).cast("int").alias("chosen"))
    return report({
        "summary": (out["summary"], ["model"]), "chosen": (chosen, ["model"]), "targets": (out["targets"], ["model", "target"]),
        "interval": (out["interval"], ["pair", "target"]), "errors": (out["errors"].drop("targets", "place"), ["model", "id"]), "submission": (sent, ["target"]),
    })


def count_feature_experiment(
    parents: DataFrame, children: DataFrame, labels: DataFrame, folds: Sequence[int], names: Sequence[str], new_parents: DataFrame, new_children: DataFrame,
    categories: Mapping[str, Sequence[str]] = feats.CATEGORIES, **options,
) -> dict:
    """The experiment on child counts: gold labels only, compared with constant and prevalence."""
    cols = feats.count_names(categories)
    x = feats.as_array(feats.count_features(parents.select("id"), children, categories), cols).select("id", "x")
    new = feats.as_array(feats.count_features(new_parents.select("id"), new_children, categories), cols).select("id", "x")
    return experiment(x, labels, folds, names, new, recipes={"observed_only": 0.0}, **options)


def blend_publish(
    checks: Sequence[DataFrame], ids: DataFrame, components: Mapping[str, DataFrame], weights: Mapping[str, float], path: str | None = None
) -> DataFrame:
    """Gate, align, rank and blend; write once when a path is given."""
    blended = blend.blend_gate(checks, ids, components, weights)
    if path:
        provenance.write_once(blended, path)
    return blended


def stack_features(
    headers: DataFrame, slices: DataFrame, planes: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], dim: int, *,
    count: int = 12, lo: float = 0.2, hi: float = 0.8, width: int = 3, plane_names: Sequence[str] = splits.PLANES,
) -> dict[str, DataFrame]:
    """Order, sample, fill, window, encode and assemble: ``vectors``, ``features`` and the order audit.

    ``headers`` as for ``order_slices``; ``slices(series, slice, ok, pixels)``; ``planes(id, plane,
    series)``: the selected series of each study. Pixels of one window reach the encoder joined.
    """
    ordered = stacks.order_slices(headers.join(planes.select("series").distinct(), "series", "left_semi"))
    usable = reuse(ordered.filter("pos is not null").select("series", "slice", "pos", "n"))
    sampled = stacks.even_sample(usable, count, lo, hi).join(slices, ["series", "slice"])
    filled = stacks.fill_nearest(sampled, "pixels", count)
    windows = stacks.neighbor_windows(filled, "pixels", width).withColumn("pixels", F.flatten("items"))
    rows = windows.select(F.col("series").alias("id"), F.lit("").alias("plane"), "window", "pixels")
    vectors = feats.encode_batches(rows, encoder, dim).select(F.col("id").alias("series"), "window", "vec")
    vectors = planes.join(vectors, "series").select("id", "plane", "window", "vec")
    pooled = feats.mean_pool_windows(vectors, count - width + 1)
    ids = planes.select("id").distinct()
    return {"order": ordered, "filled": filled, "vectors": vectors, "features": feats.assemble_slots(ids, pooled, dim, plane_names)}


def candidate_decision(rows: DataFrame, recorded: DataFrame, candidate: str, control: str, tolerance: float) -> DataFrame:
    """The control must reproduce its record before the candidate is judged against it."""
    again = rows.filter(F.col("model") == control)
    parity = evaluate.prediction_parity(again, recorded, tolerance)
    enforce(row_checks(parity, "control", {
        "drift": F.col("beyond_tolerance") > 0, "missing_new": F.col("missing_a") > 0, "missing_old": F.col("missing_b") > 0,
    }))
    macro = evaluate.fold_macro(evaluate.auc(rows, ["model", "fold", "target"]))
    return evaluate.promotion_rule(macro, candidate, [control])
