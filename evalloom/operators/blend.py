"""Alignment, global percentile ranks, rank blending and the publication gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import (
    ContractError, bad_probability, check_key, check_same_order, check_schema, check_set_equal, enforce, row_checks, union,
)
from .ordering import join_lookup, join_rows, ranked, tied


def with_row_idx(df: DataFrame, id_col: str = "id", **sizing: int) -> DataFrame:
    """Explicit 0-based row order by id."""
    return ranked(df, [], [id_col], **sizing).withColumn("row_idx", F.col("rn") - 1).drop("rn", "n")


def align_component(ids: DataFrame, preds: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """Predictions of exactly the wanted ids, carrying their ``row_idx``."""
    rules = {"probability": bad_probability(F.col("p"))}
    checks = [
        check_key(ids, ["id"], "ids"), check_set_equal(ids, preds, ["id"], "ids = predictions"),
        check_key(preds, ["id", "target"], "predictions"), row_checks(preds, "predictions", rules),
    ]
    if targets:
        per_id = preds.groupBy("id").agg(F.count_if(F.col("target").isin(*targets)).alias("k"), F.count(F.lit(1)).alias("n"))
        checks.append(row_checks(per_id, "predictions", {"targets": (F.col("k") != len(targets)) | (F.col("n") != len(targets))}))
    enforce(*checks)
    return join_rows(ids.select("id", "row_idx"), preds, ["id"])


def percentile_rank(preds: DataFrame, by: Sequence[str] = ("target",), **sizing: int) -> DataFrame:
    """Average-tie rank divided by the row count, over all rows of a target."""
    run = tied(preds, list(by), "p", **sizing)
    rank = (F.col("before_rows") + (F.col("rows") + 1) / 2.0) / F.col("total_rows")
    lookup = run.select(*by, "p", rank.alias("pct_rank"))
    return join_lookup(preds, lookup, [*by, "p"], ["id"], "inner")


def rank_blend(components: Mapping[str, DataFrame], weights: Mapping[str, float], **sizing: int) -> DataFrame:
    """``(id, target, p)``: weighted sum of the components' percentile ranks, in one job; NULL where a component lacks the cell."""
    if set(components) != set(weights):
        raise ValueError("every component needs a weight")
    rows = None
    for name, preds in components.items():
        part = preds.select(F.lit(name).alias("component"), "id", "target", "p")
        rows = part if rows is None else rows.unionByName(part)
    placed = percentile_rank(rows, ["component", "target"], **sizing)
    shares = [F.max(F.when(F.col("component") == n, F.col("pct_rank"))) * F.lit(float(w)) for n, w in weights.items()]
    blended = shares[0]
    for share in shares[1:]:
        blended = blended + share
    return placed.groupBy("id", "target").agg(blended.alias("p"))


def check_submission(sub: DataFrame, sample: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Wide prediction table against its template: columns, keys, order, probabilities."""
    schema = T.StructType([f for f in sample.schema.fields])
    return union([
        check_schema(sub, schema, "submission"), check_key(sub, ["id"], "submission"),
        check_same_order(sub, sample, "id", "submission"),
        row_checks(sub, "submission", {f"probability:{t}": bad_probability(F.col(t)) for t in targets}),
    ])


def to_wide(preds: DataFrame, targets: Sequence[str]) -> DataFrame:
    return preds.groupBy("id").pivot("target", list(targets)).agg(F.first("p"))


def constant_submission(sample: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Template ids in template order with one constant per target."""
    return sample.select("row_idx", "id", *[F.lit(float(v)).alias(t) for t, v in values.items()])


def check_component(manifest: DataFrame, members: DataFrame, expected: DataFrame, ids: DataFrame, n_members: int) -> DataFrame:
    """One component is complete: status, row count, member set with equal digest and windows.

    ``manifest(component, status, rows, digest, found_digest)``, ``members(component, id, sha256,
    windows)``, ``expected`` like ``members``.
    """
    size = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = manifest.withColumn("_n", size)
    per = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"))
    return union([
        row_checks(rows, "manifest", {
            "status": F.col("status") != "complete", "rows": F.col("rows") != F.col("_n"), "digest": ~F.col("digest").eqNullSafe(F.col("found_digest")),
        }),
        row_checks(per, "members", {"member_count": (F.col("n") != n_members) | (F.col("d") != n_members)}),
        check_set_equal(members, expected, ["component", "id", "sha256", "windows"], "members = expected"),
        check_set_equal(manifest, expected, ["component"], "manifest = expected"), check_key(manifest, ["component"], "manifest"),
    ])


def blend_gate(checks: Sequence[DataFrame], ids: DataFrame, components: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Blend only after every component check passes; nothing is computed otherwise, nor without any check."""
    if not checks:
        raise ContractError("the gate needs a check")
    enforce(*checks)
    aligned = {name: align_component(ids, preds) for name, preds in components.items()}
    return rank_blend(aligned, weights)
