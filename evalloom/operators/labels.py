"""Weak-label fusion, supervision and agreement on long tables keyed by (id, target)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import (
    ContractError, bad_binary, bad_count, bad_enum, bad_probability, check_cross_values, check_fd,
    check_key, check_set_equal, check_subset, enforce, row_checks,
)
from .ordering import join_rows
from .profile import count

VERDICTS = ["YES", "NO", "UNK"]


def _silver() -> Column:
    known = F.col("verdict").isin("YES", "NO") & (F.col("conf") > 0)
    return F.when(known, (F.col("verdict") == "YES").cast("int"))


def check_label_sources(targets: DataFrame, derived: DataFrame, folds: DataFrame, groups: DataFrame | None = None) -> list[DataFrame]:
    """Everything that must hold before labels are fused."""
    checks = [
        check_key(targets, ["id", "target"], "targets"), check_key(derived, ["id", "target"], "derived"),
        check_key(folds, ["id"], "folds"), check_subset(derived, targets, ["id"], "derived in targets"),
        check_set_equal(folds, targets, ["id"], "folds = targets"),
        row_checks(folds, "folds", {"null_group": F.col("group_id").isNull(), "fold_value": bad_count(F.col("fold"))}),
        check_fd(folds, "group_id", "fold", "folds"),
        row_checks(targets, "targets", {"binary": bad_binary(F.col("value"))}),
        row_checks(derived, "derived", {
            "score": bad_probability(F.col("score")), "conf": bad_probability(F.col("conf")), "verdict": bad_enum(F.col("verdict"), VERDICTS),
        }),
    ]
    if groups is not None:
        checks.append(check_cross_values(groups, folds, ["id"], ["group_id"], "text groups"))
    return checks


def fuse_labels(
    targets: DataFrame, derived: DataFrame, folds: DataFrame, source: str, *, groups: DataFrame | None = None, validate: bool = True
) -> DataFrame:
    """Observed label first, else a confident YES/NO verdict; unknown stays NULL and masked."""
    if not source or not source.strip():
        raise ContractError("a label source is required")
    if validate:
        enforce(*check_label_sources(targets, derived, folds, groups))
    rows = join_rows(targets.select("id", "target", F.col("value").alias("observed")), derived.select("id", "target", "score", "conf", "verdict"), ["id", "target"], "left")
    rows = join_rows(rows, folds.select("id", "group_id", "fold"), ["id"])
    value = F.coalesce(F.col("observed").cast("int"), _silver())
    origin = F.when(F.col("observed").isNotNull(), "observed").when(F.col("score").isNotNull(), F.lit(source)).otherwise("unknown")
    return rows.select(
        "id", "group_id", "fold", "target", value.alias("value"), F.col("observed").cast("int").alias("observed"),
        F.col("score").alias("derived"), "verdict", F.col("conf").alias("confidence"), value.isNotNull().alias("mask"), origin.alias("source"),
    )


def label_source_audit(labels: DataFrame) -> DataFrame:
    """Verdicts, added and masked cells, and agreement with observed labels per target."""
    usable = F.coalesce(F.col("verdict").isin("YES", "NO") & (F.col("confidence") > 0), F.lit(False))
    gold = F.col("observed").isNotNull()
    agrees = F.col("observed") == (F.col("verdict") == "YES").cast("int")
    return labels.groupBy("target").agg(
        F.count("observed").alias("observed"), *[count(F.col("verdict") == v).alias(f"verdict_{v.lower()}") for v in VERDICTS],
        count(~gold & usable).alias("added"), count(~F.col("mask")).alias("masked"),
        count(gold & usable).alias("agreement_denominator"), count(gold & usable & agrees).alias("agreement_matches"),
    )


def supervision(labels: DataFrame, silver_weight: float) -> DataFrame:
    """``y, weight`` per cell: gold 1, silver ``silver_weight``, unknown 0. Weight 0 means gold only."""
    if not 0 <= silver_weight <= 1:
        raise ContractError("the silver weight must lie in [0, 1]")
    gold = F.col("observed").isNotNull()
    silver = ~gold & F.col("mask") & F.coalesce(F.col("verdict").isin("YES", "NO"), F.lit(False)) & F.lit(silver_weight > 0)
    y = F.when(gold, F.col("observed")).when(silver, F.col("value")).otherwise(0)
    weight = F.when(gold, 1.0).when(silver, float(silver_weight)).otherwise(0.0)
    return labels.select("id", "fold", "target", "observed", "verdict", "derived", y.cast("double").alias("y"), weight.alias("weight"))


def soft_targets(rows: DataFrame, silver_weight: float = 0.25) -> DataFrame:
    """Silver cells take the preserved score as target; gold and unknown stay."""
    active = (F.col("weight") == silver_weight) & F.col("observed").isNull()
    return rows.withColumn("y", F.when(active, F.col("derived")).otherwise(F.col("y")))


def check_soft_targets(rows: DataFrame, silver_weight: float = 0.25) -> DataFrame:
    active = (F.col("weight") == silver_weight) & F.col("observed").isNull()
    return row_checks(rows, "soft targets", {"active_score": active & bad_probability(F.col("derived"))})


def masked_bce(rows: DataFrame, logit: str = "logit") -> DataFrame:
    """Weighted cross entropy with logits; the mean runs over all cells, not over weights."""
    z, y = F.col(logit), F.col("y")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return rows.agg((F.sum(F.col("weight") * loss) / F.count(F.lit(1))).alias("loss"))


def tristate_agreement(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compare two three-state sources ``(id, target, *by, state)``, per group and in total.

    States are ``present``, ``absent``, ``unknown``; a missing row is unknown. The
    total row has NULL group columns and ``total = 1``.
    """
    extra = [c for c in by if c != "target"]
    left = a.select("id", "target", *extra, F.col("state").alias("_a"))
    right = b.select("id", "target", *[F.col(c).alias(f"_r_{c}") for c in extra], F.col("state").alias("_b"))
    rows = left.join(right, ["id", "target"], "full")
    for c in extra:
        rows = rows.withColumn(c, F.coalesce(c, f"_r_{c}")).drop(f"_r_{c}")
    rows = rows.withColumn("_a", F.coalesce("_a", F.lit("unknown"))).withColumn("_b", F.coalesce("_b", F.lit("unknown")))
    states = ["present", "absent", "unknown"]
    known_a, known_b = F.col("_a") != "unknown", F.col("_b") != "unknown"
    aggs = [count((F.col("_a") == x) & (F.col("_b") == y)).alias(f"{x}_{y}") for x in states for y in states]
    aggs += [
        F.count(F.lit(1)).alias("cells"), count(known_a).alias("known_a"), count(known_b).alias("known_b"),
        count(F.col("_a") == F.col("_b")).alias("three_state_matches"), count(known_a & known_b).alias("both_known"),
        count(known_a & known_b & (F.col("_a") == F.col("_b"))).alias("both_known_matches"),
        count(~known_a & known_b).alias("only_b_known"), count(known_a & known_b & (F.col("_a") != F.col("_b"))).alias("opposite"),
    ]
    cols = [F.col(c) for c in by]
    return rows.groupingSets([cols, []], *cols).agg(*aggs, F.grouping_id().alias("_g")).withColumn(
        "total", (F.col("_g") > 0).cast("int")
    ).drop("_g")


def check_evidence_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Quoted evidence equals ``text[start:end]`` and the text digest matches."""
    rows = spans.join(texts.select("id", "text"), "id", "left")
    cut = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return row_checks(rows, "evidence", {
        "no_text": F.col("text").isNull(), "evidence": cut != F.col("evidence"), "digest": F.sha2("text", 256) != F.col("text_sha256"),
    })


def score_tier_diagnostic(labels: DataFrame) -> DataFrame:
    """Agreement with observed labels by preserved score."""
    agrees = F.col("observed") == (F.col("verdict") == "YES").cast("int")
    outcome = F.when(F.col("observed").isNull(), "unobserved").when(F.col("verdict") == "UNK", "unknown").when(agrees, "agree").otherwise("disagree")
    return labels.filter(F.col("derived").isNotNull()).groupBy(F.col("derived").alias("score"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
