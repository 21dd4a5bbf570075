"""Manifests, table fingerprints, frozen tables and column allow-lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FINGERPRINT_PRIME, row_text, word60
from .checks import ContractError
from .profile import count


def verify_manifest(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """``(path, state)`` with state ``same``, ``changed``, ``missing`` or ``extra``."""
    left = actual.select("path", F.col("sha256").alias("_a"))
    right = recorded.select("path", F.col("sha256").alias("_r"))
    state = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_r").isNull(), "extra")
        .when(F.col("_a") == F.col("_r"), "same").otherwise("changed")
    )
    return left.join(right, "path", "full").select("path", state.alias("state"))


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(rows, fingerprint)`` of a table's content, the same under any row order or partitioning.

    Put ``row_idx`` among ``cols`` to bind the order too.
    """
    word = word60(F.sha2(row_text(*cols), 256)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(word) % F.lit(FINGERPRINT_PRIME), F.lit(0)).cast("bigint").alias("fingerprint"))


def fingerprint_of(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[int, int]:
    row = table_fingerprint(df, cols or df.columns).first()
    return row["rows"], row["fingerprint"]


def write_once(df: DataFrame, path: str, inputs: Mapping[str, str] | None = None) -> None:
    """Write a table and its fingerprint side by side; an existing path is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    spark = df.sparkSession
    rows, mark = fingerprint_of(spark.read.parquet(f"{path}/data"))
    facts = spark.range(1).select(
        F.lit(rows).cast("bigint").alias("rows"), F.lit(mark).cast("bigint").alias("fingerprint"),
        F.to_json(F.create_map(*[F.lit(x) for kv in sorted((inputs or {}).items()) for x in kv]) if inputs else F.create_map()).alias("inputs"),
    )
    facts.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_fingerprint_table")


def _read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def freeze_once(df: DataFrame, path: str, inputs: Mapping[str, str]) -> DataFrame:
    """First call writes; later calls verify content and inputs and reuse. Anything else is an error."""
    import json

    spark = df.sparkSession
    data, facts = _read_or_none(spark, f"{path}/data"), _read_or_none(spark, f"{path}/_fingerprint_table")
    if data is None and facts is None:
        write_once(df, path, inputs)
        return spark.read.parquet(f"{path}/data")
    if data is None or facts is None:
        raise ContractError("frozen table is incomplete")
    saved = facts.first()
    if json.loads(saved["inputs"]) != dict(inputs):
        raise ContractError("frozen table was made from other inputs")
    if fingerprint_of(data) != (saved["rows"], saved["fingerprint"]):
        raise ContractError("frozen table was changed")
    return data


def project_allowlist(df: DataFrame, allowed: Sequence[str], required: Sequence[str] | None = None) -> DataFrame:
    """Only audited columns leave; an unlisted or absent column is an error."""
    extra, lacking = set(df.columns) - set(allowed), set(required or allowed) - set(df.columns)
    if extra or lacking:
        raise ContractError(f"columns not allowed: {sorted(extra)}; absent: {sorted(lacking)}")
    return df.select(*[c for c in allowed if c in df.columns])


def source_consistency(manifests: DataFrame) -> DataFrame:
    """Files whose digest differs between manifests ``(manifest, path, sha256)``."""
    return manifests.groupBy("path").agg(
        F.count(F.lit(1)).alias("manifests"), (F.min("sha256") != F.max("sha256")).alias("differs")
    )


def conflicts(manifests: DataFrame) -> DataFrame:
    return source_consistency(manifests).agg(count(F.col("differs")).alias("conflicting_files"))
