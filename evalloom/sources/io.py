"""Scans with a fixed contract, file inventories and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import HALF_MAX
from ..operators.checks import ContractError, check_schema, enforce
from .files import folder_files


def read_contract(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan with an exact ordered schema. A missing file or another header is an error.

    CSV text cells may hold newlines, which makes such files unsplittable: read them once
    here and write Parquet.
    """
    if fmt == "csv":
        settings = {"header": "true", "multiLine": "true", "escape": '"', "mode": "FAILFAST", "enforceSchema": "false", **options}
        header = spark.read.options(**{**settings, "inferSchema": "false"}).csv(path).columns
        if header != schema.fieldNames():
            raise ContractError(f"header of {path} differs from the contract")
        return spark.read.schema(schema).options(**settings).csv(path)
    df = spark.read.format(fmt).options(**options).load(path)
    enforce(check_schema(df, schema, path))
    return df


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Projected scan: columns not named, such as free text, are never read."""
    return spark.read.parquet(path).select(*cols)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, sha256, bytes)`` of all files below a folder, hashed in blocks where they are read; empty files count."""
    return folder_files(spark, path, glob).select("path", "sha256", "bytes")


SERIES_PATH = r"/([^/]+)_series/([^/]+)/([^/]+)/[^/]+$"


def series_inventory(spark: SparkSession, root: str, selected: DataFrame, suffix: str = "*.dcm", pattern: str = SERIES_PATH) -> DataFrame:
    """Files per selected ``(split, id, series_id)`` from paths ``<split>_series/<id>/<series>/<file>``, or others with three groups in ``pattern``.

    Contents are not read. ``state`` is ``no_matching_series``, ``no_dicom_files`` or ``found``.
    """
    files = folder_files(spark, root, suffix, sha256=False).filter(F.col("path").rlike(pattern))
    found = files.select(*[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(["split", "id", "series_id"])])
    counts = found.groupBy("split", "id", "series_id").agg(F.count(F.lit(1)).alias("n_files"))
    rows = selected.join(counts, ["split", "id", "series_id"], "left").na.fill(0, ["n_files"])
    state = F.when(F.col("series_id").isNull(), "no_matching_series").when(F.col("n_files") == 0, "no_dicom_files").otherwise("found")
    return rows.withColumn("state", state)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector rows ``(id, plane, window, vec)``, one folder per plane; never overwrites."""
    df.write.mode("errorifexists").partitionBy("plane").parquet(path)


def vector_facts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shape, finiteness, range and completeness of vectors in one aggregate."""
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > HALF_MAX))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"),
        F.count_if(broken).alias("broken"), F.count_if(F.col("vec").isNull()).alias("null_vectors"),
    )


def read_vectors(spark: SparkSession, path: str, dim: int, expected: DataFrame | None = None) -> DataFrame:
    """Vector rows, checked on read: width, finite values, one row per slot, every id with a plane."""
    df = spark.read.schema("id string, window int, vec array<float>, plane string").parquet(path)
    facts = vector_facts(df).first()
    if not facts["rows"] or facts["broken"] or facts["null_vectors"] or facts["min_dim"] != dim or facts["max_dim"] != dim:
        raise ContractError(f"vector table breaks its contract: {facts.asDict()}")
    repeated = df.groupBy("id", "plane", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        raise ContractError("a vector slot occurs twice")
    if expected is not None and expected.select("id").join(df.select("id"), "id", "left_anti").limit(1).count():
        raise ContractError("an id has no usable plane")
    return df


def explode_json_list(df: DataFrame, col: str, keys: Sequence[str], out: str = "value") -> DataFrame:
    """Rows of a JSON list-of-strings column; a cell that is no such list is counted as broken.

    Use ``check_json_list`` first; NULL items are dropped.
    """
    items = F.from_json(F.col(col), "array<string>")
    return df.select(*keys, F.explode(items).alias(out)).filter(F.col(out).isNotNull())


def check_json_list(df: DataFrame, col: str) -> DataFrame:
    from ..operators.checks import row_checks

    text = F.trim(F.col(col))
    strict = r'^\[\s*((null|"([^"\\]|\\.)*")\s*(,\s*(null|"([^"\\]|\\.)*")\s*)*)?\]$'
    return row_checks(df, col, {"json_list": text.isNull() | ~text.rlike(strict)})
