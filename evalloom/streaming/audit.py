"""Incremental audit: files arrive, every micro-batch appends its rows and a progress line."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_audit_stream(
    spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], out: str,
    checkpoint: str, *, glob: str = "*.parquet", fmt: str = "parquet", max_files: int = 12,
) -> DataFrame:
    """Process all files now waiting and return everything written so far.

    Each batch writes its own ``batch_id=`` folder by overwrite, so a retried batch
    replaces itself. ``progress`` gains one row per batch; after a failure the rows so
    far stay and the batch is marked ``failed``. Running again continues from the
    checkpoint. ``out`` and ``checkpoint`` must lie in storage all executors share.
    """
    rows_path, progress_path = posixpath.join(out, "rows"), posixpath.join(out, "progress")

    def mark(batch_id: int, rows: int, status: str) -> None:
        line = spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.lit(status).alias("status"))
        line.coalesce(1).write.mode("overwrite").parquet(posixpath.join(progress_path, f"batch_id={batch_id}"))

    def write(batch: DataFrame, batch_id: int) -> None:
        target = posixpath.join(rows_path, f"batch_id={batch_id}")
        try:
            transform(batch).write.mode("overwrite").parquet(target)
        except Exception:
            mark(batch_id, 0, "failed")
            raise
        mark(batch_id, spark.read.parquet(target).count(), "complete")

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(rows_path)


def progress(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(out, "progress"))
