"""Small helpers of this subpackage: row keys, Arrow batches of bounded size, partition counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Bytes of text that a Python task holds as Python objects at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text of a row, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that tell rows apart; equal rows share them."""
    return [F.xxhash64(F.lit(0), *cols).alias("key_a"), F.xxhash64(F.lit(1), *cols).alias("key_b")]


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batch: pa.RecordBatch, sizes: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running sum of ``sizes`` passes ``limit``; every row is in one piece."""
    start = total = 0
    for i, n in enumerate(sizes.to_pylist()):
        if total and total + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_col: str = "text") -> DataFrame:
    """Apply ``fn`` to Arrow batches of about a megabyte of text each."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, pc.binary_length(batch.column(text_col))):
                yield fn(part)

    return df.mapInArrow(run, schema)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def fits(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether the values of a saved table take at most ``limit`` bytes, so that it may be broadcast."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    return df.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"] <= limit


def small_side(df: DataFrame) -> DataFrame:
    """A saved table for a join: broadcast if it fits, else left to a shuffle join."""
    return F.broadcast(df) if fits(df) else df.hint("shuffle_merge")
