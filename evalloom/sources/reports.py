"""Small result tables: long ``(section, metric, key, value)`` rows without ids or text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section(name: str, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unfold an aggregate: one row per metric column, keyed by the joined key columns."""
    metrics = [c for c in df.columns if c not in keys]
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]) if keys else F.lit("")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(name).alias("section"), key.alias("key"), F.explode(cells).alias("c")).select(
        "section", "c.metric", "key", "c.value"
    )


def report(sections: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [section(n, df, keys) for n, (df, keys) in sections.items()])


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Aggregates are small; one file per report. Never overwrites."""
    df.coalesce(1).write.mode("errorifexists").format(fmt).save(path)
