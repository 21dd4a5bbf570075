"""Profiling aggregates over the long target table ``(id, target, value)`` and its relatives.

Everything is a map-side combined aggregate; matrices and zero cells come from the fixed
target and fold lists, not from joins of the data with itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, CYRILLIC, NON_ASCII, is_blank, length
from .ordering import quantiles


def _grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """All combinations of small fixed lists, from one generated row."""
    grid = df.sparkSession.range(1).drop("id")
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def _stack(row: DataFrame, keep: Sequence[str], cells: Mapping[str, Column], key: str = "metric", value: str = "value") -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias(key), c.alias(value)) for n, c in cells.items()])
    return row.select(*keep, F.explode(items).alias("_c")).select(*keep, "_c.*")


def count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def label_completeness(targets: DataFrame, n_targets: int) -> DataFrame:
    """Fully, partially and not labeled ids."""
    per_id = targets.groupBy("id").agg(F.count("value").alias("k"))
    return per_id.agg(
        count(F.col("k") == n_targets).alias("fully_labeled"),
        count((F.col("k") > 0) & (F.col("k") < n_targets)).alias("partially_labeled"),
        count(F.col("k") == 0).alias("unlabeled"),
    )


def target_summary(targets: DataFrame) -> DataFrame:
    return targets.groupBy("target").agg(
        F.count("value").alias("observed"), count(F.col("value").isNull()).alias("unknown"),
        count(F.col("value") == 1).alias("positive"), count(F.col("value") == 0).alias("negative"),
        F.avg("value").alias("prevalence"),
    )


def cooccurrence(targets: DataFrame, names: Sequence[str], kind: str = "positive") -> DataFrame:
    """Target by target counts of joint positives, or of joint observations.

    One flag per target and id, then all products in a single aggregate: the row count
    never grows with the square of anything.
    """
    met = F.col("value") == 1 if kind == "positive" else F.col("value").isNotNull()
    flags = targets.groupBy("id").agg(
        *[F.max(F.when((F.col("target") == t) & met, 1).otherwise(0)).alias(f"f{i}") for i, t in enumerate(names)]
    )
    sums = flags.agg(*[
        F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{j}")), F.lit(0)).cast("bigint").alias(f"s{i}_{j}")
        for i in range(len(names)) for j in range(len(names))
    ])
    cells = F.array(*[
        F.struct(F.lit(a).alias("target_a"), F.lit(b).alias("target_b"), F.col(f"s{i}_{j}").alias("n"))
        for i, a in enumerate(names) for j, b in enumerate(names)
    ])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def value_frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value of each category column, NULL kept, all columns in one job."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def keys_by_category(df: DataFrame, category: str, key: str) -> DataFrame:
    return df.groupBy(category).agg(F.countDistinct(key).alias("n"))


def describe(df: DataFrame, value: str, points: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quantiles and max as rows ``(by, metric, value)``."""
    by = list(by)
    v = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(value).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    names = ["count", "mean", "std", "min", "max"]
    rows = _stack(moments, by, {n: F.col(n) for n in names})
    middle = quantiles(df, by, value, points)
    return rows.unionByName(middle.select(*by, F.concat(F.lit("q"), F.col("q").cast("string")).alias("metric"), "value"))


def children_per_parent(children: DataFrame, parent: str) -> DataFrame:
    return describe(children.groupBy(parent).agg(F.count(F.lit(1)).alias("n")), "n")


def text_length_profile(df: DataFrame, text: str, flag: str) -> DataFrame:
    """Length distribution overall and per flag value; scope ``all``, ``true``, ``false``."""
    rows = df.select(
        length(F.col(text)).alias("chars"),
        F.explode(F.array(F.lit("all"), F.col(flag).cast("string"))).alias("scope"),
    )
    return describe(rows, "chars", (0.05, 0.25, 0.5, 0.75, 0.95), by=["scope"])


def script_counts(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    # The metric names.
    return df.agg(
        F.count_if(t.rlike(CYRILLIC)).alias("containing_cyrillic"), F.count_if(t.rlike(CJK)).alias("containing_cjk"),
        F.count_if(t.rlike(NON_ASCII)).alias("containing_non_ascii"),
    )


def columns_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """True when the columns agree on every row; a NULL on either side is a difference."""
    return df.agg((F.count_if(F.coalesce(F.col(a) != F.col(b), F.lit(True))) == 0).alias("equal"))


def missing_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    per_row = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("missing_cells"))


def nonblank_count(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count_if(~is_blank(F.col(text))).alias("nonblank"))


def fold_support(targets: DataFrame, folds: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Observed, positive and negative per fold and target, empty cells included."""
    seen = targets.groupBy("fold", "target").agg(
        F.count("value").alias("observed"), count(F.col("value") == 1).alias("positive"),
        count(F.col("value") == 0).alias("negative"),
    )
    grid = _grid(targets, fold=folds, target=names)
    return grid.join(seen, ["fold", "target"], "left").na.fill(0, ["observed", "positive", "negative"])


def fold_sizes(targets: DataFrame) -> DataFrame:
    per_id = targets.groupBy("fold", "id").agg(F.count("value").alias("k"))
    return per_id.groupBy("fold").agg(F.count(F.lit(1)).alias("ids"), count(F.col("k") > 0).alias("labeled"))


def quality_totals(quality: DataFrame, failures: Sequence[str], planes: int = 3) -> DataFrame:
    row = quality.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in failures],
        count(F.col("usable_planes") < planes).alias("ids_with_missing_planes"),
        count(F.col("usable_planes") == 0).alias("ids_with_zero_usable_planes"),
    )
    return _stack(row, [], {n: F.col(n) for n in row.columns})


def profile_conflicts(features: DataFrame, feature_cols: Sequence[str], targets: DataFrame) -> DataFrame:
    """Distinct feature profiles, repeated ones, and repeated ones whose labels disagree."""
    per_id = targets.groupBy("id").agg(F.count("value").alias("_k"))
    spread = targets.join(features.select("id", *feature_cols), "id").groupBy(*feature_cols, "target").agg(
        F.max("value").alias("_hi"), F.min("value").alias("_lo")
    )
    conflict = spread.groupBy(*feature_cols).agg(F.max((F.col("_hi") > F.col("_lo")).cast("int")).alias("conflict"))
    sizes = features.join(per_id, "id", "left").groupBy(*feature_cols).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(conflict, list(feature_cols), "left").agg(
        F.count(F.lit(1)).alias("profiles"), count(F.col("n") > 1).alias("repeated_profiles"),
        count((F.col("n") > 1) & (F.col("conflict") == 1)).alias("conflicting_profiles"), F.max("n").alias("largest_profile"),
    )


def feature_gram(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Products ``sum(x_i x_j)`` for narrow features, one pass; the rank is read off the small result."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = features.agg(*[
        F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"g{i}_{j}") for i, j in pairs
    ])
    cells = F.array(*[
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"g{i}_{j}").alias("gram")) for i, j in pairs
    ])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def wide_gram(features: DataFrame, col: str = "x"):
    """Gram matrix of an array feature: one product per Arrow batch, summed by task, then on the executors; bounded by the width."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def products(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    vectors = features.select(F.col(col).cast("array<double>").alias("v"))
    sums = vectors.mapInArrow(products, "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    return np.stack([r["s"].toArray() for r in sums.orderBy("i").collect()])  # one row for each column of the matrix


def gram_rank(gram) -> int:
    """Rank of a Gram matrix already on the driver."""
    import numpy as np

    return int(np.linalg.matrix_rank(gram, hermitian=True))


def target_source_counts(supervision: DataFrame) -> DataFrame:
    """Observed and derived cells used per target."""
    return supervision.groupBy("target").agg(
        count(F.col("observed").isNotNull()).alias("observed_cells"),
        count(F.col("observed").isNull() & (F.col("weight") > 0)).alias("derived_cells"),
    )
