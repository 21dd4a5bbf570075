"""Contract checks: rows ``(check, subject, violations)``; ``enforce`` raises on any.

Conditions over one table fuse into one aggregate pass; cross-table checks are anti,
semi or key joins over keys made distinct first, so a hot key is one row by then.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DIGEST, is_blank
from ..functions.vectors import HALF_MAX, not_finite
from .ordering import join_rows


class ContractError(ValueError):
    """A table breaks its contract."""


def _rows(row: DataFrame, subject: str, names: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(n).alias("check"), F.lit(subject).alias("subject"),
                 F.coalesce(F.col(f"`{n}`").cast("bigint"), F.lit(0)).alias("violations"))
        for n in names
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _count(df: DataFrame, subject: str, name: str) -> DataFrame:
    return _rows(df.agg(F.count(F.lit(1)).alias(name)), subject, [name])


def union(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(*checks: DataFrame) -> None:
    """Raise with the broken checks; the driver sees one row per check, never data rows."""
    if not checks:
        return
    broken = union(checks).filter("violations > 0").collect()
    if broken:
        raise ContractError("; ".join(f"{r['check']} on {r['subject']}: {r['violations']}" for r in broken))


def row_checks(df: DataFrame, subject: str, rules: Mapping[str, Column]) -> DataFrame:
    """Count the rows that meet each broken-rule condition, all in one pass; a condition that is NULL counts as met."""
    return _rows(df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()]), subject, list(rules))


# Conditions that name a broken cell, to be fused by ``row_checks``.

def bad_binary(value: Column, nullable: bool = True) -> Column:
    bad = ~value.isin(0, 1)
    return F.coalesce(bad, F.lit(not nullable))  # NULL is a value of its own here


def bad_probability(value: Column) -> Column:
    return value.isNull() | not_finite(value) | (value < 0) | (value > 1)


def bad_enum(value: Column, allowed: Sequence[str]) -> Column:
    return value.isNull() | ~value.isin(*allowed)


def bad_digest(value: Column) -> Column:
    return value.isNull() | ((value != "") & ~value.rlike(DIGEST))


def bad_count(value: Column) -> Column:
    return value.isNull() | F.isnan(value.cast("double")) | (value < 0) | (value % 1 != 0)


def bad_vector(vec: Column, dim: int) -> Column:
    broken = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > HALF_MAX))
    return vec.isNull() | (F.size(vec) != dim) | broken


# Whole checks.

def check_schema(df: DataFrame, expected: T.StructType, subject: str = "table") -> DataFrame:
    """Exact ordered names and types; reads metadata only."""
    actual = [(f.name, f.dataType) for f in df.schema.fields]
    wanted = [(f.name, f.dataType) for f in expected.fields]
    differ = sum(a != b for a, b in zip(actual, wanted)) + abs(len(actual) - len(wanted))
    row = df.sparkSession.range(1).select(F.lit(differ).alias("schema"))
    return _rows(row, subject, ["schema"])


def check_key(
    df: DataFrame, cols: Sequence[str], subject: str = "table", *, unique: bool = True, padded: bool = True
) -> DataFrame:
    """Table not empty; key not null, not blank, not padded; each key once."""
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}  # never blank or padded
    texts = [F.col(c).cast("string") for c in cols if c not in numbers]
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    blank = reduce(lambda a, b: a | b, [t.isNotNull() & is_blank(t) for t in texts], F.lit(False))
    pad = reduce(lambda a, b: a | b, [t.rlike(r"(?U)^\s|\s$") & ~is_blank(t) for t in texts], F.lit(False))
    aggs = [
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("empty"),
        F.count_if(null).alias("null_key"), F.count_if(blank).alias("blank_key"),
    ]
    if padded:
        aggs.append(F.count_if(F.coalesce(pad, F.lit(False))).alias("padded_key"))
    names = ["empty", "null_key", "blank_key"] + (["padded_key"] if padded else [])
    out = _rows(df.agg(*aggs), subject, names)
    if unique:
        out = out.unionByName(check_unique(df, cols, subject))
    return out


def check_unique(df: DataFrame, cols: Sequence[str], subject: str = "table") -> DataFrame:
    repeated = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _count(repeated, subject, "duplicate_key")


def _keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def check_subset(a: DataFrame, b: DataFrame, cols: Sequence[str], subject: str = "a in b") -> DataFrame:
    return _count(join_rows(_keys(a, cols), _keys(b, cols), cols, "left_anti"), subject, "orphan_key")


def check_set_equal(a: DataFrame, b: DataFrame, cols: Sequence[str], subject: str = "a = b") -> DataFrame:
    """Two key sets are identical; one full join reports both directions."""
    left = _keys(a, cols).withColumn("_a", F.lit(1))
    right = _keys(b, cols).withColumn("_b", F.lit(1))
    both = join_rows(left, right, cols, "full")
    return row_checks(both, subject, {"missing_right": F.col("_b").isNull(), "missing_left": F.col("_a").isNull()})


def check_disjoint(a: DataFrame, b: DataFrame, cols: Sequence[str], subject: str = "a, b") -> DataFrame:
    return _count(join_rows(_keys(a, cols), _keys(b, cols), cols, "left_semi"), subject, "shared_key")


def check_binary_or_null(df: DataFrame, cols: Sequence[str], subject: str = "table", nullable: bool = True) -> DataFrame:
    return row_checks(df, subject, {f"binary:{c}": bad_binary(F.col(c), nullable) for c in cols})


def check_probability(df: DataFrame, cols: Sequence[str], subject: str = "table") -> DataFrame:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    rules = {f"probability:{c}": bad_probability(F.col(c)) if c in numeric else F.lit(True) for c in cols}
    return row_checks(df, subject, rules)


def check_enum(df: DataFrame, col: str, allowed: Sequence[str], subject: str = "table") -> DataFrame:
    return row_checks(df, subject, {f"enum:{col}": bad_enum(F.col(col), allowed)})


def check_fd(df: DataFrame, lhs: str, rhs: str, subject: str = "table") -> DataFrame:
    """Each ``lhs`` group carries one ``rhs`` value; min and max combine map-side."""
    crossing = df.groupBy(lhs).agg(F.min(rhs).alias("_lo"), F.max(rhs).alias("_hi")).filter("_lo <> _hi")
    return _count(crossing, subject, f"crosses:{rhs}")


def check_complete_categories(
    df: DataFrame, id_col: str, cat_col: str, required: Sequence[str], subject: str = "table"
) -> DataFrame:
    """Every id has exactly the required categories: one flag each plus a stray flag."""
    seen = [F.max(F.when(F.col(cat_col) == c, 1).otherwise(0)).alias(f"_{i}") for i, c in enumerate(required)]
    stray = F.max(F.when(F.col(cat_col).isin(*required), 0).otherwise(1)).alias("_stray")
    flags = df.groupBy(id_col).agg(stray, *seen)
    complete = reduce(lambda a, b: a & b, [F.col(f"_{i}") == 1 for i in range(len(required))]) & (F.col("_stray") == 0)
    return row_checks(flags, subject, {"incomplete_categories": ~complete})


def check_cross_values(
    a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str], subject: str = "a, b"
) -> DataFrame:
    """Attributes agree, NULL with NULL, wherever the key is on both sides; equal rows of a side count once."""
    right = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in cols]).distinct()
    both = join_rows(a.select(*key, *cols).distinct(), right, key)
    return row_checks(both, subject, {f"differs:{c}": ~F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in cols})


def check_same_order(a: DataFrame, b: DataFrame, id_col: str, subject: str = "a, b", row_col: str = "row_idx") -> DataFrame:
    left = a.select(row_col, F.col(id_col).alias("_a"))
    right = b.select(row_col, F.col(id_col).alias("_b"))
    both = join_rows(left, right, [row_col], "full")
    return row_checks(both, subject, {"order": ~F.col("_a").eqNullSafe(F.col("_b"))})


def check_digest(df: DataFrame, cols: Sequence[str], subject: str = "table") -> DataFrame:
    return row_checks(df, subject, {f"digest:{c}": bad_digest(F.col(c)) for c in cols})


def check_count(df: DataFrame, cols: Sequence[str], subject: str = "table") -> DataFrame:
    return row_checks(df, subject, {f"count:{c}": bad_count(F.col(c)) for c in cols})


def check_vector(df: DataFrame, col: str, dim: int, subject: str = "table") -> DataFrame:
    return row_checks(df, subject, {"vector": bad_vector(F.col(col), dim)})


def check_class_support(support: DataFrame, subject: str = "folds") -> DataFrame:
    """Both classes in every (fold, target) cell of a support table; offenders are named."""
    return support.filter("positive = 0 or negative = 0").select(
        F.lit("class_support").alias("check"),
        F.concat_ws(":", F.lit(subject), F.col("fold").cast("string"), F.col("target")).alias("subject"),
        F.lit(1).cast("bigint").alias("violations"),
    )


def check_distinct_groups(df: DataFrame, group_col: str, subject: str = "gold") -> DataFrame:
    return check_unique(df, [group_col], subject)
