"""Array arithmetic that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGIT_LIMIT = 700.0
HALF_MAX = 65504.0  # largest value a 16-bit float can hold


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def sigmoid(logit: Column) -> Column:
    bounded = F.greatest(F.lit(-LOGIT_LIMIT), F.least(F.lit(LOGIT_LIMIT), logit))
    return F.when(~F.isnan(logit), 1.0 / (1.0 + F.exp(-bounded)))  # NULL and NaN give NULL: greatest and least would skip them


def guarded(value: Column, broken: Column, message: str) -> Column:
    """``value``, or an error where ``broken`` holds or is unknown."""
    return F.when(F.coalesce(~broken, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def broken_vector(x: Column, dim: int | Column) -> Column:
    """Not an array of ``dim`` finite numbers."""
    return x.isNull() | (F.size(x) != dim) | F.exists(x, lambda v: v.isNull() | not_finite(v))


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def quantize_u8(x: Column) -> Column:
    """``rint(255 * clip(x, 0, 1))``: half goes to even."""
    return F.rint(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).cast("smallint")


def normalize_channel(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


# Channel means and deviations of the image encoder.
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]
