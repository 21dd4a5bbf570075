"""Per-study features: counts, vector slots, pooling, intensity scaling, encoder surface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import broken_vector, guarded, not_finite
from .ordering import join_lookup, join_rows, quantiles
from .splits import PLANES, WINDOWS

# Fixed values of the count features.
CATEGORIES = {"plane": ["Axial", "Coronal", "Sagittal"], "fluid": ["0", "1"], "fat": ["0", "1"]}


def count_names(categories: Mapping[str, Sequence[str]]) -> list[str]:
    return ["total"] + [f"{c}_{v}" for c, values in categories.items() for v in values]


def count_features(parents: DataFrame, children: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """Children per parent, in total and per fixed category value; zero without children.

    A value outside the list counts in the total only. Columns of ``parents`` are kept.
    """
    cells = [
        F.count_if(F.coalesce(F.col(c).cast("string") == v, F.lit(False))).cast("double").alias(f"{c}_{v}")
        for c, values in categories.items() for v in values
    ]
    counted = children.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("total"), *cells)
    return join_rows(parents, counted, ["id"], "left").na.fill(0.0, count_names(categories))


def as_array(df: DataFrame, cols: Sequence[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def _checked(vectors: DataFrame, place: str, allowed: Sequence, dim: int | None = None) -> Column:
    """``vec``, or an error where its place is unknown or it is not a vector of finite numbers."""
    vec = F.col("vec")
    broken = vec.isNull() | ~F.col(place).isin(*allowed) | broken_vector(vec, dim if dim is not None else F.size(vec))
    return guarded(vec, broken, f"a vector has an unknown {place} or is not finite numbers of the expected width")


def _single(place: str, value, allowed: Sequence) -> Column:
    """The vector at a place of a group, where there is at most one and no place is unknown."""
    here, unknown = F.col(place) == value, F.count_if(F.coalesce(~F.col(place).isin(*allowed), F.lit(True)))
    return guarded(F.max(F.when(here, F.col("vec"))), (F.count_if(here) > 1) | (unknown > 0), f"{place} {value} is repeated, or another {place} is unknown")


def assemble_slots(ids: DataFrame, vectors: DataFrame, dim: int, planes: Sequence[str] = PLANES) -> DataFrame:
    """``(id, x)``: one fixed slot per plane, zeros where absent, then the presence flags.

    A repeated slot, a plane outside the list and a vector that isn't ``dim`` finite numbers are errors.
    """
    vectors = vectors.withColumn("vec", _checked(vectors, "plane", planes, dim))
    slots = [_single("plane", p, planes).alias(f"v{i}") for i, p in enumerate(planes)]
    packed = ids.select("id").join(vectors.groupBy("id").agg(*slots), "id", "left")
    empty = F.array_repeat(F.lit(0.0), dim)
    parts = [F.coalesce(F.col(f"v{i}").cast("array<double>"), empty) for i in range(len(planes))]
    flags = F.array(*[F.col(f"v{i}").isNotNull().cast("double") for i in range(len(planes))])
    return packed.select("id", F.concat(*parts, flags).alias("x"))


def presence_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "plane").distinct()


def mean_pool_windows(vectors: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """Mean vector over the windows of each (id, plane), summed in window order.

    A repeated window, one outside the range, and vectors of unequal width or with holes are errors.
    """
    vectors = vectors.withColumn("vec", _checked(vectors, "window", list(range(windows))))
    slots = [_single("window", w, list(range(windows))).alias(f"w{w}") for w in range(windows)]
    packed = vectors.groupBy("id", "plane").agg(*slots)
    present = F.filter(F.array(*[f"w{w}" for w in range(windows)]), lambda v: v.isNotNull())
    packed = packed.select("id", "plane", present.alias("vs"))
    first = F.transform(F.element_at("vs", 1), lambda x: x.cast("double"))
    uneven = F.array_max(F.transform("vs", F.size)) != F.array_min(F.transform("vs", F.size))
    packed = packed.withColumn("vs", guarded(F.col("vs"), uneven, "vectors of one slot differ in width"))
    summed = F.aggregate(F.slice("vs", 2, windows), first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return packed.select("id", "plane", F.transform(summed, lambda s: s / F.size("vs")).alias("vec"))


def clip_scale(pixels: DataFrame, *, invert: bool = False, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each image to its 1st and 99th percentile and scale to [0, 1]; constant images become 0.

    ``pixels(image, pixel, value)`` holds one row per pixel, so an image of any size
    spreads over tasks; percentiles are exact. ``invert`` first maps x to min + max - x.
    """
    rows = pixels.withColumn("value", guarded(F.col("value"), F.col("value").isNull() | not_finite(F.col("value")), "a pixel is not a finite number"))
    if invert:
        ends = rows.groupBy("image").agg((F.min("value") + F.max("value")).alias("_ends"))
        rows = join_lookup(rows, ends, ["image"], ["pixel"]).withColumn("value", F.col("_ends") - F.col("value")).drop("_ends")
    cuts = quantiles(rows, ["image"], "value", [low, high])
    cuts = cuts.groupBy("image").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = join_lookup(rows, cuts, ["image"], ["pixel"])
    scaled = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    return rows.select("image", "pixel", F.when(F.col("_hi") <= F.col("_lo"), 0.0).otherwise(bounded).alias("scaled"))


def pixel_hash(pixels: Column) -> Column:
    """Digest of the little-endian 32-bit float bytes of an array column."""

    def digest(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: None if p is None else hashlib.sha256(np.asarray(p, dtype="<f4").tobytes()).hexdigest())

    return F.pandas_udf(digest, T.StringType())(pixels)


def encode_batches(
    df: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], dim: int, *, keys: Sequence[str] = ("id", "plane", "window"),
    col: str = "pixels", batch: int = 32,
) -> DataFrame:
    """Run a user encoder over fixed-size batches inside the tasks: ``(keys, vec)``.

    The encoder sees at most ``batch`` rows and returns finite vectors of width ``dim``.
    """
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for start in range(0, len(frame), batch):
                block = np.stack([np.asarray(v, dtype=np.float32) for v in frame[col].iloc[start:start + batch]])
                out = np.asarray(encoder(block), dtype=np.float32)
                if out.shape != (len(block), dim) or not np.isfinite(out).all():
                    raise ValueError("the encoder must return finite vectors of the declared width")
                parts.extend(out)
            if parts:
                yield frame[keys].assign(vec=parts)

    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + ", vec array<float>"
    return df.select(*keys, col).mapInPandas(run, schema)


def attention_pool(
    vectors: DataFrame, params: Mapping[str, np.ndarray], planes: int = 3, windows: int = WINDOWS, ids: DataFrame | None = None
) -> DataFrame:
    """Score each (id, target) by masked softmax attention over the usable window slots.

    ``vectors(id, plane, window, vec)`` with 0-based plane and window; absent slots take no
    part. ``params``: ``proj [h, d]``, ``proj_bias [h]``, ``slot [planes*windows, h]``,
    ``query [t, h]``, ``out [t, h]``, ``out_bias [t]``, the fixed-size head. Every row of ``ids`` is scored; one without a usable slot is an error.
    """
    proj, bias, slot_emb = params["proj"], params["proj_bias"], params["slot"]
    query, out, out_bias = params["query"], params["out"], params["out_bias"]
    width = float(proj.shape[0]) ** 0.5

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            hidden = np.stack(frame["vec"].to_numpy()).astype(float) @ proj.T + bias + slot_emb[frame["slot"].to_numpy()]
            yield pd.DataFrame({
                "id": frame["id"], "slot": frame["slot"],
                "score": list(hidden @ query.T / width), "part": list(hidden @ out.T),
            })

    slot = (F.col("plane") * windows + F.col("window")).cast("int")
    place = F.col("plane").between(0, planes - 1) & F.col("window").between(0, windows - 1)
    vec = guarded(F.col("vec"), ~place | broken_vector(F.col("vec"), proj.shape[1]), "a window has an unknown slot or is not finite numbers of the expected width")
    rows = vectors.select("id", slot.alias("slot"), vec.alias("vec"))
    kind = dict(vectors.dtypes)["id"]
    rows = rows.mapInPandas(project, f"id {kind}, slot int, score array<double>, part array<double>")
    slots = [
        guarded(F.max(F.when(F.col("slot") == s, F.struct("score", "part"))), F.count_if(F.col("slot") == s) > 1, f"slot {s} is repeated")
        for s in range(planes * windows)
    ]
    packed = rows.groupBy("id").agg(F.filter(F.array(*slots), lambda s: s.isNotNull()).alias("s"))
    if ids is not None:
        packed = ids.select("id").join(packed, "id", "left")
        packed = packed.withColumn("s", guarded(F.col("s"), F.col("s").isNull(), "an id has no usable slot"))
    targets = F.sequence(F.lit(0), F.lit(len(out_bias) - 1))
    each = packed.select("id", "s", F.explode(targets).alias("target")).withColumn(
        "peak", F.array_max(F.transform("s", lambda x: F.get(x["score"], F.col("target"))))
    )

    def mass(x: Column) -> Column:
        return F.exp(F.get(x["score"], F.col("target")) - F.col("peak"))

    top = F.aggregate("s", F.lit(0.0), lambda a, x: a + mass(x) * F.get(x["part"], F.col("target")))
    low = F.aggregate("s", F.lit(0.0), lambda a, x: a + mass(x))
    constant = F.array(*[F.lit(float(b)) for b in out_bias])
    return each.select("id", "target", (top / low + F.get(constant, F.col("target"))).alias("logit"))
