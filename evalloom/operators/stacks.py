"""Series choice, slice order, sampling, windows and nearest fill over long slice rows.

A series may be of any length: order comes from ``ranked`` and neighbors meet by
``(series, position)``, so no task has to hold a whole stack.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, not_finite
from ..session import reuse
from .ordering import join_lookup, ranked
from .splits import PLANES

# Tolerances of direction cosines and slice distance, and the truthy flags.
COSINE_TOLERANCE = 1e-3
RELATIVE_TOLERANCE = 1e-5
MIN_GAP = 1e-4
TRUE_FLAGS = ["1", "1.0", "True"]
FAILURES = ["header_failures", "decode_failures", "repeated_failed_samples", "spacing_fallbacks"]


def _flag(name: str, df: DataFrame) -> Column:
    text = F.col(name).cast("string")
    if dict(df.dtypes)[name] == "boolean":
        text = F.initcap(text)
    return F.coalesce(text.isin(*TRUE_FLAGS), F.lit(False))


def select_series(ids: DataFrame, series: DataFrame, planes: Sequence[str] = PLANES) -> DataFrame:
    """One series per (id, plane): fluid-sensitive first, then fat-suppressed, then least id.

    An absent plane stays as a row with NULL series.
    """
    best = series.select(
        "id", F.lower("plane").alias("_plane"),
        F.struct((~_flag("fluid", series)).alias("a"), (~_flag("fat", series)).alias("b"), F.col("series_id").cast("string").alias("s")).alias("c"),
    ).filter(F.col("_plane").isin(*[p.lower() for p in planes])).groupBy("id", "_plane").agg(F.min("c").alias("c"))
    slots = ids.select("id", F.explode(F.array(*[F.lit(p) for p in planes])).alias("plane")).withColumn("_plane", F.lower("plane"))
    return slots.join(best, ["id", "_plane"], "left").select("id", "plane", F.col("c.s").alias("series_id"))


def _norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _cross(a: Column, b: Column) -> Column:
    def g(v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))

    return F.array(
        g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1), g(a, 2) * g(b, 0) - g(a, 0) * g(b, 2), g(a, 0) * g(b, 1) - g(a, 1) * g(b, 0)
    )


def _placed_slices(headers: DataFrame) -> DataFrame:
    """``(series, slice, _valid, _inst, _apart, _key)``: whether a slice's geometry is valid, differs from that of the first, and where it lies.

    Kept, as several facts of a series are taken from it: each would meet the rows with their arrays again, all in one task of a later stage.
    """
    ori, loc = F.col("orientation"), F.col("position")
    finite = ~F.exists(ori, lambda x: x.isNull() | not_finite(x)) & ~F.exists(loc, lambda x: x.isNull() | not_finite(x))
    row, col = F.slice(ori, 1, 3), F.slice(ori, 4, 3)
    unit = COSINE_TOLERANCE + RELATIVE_TOLERANCE
    cosines = (F.abs(_norm(row) - 1) <= unit) & (F.abs(_norm(col) - 1) <= unit) & (F.abs(dot(row, col)) <= COSINE_TOLERANCE)
    valid = F.coalesce((F.size(ori) == 6) & (F.size(loc) == 3) & finite & cosines, F.lit(False))
    rows = headers.select("series", "slice", "orientation", "position", valid.alias("_valid"), F.col("instance").try_cast("double").alias("_inst"))

    first = rows.filter("_valid").groupBy("series").agg(F.min_by("orientation", "slice").alias("_first"))
    first = first.withColumn("_normal", _cross(F.slice("_first", 1, 3), F.slice("_first", 4, 3))).withColumn("_length", _norm(F.col("_normal")))
    rows = join_lookup(rows, first, ["series"], ["slice"])
    apart = F.exists(
        F.zip_with("orientation", "_first", lambda a, b: F.abs(a - b) > COSINE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(b)), lambda x: x
    )
    key = F.when(F.col("_valid"), dot(F.col("position"), F.col("_normal")) / F.col("_length"))
    return reuse(rows.select("series", "slice", "_valid", "_inst", (F.col("_valid") & apart).alias("_apart"), key.alias("_key")))


def order_methods(headers: DataFrame) -> DataFrame:
    """``(series, method, reason)``: what the slices of each series can be ordered by; see ``order_slices``."""
    return _methods(_placed_slices(headers))


def _methods(rows: DataFrame) -> DataFrame:
    # Two slices too close: equal cell, or the facing ends of two neighboring cells.
    cells = rows.filter("_valid").groupBy("series", F.floor(F.col("_key") / MIN_GAP).alias("cell")).agg(
        F.count(F.lit(1)).alias("k"), F.min("_key").alias("lo"), F.max("_key").alias("hi")
    )
    facing = cells.select("series", F.explode(F.array(
        F.struct(F.col("cell").alias("cell"), F.col("k").alias("k"), F.col("lo").alias("lo"), F.lit(None).cast("double").alias("prev")),
        F.struct((F.col("cell") + 1).alias("cell"), F.lit(1).cast("bigint").alias("k"), F.lit(None).cast("double").alias("lo"), F.col("hi").alias("prev")),
    )).alias("c")).select("series", "c.*").groupBy("series", "cell").agg(
        F.max("k").alias("k"), (F.max("lo") - F.max("prev")).alias("gap")
    )
    close = facing.groupBy("series").agg(F.max((F.col("k") > 1) | F.coalesce(F.col("gap") <= MIN_GAP, F.lit(False))).alias("close"))
    repeated = rows.groupBy("series", "_inst").agg(F.count(F.lit(1)).alias("k")).groupBy("series").agg(
        F.max((F.col("k") > 1) | F.col("_inst").isNull() | not_finite(F.col("_inst"))).alias("bad_instance")
    )
    facts = rows.groupBy("series").agg(F.min("_valid").alias("all_valid"), F.max("_apart").alias("mixed"))
    facts = facts.join(close, "series", "left").join(repeated, "series", "left")
    # The names of methods and reasons.
    reason = F.when(~F.col("all_valid"), "missing or invalid geometry").when(F.coalesce(F.col("close"), F.lit(False)), "duplicate slice positions")
    method = (
        F.when(F.coalesce(F.col("mixed"), F.lit(False)), "rejected").when(reason.isNull(), "geometry")
        .when(~F.coalesce(F.col("bad_instance"), F.lit(True)), "InstanceNumber").otherwise("rejected")
    )
    why = F.when(F.col("mixed"), "inconsistent orientation").otherwise(reason)
    return reuse(facts.select("series", method.alias("method"), why.alias("reason")))


def order_slices(headers: DataFrame, **sizing: int) -> DataFrame:
    """Order the slices of each series: ``(series, slice, method, reason, pos, n, position)``.

    ``headers(series, slice, orientation[6], position[3], instance)``; ``slice`` is a unique
    name inside the series. All slices lie on geometry, or all on unique instance numbers;
    ``pos`` is 0-based, NULL with method ``rejected``. File order is never used.
    """
    rows = _placed_slices(headers)
    facts = _methods(rows)
    rows = join_lookup(rows, facts, ["series"], ["slice"])
    sort_key = F.when(F.col("method") == "geometry", F.col("_key")).when(F.col("method") == "InstanceNumber", F.col("_inst"))
    placed = ranked(rows.withColumn("_sort", sort_key).select("series", "slice", "method", "reason", "_key", "_sort"), ["series"], ["_sort", "slice"], **sizing)
    kept = F.col("method") != "rejected"
    return placed.select(
        "series", "slice", "method", "reason", F.when(kept, F.col("rn") - 1).alias("pos"), "n",
        F.when(F.col("method") == "geometry", F.col("_key")).alias("position"),
    )


def sample_positions(n: Column, count: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``count`` evenly spaced positions of an ``n``-slice stack between two fractions."""
    last = (n - 1).cast("double")
    if count == 1:
        return F.array(F.floor(n / 2).cast("bigint") if (lo, hi) == (0.0, 1.0) else F.rint(last * lo).cast("bigint"))
    start, stop = last * lo, last * hi
    step = (stop - start) / (count - 1)
    points = [F.rint(start + step * i).cast("bigint") for i in range(count - 1)]
    return F.array(*points, F.rint(stop).cast("bigint"))


def even_sample(ordered: DataFrame, count: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Rows of an ordered stack ``(series, pos, n, ...)`` that are sampled, once per ``sample``.

    Each row knows its position and the stack size, so it finds its own samples: no join.
    """
    slots = F.transform(sample_positions(F.col("n"), count, lo, hi), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    mine = F.transform(F.filter(slots, lambda s: s["p"] == F.col("pos")), lambda s: s["i"])
    return ordered.select("*", F.explode(mine).alias("sample"))


def neighbor_windows(samples: DataFrame, payload: str, width: int = 3) -> DataFrame:
    """Overlapping windows of consecutive samples: ``(series, window, items)``, incomplete ones dropped."""
    starts = F.sequence(F.greatest(F.lit(0), F.col("sample") - (width - 1)), F.col("sample"))
    rows = samples.select("series", "sample", payload, F.explode(starts).alias("window"))
    slots = [F.max(F.when(F.col("sample") - F.col("window") == j, F.col(payload))).alias(f"w{j}") for j in range(width)]
    packed = rows.groupBy("series", "window").agg(F.count(F.lit(1)).alias("k"), *slots).filter(F.col("k") == width)
    return packed.select("series", "window", F.array(*[f"w{j}" for j in range(width)]).alias("items"))


def fill_nearest(samples: DataFrame, payload: str, count: int) -> DataFrame:
    """Give each failed sample the nearest good one of its series, the first on ties.

    ``samples(series, sample, pos, ok, payload)`` with ``sample < count``. A series
    without a good sample yields no rows.
    """
    def at(i: int, cond: Column) -> Column:
        return F.max(F.when((F.col("sample") == i) & cond, F.struct("pos", "sample", payload)))

    packed = samples.groupBy("series").agg(
        F.array(*[at(i, F.lit(True)) for i in range(count)]).alias("every"),
        F.array(*[at(i, F.col("ok")) for i in range(count)]).alias("good"),
    )
    packed = packed.withColumn("every", F.filter("every", lambda s: s.isNotNull())).withColumn(
        "good", F.filter("good", lambda s: s.isNotNull())
    ).filter(F.size("good") > 0)
    rows = packed.select("series", F.explode("every").alias("s"), "good")
    nearest = F.array_min(F.transform("good", lambda g: F.struct(F.abs(g["pos"] - F.col("s.pos")).alias("d"), g["sample"].alias("from"), g[payload].alias("v"))))
    own = F.exists("good", lambda g: g["sample"] == F.col("s.sample"))
    mine = F.element_at(F.filter("good", lambda g: g["sample"] == F.col("s.sample")), 1)
    return rows.withColumn("_near", F.when(~own, nearest)).select(
        "series", F.col("s.sample").alias("sample"), F.col("s.pos").alias("pos"),
        F.coalesce(F.col("_near.from"), F.col("s.sample")).alias("source"),
        F.when(own, mine[payload]).otherwise(F.col("_near.v")).alias(payload), (~own).alias("repeated"),
    )


def series_status(selected: DataFrame) -> DataFrame:
    """Status ladder from ``series_id, n_files, method, good`` and the failure counts."""
    fallback = (F.col("header_failures") + F.col("decode_failures") + F.col("spacing_fallbacks") > 0) | (F.col("method") != "geometry")
    # The names of the status ladder.
    status = (
        F.when(F.col("series_id").isNull(), "no_matching_series")
        .when(F.coalesce("n_files", F.lit(0)) == 0, "no_dicom_files")
        .when(F.coalesce("method", F.lit("rejected")) == "rejected", "unorderable_series")
        .when(F.coalesce("good", F.lit(0)) == 0, "all_sampled_slices_failed")
        .when(fallback, "usable_with_fallback").otherwise("usable")
    )
    return selected.withColumn("status", status)


def study_quality(series: DataFrame, planes: Sequence[str] = PLANES) -> DataFrame:
    """Per id: usable planes, missing planes joined by ``|`` in the fixed order, failure sums."""
    usable = F.col("status").startswith("usable")
    flags = [F.max(F.when(F.col("plane") == p, usable.cast("int")).otherwise(0)).alias(f"_p{i}") for i, p in enumerate(planes)]
    sums = [F.sum(c).cast("bigint").alias(c) for c in FAILURES]
    by_number = F.count_if(F.coalesce(F.col("method") == "InstanceNumber", F.lit(False))).alias("instance_number_planes")
    row = series.groupBy("id").agg(*flags, *sums, by_number)
    present = sum((F.col(f"_p{i}") for i in range(len(planes))), F.lit(0))
    missing = F.concat_ws("|", *[F.when(F.col(f"_p{i}") == 0, F.lit(p)) for i, p in enumerate(planes)])
    return row.select("id", present.alias("usable_planes"), missing.alias("missing_planes"), *FAILURES, "instance_number_planes")
