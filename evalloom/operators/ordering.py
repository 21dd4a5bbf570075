"""Global order without a single-task window, and joins that survive hot keys.

``ranked`` numbers rows inside groups of any size. A sizing pass counts the rows. A key
that fits one task is ordered by a plain window. A hot key, one above a row limit that follows
from ``min_rows``, ``buckets`` and the constants below, is cut by boundaries drawn from a hash sample of its order
values; a row's bucket is the number of boundaries at or below it, a pure function of
the row, so equal values meet and the result does not depend on which boundaries were
drawn. The limit is at least ``total / max(buckets, MAX_BOUNDS)``, so hot keys and their
boundaries together stay below a fixed number whatever the size of the data. Only those boundaries visit the
driver, as in a range-partitioned sort, and that side may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 16
HASH_RANGE = 1 << 30
MIN_ROWS = 100_000  # fewer rows of one key than this are ordered in one task
MAX_TASK_ROWS = 20_000_000  # more than this are not, as long as the boundaries stay few
MAX_BOUNDS = 20_000
LANES = 64  # of a key in the first cut of a top-k


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return buckets
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(4096, 2 * tasks))


def _same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs])


def _evenly(items: Column, pieces: Column) -> Column:
    """``pieces - 1`` inner cut points of a sorted array."""
    return F.when(pieces > 1, F.transform(
        F.sequence(F.lit(1), pieces - 1), lambda i: F.get(items, (F.size(items) * i / pieces).cast("int"))
    ))


def _boundaries(df: DataFrame, names: Sequence[str], place: Column, buckets: int, min_rows: int) -> DataFrame | None:
    """Per hot key a two-level sorted boundary list as a local table; None if no key is hot."""
    total = df.count()
    limit = max(min_rows, min(-(-total // buckets), MAX_TASK_ROWS), -(-total // MAX_BOUNDS))
    if total <= limit:
        return None
    spark = df.sparkSession
    heads = [f"_h{i}" for i in range(len(names))]
    counts = df.groupBy(*[F.col(k).alias(h) for k, h in zip(names, heads)]).agg(F.count(F.lit(1)).alias("_c"))
    over = counts.filter(F.col("_c") > limit).withColumn("_pieces", F.ceil(F.col("_c") / F.lit(limit)).cast("int")).drop("_c")
    found = over.collect()  # at most max(buckets, MAX_BOUNDS) rows: each holds more than ``limit`` rows
    if not found:
        return None
    hot = spark.createDataFrame(found, over.schema)
    rows = df.select(*names, place.alias("_p")).join(F.broadcast(hot), _same([(F.col(k), F.col(h)) for k, h in zip(names, heads)]))
    rate = int(SAMPLE_PER_BUCKET * HASH_RANGE / limit)
    drawn = rows.filter(F.pmod(F.xxhash64("_p"), F.lit(HASH_RANGE)) < rate)
    drawn = drawn.groupBy(*heads).agg(F.sort_array(F.collect_list("_p")).alias("_s"), F.max("_pieces").alias("_pieces"))
    cuts = drawn.select(*heads, _evenly(F.col("_s"), F.col("_pieces")).alias("_cuts")).filter(F.size("_cuts") > 0)
    width = F.greatest(F.lit(1), F.sqrt(F.size("_cuts")).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("_cuts") / width).cast("int") - 1),
        lambda i: F.slice(F.col("_cuts"), i * width + 1, width),
    )
    cuts = cuts.withColumn("_blocks", blocks).select(
        *heads, F.transform("_blocks", lambda x: F.get(x, F.lit(0))).alias("_heads"), "_blocks", width.alias("_width")
    )
    kept = cuts.collect()  # at most twice as many boundary values
    return spark.createDataFrame(kept, cuts.schema) if kept else None


def _with_bucket(df: DataFrame, names: Sequence[str], bounds: DataFrame, place: Column, how: str) -> DataFrame:
    """``_bucket``: how many boundaries of the row's key lie at or below it, 0 if the key is not hot."""
    df = df.join(
        F.broadcast(bounds), _same([(F.col(k), F.col(f"_h{i}")) for i, k in enumerate(names)]), how
    )
    # Search the heads, then one block: 2 * sqrt(boundaries) comparisons.
    df = df.withColumn("_block", F.size(F.filter("_heads", lambda b: b <= place)))
    block = F.get(F.col("_blocks"), F.col("_block") - 1)
    inside = F.size(F.filter(block, lambda b: b <= place))
    bucket = F.when(F.col("_block") > 0, (F.col("_block") - 1) * F.col("_width") + inside).otherwise(0)
    return df.withColumn("_bucket", F.when(F.col("_heads").isNull(), F.lit(0)).otherwise(bucket)).drop(
        "_block", "_blocks", "_heads", "_width", *[f"_h{i}" for i in range(len(names))]
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    *,
    buckets: int | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Exact ``rn`` (1-based) and ``n`` per key, plus exclusive prefix sums and totals.

    ``order`` must be unique inside a key and computed row by row (no order-dependent
    float sums). ``sums`` maps a name to a numeric column; each adds ``before_<name>``
    and ``total_<name>``. Tied values belong in collapsed rows first, see ``tied``.
    """
    sums = dict(sums or {})
    columns, order = df.columns, list(order)
    if {"rn", "n"} & set(columns):
        raise ValueError("columns rn and n are made here; rename the input's own")
    names = list(keys)
    if not names:
        # One group over the whole table; the key is derived from the row so that
        # equality with the boundary side stays an equi-join.
        df = df.withColumn("_whole", F.col(order[0]).isNull() & F.col(order[0]).isNotNull())
        names = ["_whole"]
    place = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    bounds = _boundaries(df, names, place, _bucket_count(df, buckets), min_rows)
    if bounds is None:
        whole = Window.partitionBy(*names)
        running = whole.orderBy(*order)
        before = running.rowsBetween(Window.unboundedPreceding, -1)
        out = [F.row_number().over(running).cast("bigint").alias("rn"), F.count(F.lit(1)).over(whole).alias("n")]
        for name, column in sums.items():
            out.append(F.coalesce(F.sum(column).over(before), F.lit(0)).alias(f"before_{name}"))
            out.append(F.sum(column).over(whole).alias(f"total_{name}"))
        return df.select(*columns, *out)
    parts = {"rows": F.count(F.lit(1)), **{f"s_{n}": F.sum(c) for n, c in sums.items()}}

    counts = _with_bucket(df, names, bounds, place, "inner").groupBy(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.col("_bucket").alias("_b")
    ).agg(*[c.alias(f"_{n}") for n, c in parts.items()])
    whole = Window.partitionBy(*[f"_k{i}" for i in range(len(names))])
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[f"_k{i}" for i in range(len(names))], "_b",
        *[F.coalesce(F.sum(f"_{n}").over(below), F.lit(0)).alias(f"_off_{n}") for n in parts],
        *[F.sum(f"_{n}").over(whole).alias(f"_all_{n}") for n in parts],
    )  # only hot keys, one row per bucket: at most twice max(buckets, MAX_BOUNDS)

    local = Window.partitionBy(*names, "_bucket")
    running = local.orderBy(*order)
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    out = _with_bucket(df, names, bounds, place, "left").select(
        *columns, *[n for n in names if n not in columns], "_bucket",
        F.row_number().over(running).alias("_rn"), F.count(F.lit(1)).over(local).alias("_n"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{n}") for n, c in sums.items()],
        *[F.sum(c).over(local).alias(f"_total_{n}") for n, c in sums.items()],
    )
    out = out.join(
        F.broadcast(offsets),
        _same([(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(names)]) & (F.col("_bucket") == F.col("_b")),
        "left",
    )

    def offset(name: str) -> Column:
        return F.coalesce(F.col(f"_off_{name}"), F.lit(0))

    result = [
        (F.col("_rn") + offset("rows")).cast("bigint").alias("rn"),
        F.coalesce(F.col("_all_rows"), F.col("_n")).cast("bigint").alias("n"),
    ]
    for name in sums:
        result.append((F.col(f"_before_{name}") + offset(f"s_{name}")).alias(f"before_{name}"))
        result.append(F.coalesce(F.col(f"_all_s_{name}"), F.col(f"_total_{name}")).alias(f"total_{name}"))
    return out.select(*columns, *result)


def tied(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None,
    **sizing: int,
) -> DataFrame:
    """One row per (keys, value) with ``tied`` rows, prefix ``before_*`` and ``total_*``.

    Collapsing equal values first makes a heavily tied value one row, so no bucket can
    consist of ties. Adds the counters ``rows`` and any extra ``sums`` per value.
    """
    sums = dict(sums or {})
    collapsed = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    return ranked(collapsed, keys, [value], {n: n for n in ["rows", *sums]}, **sizing)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], **sizing: int
) -> DataFrame:
    """Exact linear-interpolated quantiles per key as rows ``(keys, q, value)``.

    NULL values are skipped. The builtin ``percentile`` keeps every distinct value of a
    group in one task; here the values are cumulated in buckets and only the one or two
    rows around each wanted position remain.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    run = tied(known, keys, "_value", **sizing)
    run = run.withColumn("_first", F.col("before_rows")).withColumn("_last", F.col("before_rows") + F.col("rows") - 1)
    spots = F.array(*[F.lit(float(q)) for q in points])
    hit = run.select(*keys, F.col("_value").cast("double").alias("_v"), "_first", "_last", "total_rows", F.explode(spots).alias("q"))
    at = F.col("q") * (F.col("total_rows") - 1)
    hit = hit.withColumn("_lo", F.floor(at)).withColumn("_hi", F.ceil(at)).withColumn("_frac", at - F.floor(at))

    def inside(spot: str) -> Column:
        return (F.col("_first") <= F.col(spot)) & (F.col(spot) <= F.col("_last"))

    hit = hit.filter(inside("_lo") | inside("_hi"))
    low, high = F.max(F.when(inside("_lo"), F.col("_v"))), F.max(F.when(inside("_hi"), F.col("_v")))
    return hit.groupBy(*keys, "q").agg((low + (high - low) * F.max("_frac")).alias("value"))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str], *, lanes: int = LANES
) -> DataFrame:
    """The first ``k`` rows per key under a total order, cut in two steps.

    Each key is first split over hash lanes of ``spread`` columns, so no task sorts a
    whole hot key; at most ``k * lanes`` rows per key reach the second cut. Adds ``place``.
    """
    lane = F.pmod(F.xxhash64(*spread), F.lit(lanes))
    first = Window.partitionBy(*keys, "_lane").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_lane", lane)
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
        .withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k)
        .drop("_lane")
    )


def join_rows(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input: by sort and merge at any size.

    Adaptive execution goes by compressed bytes, so it would broadcast a few megabytes of ids and small numbers that are
    hundreds on the driver.
    """
    return df.join(other.hint("merge"), list(on), how)


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", *, grows: bool = False) -> DataFrame:
    """Join many rows to a lookup that is unique on ``on``; one that ``grows`` with the rows is never broadcast.

    The skew-join rule of adaptive execution splits an oversized partition of the row side and repeats the lookup's part of it, and small lookups
    turn into broadcasts by their measured size; so adaptive execution must be on. ``spread`` names what tells the rows of a key apart.
    """
    off = [k for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled") if df.sparkSession.conf.get(k, "true") != "true"]
    if off:
        raise ValueError(f"hot keys need {' and '.join(off)}")
    return join_rows(df, lookup, on, how) if grows else df.join(lookup, list(on), how)
