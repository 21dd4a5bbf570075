"""Paired resampling within folds, all replicates at once.

A unit has an array with the number of times each replicate draws it, as packed whole numbers. It meets the unit's scores in the tasks, which add up
the drawn positives and negatives of every replicate for each distinct score before anything is shuffled; so what moves is at most one
small number per row and replicate, and with tied scores far less. Runs of scores in order are reduced to (wins, positives, negatives) arrays, and
runs are merged pairwise-associatively: wins of a later run also count the negatives before it. No task holds more than a run of scores.
Arrays never stand on a side of a join that could be broadcast: Catalyst takes them for a few bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reuse
from .ordering import MIN_ROWS, join_lookup, join_rows, ranked

EXACT_DRAWS = 10_000_000  # units x replicates up to which draws with replacement are exact; Poisson counts beyond
RUN_VALUES = 1 << 20  # array cells of a run of scores
MERGED_RUNS = 256
DRAWN = 1 << 21  # draws of one step of a task, and of a block of units
SUMMED = 1 << 22  # array cells that a task adds up at once
HELD = 4096  # distinct scores that a task keeps before it hands them on
UNIT_ROWS = 4096  # rows of a unit beyond which it is dealt over several


def draw_counts(units: DataFrame, replicates: int, seed: int, *, exact: bool | None = None, **sizing: int) -> DataFrame:
    """``(fold, id, times)``: how often each replicate draws each of ``units(fold, id)``, which are distinct.

    Exact: draw j of a fold of n units picks number ``hash(seed, replicate, fold, j) mod n``, n draws. Above ``EXACT_DRAWS`` draws in all each count is
    a Poisson number seeded by a hash of (seed, fold, id), with mean 1, or ``size`` where a unit stands for several; nothing is shuffled then and
    replicates have n draws on average.
    """
    if exact is None:
        exact = units.count() * replicates <= EXACT_DRAWS
    if not exact:
        marked = units.select("fold", "id", _mark(seed).alias("mark"), _size(units).alias("size"))
        counted = lambda marks, sizes: pd.Series(list(_poisson(marks, sizes, replicates).astype(np.int32)))
        return marked.select("fold", "id", F.pandas_udf(_typed(counted, 2), "array<int>")("mark", "size").alias("times"))
    placed = ranked(units.select("fold", "id"), ["fold"], ["id"], **sizing).select("fold", "id", (F.col("rn") - 1).alias("at"))
    unpacked = lambda cells: pd.Series(list(_unpacked(cells, replicates).astype(np.int32)))
    met = placed.join(_exact_counts(units, replicates, seed).hint("merge"), ["fold", "at"], "left")
    return met.select("fold", "id", F.pandas_udf(_typed(unpacked, 1), "array<int>")("times").alias("times"))


def _typed(function, arguments: int):
    """The function with the annotations by which Spark tells kinds of batches."""
    function.__annotations__ = {**{n: pd.Series for n in function.__code__.co_varnames[:arguments]}, "return": pd.Series}
    return function


def _mark(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "fold", "id")


def _size(units: DataFrame) -> Column:
    return (F.col("size") if "size" in units.columns else F.lit(1)).cast("bigint")


def _poisson(marks, sizes, replicates: int) -> np.ndarray:
    seeds = np.asarray(marks, np.int64).astype(np.uint64)
    return np.stack([np.random.default_rng(h).poisson(m, replicates) for h, m in zip(seeds, sizes)]) if len(seeds) else np.zeros((0, replicates), np.int64)


def _packed(counts: np.ndarray) -> list[bytes]:
    """Rows of counts as bytes, in the least width that holds them all."""
    top = counts.max(initial=0)
    narrow = next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)
    return [v.tobytes() for v in counts.astype(narrow)]


def _unpacked(cells, replicates: int) -> np.ndarray:
    """The reverse; every row tells its width by its length, and nothing stands for zeros."""
    out = np.zeros((len(cells), replicates), np.int64)
    for i, v in enumerate(cells):
        if v is not None:
            out[i] = np.frombuffer(v, f"<u{len(v) // replicates}")
    return out


def _exact_counts(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(fold, at, times)`` of every place of a fold that is drawn at all, ``times`` packed.

    A task makes all replicates' draws for a stretch of j and deals them by blocks of places; a block is counted by another.
    """
    step = max(1, DRAWN // replicates)
    sizes = units.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("fold", F.col("fold").cast("string").alias("name"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))).alias("start"))
    fold = units.schema["fold"]
    dealt_schema = T.StructType([fold, *T.StructType.fromDDL("block bigint, v binary").fields])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, n, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "n", "start")))):
                tails = [b":%d" % j for j in range(start, min(n, start + step))]
                codes = []
                for r in range(replicates):
                    head = f"{seed}:{r}:{name}".encode()
                    words = b"".join([hashlib.sha256(head + t).digest()[:8] for t in tails])
                    codes.append((np.frombuffer(words, ">u8") >> np.uint64(4)).astype(np.int64) % n * replicates + r)  # the first 60 bits
                found = np.sort(np.concatenate(codes))
                block = found // (step * replicates)
                cuts = np.flatnonzero(np.diff(block)) + 1
                cells = [v.tobytes() for v in np.split((found - block * (step * replicates)).astype("<u4"), cuts)]
                same = batch.column("fold").take(pa.array([i] * len(cells), pa.int64()))
                yield pa.RecordBatch.from_arrays([same, pa.array(block[np.r_[0, cuts]], pa.int64()), pa.array(cells, pa.binary())], ["fold", "block", "v"])

    def count(table: pa.Table) -> pa.Table:
        drawn = np.concatenate([np.frombuffer(v, "<u4") for v in table.column("v").to_pylist()])
        times = np.bincount(drawn, minlength=step * replicates).reshape(step, replicates)
        some = np.flatnonzero(times.any(axis=1))
        at = table.column("block")[0].as_py() * step + some
        same = table.column("fold").combine_chunks().take(pa.array(np.zeros(len(some), np.int64)))
        return pa.table([same, pa.array(at, pa.int64()), pa.array(_packed(times[some]), pa.binary())], names=["fold", "at", "times"])

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(2 * tasks).mapInArrow(draw, dealt_schema)
    return dealt.groupBy("fold", "block").applyInArrow(count, T.StructType([fold, *T.StructType.fromDDL("at bigint, times binary").fields]))


def _alike(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(fold, cells, id, size)``: one row for each distinct (fold, cells) of a unit, with the number of units alike as ``size``.

    Poisson counts of units alike add up to a Poisson count, so only distinct ones need draws.
    """
    cells = F.sort_array(F.collect_list(F.struct(*fields)))  # models x targets
    return rows.groupBy("fold", "id").agg(cells.alias("cells")).groupBy("fold", "cells").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))


def _grouped_units(rows: DataFrame) -> DataFrame:
    """The rows of one unit of each kind."""
    return _alike(rows, ["model", "target", "y", "p"]).select("fold", "id", "size", F.inline("cells"))


def _arrays(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _reduced(df: DataFrame, keys: Sequence[str], run: str, one) -> DataFrame:
    """One row ``(keys, run, wins, pos, neg)`` per key and value of ``run`` by ``one(table)``."""
    added = T.StructType.fromDDL(f"{run} bigint, wins array<double>, pos array<double>, neg array<double>")
    schema = T.StructType([*df.select(*keys).schema.fields, *added.fields])

    def reduce(table: pa.Table) -> pa.Table:
        cells = [table.column(c).slice(0, 1) for c in [*keys, run]]
        return pa.table([*cells, *[pa.array([v], pa.list_(pa.float64())) for v in one(table)]], names=[*keys, run, "wins", "pos", "neg"])

    return df.groupBy(*keys, run).applyInArrow(reduce, schema)


def _with_runs(rows: DataFrame, by: Sequence[str], replicates: int, **sizing: int) -> DataFrame:
    """``run``: the number of the row's stretch of distinct scores, each as long as fits a task with its arrays."""
    length = max(1, RUN_VALUES // (2 * replicates))
    distinct = reuse(rows.select(*by, "p").distinct())
    many = distinct.count() > MIN_ROWS
    places = ranked(distinct, by, ["p"], **sizing)
    return join_lookup(rows, places.select(*by, "p", F.floor((F.col("rn") - 1) / length).alias("run")), [*by, "p"], ["fold", "id"], grows=many)


def _units(rows: DataFrame, fields: Sequence[str], long: bool) -> DataFrame:
    """``(fold, id, cells)``: a unit's rows in an array, ``long`` ones dealt over several."""
    if not long:
        return rows.groupBy("fold", "id").agg(F.collect_list(F.struct(*fields)).alias("cells"))
    part = F.floor((F.row_number().over(Window.partitionBy("fold", "id").orderBy("p")) - 1) / UNIT_ROWS)
    return rows.withColumn("_part", part).groupBy("fold", "id", "_part").agg(F.collect_list(F.struct(*fields)).alias("cells")).drop("_part")


def _summed(keys: pd.DataFrame, counts: np.ndarray, parents: np.ndarray | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Distinct rows of ``keys`` and the sums of their rows of ``counts``."""
    codes = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    return keys.iloc[order[starts]].reset_index(drop=True), np.add.reduceat(counts[order if parents is None else parents[order]], starts, axis=0)


def _steps(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches ``(start, units)`` of at most ``most`` cells; a unit with more is a stretch of its own and leaves the others together."""
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        width = max(1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")) - i)
        yield i, width
        i += width


def _drawn_scores(units: DataFrame, by: Sequence[str], replicates: int) -> DataFrame:
    """``(by, run, lot, y, p, v)``: packed sums of the multiplicities for each distinct score of a task.

    ``units(cells)`` with the multiplicities as ``times``, an array or packed, or as ``mark`` and ``size`` of Poisson counts.
    """
    names = [*by, "run", "y", "p"]
    cell = units.schema["cells"].dataType.elementType
    schema = T.StructType([*[cell[n] for n in [*by, "run"]], *T.StructType.fromDDL("lot int").fields, cell["y"], cell["p"], *T.StructType.fromDDL("v binary").fields])
    lots = isqrt(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        if "mark" in batch.schema.names:
            return _poisson(batch.column("mark").to_numpy(), batch.column("size").to_numpy(), replicates)
        times = batch.column("times")
        if pa.types.is_binary(times.type) or pa.types.is_large_binary(times.type):
            return _unpacked(times.to_pylist(), replicates)
        return times.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, replicates).astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() % max(1, lots)
        held: list[tuple[pd.DataFrame, np.ndarray]] = []

        def handed(keys: pd.DataFrame, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), HELD):
                some = keys.iloc[i : i + HELD]
                cells = {**{n: pa.array(some[n], kinds[n]) for n in names}, "lot": pa.array([lot] * len(some), pa.int32()), "v": pa.array(_packed(sums[i : i + HELD]), pa.binary())}
                yield pa.RecordBatch.from_arrays([cells[n] for n in schema.names], schema.names)

        kinds: dict[str, pa.DataType] = {}
        for batch in batches:
            lengths = np.diff(batch.column("cells").offsets.to_numpy())
            if not lengths.sum():
                continue
            for i, width in _steps(lengths, max(1, SUMMED // replicates)):
                some = batch.slice(i, width)
                flat = some.column("cells").flatten()
                kinds = {n: flat.field(n).type for n in names}
                keys = pd.DataFrame({n: c.to_pandas() for n, c in zip(flat.type.names, flat.flatten())})[names]
                parents = np.repeat(np.arange(some.num_rows), lengths[i : i + width])
                known = keys["y"].notna().to_numpy()
                if not known.any():
                    continue
                held.append(_summed(keys[known], counts(some), parents[known]))
                if sum(len(k) for k, _ in held) >= HELD:
                    keys, sums = _summed(pd.concat([k for k, _ in held], ignore_index=True), np.concatenate([c for _, c in held]))
                    held = [(keys, sums)]
                    if len(keys) >= HELD // 2:
                        yield from handed(keys, sums)
                        held = []
        if held:
            yield from handed(*_summed(pd.concat([k for k, _ in held], ignore_index=True), np.concatenate([c for _, c in held])))

    kept = [c for c in ("cells", "times", "mark", "size") if c in units.columns]
    added = units.select(*kept).mapInArrow(add, schema)

    def again(table: pa.Table) -> pa.Table:
        keys, sums = _summed(table.select(["y", "p"]).to_pandas(), _unpacked(table.column("v").to_pylist(), replicates))
        same = table.select([*by, "run", "lot"]).take(pa.array(np.zeros(len(keys), np.int64)))
        for n in ("y", "p"):
            same = same.append_column(n, pa.array(keys[n], table.schema.field(n).type))
        return same.append_column("v", pa.array(_packed(sums), pa.binary()))

    return added.groupBy(*by, "run", "lot").applyInArrow(again, schema)


def replicate_auc(rows: DataFrame, times: DataFrame, by: Sequence[str], replicates: int, **sizing: int) -> DataFrame:
    """``(by, auc)``: the AUC of every replicate, NaN where it has one class; ``rows(fold, id, y, p)`` with the columns of ``by``."""
    placed = _with_runs(rows.filter("y IS NOT NULL"), by, replicates, **sizing)
    met = _units(placed, [*by, "run", "y", "p"], True).join(times.hint("merge"), ["fold", "id"])
    return _run_auc(_drawn_scores(met, by, replicates), by, replicates)


def _run_auc(scores: DataFrame, by: Sequence[str], replicates: int) -> DataFrame:
    def first(table: pa.Table):
        keys, counts = table.select(["y", "p"]).to_pandas(), _unpacked(table.column("v").to_pylist(), replicates)
        values, at = np.unique(keys["p"].to_numpy(), return_inverse=True)
        pos, neg = np.zeros((2, len(values), replicates))
        ones = keys["y"].to_numpy() == 1
        np.add.at(pos, at[ones], counts[ones])
        np.add.at(neg, at[~ones], counts[~ones])
        below = np.cumsum(neg, axis=0) - neg
        return (pos * (below + neg / 2)).sum(0), pos.sum(0), neg.sum(0)

    def merged(table: pa.Table):
        table = table.sort_by("at")
        wins, pos, neg = (_arrays(table, c) for c in ("wins", "pos", "neg"))
        below = np.cumsum(neg, axis=0) - neg
        return (wins + pos * below).sum(0), pos.sum(0), neg.sum(0)

    found = _reduced(scores, by, "run", first)
    for at in (F.floor(F.col("at") / MERGED_RUNS), F.lit(0).cast("bigint")):
        found = _reduced(found.withColumnRenamed("run", "at").withColumn("run", at), by, "run", merged)
    pairs = F.zip_with("pos", "neg", lambda a, b: a * b)
    return found.select(*by, F.zip_with("wins", pairs, lambda w, n: F.when(n > 0, w / n).otherwise(F.lit(float("nan")))).alias("auc"))


def paired_bootstrap(
    rows: DataFrame, pairs: Sequence[tuple[str, str]], folds: int, targets: int, replicates: int, seed: int, *, unit: str = "id", exact: bool | None = None,
    **sizing: int
) -> DataFrame:
    """AUC differences ``(replicate, pair, target, difference)`` of accepted replicates.

    ``rows(model, fold, id, target, y, p)`` on fully observed ids; every model sees the same draws. A replicate counts only
    if every (fold, target) keeps both classes. Target ``macro`` is the mean of targets. ``unit`` names the column whose values are drawn as wholes,
    such as the group of an id.
    """
    if unit != "id":
        rows = rows.withColumn("id", F.col(unit))
    by = ["model", "fold", "target"]
    rows = rows.select(*by, "id", "y", "p")
    units = rows.select("fold", "id").distinct()
    if exact is None:
        exact = units.count() * replicates <= EXACT_DRAWS
    fields = ["model", "target", "y", "p", "fold", "run"]
    placed = _with_runs(rows, by, replicates, **sizing)
    if exact:
        places = ranked(units, ["fold"], ["id"], **sizing).select("fold", "id", (F.col("rn") - 1).alias("at"))
        met = join_rows(_units(placed, fields, unit != "id"), places, ["fold", "id"])
        met = met.join(_exact_counts(units, replicates, seed).hint("merge"), ["fold", "at"], "left")
    else:
        met = _alike(placed, fields) if unit == "id" else _units(placed, fields, True)
        met = met.select("cells", _mark(seed).alias("mark"), _size(met).alias("size"))
    scores = _run_auc(_drawn_scores(met, by, replicates), by, replicates)
    scores = scores.select(*by, F.posexplode("auc").alias("replicate", "a"))  # models x folds x targets x replicates
    scores = scores.withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    means = scores.groupBy("replicate", "model", "target").agg(F.avg("a").alias("a"), F.count("a").alias("cells"))
    tables = means.groupBy("replicate").agg(F.collect_list(F.struct("model", "target", "a", "cells")).alias("s"))
    per_model = F.transform(F.array_distinct(F.col("s.model")), lambda m: F.aggregate(
        F.filter("s", lambda x: x["model"] == m), F.lit(0).cast("bigint"), lambda n, x: n + x["cells"]
    ))
    valid = tables.filter(F.array_min(per_model) == folds * targets)

    def mean(model: str, target: Column) -> Column:
        return F.get(F.filter("s", lambda x: (x["model"] == model) & (x["target"] == target)), F.lit(0))["a"]

    def differences(a: str, b: str) -> Column:
        name = F.lit(f"{a}_minus_{b}").alias("pair")
        each = F.transform(F.array_distinct(F.col("s.target")), lambda t: F.struct(name, t.alias("target"), (mean(a, t) - mean(b, t)).alias("difference")))
        whole = F.aggregate(each, F.lit(0.0), lambda n, x: n + x["difference"]) / F.size(each)
        return F.concat(each, F.array(F.struct(name, F.lit("macro").alias("target"), whole.alias("difference"))))

    cells = valid.select("replicate", F.explode(F.concat(*[differences(a, b) for a, b in pairs])).alias("c"))
    return cells.select("replicate", "c.pair", "c.target", "c.difference")


def percentile_interval(
    draws: DataFrame, replicates: int, cells: Sequence[tuple[str, str]] | None = None, points: tuple[float, float] = (0.025, 0.975)
) -> DataFrame:
    """Linear quantiles of the accepted draws per (pair, target); bounded by the replicate count.

    ``cells`` names the (pair, target) rows to report; one without an accepted draw has NULL bounds and 0 accepted.
    """
    q = F.percentile("difference", F.array(*[F.lit(p) for p in points]))
    found = draws.groupBy("pair", "target").agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    if cells is not None:
        named = draws.sparkSession.createDataFrame(list(cells), "pair string, target string")
        found = named.join(found, ["pair", "target"], "left")
    return found.select(
        "pair", "target", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.coalesce("n", F.lit(0)).cast("bigint").alias("accepted"),
        F.lit(replicates).cast("bigint").alias("attempted"),
    )


def interval_cells(pairs: Sequence[tuple[str, str]], targets: Sequence[str]) -> list[tuple[str, str]]:
    return [(f"{a}_minus_{b}", t) for a, b in pairs for t in [*targets, "macro"]]
