"""Rows packed into blocks of plain numbers, and sums over them: what the joint fits read in every pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .checks import ContractError

BLOCK_VALUES = 1 << 19  # feature values of a block, 4 MB
NO_FOLD = -(1 << 31)


@dataclass(frozen=True)
class Slot:
    """One head: a column of the label arrays, and the fold whose rows it must not see."""

    name: str
    column: int
    scaler: int
    exclude: int | None


def packed(rows: DataFrame) -> DataFrame:
    """Blocks ``(n, x, fold, y, w)`` of little-endian numbers from ``rows(x, fold, y, w)`` with arrays of one width each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        values = 0

        def block() -> pa.RecordBatch:
            x, fold, y, w = (np.concatenate(c) for c in zip(*held))
            cells = [pa.array([len(fold)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (x, fold, y, w)]]
            return pa.RecordBatch.from_arrays(cells, ["n", "x", "fold", "y", "w"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            wide = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c in ("x", "y", "w")]
            fold = batch.column("fold").fill_null(NO_FOLD).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append([wide[0], fold, wide[1], wide[2]])
            values += wide[0].size
            if values >= BLOCK_VALUES:
                yield block()
                held, values = [], 0
        if held:
            yield block()

    return rows.select("x", "fold", "y", "w").mapInArrow(run, "n int, x binary, fold binary, y binary, w binary")


def block_sums(blocks: DataFrame, evaluate: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of ``evaluate(x, fold, y, w)``, a matrix of one shape, over all blocks.

    Each task adds its blocks; the tasks' matrices are added by about the root of the number of shuffle partitions, theirs by one task
    that gets no more than those, and one matrix comes back.
    """
    schema, names = "n int, v binary", ["n", "v"]

    def one(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, x, fold, y, w in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "fold", "y", "w"))):
                wide = [np.frombuffer(v, float).reshape(n, -1) for v in (x, y, w)]
                part = np.asarray(evaluate(wide[0], np.frombuffer(fold, np.int64), wide[1], wide[2]), float)
                total = part if total is None else total + part
        yield from one(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, v in zip(batch.column("n").to_pylist(), batch.column("v").to_pylist()):
                part = np.frombuffer(v, float).reshape(n, -1)
                total = part if total is None else total + part
        yield from one(total)

    parts = blocks.mapInArrow(first, schema)
    fan = int(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5)
    if fan > 4:
        parts = parts.repartition(fan).mapInArrow(add, schema)
    found = parts.repartition(1).mapInArrow(add, schema).collect()  # one row
    if not found:
        raise ContractError("no supervised rows")
    return np.frombuffer(found[0]["v"], float).reshape(found[0]["n"], -1)
