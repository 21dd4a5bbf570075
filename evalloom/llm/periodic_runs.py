"""Runs of periodic words in each text, by enumeration of maximal pairs.

A maximal pair is two places of a text whose next words agree over exactly ``l`` words and whose words before differ. If
their distance ``d`` is at most ``l / (exponent - 1)``, the stretch from the first place to the end of the second match has period
``d`` and can't be extended on either side, so it is a run; its smallest period is the least distance that yields the same
stretch. Each run arises from the pair (start, start + period), so nothing needs to be extended or verified afterwards.

Arrow batches of about a megabyte are handled at once. Prefix doubling in numpy sorts the places whose next words repeat in the
same text; places whose first words (16 for the default bounds) are unique drop out early, as no long enough pair starts there.
Longest common prefixes come from the ranks of the doubling steps. Groups of equal first words without two places that are
close enough for their longest match are left out. Over the rest the tree of lcp-intervals is walked bottom-up. A node holds its places sorted,
and for each left word the sorted list of its places; of two children the smaller one's places are looked up in the larger one: those
within reach, without those of the same left word (the latter are skipped by counting in the class list), are the pairs. The work is
O(n log^2 n) for a text of n words, however periodic it is.

Defined results: null text has no words and stays null as ``collapsed``; empty texts have no runs; of equal stretches the smallest period
counts, overlapping runs are all returned; repeated rows each get their runs; an empty table gives an empty table; a text of any
length is processed whole, its words must fit in a task; other columns pass through, except for their own ``runs`` and ``collapsed``,
which are replaced. A null doc_id is planted with no period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, text_of

SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
Run = tuple[int, int, int]


# --- maximal pairs of a batch of texts ------------------------------------------------


def doubled(keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``(ranks, repeated)``: for each step k the ranks of the 2^k symbols at each place, and the places whose 2^k symbols repeat.

    A repeated stretch must end before the last symbol of ``keys``. Ranks order places as their symbols do; a unique place keeps its rank.
    """
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.repeat(first, sizes)
    ranks, repeated, step = [rank], [order[np.repeat(sizes > 1, sizes)]], 1
    while len(repeated[-1]):
        at = repeated[-1]
        pair = rank[at].astype(np.int64) * len(keys) + rank[at + step]
        o = np.argsort(pair, kind="stable")
        at, pair = at[o], pair[o]
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        old = rank[at]
        begins = np.r_[True, old[1:] != old[:-1]]
        begin = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        sizes = np.diff(np.r_[new, len(at)])
        rank = rank.copy()
        rank[at] = old + (np.repeat(new, sizes) - begin)
        ranks.append(rank)
        repeated.append(at[np.repeat(sizes > 1, sizes)])
        step *= 2
    return ranks, repeated


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths over which the symbols from ``a`` and from ``b`` on agree, from the ranks of the doubling steps."""
    n = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        n[ranks[k][a + n] == ranks[k][b + n]] += 1 << k
    return n


class Places:
    """The places of an lcp-interval: all of them sorted, and those of each left word sorted."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int) -> None:
        self.all, self.by_left = [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.all, place)
        if (own := self.by_left.get(left)) is None:
            self.by_left[left] = [place]
        else:
            insort(own, place)

    def others(self, left: int, low: int, high: int) -> list[int]:
        """Places in low..high whose left word is another one."""
        i, j = bisect_left(self.all, low), bisect_right(self.all, high)
        if i == j:
            return []
        own = self.by_left.get(left)
        if own is None:
            return self.all[i:j]
        found, todo = [], [(i, j)]
        while todo:
            i, j = todo.pop()
            same = bisect_right(own, self.all[j - 1]) - bisect_left(own, self.all[i])
            if same == 0:
                found += self.all[i:j]
            elif same < j - i:
                mid = (i + j) // 2
                todo += [(i, mid), (mid, j)]
        return found


def close_pairs(places: list[int], lcp: list[int], left: list[int], exponent: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs ``(place, distance, length)`` with length >= (exponent - 1) * distance of one group of suffixes.

    ``places`` are sorted by their suffixes, ``lcp[i]`` is the common prefix of places i - 1 and i, ``left[i]`` the word before.
    """
    left_of = dict(zip(places, left, strict=True))
    stack: list[tuple[int, Places]] = []

    def joined(a: Places, b: Places, length: int) -> Iterator[tuple[int, int, int]]:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        reach = length // (exponent - 1)
        for p in small.all:
            for q in large.others(left_of[p], p - reach, p + reach):
                yield min(p, q), abs(p - q), length
        for p in small.all:
            large.add(p, left_of[p])
        return large

    for i, place in enumerate(places):
        now = Places(place, left[i])
        after = lcp[i + 1] if i + 1 < len(places) else -1
        while stack and stack[-1][0] > after:
            length, before = stack.pop()
            now = yield from joined(before, now, length)
        if stack and stack[-1][0] == after:
            now = yield from joined(stack.pop()[1], now, after)
            stack.append((after, now))
        elif after >= 0:
            stack.append((after, now))


def find_runs(texts: list[np.ndarray], min_length: int = 24, exponent: int = 3) -> list[list[Run]]:
    """Runs ``(start, length, period)`` of each text, given as arrays of word codes, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)]
    codes = np.full(starts[-1] if len(texts) else 0, -1, np.int64)
    for s, t in zip(starts, texts):
        codes[s : s + len(t)] = t
    if not len(codes):
        return out
    # words of different texts never match; the end of each text is a symbol of its own
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    keys = np.where(codes >= 0, text * (codes.max() + 1) + codes, (len(texts)) * (codes.max() + 1) + text)
    ranks, repeated = doubled(keys)
    least = -(-min_length * (exponent - 1) // exponent)  # of the match: distance <= match / (exponent - 1), both together >= min_length
    step = min(max(least, 1).bit_length() - 1, len(ranks) - 1)
    if 1 << step > least or not len(repeated[step]):
        return out
    places = repeated[step]
    group = ranks[step][places]
    # gaps between places of a group, in the order of the text
    o = np.lexsort((places, group))
    heads = np.flatnonzero(np.r_[True, group[o][1:] != group[o][:-1]])
    gaps = np.diff(places[o], prepend=0)
    gaps[heads] = len(codes)
    nearest = np.minimum.reduceat(gaps, heads)
    o = np.argsort(ranks[-1][places], kind="stable")
    places, group = places[o], group[o]
    lcp = np.r_[0, common_prefixes(ranks, places[:-1], places[1:])]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lcp[heads] = 0
    longest = np.maximum.reduceat(lcp, heads)
    left = np.where(places > 0, codes[places - 1], -1)
    best: dict[tuple[int, int], int] = {}
    tails = np.r_[heads[1:], len(places)]
    for g in np.flatnonzero((longest >= least) & (nearest * (exponent - 1) <= longest)):
        a, b = heads[g], tails[g]
        for start, distance, length in close_pairs(places[a:b].tolist(), lcp[a:b].tolist(), left[a:b].tolist(), exponent):
            if distance + length >= min_length:
                span = (start, distance + length)
                best[span] = min(distance, best.get(span, distance))
    at = np.searchsorted(starts, [s for s, _ in best], side="right") - 1
    for t, ((start, length), period) in zip(at.tolist(), best.items()):
        out[t].append((start - int(starts[t]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


# --- documents ------------------------------------------------------------------------


def periodic_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``.

    A run is a stretch of at least ``min_length`` words with smallest period q that is at least ``exponent`` times q long and ends where the
    period ends. ``collapsed`` is the text's words joined by one space, without those that a run contains after its first period.
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("exponent and min_length must be at least 2")
    docs = docs.drop("runs", "collapsed")
    added = T.StructType.fromDDL(f"runs {RUNS}, collapsed string")
    schema, names = T.StructType([*docs.schema.fields, *added.fields]), docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        import pandas as pd

        texts = part.column(text_col).to_pylist()
        words = [(t or "").encode().split() for t in texts]  # by ASCII spaces alone
        sizes = np.cumsum([len(w) for w in words])
        flat = np.empty(int(sizes[-1]), object)
        flat[:] = [x for w in words for x in w]
        codes = np.split(pd.factorize(flat)[0].astype(np.int64), sizes[:-1])
        found = find_runs(codes, min_length, exponent)
        collapsed = []
        for t, w, r in zip(texts, words, found):
            if r:
                w = np.array(w, object)[kept_words(len(w), r)].tolist()
            collapsed.append(None if t is None else b" ".join(w).decode())
        values = [[{"start": a, "length": n, "period": p} for a, n, p in r] for r in found]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind), pa.array(collapsed, pa.string())], names=[*names, "runs", "collapsed"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in it:
            for part in chunks(batch, pc.binary_length(batch.column(text_col))):
                yield run(part)

    return docs.mapInArrow(batches, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; where crc32 of the decimal doc_id is a multiple of 10, the words from place a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(text_of(), SPACE), "")
    rows = docs.select("doc_id", text_of().alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % n
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8))))
    source = F.expr("transform(sequence(0L, size(words) - 1L), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int)))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def _steepest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equal ones."""
    zero = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, zero, better)


def run_digests(docs: DataFrame) -> DataFrame:
    """Number and digest of the runs, the run with the greatest exponent and the digest of the collapsed text of every document."""
    rows = periodic_runs(planted(docs)).withColumn("top", _steepest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000L * top.length div top.period").alias("exponent_milli")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *top, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256")
    )
