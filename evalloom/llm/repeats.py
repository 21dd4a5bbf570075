"""Removal of repeated byte strings by suffix arrays of content-defined shards.

A window is a string of ``length`` bytes at some place of a document; a byte goes if a window that covers it also starts somewhere
else. The least hash of the grams in a window (its minimizer) depends on the window's bytes alone, so equal windows have
equal minimizers, and the corpus can be cut into shards by minimizer without losing a match:

1. Neighbouring windows of one minimizer form a segment. Segments with a minimizer of their own,
   which occurs once in them, cannot repeat and are dropped.
   Equal segments (128-bit digests) repeat as a whole; copies within a task collapse before the shuffle.
2. One segment for each digest, where a minimizer has several, goes to the minimizer's shard. There a suffix array is built by
   Larsson-Sadakane refinement in numpy (unsorted groups double their sorted prefix each round), Kasai's rule gives the common
   prefixes (all segments step along their positions side by side), and a window repeats if it shares ``length`` bytes
   with a neighbour in the array.
3. A minimizer with very many segments, such as the edge of a passage that a third of the documents quote, is dealt to several
   shards. Their suffix arrays are merged: each shard gives the digest of each distinct window once, the digests are
   brought together in sorted ranges, and binary search counts each one's shards.

Defined results: null text counts as empty; texts shorter than ``length`` stay whole; repeated rows are different places, so all their windows
repeat; an empty table gives no rows; further columns are not carried. Texts are read in pieces that overlap by a window, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, partitions, ragged, row_key, saved, text_of

GRAM = 32
#: Bytes of a piece, windows of a segment, segments of a shard, bytes of a suffix array.
PIECE, SEGMENT_WINDOWS, SHARD_SEGMENTS, ARRAY_BYTES = 1 << 20, 1024, 20_000, 1 << 21
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
KEY = ["key_a", "key_b"]
SPAN = "key_a long, key_b long, start long, count long"


# --- segments -------------------------------------------------------------------------


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, from running minima of blocks in both directions."""
    n, rows = len(values), -(-len(values) // width)
    blocks = np.concatenate((values, np.full(rows * width - n, np.iinfo(values.dtype).max, dtype=values.dtype))).reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the least one of each window of ``data``, which has at least ``length`` bytes."""
    n = len(data) - GRAM + 1
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=padded, strides=(1,))
    h = words[:n] * FACTORS[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k : 8 * k + n] * FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= FACTORS[4]
    h ^= h >> np.uint64(29)
    return h, _lowest(h, length - GRAM + 1)


def _twice(grams: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Segments in which the minimizer's gram occurs more than once; in others no window can repeat within the segment."""
    pad = np.full(width - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    chosen = np.flatnonzero(grams == ~_lowest(np.concatenate((pad, ~low, pad)), width))  # least in some window
    a, b = np.searchsorted(chosen, starts), np.searchsorted(chosen, ends + width - 1)
    part = np.repeat(np.arange(len(starts)), b - a)
    here = grams[ragged(chosen, a, b - a)] == low[starts][part]
    return np.bincount(part[here], minlength=len(starts)) > 1


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Document index, first window, windows, minimizer, two digest halves and ``_twice`` of each segment of some texts."""
    pieces = [(i, a, min(a + PIECE + length - 1, len(t))) for i, t in enumerate(texts) for a in range(0, len(t) - length + 1, PIECE)]
    if not pieces:
        return (*(np.zeros(0, dtype=np.int64) for _ in range(6)), np.zeros(0, dtype=bool))
    sizes = np.array([b - a for _, a, b in pieces])
    data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in pieces]), dtype=np.uint8)
    grams, low = minimizers(data, length)
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[1:-1] = low[1:] != low[:-1]
    edge[begin] = True
    edge[np.minimum(begin + sizes - length + 1, len(low))] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(low))
    parts = -(-(ends - starts) // SEGMENT_WINDOWS)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * SEGMENT_WINDOWS, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + SEGMENT_WINDOWS)
    piece = np.searchsorted(begin, starts, "right") - 1
    inside = starts < begin[piece] + sizes[piece] - length + 1
    starts, ends, piece = starts[inside], ends[inside], piece[inside]
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    marks = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), (ends + length - 1).tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)
    doc = np.array([p[0] for p in pieces])[piece]
    first = starts - begin[piece] + np.array([p[1] for p in pieces])[piece]
    return doc, first, ends - starts, low[starts].view(np.int64), marks[:, 0], marks[:, 1], _twice(grams, low, starts, ends, length - GRAM + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    raw = text_of().cast("binary")
    return docs.select("doc_id", *row_key(F.col("doc_id"), text_of()), raw.alias("raw"))


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Segments of the texts, equal ones of a task's megabyte collapsed: ``n`` is their number, and 0 for a further copy."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, first, count, low, a, b, twice = segments(batch.column("raw").to_pylist(), length)
        order = np.lexsort((b, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[: len(order)]
        n = np.zeros(len(order), dtype=np.int64)
        at = np.flatnonzero(new)
        n[order[at]] = np.diff(np.append(at, len(order)))
        keys = [batch.column(k).to_numpy()[doc] for k in KEY]
        names = ["low", "mark_a", "mark_b", *KEY, "start", "count", "n", "twice"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (low, a, b, *keys, first, count.astype(np.int32), n.astype(np.int32), twice)], names=names)

    rows = _keyed(docs).filter(F.octet_length("raw") >= length).drop("doc_id")
    return map_chunks(rows, run, "low long, mark_a long, mark_b long, key_a long, key_b long, start long, count int, n int, twice boolean", "raw")


def _crowded(docs: DataFrame, length: int) -> DataFrame:
    """``(low, salts)``: minimizers with more different segments than a shard holds; at most one for each ``SHARD_SEGMENTS`` segments.

    A task reports those it meets more than once; the others have at most one segment for each megabyte.
    """
    rows = _segment_rows(docs, length).filter("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, many = np.unique(batch.column("low").to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(low[many > 1]), pa.array(many[many > 1].astype(np.int64))], names=["low", "many"])

    seen = rows.select("low").mapInArrow(run, "low long, many long").groupBy("low").agg(F.sum("many").alias("many"))
    return seen.filter(F.col("many") > SHARD_SEGMENTS).select("low", F.ceil(F.col("many") / SHARD_SEGMENTS).alias("salts"))


def _by_key(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Sorted batches cut where the first ``keys`` columns change, after about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held)
            change = np.zeros(whole.num_rows - 1, dtype=bool)
            for i in range(keys):
                x = whole.column(i).to_numpy()
                change |= x[1:] != x[:-1]
            at = np.flatnonzero(change)
            cut = int(at[-1]) + 1 if len(at) else 0
            if cut:
                yield whole.slice(0, cut)
            held, size = whole.slice(cut).to_batches(), whole.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _sorted_out(docs: DataFrame, crowded: DataFrame, length: int) -> DataFrame:
    """Segments that repeat as a whole (``whole``), and one segment of each digest where a minimizer has several or occurs twice in one (``tested``)."""
    salts = F.coalesce("salts", F.lit(1))
    rows = _segment_rows(docs, length).join(F.broadcast(crowded), "low", "left")  # bounded: see _crowded
    rows = rows.withColumn("shard", F.pmod(F.col("mark_a"), salts).cast("int")).withColumn("split", salts > 1)
    order = ["low", "shard", "mark_a", "mark_b"]
    rows = rows.select(*order, "split", *KEY, "start", "count", "n", "twice")
    rows = rows.repartition(partitions(docs.sparkSession), "low", "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 2, 100_000):
            low, shard, a, b, split = (rows.column(c).to_numpy() for c in (*order, "split"))
            group = np.concatenate(([True], (low[1:] != low[:-1]) | (shard[1:] != shard[:-1])))
            new = group | np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            kind, n = np.cumsum(new) - 1, rows.column("n").to_numpy()
            total = np.bincount(kind, weights=n)
            whole = (total >= 2)[kind]
            in_group = np.cumsum(group) - 1
            kinds = np.bincount(in_group, weights=new)
            tested = new & ((kinds >= 2)[in_group] | split | rows.column("twice").to_numpy())
            keep = np.flatnonzero(whole | tested)
            cols = [pa.array(x[keep]) for x in (low, shard, split)] + [rows.column(c).combine_chunks().take(pa.array(keep)) for c in (*KEY, "start", "count")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(whole[keep]), pa.array(tested[keep])], names=["low", "shard", "split", *KEY, "start", "count", "whole", "tested"])

    return rows.mapInArrow(run, "low long, shard int, split boolean, key_a long, key_b long, start long, count int, whole boolean, tested boolean")


# --- suffix arrays --------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of integers whose last is unlike all others, by Larsson-Sadakane refinement.

    A rank is the last place of the suffix's group. Each round sorts the members of unsorted groups by the
    rank of the suffix h places further, which doubles the sorted prefix.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    value = text[order]
    last = np.flatnonzero(np.append(value[1:] != value[:-1], True))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(last, np.diff(np.append(-1, last)))
    h = 1
    open_ = np.flatnonzero(np.append(value[1:] == value[:-1], False) | np.append(False, value[1:] == value[:-1]))
    while len(open_):
        members = order[open_]
        group, key = rank[members], rank[members + h]
        by = np.argsort(group * n + key, kind="stable")
        members, group, key = members[by], group[by], key[by]
        order[open_] = members
        same = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        last = np.flatnonzero(np.append(~same, True))
        rank[members] = np.repeat(open_[last], np.diff(np.append(-1, last)))
        open_ = open_[np.append(same, False) | np.append(False, same)]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in the array; parts begin at ``starts``, longest first or not.

    A step to the next position loses at most one byte of the prefix. All parts step together.
    """
    n = len(text)
    lcp = np.zeros(n, dtype=np.int64)
    size = np.diff(np.append(starts, n))
    h = np.zeros(len(starts), dtype=np.int64)
    for t in range(int(size.max(initial=0))):
        part = np.flatnonzero(size > t)
        i = starts[part] + t
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        h[part] = np.where(r > 0, np.maximum(h[part] - 1, 0), 0)
        grow = np.flatnonzero(r > 0)
        while len(grow):
            at = h[part[grow]]
            grow = grow[text[i[grow] + at] == text[j[grow] + at]]
            h[part[grow]] += 1
        lcp[i] = h[part]
    return lcp


def repeated_windows(parts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each part whether each window occurs again in these parts; and for each window of all parts the first equal one."""
    sizes = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    text = np.empty(sizes.sum(), dtype=np.int64)
    fill = np.ones(len(text), dtype=bool)
    fill[starts + sizes - 1] = False
    text[fill] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    text[starts + sizes - 1] = 256 + np.arange(len(parts))  # ends differ from each other, so no match crosses them
    order, rank = suffix_array(text)
    lcp = common_prefixes(text, order, rank, starts)
    close = lcp[order] >= length
    again = np.zeros(len(text), dtype=bool)
    again[order] = close | np.append(close[1:], False)
    first = np.empty(len(text), dtype=np.int64)
    head = np.flatnonzero(~close)
    first[order] = np.repeat(np.minimum.reduceat(order, head), np.diff(np.append(head, len(order))))
    cut = [slice(s, s + z - length) for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return [again[c] for c in cut], np.concatenate([first[c] - np.arange(c.start, c.stop) for c in cut])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def _shard_matches(parts: DataFrame, length: int) -> DataFrame:
    """Repeated runs of windows in each shard; of a split minimizer, the digests of its distinct windows."""
    names = ["key_a", "key_b", "start", "count", "mark_a", "mark_b", "n"]

    def matched(rows: list[dict]) -> pa.RecordBatch | None:
        raws = [r["part"] for r in rows]
        flags, first = repeated_windows(raws, length)
        out: list[list] = [[] for _ in names]
        at = 0
        for row, own in zip(rows, flags, strict=True):
            here = first[at : at + len(own)]
            at += len(own)
            if not row["whole"]:
                for a, n in zip(*(x.tolist() for x in _runs(own)), strict=True):
                    for c, v in zip(out, (row["key_a"], row["key_b"], row["start"] + a, n, None, None, None), strict=True):
                        c.append(v)
            if row["split"]:  # a window that is the first of its kind in this shard
                for p in np.flatnonzero(here == 0).tolist():
                    d = np.frombuffer(xxhash.xxh3_128_digest(row["part"][p : p + length]), dtype="<i8")
                    known = bool(own[p]) or row["whole"]
                    for c, v in zip(out, (row["key_a"], row["key_b"], row["start"] + p, 1, int(d[0]), int(d[1]), 2 if known else 1), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["low"], row["shard"])
                if here != last and size >= ARRAY_BYTES:
                    yield matched(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["part"])
                last = here
        if held:
            yield matched(held)

    rows = parts.select("low", "shard", "split", "whole", *KEY, "start", "part")
    rows = rows.repartition(partitions(parts.sparkSession), "low", "shard").sortWithinPartitions("low", "shard")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _merged(windows: DataFrame) -> DataFrame:
    """Windows of split minimizers that other shards hold too: sorted digests, counted by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 2, 200_000):
            a, b, n = (rows.column(c).to_numpy() for c in ("mark_a", "mark_b", "n"))
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            kind = np.cumsum(new) - 1
            total = np.append(np.cumsum(n), 0)
            lo, hi = np.searchsorted(kind, kind, "left"), np.searchsorted(kind, kind, "right")
            keep = np.flatnonzero((total[hi - 1] - total[lo - 1] >= 2) & (n == 1))
            yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(keep)) for c in (*KEY, "start", "count")], names=[*KEY, "start", "count"])

    rows = windows.select("mark_a", "mark_b", *KEY, "start", "count", "n")
    rows = rows.repartition(partitions(windows.sparkSession), "mark_a", "mark_b").sortWithinPartitions("mark_a", "mark_b")
    return rows.mapInArrow(run, SPAN)


# --- documents ------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(key_a, key_b, start, count)``: runs of repeated windows, by first window and number of windows."""
    crowded = saved(_crowded(docs, length))
    found = saved(_sorted_out(docs, crowded, length))
    tested = found.filter("tested").drop("tested")
    part = F.substring("raw", (F.col("start") + 1).cast("int"), F.col("count") + length - 1)
    parts = tested.join(_keyed(docs).drop("doc_id"), KEY).select("low", "shard", "split", "whole", *KEY, "start", part.alias("part"))
    matched = saved(_shard_matches(parts, length))
    runs = matched.filter("n IS NULL").select(*KEY, "start", "count")
    whole = found.filter("whole").select(*KEY, "start", F.col("count").cast("long").alias("count"))
    return whole.unionByName(runs).unionByName(_merged(matched.filter("n IS NOT NULL")))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: ``kept`` is the rest of the text's bytes."""
    spans = saved(repeated_spans(docs, length)).groupBy(*KEY).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    rows = _keyed(docs).join(spans, KEY, "left").select("doc_id", "raw", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed, runs = [], [], []
        for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if not spans:
                kept.append(raw)
                removed.append(0)
                runs.append(0)
                continue
            depth = np.zeros(len(raw) + 1, dtype=np.int64)
            start, count = (np.array([s[c] for s in spans]) for c in ("start", "count"))
            np.add.at(depth, start, 1)
            np.add.at(depth, start + count + length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept.append(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(len(_runs(gone)[0]))
        sizes = pa.array([len(x) for x in batch.column("raw").to_pylist()], pa.int64())
        cols = [batch.column("doc_id"), sizes, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_chunks(rows, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary", "raw")


def repeat_digests(docs: DataFrame, length: int = 200) -> DataFrame:
    rows = without_repeats(docs, length)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
