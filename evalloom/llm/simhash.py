"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint sets a bit where more than half of the shingle hashes do. Two fingerprints that differ in at
most three of 64 bits agree on one of four 16-bit blocks, so each distinct fingerprint goes to four groups of
equal blocks. A group's fingerprints, block first, form a binary trie: the join walks pairs of its
nodes together, adds up the bits in which the two paths differ, and drops a pair once the sum passes the
budget, or once both nodes already lie in one component. A group with more fingerprints than ``GROUP_ROWS`` is dealt
again by quarters of its other 48 bits, one of which must agree too; nothing is lost by that.

A group returns a spanning forest instead of pairs, at most one link for each fingerprint, and components are
found over distinct fingerprints. Documents meet them again through one join on the fingerprint; copies are
never paired with each other.

Defined results: null text counts as empty; texts without words have fingerprint zero, which links like any other;
repeated rows share fingerprint and component; an empty table gives no rows; a component without any doc_id has a null id;
further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linkage import link_components
from .common import map_chunks, partitions, ragged, row_key, saved, small_side, text_of

BITS, BLOCKS = 64, 4
#: Fingerprints of a group from which on it is dealt again; rows a task turns into one trie; node pairs walked at once; row pairs of equal values tested at once.
GROUP_ROWS, TRIE_ROWS, PAIRS, LEAF = 50_000, 50_000, 100_000, 64


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a text: words in lower-cased A-Z, split at ASCII white space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        spans = [line]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = [line[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, bits)``: the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        signed = np.array(made, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], names=["doc_id", "bits"])

    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return map_chunks(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


# --- the trie -------------------------------------------------------------------------


class Forest:
    """Labels of rows: the least row of their component so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label[:] = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]


class SpanningForest(Forest):
    """A forest that keeps the pairs of rows that joined its components."""

    def __init__(self, n: int):
        super().__init__(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, low, high = a[open_], b[open_], np.minimum(x, y)[open_], np.maximum(x, y)[open_]
            if not len(a):
                return
            order = np.lexsort((low, high))
            pick = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]  # each root hangs below one other
            self.pairs.append((a[pick], b[pick]))
            label[high[pick]] = low[pick]
            while (label[label] != label).any():
                label[:] = label[label]


def trie_join(
    values: np.ndarray, groups: np.ndarray, budget: int, top: int, full: np.ndarray | None = None, limit: int = 0, forest: Forest | None = None
) -> np.ndarray:
    """For each row the least row it is linked to within its group, directly or by way of others.

    ``values`` are sorted within ``groups``, and equal above bit ``top`` there. With ``full`` (words of longer
    fingerprints) a pair is linked only if these differ in at most ``limit`` bits; rows with equal values are then ordered by
    ``full``, each meets the first one and the one before it, and then all other rows that no links join to it yet, by halves.
    A ``forest`` of rows that are already in that order is continued.
    """
    if full is not None:
        order = np.lexsort((*full.T[::-1], values, groups))
        values, full = values[order], full[order]

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if full is None:
            return np.bitwise_count(values[a] ^ values[b]) <= budget
        return np.bitwise_count(full[a] ^ full[b]).sum(axis=1) <= limit

    n = len(values)
    forest = forest or Forest(n)
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones: dict[int, np.ndarray] = {}
    stack = [(top - 1, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    while stack:
        bit, alo, ahi, blo, bhi, off = stack.pop()
        if len(alo) > (PAIRS if bit >= -1 else max(1, PAIRS // LEAF)):
            half = len(alo) // 2
            stack.append((bit, *(x[:half] for x in (alo, ahi, blo, bhi, off))))
            stack.append((bit, *(x[half:] for x in (alo, ahi, blo, bhi, off))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[single], blo[single]
        if len(a):
            near = close(a, b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.link(a[near], b[near])
        label = forest.label
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        whole = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (label[alo] == label[blo])
        keep = ~single & ~whole
        if not keep.any():
            continue
        if bit < 0:  # below the last bit a node holds one value, which several longer fingerprints may share
            if bit == -1:
                own = keep & (alo == blo)
                size = (ahi - alo)[own] - 1
                b = ragged(np.arange(n), alo[own] + 1, size)
                a = np.concatenate((np.repeat(alo[own], size), b - 1, alo[keep & ~own]))
                b = np.concatenate((b, b, blo[keep & ~own]))
                near = close(a, b)
                forest.link(a[near], b[near])
            if full is not None:
                alo, ahi, blo, bhi = (x[keep] for x in (alo, ahi, blo, bhi))
                if bit < -1:
                    small = (ahi - alo) * (bhi - blo) <= LEAF
                    size = (ahi - alo)[small] * (bhi - blo)[small]
                    at = ragged(np.arange(LEAF), np.zeros(len(size), dtype=np.int64), size)
                    wide = np.repeat((bhi - blo)[small], size)
                    a, b = np.repeat(alo[small], size) + at // wide, np.repeat(blo[small], size) + at % wide
                    open_ = forest.label[a] != forest.label[b]
                    a, b = a[open_], b[open_]
                    near = close(a, b)
                    forest.link(a[near], b[near])
                    alo, ahi, blo, bhi = (x[~small] for x in (alo, ahi, blo, bhi))
                    amid, bmid, own = (alo + ahi) // 2, (blo + bhi) // 2, alo == blo
                    parts = [(alo, amid, blo, bmid), (amid, ahi, bmid, bhi), (alo, amid, bmid, bhi), tuple(x[~own] for x in (amid, ahi, blo, bmid))]
                    alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*parts, strict=True))
                    some = (ahi > alo) & (bhi > blo)
                    alo, ahi, blo, bhi = (x[some] for x in (alo, ahi, blo, bhi))
                if len(alo):
                    stack.append((bit - 1, alo, ahi, blo, bhi, np.zeros(len(alo), dtype=np.int64)))
            continue
        alo, ahi, blo, bhi, off = (x[keep] for x in (alo, ahi, blo, bhi, off))
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)))
        count = ones[bit]
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        own = (alo == blo) & (ahi == bhi)
        parts = [
            (alo, amid, blo, bmid, off),
            (amid, ahi, bmid, bhi, off),
            (alo, amid, bmid, bhi, off + 1),
            tuple(x[~own] for x in (amid, ahi, blo, bmid, off + 1)),
        ]
        alo, ahi, blo, bhi, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = (alo == blo) & (ahi == bhi)
        keep = (ahi > alo) & (bhi > blo) & (off <= budget) & ~(own & (ahi - alo == 1))
        stack.append((bit - 1, *(x[keep] for x in (alo, ahi, blo, bhi, off))))
    if full is None:
        return forest.label
    least, label = np.full(n, n), np.empty(n, dtype=np.int64)
    np.minimum.at(least, forest.label, order)
    label[order] = least[forest.label]
    return label


def _dealt(rows: DataFrame, bits: int, others: list[str]) -> DataFrame:
    """Rows ``(piece, value, ...)`` of ``bits``-wide values, dealt to groups that agree on a block, and sorted there.

    ``turned`` is the value turned so that its block comes first. A large group is dealt again by quarters of its other bits.
    """
    width, mask = bits // BLOCKS, (1 << (bits // BLOCKS)) - 1
    part = (bits - width) // BLOCKS
    blocks = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("value", b * width).bitwiseAND(mask).alias("same")) for b in range(BLOCKS)]
    rows = rows.select("piece", "value", *others, F.inline(F.array(*blocks)))
    key = ["piece", "block", "same"]
    large = rows.groupBy(*key).count().filter(F.col("count") > GROUP_ROWS).select(*key, F.lit(True).alias("large"))
    kept = "" if bits == BITS else f" & {(1 << bits) - 1}"
    turned = F.expr(f"(shiftleft(value, ({BLOCKS - 1} - block) * {width}){kept}) | CASE WHEN block = {BLOCKS - 1} THEN 0L ELSE shiftrightunsigned(value, (block + 1) * {width}) END")
    spread = F.when(
        F.col("large"),
        F.array(*[F.expr(f"{q + 1}L * {1 << part} + (shiftrightunsigned(turned, {q * part}) & {(1 << part) - 1})") for q in range(BLOCKS)]),
    ).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.join(large, key, "left").withColumn("turned", turned)
    rows = rows.select(*key, F.explode(spread).alias("sub"), "turned", *others)
    return rows.repartition(partitions(rows.sparkSession), *key, "sub").sortWithinPartitions(*key, "sub", "turned")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """About ``TRIE_ROWS`` sorted rows at a time with their group numbers, never cutting a group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def changes(rows: pa.Table) -> np.ndarray:
        out = np.zeros(rows.num_rows - 1, dtype=bool)
        for c in ("piece", "block", "same", "sub"):
            x = rows.column(c).to_numpy()
            out |= x[1:] != x[:-1]
        return out

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TRIE_ROWS:
            rows = pa.Table.from_batches(held)
            cut = np.flatnonzero(changes(rows))
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                yield np.append(0, np.cumsum(changes(rows.slice(0, at)))), rows.slice(0, at)
            held, size = rows.slice(at).to_batches(), rows.num_rows - at
    if size:
        rows = pa.Table.from_batches(held)
        yield np.append(0, np.cumsum(changes(rows))), rows


def trie_links(bits: DataFrame, budget: int = 3) -> DataFrame:
    """Links ``(a, b)`` that span the components of distinct fingerprints ``bits`` within ``budget`` differing bits."""
    if not 0 <= budget < BLOCKS:
        raise ValueError(f"budget must be between 0 and {BLOCKS - 1}")
    width = BITS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches):
            values = rows.column("turned").to_numpy().view(np.uint64)
            label = trie_join(values, group, budget, BITS - width)
            at = np.flatnonzero(label != np.arange(len(label)))
            back = ((BLOCKS - 1 - rows.column("block").to_numpy()) * width).astype(np.uint64)
            plain = np.where(back == 0, values, (values >> back) | (values << ((np.uint64(BITS) - back) % np.uint64(BITS))))
            plain = plain.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(plain[at]), pa.array(plain[label[at]])], names=["a", "b"])

    return _dealt(bits.select(F.lit(0).alias("piece"), F.col("bits").alias("value")), BITS, []).mapInArrow(run, "a long, b long")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(bits, component_id)`` from ``nodes(bits, least)`` and ``links(a, b)`` between their bits."""
    ends = F.array(F.col("a"), F.col("b"))
    keys = links.distinct().select(F.lit("near").alias("kind"), F.struct("a", "b").alias("key"), F.explode(ends).alias("id"))
    linked = link_components(keys.select("id"), keys)
    named = nodes.join(linked.withColumnRenamed("id", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("bits", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per document; the component is its least doc_id."""
    marked = saved(fingerprints(docs, shingle))
    bits = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    named = _components(bits, saved(trie_links(bits.select("bits"), budget)))
    return marked.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# --- copies by similarity -------------------------------------------------------------

#: Fingerprints of 256 bits; pieces of 32 bits, of which one must agree within the trie's budget; bit limits of the proposals, in
#: standard deviations around the mean at the wanted similarity.
WORDS, PIECE, STIR, LEVELS = 4, 32, (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (-1, 1, 3)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Four fingerprints, from the shingle hashes and three mixtures of them."""
    out = []
    for k in STIR:
        h = hashes
        if k:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(k)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(31)
        out.append(majority(h) if len(h) else 0)
    return out


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, key_a, key_b, tie, node_a, node_b, w0..)`` of ``(doc_id, key_a, key_b, tie, text)``: texts with equal words share a node."""
    names = [f"w{i}" for i in range(WORDS)]
    keep = ["doc_id", "key_a", "key_b", "tie"]

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        made = []
        for text in batch.column("text").to_pylist():
            line = b" ".join(text.lower().split())
            made.append([xxhash.xxh64_intdigest(line, 1), xxhash.xxh64_intdigest(line, 2), *wide_fingerprint(shingle_hashes(text, shingle))])
        cells = np.array(made, dtype=np.uint64).reshape(-1, 2 + WORDS).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], names=[*keep, "node_a", "node_b", *names]
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_chunks(rows, mark, f"doc_id {kind}, key_a long, key_b long, tie long, node_a long, node_b long, " + ", ".join(f"{n} long" for n in names))


def _proposed(nodes: DataFrame, limits: list[int], budget: int) -> DataFrame:
    """``(a, b, bits)``: pairs of nodes that span, closest first, what is within the last limit of differing bits in a group of tries."""
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches):
            values = rows.column("turned").to_numpy().view(np.uint64)
            full = np.stack([rows.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
            order = np.lexsort((*full.T[::-1], values, group))
            values, full, node = values[order], full[order], rows.column("node").to_numpy()[order]
            forest = SpanningForest(len(values))
            for limit in limits:
                trie_join(values, group, budget, PIECE - PIECE // BLOCKS, full, limit, forest)
            if forest.pairs:
                a, b = (np.concatenate(x) for x in zip(*forest.pairs, strict=True))
                bits = np.bitwise_count(full[a] ^ full[b]).sum(axis=1).astype(np.int32)
                a, b = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits)], names=["a", "b", "bits"])

    pieces = [F.struct(F.lit(i).alias("piece"), F.shiftrightunsigned(names[i // 2], PIECE * (i % 2)).bitwiseAND((1 << PIECE) - 1).alias("value")) for i in range(2 * WORDS)]
    dealt = _dealt(nodes.select("node", *names, F.inline(F.array(*pieces))), PIECE, ["node", *names])
    return dealt.mapInArrow(run, "a long, b long, bits int").distinct()


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``(node, s)`` of ``(node, text)``: the distinct shingle hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column("text").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
        values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["node", "s"])

    return map_chunks(rows, run, "node long, s array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    met = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return met.filter(same >= similarity * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def _linked(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes in ``pairs``."""
    keys = pairs.select(F.lit("near").alias("kind"), F.struct("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("id"))
    return link_components(keys.select("id"), keys).withColumnRenamed("id", "node")


def near_links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, similarity: float, budget: int = 3) -> DataFrame:
    """Verified pairs ``(a, b)`` of ``nodes(node, w0..)``; ``texts`` gives ``(node, text)`` for a table of nodes.

    The tries only propose pairs; each that counts has been compared by its whole shingle sets. First every node's closest proposal is
    compared, then all proposals that still lie between different components, so large groups of near copies cost about one comparison a node.
    """
    chance = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    spread = np.sqrt(WORDS * BITS * chance * (1 - chance))
    limits = [int(WORDS * BITS * chance + x * spread) for x in LEVELS]
    pairs = saved(_proposed(nodes, limits, budget))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "bits"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "bits"))).alias("e")).select("e.*")
    sets = saved(_shingle_sets(texts(ends.select("node").distinct()), shingle))
    nearest = ends.groupBy("node").agg(F.min(F.struct("bits", "other")).alias("o")).select("node", "o.other")
    nearest = nearest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    first = saved(_similar(nearest, sets, similarity))
    linked = saved(_linked(first))
    left, right = linked.select(F.col("node").alias("a"), F.col("component").alias("ca")), linked.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    rest = saved(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return first.unionByName(_similar(rest, sets, similarity))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group of copies and near copies: that of the least doc_id.

    Groups are the components of pairs whose shingle sets have a Jaccard similarity of at least ``similarity``, each such pair compared
    exactly. Texts with the same words are one node. Candidates come from 256-bit fingerprints: two texts of Jaccard similarity J have shingle
    vectors at an angle with cosine 2J / (1 + J), and bits differ with a chance of the angle over pi. Proposed are pairs that agree within
    ``budget`` bits on one of eight pieces of 32 bits, each joined by its tries, and that differ in at most the mean at ``similarity`` plus three
    standard deviations: nine in ten pairs at 0.8, all but one in a thousand at 0.9.

    Null text counts as empty, texts without words are copies of each other; a null doc_id comes last; of rows with equal doc_id and text the one
    with the least hash of all columns stays, of equal rows one; texts of any length are compared whole; an empty table stays empty.
    """
    keys = [*row_key(F.col("doc_id"), text_of()), F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]).alias("tie")]
    names, key = [f"w{i}" for i in range(WORDS)], ["key_a", "key_b", "tie"]
    marked = saved(_marked(docs.select("doc_id", *keys, text_of().cast("binary").alias("text")), shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "key_a", "key_b")).alias("least")
    nodes = marked.groupBy("node_a", "node_b").agg(F.min(F.struct(*names)).alias("w"), least)
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "w.*", "least"))

    def texts(wanted: DataFrame) -> DataFrame:
        of = saved(nodes.join(wanted, "node", "left_semi").select("node", *[F.col(f"least.{c}").alias(c) for c in key]))
        return docs.select(*keys, text_of().cast("binary").alias("text")).join(small_side(of), key).dropDuplicates(["node"]).select("node", "text")

    links = saved(near_links(nodes.select("node", *names), texts, shingle, similarity, budget))
    named = nodes.select("node", "least").join(_linked(links), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least"))
    stays = saved(named.select(*[F.col(f"least.{c}").alias(c) for c in key]))
    repeated = saved(marked.groupBy(*key).count().filter("count > 1").select(*key))
    whole = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(stays, key, "left_semi")
    once = whole.join(small_side(repeated), key, "left_anti")
    again = whole.join(small_side(repeated), key, "left_semi").dropDuplicates(key)
    return once.unionByName(again).select("row.*")
