"""Byte-level BPE by a segment tree over byte positions.

A piece of text is a row of byte positions. The tree's leaves hold, for every live position, the rank of
the pair that it starts with its live right neighbour; an inner node holds the leftmost minimum below it.
The root names the next merge, which changes three leaves (the merged position, its dead right
neighbour and its live left neighbour), each a logarithmic number of nodes. Many pieces of similar
length go through one set of trees side by side; a long piece has a tree of its own.

Pieces repeat, so a worker keeps the ids of space-separated chunks in a dictionary of bounded size; it
only saves time. ``encode`` and ``decode`` are per-row maps without a shuffle: a lost task is simply run again.

Defined results: null text counts as empty and has no ids; null ids decode to null; other columns stay as they are, but one
with the name of the output is replaced; repeated rows each get their result; texts of any length are processed whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, text_of

#: Entries of each of the two generations of a worker's chunk dictionary, and pieces held at once.
CACHE_ENTRIES, HELD_PIECES = 120_000, 100_000
#: From this length on a piece gets a tree of its own; bytes of all trees built side by side.
LONG_PIECE, TREE_BYTES = 256, 1 << 21
NONE = np.iinfo(np.int64).max
ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")


class ByteBPE:
    """Encoder and decoder for one rank file; pieces come from ``pattern``."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern)
        self.size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair of tokens that make a token; decoding never asks for it."""
        pairs, get = {}, self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        return pairs

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs as sorted keys, and their ranks."""
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        return keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64)

    # --- merging ------------------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        keys, ranks = self.table
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], NONE)

    def _merge_many(self, pieces: tuple[bytes, ...], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes, a power of two, each with its tree in one row of ``tree``."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, size)
        place = np.arange(size)
        live = place < length[:, None]
        ids = self.first[raw]
        nxt = np.broadcast_to(place + 1, (n, size)).copy()
        prv = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        pair = place[:-1] + 1 < length[:, None]
        rank = self._rank(ids[:, :-1][pair], ids[:, 1:][pair])
        leaf = np.full((n, size - 1), NONE, dtype=np.int64)
        leaf[pair] = np.where(rank == NONE, NONE, rank * size + np.nonzero(pair)[1])
        tree[:, size : 2 * size - 1] = leaf
        for low in (size >> k for k in range(1, size.bit_length())):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        rows = np.nonzero(tree[:, 1] != NONE)[0]
        flat, width = tree.reshape(-1), 2 * size
        while len(rows):
            root = tree[rows, 1]
            at = root % size
            dead = nxt[rows, at]
            ids[rows, at] = root // size
            live[rows, dead] = False
            after = nxt[rows, dead]
            nxt[rows, at] = after
            more = after < length[rows]
            prv[rows[more], after[more]] = at[more]
            right = np.full(len(rows), NONE, dtype=np.int64)
            right[more] = self._rank(ids[rows[more], at[more]], ids[rows[more], after[more]])
            before = prv[rows, at]
            has = before >= 0
            left = np.full(len(rows), NONE, dtype=np.int64)
            left[has] = self._rank(ids[rows[has], before[has]], ids[rows[has], at[has]])
            before = np.where(has, before, at)
            base = rows * width
            nodes = [size + dead, size + at, size + before]
            flat[base + nodes[0]] = NONE
            flat[base + nodes[2]] = np.where(left == NONE, NONE, left * size + before)
            own = np.where(right == NONE, NONE, right * size + at)
            flat[base + nodes[1]] = own  # last: without a left neighbour nodes[2] is this leaf
            for _ in range(size.bit_length() - 1):
                for k in range(3):
                    nodes[k] = nodes[k] >> 1
                    below = base + 2 * nodes[k]
                    flat[base + nodes[k]] = np.minimum(flat[below], flat[below + 1])
            rows = rows[tree[rows, 1] != NONE]
        out = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        starts = ends - live.sum(axis=1) * 4
        return [out[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _merge_one(self, piece: bytes) -> bytes:
        """One long piece with a tree in a plain list."""
        n, size, pairs = len(piece), 1 << (len(piece) - 1).bit_length(), self.pairs
        ids = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        none = self.size * size
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            rank = pairs.get(ids[i] * self.size + ids[nxt[i]]) if nxt[i] < n else None
            return none if rank is None else rank * size + i

        for i in range(n):
            tree[size + i] = leaf(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] != none:
            rank, at = divmod(tree[1], size)
            dead = nxt[at]
            ids[at], live[dead], nxt[at] = rank, False, nxt[dead]
            if nxt[at] < n:
                prv[nxt[at]] = at
            tree[size + dead] = none
            changed = [dead, at] + ([prv[at]] if prv[at] >= 0 else [])
            for i in changed[1:]:
                tree[size + i] = leaf(i)
            for i in changed:
                node = (size + i) >> 1
                while node:
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
                    node >>= 1
        return np.array([t for t, keep in zip(ids, live, strict=True) if keep], dtype="<u4").tobytes()

    def merge(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces as little-endian 32-bit integers; a piece that is a token is that token."""
        found: dict[str, bytes] = {}
        sizes: list[list[tuple[str, bytes]]] = [[] for _ in range(LONG_PIECE.bit_length())]
        get = self.ranks.get
        for piece in pieces:
            raw = piece.encode()
            rank = get(raw)
            if rank is not None:
                found[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                found[piece] = self._merge_one(raw)
            else:
                sizes[(len(raw) - 1).bit_length()].append((piece, raw))
        for bits, group in enumerate(sizes):
            step = TREE_BYTES >> (bits + 4)
            for i in range(0, len(group), step):
                names, raws = zip(*group[i : i + step], strict=True)
                found.update(zip(names, self._merge_many(raws, 1 << bits), strict=True))
        return found

    # --- texts --------------------------------------------------------------------------

    def _fill(self, words: set[str]) -> None:
        """Put the ids of the chunks that the dictionary lacks into it; entries unused for a generation go."""
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        find, split = self.find.findall, []
        for word in words:
            if word not in cache:
                known = older.get(word)
                if known is None:
                    split.append((word, find(word)))
                else:
                    cache[word] = known
        ids = self.merge({p for _, pieces in split for p in pieces})
        for word, pieces in split:
            cache[word] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        """Cut before each space between two characters that aren't white space, where the pattern always cuts too."""
        words = text.split(" ")
        if not ODD_SPACE.search(text):
            return [words[0], *[" " + w for w in words[1:]]]
        out = [words[0]]
        for w in words[1:]:
            if w and not w[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " + w)
            else:
                out[-1] += " " + w
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        split = [self.chunks_of(t) for t in texts]
        parts = [[] for _ in texts]
        group, held = [], 0
        for i, words in enumerate(split):
            for k in range(0, len(words), HELD_PIECES):
                part = words[k : k + HELD_PIECES]
                if group and held + len(part) > HELD_PIECES:
                    self._encode_group(group, parts)
                    group, held = [], 0
                group.append((i, part))
                held += len(part)
        self._encode_group(group, parts)
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def _encode_group(self, group: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        self._fill(set().union(*(words for _, words in group)))
        for i, words in group:
            parts[i].append(b"".join(map(self.cache.__getitem__, words)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def model(path: str, pattern: str) -> ByteBPE:
    """The encoder of a worker, built once for each rank file."""
    return ByteBPE(path, pattern)


def _mapped(df: DataFrame, col: str, out: str, kind: T.DataType, fn) -> DataFrame:
    """``df`` with ``out`` in place of a column of that name; ``fn`` maps the list of a chunk's values."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in chunks(batch, pc.binary_length(batch.column(col))):
                made = fn(part.column(col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of each text as a binary of little-endian unsigned 32-bit integers."""
    return _mapped(
        df.withColumn(text_col, text_of(text_col)), text_col, out, T.BinaryType(),
        lambda texts: pa.array(model(path, pattern).encode_many(texts), pa.binary()),
    )


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids stand for."""
    return _mapped(
        df, ids_col, out, T.BinaryType(),
        lambda ids: pa.array([None if x is None else model(path, pattern).decode(x) for x in ids], pa.binary()),
    )


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode the texts, decode the ids, and describe both: counts and SHA-256 digests."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
