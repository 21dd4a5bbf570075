"""Token ids in Parquet files: list columns with dictionary pages, bounded row groups and page indexes.

Documents are range-partitioned and sorted by doc_id, encoded in place, and written by Spark's Parquet writer: one file for each
range, rows in ascending doc_id order, ids as ``list<int32>``. Few distinct ids make dictionary pages (indices of
at most 16 bits, run-length coded) the right encoding; ``DELTA`` selects the second data page version with delta encoding
instead. Row groups and pages are bounded, and the writer keeps column and offset indexes, so that a
reader that wants counts and offsets reads three narrow columns, and one that wants a doc_id range reads its pages.

Each row has its part number and its offset within the part; the offsets of the parts come from a sum over the
narrow columns, one row for each part. ``read_tokens`` adds them up to the global ``start``.

Encoding: the tokenizer's pieces never cross a space or a line feed, nor the boundary between a Latin letter or digit and ASCII punctuation up to the
word's end, so the words between spaces are cut there; ASCII parts go to lower case, as the tokenizer's normalizer does. The parts are encoded
once for a worker, many new ones in one call of the library, and their ids are put together again by the tokens' offsets. A text that holds one
of the file's added tokens, which the library cuts out first, is encoded whole.

Defined results: null text counts as empty and has the end id alone; a text of any length is encoded whole, its ids must fit in a task; null doc_ids come first; equal doc_ids follow
the hash of their text; an empty table writes no rows; further columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, partitions, ragged, text_of

#: Bytes of a row group and of a page; words that one call of the library encodes; entries of a generation of the
#: dictionary; bytes of text whose words are looked up at once.
ROW_GROUP, PAGE, CALL_WORDS, CACHE_ENTRIES, CALL_BYTES = 32 << 20, 1 << 20, 20_000, 400_000, 8 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters and digits that stay one letter under the normalizer, so that punctuation after them is a piece of its own.
LAST = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"
DICTIONARY = {"parquet.enable.dictionary": "true"}
DELTA = {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}


class WordIds:
    """Ids of texts by a tokenizer file of the tokenizers library, word by word."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = "|".join(re.escape(t) for t in added if t)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(made.ids, dtype="<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        at = np.fromiter((a for a, _ in made.offsets), dtype=np.int64, count=len(made.ids))
        cuts = (4 * np.searchsorted(at, ends)).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian 32-bit integers; entries unused for a generation go."""
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older, new = self.cache, self.older, []
        for word in words:
            if word not in cache:
                known = older.get(word)
                if known is None:
                    new.append(word)
                else:
                    cache[word] = known
        for i in range(0, len(new), CALL_WORDS):
            part = new[i : i + CALL_WORDS]
            cache.update(zip(part, self._encode(part), strict=True))
        return list(map(cache.__getitem__, words))

    def encode_many(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number in each text."""
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)) if self.added else np.empty(0, np.int64)
        if len(whole):
            ids, count = self._by_words(pc.if_else(pc.match_substring_regex(texts, self.added), "", texts))
            made = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<i4") for i in whole.tolist()]
            pieces = np.split(ids, np.cumsum(count)[:-1])
            for i, v in zip(whole.tolist(), made, strict=True):
                pieces[i] = v
            return np.concatenate(pieces), np.array([len(v) for v in pieces])
        return self._by_words(texts)

    def _by_words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = words.offsets.to_numpy()
        coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        trimmed = pc.utf8_rtrim(distinct, characters=PUNCTUATION)
        cut = pc.match_substring_regex(trimmed, LAST)
        heads = pc.if_else(cut, trimmed, distinct)
        tails = _rest(distinct, heads)
        heads = pc.if_else(pc.equal(pc.utf8_length(heads), pc.binary_length(heads)), pc.ascii_lower(heads), heads)
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        made = self._ids(parts.dictionary.to_pylist())
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        start = np.cumsum(size) - size
        part = parts.indices.to_numpy()
        both = np.column_stack([part[: len(distinct)], part[len(distinct) :]])  # the parts of each distinct word
        used = both[code]
        ids = ragged(np.frombuffer(b"".join(made), dtype="<i4"), start[used].ravel(), size[used].ravel())
        total = np.concatenate(([0], np.cumsum(size[both].sum(axis=1)[code])))[ends - ends[0]]
        return ids, np.diff(total)


def _rest(words: pa.StringArray, heads: pa.StringArray) -> pa.StringArray:
    """What follows each head in its word."""
    if not len(words):
        return words
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    begin = at[:-1] + pc.binary_length(heads).to_numpy()
    length = at[1:] - begin
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.tobytes()), pa.py_buffer(ragged(raw, begin, length).tobytes()))


@lru_cache(maxsize=4)
def model(path: str) -> WordIds:
    return WordIds(path)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``(part, part_start, doc_id, n_tokens, ids)`` in doc_id order, a part for each range."""
    n = partitions(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("tie"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, made = TaskContext.get().partitionId(), 0, model(path)
        for batch in batches:
            for rows in chunks(batch, pc.binary_length(batch.column("text")), CALL_BYTES):
                ids, count = made.encode_many(rows.column("text"))
                at = np.cumsum(count)
                ids = np.insert(ids, at, end_id)  # after each document
                count = count + 1
                ends = np.cumsum(count)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(count), part, dtype=np.int32)), pa.array(start + ends - count), rows.column("doc_id"), pa.array(count), ids],
                    names=["part", "part_start", "doc_id", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return rows.mapInArrow(run, f"part int, part_start long, doc_id {kind}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, encoding: dict[str, str] = DICTIONARY) -> None:
    """Write the ids of ``docs(doc_id, text)`` with ``end_id`` after each document."""
    options = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), **encoding}
    encoded(docs, path, end_id).write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens[, ids])``; ``start`` counts the ids of all documents before this one."""
    rows = spark.read.parquet(folder)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    start = (F.col("part_start") + F.col("before")).alias("start")
    return rows.join(F.broadcast(parts), "part").select("doc_id", start, "n_tokens", *(["ids"] if ids else []))  # a row for each part


def token_checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: of the ids as little-endian unsigned 32-bit integers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
