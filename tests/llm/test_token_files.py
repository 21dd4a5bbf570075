"""Token files: the same ids as the library gives for whole texts, exact offsets, selective reads."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evalloom.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(docs):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = made.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", [token_files.DICTIONARY, token_files.DELTA])
def test_round_trip(spark, tmp_path, encoding):
    rng = np.random.default_rng(3)
    letters = list("ab \n\t'sÉé\x1c1٣=🙂$́ İΣ ß\x85ﬁ") + ["'ll", "<|endoftext|>", "the ", "  ", "T\u0308", "K\u212a.", "Ab,", "x&&&", "dogs'", "n\u0303!?"]
    docs = [(i * 7 % 501, "".join(rng.choice(letters, rng.integers(0, 60)))) for i in range(500)]
    docs += [(None, "first"), (600, None), (601, ""), (604, "a <|endoftext|> b"), (605, "<|startoftext|>" * 3 + "X<|endoftext|>"), (606, "<|endof text|>"), (602, "x y " * 100_000), (603, "z" * 5_000)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, part int, ids int").repartition(5)
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(frame, folder, PATH, 2, encoding)
    rows = token_files.token_checksums(token_files.read_tokens(spark, folder)).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected(docs)
    narrow = token_files.read_tokens(spark, folder, ids=False)
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    some = next(p for p in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = pq.ParquetFile(some).metadata.row_group(0).column(4)
    assert column.has_offset_index and column.has_column_index
    assert ("RLE_DICTIONARY" in str(column.encodings) or "PLAIN_DICTIONARY" in str(column.encodings)) == (encoding is token_files.DICTIONARY)
    assert column.path_in_schema.startswith("ids.")


def test_many_word_shapes():
    """Heads, tails and case of whole words against the library, text by text."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    made, own = Tokenizer.from_file(PATH), token_files.WordIds(PATH)
    letters = list("aZzé5٣'.,!$&-\u0301ΣİßﬁΩ\u212b") + ["'s", "'LL", "don't", "Ab."]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(0, 7))) for _ in range(rng.integers(0, 9))) for _ in range(4000)]
    ids, count = own.encode_many(pa.array(texts))
    want = [made.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_repeats_and_empty(spark, tmp_path):
    frame = spark.createDataFrame([(5, "same")] * 4 + [(5, "other")], "doc_id long, text string")
    token_files.write_tokens(frame, str(tmp_path / "a"), PATH, 2)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [5] * 5
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    token_files.write_tokens(frame.limit(0), str(tmp_path / "b"), PATH, 2)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0
