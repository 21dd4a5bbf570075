"""Ids equal to the library's, and an exact way back."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from evalloom.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = np.random.default_rng(1)
    letters = list("ab \n\t'sé\x1c1٣=🙂$́\x85　 ") + ["the ", "  ", "'ll", "<|endoftext|>"]
    made = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 30))) for _ in range(500)]
    return ["", " ", "\n", "a  ", "  a", "a" * 5000, " " * 3000, "=-" * 4000, "é" * 700, " ".join(words), "word " * 100_000, *made]


def test_against_the_library(library):
    model = byte_bpe.ByteBPE(PATH, PATTERN)
    every = texts()
    for text, ids in zip(every, model.encode_many(every), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text), text[:60]
        assert model.decode(ids) == text.encode()


def test_trees_agree():
    """One tree for each long piece, and many side by side, whatever the size class."""
    model = byte_bpe.ByteBPE(PATH, PATTERN)
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.choice([97, 98, 104, 101, 116, 195, 169], rng.integers(1, 33)).astype(np.uint8)) for _ in range(300)]
    assert model._merge_many(tuple(pieces), 32) == [model._merge_one(p) for p in pieces]


def test_small_dictionary(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(byte_bpe, "HELD_PIECES", 7)
    model = byte_bpe.ByteBPE(PATH, PATTERN)
    every = texts()[11:900]
    for i in range(0, len(every), 50):
        for text, ids in zip(every[i : i + 50], model.encode_many(every[i : i + 50]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)


def test_documents(spark, library):
    docs = list(enumerate([None, *texts()[:300]]))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs + docs[:3]], "doc_id long, text string, ids string, decoded int")
    rows = byte_bpe.bpe_digests(frame, PATH, PATTERN).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        text = docs[r.doc_id][1] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    kept = byte_bpe.encode(frame, PATH, PATTERN)
    assert kept.columns == ["doc_id", "text", "decoded", "ids"]
    holes = kept.limit(1).selectExpr("doc_id", "cast(null as binary) AS ids")
    assert byte_bpe.decode(holes, PATH, PATTERN).first().decoded is None
    assert byte_bpe.bpe_digests(frame.limit(0), PATH, PATTERN).count() == 0
