"""Suffix arrays against sorting, removed bytes against a dictionary of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from evalloom.llm import repeats


def plain(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(docs, raws, strict=True):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(((gone[1:-1] & ~gone[:-2]).sum() + gone[0])) if len(r) else 0
        kept = bytes(x for x, g in zip(r, gone, strict=False) if not g)
        out.append((doc, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        parts = [rng.integers(97, 99, rng.integers(1, size + 1)).astype(np.uint8).tobytes() for _ in range(4)]
        text = np.concatenate([np.append(np.frombuffer(p, dtype=np.uint8).astype(np.int64), 256 + i) for i, p in enumerate(parts)])
        starts = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        order, rank = repeats.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert (order[rank] == np.arange(len(text))).all()
        lcp = repeats.common_prefixes(text, order, rank, starts)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            assert lcp[b] == n


def fixture(rng):
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(120) for _ in range(12)]
    passage = text(60)
    docs = [(None, base[0]), (1, None), (2, ""), (3, "short"), (4, base[1]), (5, base[1]), (5, base[1]), (6, base[2] + base[3]), (7, base[3] + base[2])]
    docs += [(10 + i, text(int(rng.integers(0, 30))) + passage + text(int(rng.integers(0, 30)))) for i in range(40)]
    for i in range(40):
        w = base[4 + i % 6].split(" ")
        w[int(rng.integers(len(w)))] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(200, "=" * 3000), (201, "=" * 205), (202, "ab" * 700), (203, "é" * 150 + "x"), (204, base[10] + " " + base[10]), (205, "x" + base[11][:200]), (206, "y" + base[11][:199]), (207, "z" + base[11][:201])]
    return docs


@pytest.mark.parametrize(("segments", "piece"), [(20_000, 1 << 20), (3, 700)])
def test_without_repeats(spark, monkeypatch, segments, piece):
    """Also with crowded minimizers dealt to several shards, and texts read in pieces."""
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", segments)
    monkeypatch.setattr(repeats, "PIECE", piece)
    docs = fixture(np.random.default_rng(4))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, low string, start int").repartition(4)
    got = [tuple(r) for r in repeats.repeat_digests(frame).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, 200), key=str)


def test_segments_cover_all_windows(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    monkeypatch.setattr(repeats, "SEGMENT_WINDOWS", 40)
    texts = [(t or "").encode() for _, t in fixture(np.random.default_rng(5))]
    doc, first, count, low, *_ = repeats.segments(texts, 200)
    seen = Counter((d, p) for d, a, n in zip(doc, first, count, strict=True) for p in range(a, a + n))
    assert seen == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 199))
    by = {}
    for d, a, n, m in zip(doc, first, count, low, strict=True):
        for p in range(a, a + n):
            assert by.setdefault(texts[d][p : p + 200], m) == m


def test_empty(spark):
    assert repeats.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
