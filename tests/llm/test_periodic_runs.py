"""Runs of periodic words against a scan of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import periodic_runs as pr


def plain_runs(w, min_length=24, exponent=3):
    found, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)  # the least period comes first
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = plain_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def fixture():
    rng = np.random.default_rng(5)
    docs = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "the " * 300), (5, "the " * 23), (6, "the " * 24 + "end"), (7, "a\x85b c d " * 9)]
    for i in range(150):
        w = list(rng.choice(["x", "y", "z", "ñ", "日本"], rng.integers(0, 30)))
        for _ in range(rng.integers(0, 5)):
            block = list(rng.choice(["x", "y", "z"], rng.integers(1, 12)))
            w += (block * rng.integers(1, 9))[: rng.integers(1, 80)] + list(rng.choice(["x", "q", "r"], rng.integers(0, 3)))
        docs.append((10 + i, rng.choice([" ", "\n", "  \t"]).join(w)))
    boiler = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    docs += [docs[20], docs[20], (10, "another text with id ten"), (900, "".join(boiler + f"word{i} " * (i % 25) for i in range(60))), (901, "u v w " * 30_000)]
    return docs


def test_digests(spark):
    docs = fixture()
    frame = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted((tuple(r) for r in pr.run_digests(frame).collect()), key=repr)
    assert [r for r in got if r[0] != 901] == sorted((plain_row(*d) for d in docs if d[0] != 901), key=repr)
    long = next(r for r in got if r[0] == 901)
    assert zlib.crc32(b"901") % 10 and long[1:6] == (1, 0, 90_000, 3, 30_000_000)
    assert sum(r[1] for r in got) > 80


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(2, 24), st.integers(2, 4))
def test_all_texts(texts, least, exponent):
    assert pr.find_runs([np.array(t, np.int64) for t in texts], least, exponent) == [plain_runs(t, least, exponent) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=12))
def test_periodic_texts(blocks):
    text = [x for block, times in blocks for x in block * times]
    assert pr.find_runs([np.array(text, np.int64)]) == [plain_runs(text)]


def test_interface(spark):
    frame = spark.createDataFrame([(1, "a b a b a b c", "k"), (2, None, None)], "doc_id long, text string, other string")
    rows = {r.doc_id: r for r in pr.periodic_runs(frame, min_length=4, exponent=2).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 6, 2)] and rows[1].collapsed == "a b c" and rows[1].other == "k"
    assert rows[2].runs == [] and rows[2].collapsed is None
    assert pr.periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(frame, exponent=1)
