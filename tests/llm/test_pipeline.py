"""The pipeline's stages one after the other, each against a plain version on its own input."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from evalloom.llm import pii, quality

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_columns_and_registration(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run
    for rows in steps[:-1]:
        assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert len(steps[-1]) == len(steps[-2])


def test_quality(spark, steps):
    """Base failures go, nearly all good documents stay, rows pass unchanged."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r for r in steps[1]}
    assert all(kept[r.doc_id] == r for r in steps[0] if r.doc_id in kept)
    rows = quality.measured(spark.read.parquet(f"{SF}/documents.parquet")).select("row.doc_id", quality.base_failed().alias("f")).collect()
    assert not any(r.f for r in rows if r.doc_id in kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.f]
    assert sum(r.doc_id in kept for r in good) >= 0.97 * len(good)


def test_near_duplicates(steps):
    """No two kept texts of similarity 0.9 or more; each text that went has a partner of 0.8 or more; without a partner none goes."""
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    before, after = {r.doc_id: shingles(r.text) for r in steps[1]}, {r.doc_id for r in steps[2]}
    similar = {}
    for a in before:
        for b in before:
            if a < b:
                same = len(before[a] & before[b])
                similar[a, b] = same / (len(before[a]) + len(before[b]) - same)
    assert not [p for p, j in similar.items() if j >= 0.9 and p[0] in after and p[1] in after]
    for gone in before.keys() - after:
        assert max(j for p, j in similar.items() if gone in p) >= 0.8
    pairs = [p for p, j in similar.items() if j >= 0.8]
    assert sum(p[0] in after and p[1] in after for p in pairs) <= 0.05 * len(pairs)


def test_decontamination(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1) if w else 0)}
    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2] if not hit(r.text)}


def test_personal_data(steps):
    before = {r.doc_id: r for r in steps[3]}
    assert len(steps[4]) == len(steps[3])
    for r in steps[4]:
        assert not pii.base_spans(r.text)
        assert r.n_chars == len(r.text)
        if not pii.SIGNAL.search(before[r.doc_id].text):
            assert r == before[r.doc_id]


def test_tokens(steps):
    texts = {r.doc_id: r.text for r in steps[4]}
    import hashlib

    for r in steps[5]:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens > 0
    assert np.isfinite([r.n_tokens for r in steps[5]]).all()
