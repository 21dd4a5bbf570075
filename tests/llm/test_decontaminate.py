"""Contamination against a plain scan of every window."""

import hashlib
import re

import numpy as np

from evalloom.llm import decontaminate as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[t]
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ñandú", "the"]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(25)]
    items += [(3, "second text of item three"), (None, "no id"), (77, None), (78, ""), (79, "..."), (80, "the " * 15), (81, "a b a b a b a b a b a b"), (82, items[0][1])]
    docs = [(1, None), (2, ""), (3, "No-ID!"), (4, "the " * 40), (5, "A b a b\na b a b a b a b a")]
    for i in range(60):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 40)))
        for _ in range(rng.integers(0, 3)):
            w = words(items[rng.integers(25)][1])
            k = rng.integers(0, len(w))
            text += rng.choice([" ", ". ", "\n"]) + "; ".join(w[k : k + rng.integers(8, 14)]).upper().replace("É", "É")
        docs.append((10 + i, text))
    return [*docs, docs[20], docs[20], (10, "another text with id ten"), (500, "x y " * 50_000 + items[4][1])], items


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(dc, "GROUP_WINDOWS", 2)
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, item_id string, pos int").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(tuple(r) for r in dc.contamination(frame, bench).collect())
    assert got == sorted(plain(docs, items))
    kept = sorted(r.doc_id for r in dc.clean_documents(frame, bench).collect())
    assert kept == sorted(d for d, *_, bad in plain(docs, items) if not bad)


def test_no_broadcast_of_terms(spark, monkeypatch):
    monkeypatch.setattr(dc, "fits", lambda df: False)
    monkeypatch.setattr(dc, "small_side", lambda df: df.hint("shuffle_merge"))
    docs, items = fixture()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in dc.contamination(frame, bench).collect()) == sorted(plain(docs, items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare one two three"), (2, "three two x one rare"), (3, "rare x x x x one two three"), (4, "rare one two")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "rare one two three")], "item_id long, text string")
    found, _ = dc.matches(docs, items, near=4)
    keyed = dc._rows(docs).join(found, ["key_a", "key_b"])
    assert {(r.doc_id, r.exact) for r in keyed.collect()} == {(1, True), (2, False)}


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(docs, items.limit(0)).first().contaminated is False
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert dc.clean_documents(docs, items.limit(0)).count() == 1
