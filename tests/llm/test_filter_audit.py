"""Filter interaction against applying the filters in each order, document by document."""

import re
from itertools import permutations

import numpy as np

from evalloom.llm import filter_audit as fa


def failed(docs):
    out = []
    for doc_id, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {name for name, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t)))) if bad}
        if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs):
            own.add("E")
        out.append((doc_id, part or "", own))
    return out


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows, known = {}, failed(docs)
    for part in {p for _, p, _ in known}:
        mine = [(d, f) for d, p, f in known if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, name in enumerate(order, 1):
                out = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                removed_by[name] += len(out)
                rows[part, "".join(order), step] = [
                    len(left), len(out), sum(name in f for _, f in gone), sum(f == {name} for _, f in mine), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out), name
                ]
                gone += out
        for (p, _, _), row in rows.items():
            if p == part:
                row[-1] = removed_by[row[-1]]
    return sorted((*k, *v) for k, v in rows.items())


def fixture():
    rng = np.random.default_rng(8)
    docs = [(1, None, None), (2, "", "a"), (None, "same text", "a"), (None, "same text", None), (7, "same text", "b"), (7, "same text", "b"), (7, "same text", "a"), (8, "same text", "a"), (7, "other text", "a")]
    pool = []
    for _ in range(40):
        w = rng.choice([f"word{i}" for i in range(60)] + ["CAPITALS", "#", "a|b", "ñ"], rng.integers(0, 120))
        pool.append(" ".join(w))
    docs += [(10 + i, pool[rng.integers(40)], [None, "", "a", "b", "c"][rng.integers(5)]) for i in range(150)]
    docs += [(1000 - i, "one text of many copies", "hot") for i in range(60)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 400, 2)] + [(10, 1, None), (10, 0, 1), (None, 1, 1), (12, None, None), (999_999, 1, 1)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(fa, "HOT_COPIES", 8)
    docs, labels = fixture()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", bits int, part string").repartition(3)
    got = fa.filter_audit(frame, spark.createDataFrame([(*r, "y") for r in labels], LABELS + ", part string"))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)


def test_colliding_hashes(spark, monkeypatch):
    """Equal hashes of different texts make no copies."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fa, "_hashes", lambda text: [F.lit(1).cast("long").alias("hash_a"), F.char_length(text).cast("long").alias("hash_b")])
    docs = [(1, "ab", "s"), (2, "ba", "s"), (3, "ba", "s"), (4, "ab", "s"), (5, "cc", "s")]
    frame = spark.createDataFrame(docs, DOCS)
    assert sorted(r.doc_id for r in fa.copies(frame, fa.measured(frame)).collect()) == [3, 4]


def test_empty_and_long(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert fa.filter_audit(none, labels).count() == 0
    docs = [(1, "word " * 200_000, "s"), (2, "word " * 200_000, None)]
    frame = spark.createDataFrame(docs, DOCS)
    assert sorted(tuple(r) for r in fa.filter_audit(frame, labels).collect()) == plain(docs, [])
