"""Base spans against plain patterns, the field's sums and best labelling against all labellings, and what it adds."""

import hashlib
import re
from itertools import product

import numpy as np

from evalloom.llm import pii


def plain(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def texts():
    rng = np.random.default_rng(3)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "+", "1", "255", "256.", "1.2.3.4", "4111 1111-1111 1111", "+1 (644) 555-7859", " ", "\n", "é", "٣", "%", "(", ")", "@c.d@e.f"]
    out = [None, "", "no data", "@b.c@d.e", "a@b.c@d.e", "version 2.0.", "1" * 5000, "a" * 3000 + "@", "x" * 3000 + "@b.c", "1 " * 2000]
    return out + ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(1500)]


def test_long_texts():
    """Linear in the text, where a pattern that backtracks is not."""
    assert pii.base_spans("a" * 500_000 + " @") == []
    assert pii.base_spans("x" * 500_000 + "@b.c") == [("email", 0, 500_004)]
    assert pii.all_spans("word " * 200_000 + "1.2.3.4", np.zeros((len(pii.NAMES), 4)))[1] == [("ip", 1_000_000, 1_000_007)]


def test_base():
    for t in texts():
        assert pii.base_spans(t or "") == plain(t), t[:80]


def labellings(island):
    """All sets of non-overlapping (candidate, kind)."""
    def grow(at):
        yield ()
        for k, (i, j) in enumerate(island.spans):
            if i >= at:
                for kind, rest in product(range(len(pii.KINDS)), grow(j)):
                    yield ((k, kind), *rest)

    return list(grow(0))


def test_field_against_all_labellings():
    rng = np.random.default_rng(5)
    for text in ("1.2 a3", "+1 (2)", "x1@y", "7-8.9"):
        island = pii.Island(text, 0, len(text))
        scores = rng.normal(0, 1, (len(island.spans), len(pii.KINDS)))
        every = labellings(island)
        total = np.array([sum(scores[k] for k in x) for x in every])
        best = every[int(total.argmax())]
        assert sorted(island.best(scores)) == sorted(best)
        weight = np.exp(total - np.logaddexp.reduce(total))
        want = np.zeros_like(scores)
        for x, w in zip(every, weight, strict=True):
            for k in x:
                want[k] += w
        assert np.allclose(island.expected(scores), want)


def sample(rng, n):
    made = []
    for _ in range(n):
        d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
        card = next(c for x in range(10) if pii.luhn(c := "4" + d(14) + str(x)) or x == 9)
        kinds = [f"ab{d(1)}.{d(2)}@mail{d(1)}.example.com", ".".join(map(str, rng.integers(1, 256, 4))), card, f"+1 ({d(3)}) 555-{d(4)}", "2.0.", "3.", f"v{d(2)}x", f"{d(4)}-{d(2)}"]
        made.append((" ", str(rng.choice(kinds)), " "))
    return made


def test_learns_and_adds():
    rng = np.random.default_rng(6)
    weights = pii.fit(sample(rng, 300))
    right = total = 0
    for _, text, _ in sample(rng, 200):
        total += 1
        right += pii.field_spans(f"x {text} y", weights) == [(k, a + 2, b + 2) for k, a, b in pii.base_spans(text)]
    assert right / total > 0.95
    assert pii.all_spans("Version 2.0 of 1999, see page 7.", weights)[1] == []
    base, every = pii.all_spans("mail a1.22@mail7.example.com now", weights)
    assert base == every == [("email", 5, 28)]
    assert pii.fit([]).any() == np.False_


def test_documents(spark):
    docs = [(i, t) for i, t in enumerate(texts()[:150])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs + docs[:3]], "doc_id long, text string, spans string, base int")
    rows = pii.pii_digests(frame).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        want = plain(docs[r.doc_id][1])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",") if r.spans else [])
    assert pii.pii_digests(frame.limit(0)).count() == 0
    clean = {r.doc_id: r for r in pii.redacted(frame, np.zeros((len(pii.NAMES), 4))).collect()}
    assert clean[0].text is None and clean[2].text == "no data" and clean[4].text == "[EMAIL]@d.e" and clean[4].base == 1
