"""Secret spans against a plain version, and what a second run scans."""

import hashlib
import re

import numpy as np

from evalloom.llm import secret_ledger as sl


def plain(text):
    text, out = text or "", []
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    names = names.replace("_?", "_?")
    for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
    return [sum(k == x for *_, k in out) for x in ("assign", "access", "hex")] + [hashlib.sha256(spans.encode()).hexdigest()]


def texts():
    rng = np.random.default_rng(2)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "abc", "abcdef", "xyz=/+", "AKIA", "Q7Z", "0123456789abcdef" * 2, "f" * 23, "\n", "é", "🙂", "toKen="]
    out = [None, "", "password=hunter2", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "token = \"" + "a0" * 20 + '"']
    out += ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(400)]
    return [*out, "x " * 200_000 + "secret: abcdefg", "password=hunter2"]


def test_spans(spark, tmp_path):
    docs = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs + docs[:5]], "doc_id long, text string, blob string")
    rows = sl.secret_digests(frame, str(tmp_path / "ledger")).collect()
    assert len(rows) == len(docs) + 5
    for r in rows:
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == plain(docs[r.doc_id][1]), docs[r.doc_id]


def test_incremental(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    schema = "path string, version int, text string"
    first = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("c", 1, "plain"), ("d", 1, None)], schema)
    assert {r.path: len(r.spans) for r in sl.findings(first, folder, [sl.BASE], "path").collect()} == {"a": 1, "b": 1, "c": 0, "d": 0}
    assert sl.read_ledger(spark, folder).count() == 3
    second = first.union(spark.createDataFrame([("a", 2, "ghp_" + "x1" * 20)], schema))
    got = sl.findings(second, folder, [sl.BASE, sl.VENDOR], "path").collect()
    assert sorted((r.path, *[s.kind for s in r.spans]) for r in got) == [("a", "assign"), ("a", "code_host"), ("b", "assign"), ("c",), ("d",)]
    # one new blob under two rule sets, three old ones under the new rule set
    assert sl.read_ledger(spark, folder).groupBy("rules").count().orderBy("rules").collect() == [("base", 4), ("vendor", 4)]
    sl.findings(second, folder, [sl.BASE, sl.VENDOR], "path").collect()
    assert sl.read_ledger(spark, folder).count() == 8


def test_empty(spark, tmp_path):
    assert sl.secret_digests(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "x")).count() == 0
