"""License detections against plain Python over whole texts."""

import re
import re._parser as sre

import numpy as np
import pytest

from evalloom.llm import license_scan as ls


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


RULES = [(i, label, level, base, word, re.compile(pattern)) for i, label, level, base, word, _, pattern in ls.signatures()]


def plain_spans(w):
    """Every rule at every place of its anchor, in the whole text."""
    spans = set()
    for at, word in enumerate(w):
        line = f" {' '.join([*w[:at], f'<{word}>', *w[at + 1 :]])} "
        for i, label, level, base, keyword, pattern in RULES:
            if keyword == word and (m := pattern.search(line)):
                start = line[: m.start(1)].count(" ") - 1
                spans.add((start, start + m[1].count(" ") + 1, i, label, level, base))
    return spans


def plain(doc_id, text):
    w = words(text)
    spans = plain_spans(w)

    def contained(s):
        rank = lambda t: (t[4], t[0] - t[1], t[2])
        return any(t[0] <= s[0] and s[1] <= t[1] and rank(t) < rank(s) for t in spans if t != s)

    kept = [s for s in spans if s[5] or not contained(s)]
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    base = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in base]
    return (
        doc_id, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
        ",".join(sorted({s[3] for s in kept})), max((ls.CONFIDENCE[s[4]] for s in kept), default=0.0),
    )


LINES = [
    "Released under the MIT License.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause", "gnu lesser general public licence v2.1 or later",
    "cc by cc by sa", "General. Public, license", "dual licensed: MPL 2.0 / GPL v2 / LGPL v2.1", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "all rights all rights reserved reserved",
    "creativecommons.org/licenses/by-nd/4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit Licence", "provided as is without warranty of any kind", "UNAUTHORISED copying",
    "distributed under the terms of the Mozilla Public License Version 1.1", "new BSD license", "das mit dem", "copyright (c) 2024",
]


def fixture():
    rng = np.random.default_rng(7)
    docs = [(1, None), (2, ""), (3, "..."), (None, "CC-BY"), (4, "É CC by"), (5, "all rights reserved " * 30)]
    docs += [(10 + i, line) for i, line in enumerate(LINES)]
    for i in range(80):
        parts = [*rng.choice(LINES, rng.integers(0, 6)), *rng.choice(["la casa", "the end of", "und"], rng.integers(0, 4)), *rng.choice([x.split()[0] for x in LINES], 2)]
        rng.shuffle(parts)
        docs.append((100 + i, " ".join(parts)))
    return [*docs, docs[30], docs[30], (10, "another text with id ten, under the mit license")]


def test_digests(spark):
    docs = fixture()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, label string, start int").repartition(3)
    assert sorted((tuple(r) for r in ls.license_digests(frame).collect()), key=repr) == sorted((plain(*d) for d in docs), key=repr)


def test_known_labels(spark):
    frame = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    got = {LINES[r.doc_id]: (r.labels, r.score) for r in ls.license_digests(frame).collect()}
    assert got["Released under the MIT License."] == ("mit", 0.9)
    assert got["Licensed under the Apache License, Version 2.0"] == ("apache-2.0", 0.99)
    assert got["This work is licensed under the GNU General Public License, version 3."] == ("gpl,gpl-3", 0.99)
    assert got["SPDX-License-Identifier: BSD-3-Clause"] == ("bsd-3-clause", 1.0)
    assert got["gnu lesser general public licence v2.1 or later"] == ("lgpl-2.1-or-later", 0.99)
    assert got["Licensed under CC BY-NC 4.0."] == ("cc-by,cc-by-nc-4.0", 0.99)
    assert got["Creative Commons Attribution-NonCommercial-ShareAlike 3.0"] == ("cc-by-nc-sa-3.0", 0.95)
    assert got["dual licensed: MPL 2.0 / GPL v2 / LGPL v2.1"] == ("gpl-2,lgpl-2.1,mpl-2.0", 0.95)
    assert got["das mit dem"] == ("", 0.0)


def test_long_text(spark):
    text = "word " * 40_000 + "Licensed under the Apache License, Version 2.0. " + "cc by " * 2000
    row = ls.license_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.labels) == (44_008, 2000, 40_008, 44_006, "apache-2.0,cc-by")


def test_empty(spark):
    assert ls.license_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def longest(tree):
    """Most spaces that an expression matches."""
    n = 0
    for op, value in tree:
        if op is sre.LITERAL:
            n += value == 32
        elif op is sre.BRANCH:
            n += max(longest(t) for t in value[1])
        elif op is sre.SUBPATTERN:
            n += longest(value[3])
        elif op is sre.MAX_REPEAT:
            assert value[1] != sre.MAXREPEAT or longest(value[2]) == 0
            n += longest(value[2]) * (value[1] if value[1] != sre.MAXREPEAT else 0)
        else:
            assert op is sre.IN
    return n


@pytest.mark.parametrize("rules", [ls.signatures()])
def test_rules(rules):
    assert len({r[0] for r in rules}) > 300
    for _, label, level, base, keyword, needs, pattern in rules:
        assert longest(sre.parse(pattern)) - 2 <= ls.REACH, pattern
        assert re.fullmatch("[a-z0-9]+", keyword) and 0 <= level < len(ls.CONFIDENCE) and "'" not in label + needs + pattern
