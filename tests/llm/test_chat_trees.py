"""Packed conversations read back exactly; shared turns, positions and attention intervals against a plain tree."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from evalloom.llm import byte_bpe, chat_trees

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def fixture():
    rng = np.random.default_rng(1)
    texts = ["", None, "hello", "\\", "<turn:assistant>", "</turn>", r"\### Assistant: </turn> ok", "é 🙂\n", "a\\(b\\)", "x" * 300]
    rows = []
    for conv in range(200):
        first = 0 if conv % 3 == 0 else int(rng.integers(4))
        for turn in range(int(rng.integers(1, 7))):
            role = ["user", "assistant", None, "<odd>\\"][turn % 2 if rng.random() < 0.9 else int(rng.integers(4))]
            text = texts[first] if turn == 0 else texts[int(rng.integers(len(texts)))]
            rows.append((conv, turn, role, text))
    rows += [(500, t, "user", "same") for t in (2, 0, 1)] + [(501, 0, "user", "twice")] * 2 + [(None, None, "assistant", "no id")]
    rows += [(600 + i, 0, "assistant", "long " * 40_000) for i in range(2)]
    return [(*r, 1, "extra") for r in rows]


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        text, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        wide = sum(len(s) + sum(s.count(c) for c in "\\<>") for t in turns for s in t) + len(turns) * len("<turn:></turn>")
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), wide)
    return out


def test_round_trip(spark):
    rows = fixture()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pack int, path string").repartition(3)
    got = chat_trees.read_back(chat_trees.packs(frame, PATH, PATTERN), PATH, PATTERN).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert chat_trees.packs(frame.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize(("chars", "convs"), [(1 << 16, 4096), (600, 4096), (10**9, 7)])
def test_trees(monkeypatch, chars, convs):
    """Within a pack each shared prefix is emitted once, in depth-first order, and a token sees its own branch alone."""
    monkeypatch.setattr(chat_trees, "PACK_CHARS", chars)
    monkeypatch.setattr(chat_trees, "PACK_CONVERSATIONS", convs)
    rng = np.random.default_rng(7)
    all_ = sorted([("user" if k % 2 == 0 else "assistant", f"t{rng.integers(3)}") for k in range(rng.integers(1, 6))] for _ in range(120))
    packer = chat_trees.Packer(byte_bpe.model(PATH, PATTERN))
    made = [p for i, turns in enumerate(all_) if (p := packer.add(i, turns))] + [packer.close()]
    assert (len(made) == 1) == (chars == 1 << 16)
    seen = []
    for pack in made:
        nodes, prefixes = pack["nodes"], set()
        for conv in pack["convs"]:
            seen.append(conv["conv_id"])
            prefixes |= {tuple(all_[conv["conv_id"]][: k + 1]) for k in range(len(all_[conv["conv_id"]]))}
        assert len(nodes) == len(prefixes)
        for i, node in enumerate(nodes):
            branch, at = [], node["parent"]
            while at >= 0:
                branch.append(at)
                at = nodes[at]["parent"]
            assert node["parent"] < i and node["start"] == (nodes[i - 1]["end"] if i else 0)
            ancestors = {t for b in branch for t in range(nodes[b]["start"], nodes[b]["end"])}
            assert {t for x in node["attends"] for t in range(x["start"], x["end"])} == ancestors
            assert pack["positions"][node["start"]] == len(ancestors)
    assert seen == list(range(120))
