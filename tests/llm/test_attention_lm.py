"""Base scores against plain counting; the network's gradient, causality, normalization and gain over unigrams."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from evalloom.llm import attention_lm as lm

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain(docs):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs}
    count = Counter(w for d, t in docs if not held[d] for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    return [(d, held[d], len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, sum(log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for d, t in docs]


def fixture():
    rng = np.random.default_rng(2)
    docs = [(None, "no id"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "É é \x1c \x85 ß　x"), (5, "ABC abc Abc"), (5, "ABC abc Abc"), (6, "w1 " * 100_000)]
    for i in range(10, 80):
        docs.append((i, " ".join(f"word{x}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 50) + rng.choice(["", " ", "\n"])))
    return docs


def test_words():
    texts = [t or "" for _, t in fixture()]
    code, size, names = lm.coded(pa.array(texts))
    made = iter(code)
    assert [[names[next(made)] for _ in range(n)] for n in size] == [words(t) for t in texts]


def test_documents(spark):
    docs = fixture()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, code int, word string").repartition(3)
    rows = lm.lm_scores(frame, PATH).collect()
    want = sorted(plain(docs), key=str)
    got = sorted((tuple(r) for r in rows), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in got)
    assert lm.lm_scores(frame.limit(0), PATH).count() == 0
    one = next(r for r in want if r[1] and r[2] > 1)  # no training text
    held = frame.filter(f"doc_id = {one[0]}")
    assert [tuple(r)[1:6] for r in lm.lm_scores(held, PATH).collect()] == [(True, one[2], 0, 0, 0.0)]


def small(seed=1):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 40).astype(float)
    net = lm.network(counts, [chr(97 + i % 26) + ("</w>" if i % 3 else "") for i in range(40)], end=39)
    for name in ("family", "member"):
        net.weights[name] = rng.normal(0, 0.3, net.weights[name].shape).astype(np.float32)
    return net, rng



def test_each_place_once_and_causal():
    """A text's score is the sum over its places of conditional probabilities that add up to one, whatever follows."""
    net, rng = small()
    classes = net.family.shape[1] * lm.MEMBERS
    for n in (0, 1, lm.QUERIES - 1, lm.QUERIES, 3 * lm.QUERIES + 2):
        ids = rng.integers(0, 39, n)
        keys, valid, _ = lm.windows(net, [ids])
        aim = lm.targets(net, [ids]).reshape(-1)
        assert (aim[: n + 1] == np.append(ids, net.end)).all() and (aim[n + 1 :] == -1).all()
        log = lambda keys, c: lm.forward(net, keys, valid, np.full(keys.shape[0] * lm.QUERIES, c))["log"]  # noqa: E731, B023
        p = np.exp([log(keys, c) for c in range(classes)]).T
        every = p[:, net.group] * np.exp(net.share)  # over all ids
        assert np.allclose(every.sum(axis=1), 1, atol=1e-4)
        want = sum(np.log10(every[i, a]) for i, a in enumerate(aim[: n + 1]))
        assert abs(lm.log_scores(net, [ids, ids])[1] - want) < 1e-3
        if n > 2:  # a later id changes no earlier place
            other = ids.copy()
            other[-1] = (other[-1] + 1) % 39
            assert np.allclose(log(lm.windows(net, [other])[0], 1)[:n], log(keys, 1)[:n], atol=1e-6)


def test_gradient():
    net, rng = small()
    ids = [rng.integers(0, 39, 20), rng.integers(0, 39, 3)]
    keys, valid, _ = lm.windows(net, ids)
    aim = lm.targets(net, ids)
    group = np.where(aim >= 0, net.group[np.maximum(aim, 0)], -1)
    grads, loss, n = lm.gradient(net, keys, valid, group)
    assert n == 25
    for name, g in grads.items():
        for at in np.argsort(-np.abs(g), axis=None)[:5]:
            w = net.weights[name].reshape(-1)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = lm.gradient(net, keys, valid, group)[1]
            w[at] = old - step
            down = lm.gradient(net, keys, valid, group)[1]
            w[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g.reshape(-1)[at], rel=0.05, abs=2e-2), name


def test_learns():
    """A pattern three places back, which pairs cannot see."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(400):
        x = rng.integers(0, 8, 3).tolist()
        while len(x) < 48:
            x.append((x[-3] + 1) % 8 if rng.random() < 0.95 else int(rng.integers(8)))
        texts.append(np.array(x))
    counts = np.bincount(np.concatenate(texts), minlength=10).astype(float)
    net = lm.network(counts, list("abcdefghij"), end=9)
    pairs = lm.with_pairs(net, lm.pair_counts(net, texts[:300]))
    before = lm.log_scores(pairs, texts[300:]).mean()
    for turn in range(60):
        lm.train_on(pairs, iter([texts[:300]]), turn)
    assert lm.log_scores(pairs, texts[300:]).mean() > 0.75 * before


def test_trains_on_every_window():
    """Texts below and above a batch give all their places in each round, however they are dealt into lists."""
    net, rng = small()
    texts = [rng.integers(0, 39, n) for n in [*range(40), 5 * lm.BATCH * lm.QUERIES, 1]]
    places = sum(len(x) + 1 for x in texts)
    for turn in range(lm.ROUNDS):
        assert lm.train_on(net, iter([[x] for x in texts]), turn) == places
        assert lm.train_on(net, iter([texts]), turn) == places
        assert lm.train_on(net, iter([texts[3:4]]), turn) == 4


def test_gradients_of_the_rows_held():
    """A batch gives gradients of its own input rows alone, each the sum of all its places, however often a row is met."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([np.full(7 * lm.TURNS, 3), np.full(lm.TURNS, 9), np.full(lm.TURNS + 1, 1279), np.arange(40, 70), rng.integers(0, 1280, 500)])
    rng.shuffle(rows)
    values = rng.normal(size=(len(rows), 48)).astype(np.float32)
    want = np.zeros((1280, 48))
    np.add.at(want, rows, values)
    at, sums = lm._scatter(rows, values)
    assert sorted(at.tolist()) == sorted(set(rows.tolist()))
    assert np.allclose(sums, want[at], atol=1e-4)
    net, rng = small()
    ids = [rng.integers(0, 5, 30)]
    keys, valid, _ = lm.windows(net, ids)
    aim = lm.targets(net, ids)
    group = np.where(aim >= 0, net.group[np.maximum(aim, 0)], -1)
    (at, sums), *_ = lm._gradient(net, keys, valid, group)
    assert set(at.tolist()) == set(np.maximum(keys, 0).reshape(-1).tolist())
    dense = lm.gradient(net, keys, valid, group)[0]["rows"]
    assert (dense[at] == sums).all() and not np.delete(dense, at, axis=0).any()


def test_strips_are_their_windows():
    """Consecutive windows side by side give the same logarithms, loss and gradients as one by one, ends and short texts included."""
    net, rng = small()
    net.weights["place"] = rng.normal(0, 0.3, len(net.weights["place"])).astype(np.float32)
    ids = [rng.integers(0, 39, n) for n in (0, 1, 15, 16, 63, 64, 65, 300)]
    made = lm.lines(net, ids)
    group = lambda asked: np.where(made.aims[asked] >= 0, net.group[np.maximum(made.aims[asked], 0)], -1)
    for wide in (1, 2, 3, 4):
        places, grads, loss, n = [], {}, 0.0, 0
        for at, asked, owner in lm.strips(made, wide):
            assert len(at) == len(asked) == len(owner)
            places += asked.reshape(-1).tolist()
            keys = made.rows[at]
            g, own, m = lm.gradient(net, keys, keys >= 0, group(asked))
            grads = {k: grads.get(k, 0) + v for k, v in g.items()}
            loss, n = loss + own, n + m
        assert sorted(places) == sorted(set(places))  # each place once
        assert n == sum(len(x) + 1 for x in ids)
        if wide == 1:
            want, want_loss = grads, loss
        assert loss == pytest.approx(want_loss, rel=1e-5)
        for name, g in grads.items():
            assert np.allclose(g, want[name], atol=1e-3), (wide, name)


def test_rows_gathered_once_in_a_strip(monkeypatch):
    """Training on a long text takes few more input rows than places; windows one by one take two for each."""
    net, rng = small()
    text, taken, sums = rng.integers(0, 39, 100 * lm.QUERIES), [], lm._scatter
    monkeypatch.setattr(lm, "_scatter", lambda rows, values: (taken.append(rows.size), sums(rows, values))[1])
    places = lm.train_on(net, iter([[text]]), 0)
    assert places == len(text) + 1
    assert sum(taken) < 1.3 * places


def test_score_against_plain_loops():
    """The score of a text by loops over its places and keys, from the weights alone."""
    net, rng = small()
    net.weights["place"] = rng.normal(0, 0.3, len(net.weights["place"])).astype(np.float32)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    ids = rng.integers(0, 39, 6 * lm.QUERIES + 5)
    inputs, aims = net.unit[np.append(net.end, ids)], np.append(ids, net.end)
    total = 0.0
    for i, aim in enumerate(aims):
        first = max(i // lm.QUERIES * lm.QUERIES - lm.CONTEXT, 0)
        query, weight, mixed = w["rows"][inputs[i], : lm.WIDTH], 0.0, 0.0
        for j in range(first, i + 1):
            a = np.exp(query @ w["rows"][inputs[j], lm.WIDTH : 2 * lm.WIDTH] / lm.WIDTH**0.5 + w["place"][i - j])
            weight, mixed = weight + a, mixed + a * w["rows"][inputs[j], 2 * lm.WIDTH :]
        h, (family, member) = mixed / weight, divmod(int(net.group[aim]), lm.MEMBERS)
        for logit, at in ((h @ w["family"] + net.family[inputs[i]], family), (h @ w["member"][family] + net.member[inputs[i] * len(w["member"]) + family], member)):
            total += logit[at] - np.log(np.exp(logit).sum())
        total += net.share[aim]
    assert lm.log_scores(net, [ids])[0] == pytest.approx(total / np.log(10), rel=1e-5)


def test_word_table_by_one_sort(spark):
    """Counts over all blocks and one first row for each word, by a single window."""
    rows = [(b, c, f"w{c % 7}x{b % 2}", 10 * b + c) for b in (5, 2, 9) for c in range(7)]
    table = lm.word_table(spark.createDataFrame(rows, "block long, code int, word string, n long").repartition(3), PATH)
    word = {(b, c): w for b, c, w, _ in rows}
    got = [(word[r["block"], r["code"]], r["block"], r["count"], r["first"]) for r in table.collect()]
    want = [(w, b, sum(n for *_, v, n in rows if v == w), b == min(x for x, _, v, _ in rows if v == w)) for b, _, w, _ in rows]
    assert sorted(got) == sorted(want)
    assert len(re.findall(r"^\W*Window ", table._jdf.queryExecution().sparkPlan().toString(), re.M)) == 1
