"""Language-model scores by a causal self-attention network trained in numpy on subword ids.

Words and codes. A task cuts its rows into blocks of a few megabytes, gives the words of a block codes, and writes each text as
codes beside the block's word list with training counts. Words are then summed over all blocks by one shuffle on the word, tokenized once
each, and sent back to their blocks, where they meet the codes: a text gets its exact base score and its subword ids there, and
text itself never moves. Nothing word-sized reaches the driver: only counts of subword ids do, one for each id of the tokenizer.

Network. The input of a place is the id before it. One attention layer with relative position biases, a residual path from the
input (the log-probabilities of the classes after it, from pair counts over all training texts),
and a softmax over classes of ids, by families of classes; the most frequent ids are classes of their own, the others share classes by
shape and frequency, within which the training counts of the whole corpus decide, so that each id has a probability and they add up to one. Texts
are cut into windows of ``QUERIES`` places that also see the ``CONTEXT`` places before them, so each place is scored once, with at least so
much context. They go through masked attention in batches; ``STRIP`` consecutive ones share the rows of the places they have in common.

Training is data-parallel: in each of ``ROUNDS`` rounds every task runs Adagrad over all windows of its training texts from the
common weights, and the weights are averaged by the number of places, by a tree of sums. Weights and counts learn from every token.

Defined results: null text counts as empty, and scores its end alone; a null doc_id counts as "" for the split; repeated rows each get their
score and count as often; without training texts every count is zero and the network is the untrained one; an empty table gives no rows; further
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_files
from .common import chunks, ragged, saved, text_of

BLOCK_BYTES = 16 << 20
END = "<|endoftext|>"
#: Network: width, places of a window, places seen before it (no more than a window has), ids with a class or an input vector of their own, frequency steps of a shape.
WIDTH, QUERIES, CONTEXT, SINGLE, INPUTS, STEPS = 16, 16, 16, 192, 1024, 8
#: Classes come in families of so many: a softmax over families, then one over the classes of a family.
MEMBERS = 32
#: So many consecutive windows of a text lie in a strip, whose input rows are gathered once; the rest of a text is single windows.
STRIP = 4
#: A row met more often in a batch counts as frequent; only tests of the sums by row ask for it.
TURNS = 24
ROUNDS, RATE, BATCH, SCORE_BATCH, TOP = 2, 0.2, 128, 256, 60.0
TOKEN_PRIOR, PAIR_PRIOR = 0.1, 20.0


# --- words ----------------------------------------------------------------------------


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words, the number of words of each text, and the words by code."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = words.offsets.to_numpy()
    made = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    code, names = made.indices.to_numpy(), made.dictionary.to_pylist()
    keep = np.ones(len(code), dtype=bool)
    if "" in names:  # around white space at the ends of a text
        keep = code != names.index("")
    total = np.concatenate(([0], np.cumsum(keep)))[ends - ends[0]]
    code = code[keep]
    order = np.argsort(-np.bincount(code, minlength=len(names)), kind="stable")  # small codes for frequent words
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    return place[code], np.diff(total), [names[i] for i in order]


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of texts ``(block, doc_id, held_out, codes)`` and of words ``(block, code, word, n)`` in one table."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = docs.select("doc_id", held.alias("held_out"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_id", "held_out", "codes", "code", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, pc.binary_length(batch.column("text")), BLOCK_BYTES):
                block += 1
                code, size, words = coded(part.column("text"))
                raw, ends = code.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
                cut = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                m, blank = part.num_rows, lambda n, t: pa.nulls(n, t)
                same = lambda n: pa.array(np.full(n, block, dtype=np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(m), part.column("doc_id"), part.column("held_out"), pa.array(cut, pa.binary()), *(blank(m, t) for t in (pa.int32(), pa.string(), pa.int64()))], names=names)
                train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), size)
                count = np.bincount(code[train], minlength=len(words))
                k = len(words)
                yield pa.RecordBatch.from_arrays([same(k), *(blank(k, t) for t in (part.column("doc_id").type, pa.bool_(), pa.binary())), pa.array(np.arange(k, dtype=np.int32)), pa.array(words, pa.string()), pa.array(count.astype(np.int64))], names=names)

    return rows.mapInArrow(run, f"block long, doc_id {kind}, held_out boolean, codes binary, code int, word string, n long")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """``(block, code, count, ids, first)``: for each word of a block its training count in the corpus and its subword ids."""
    by = Window.partitionBy("word")
    first = F.min("block").over(by) == F.col("block")  # a block lists a word once; one window, so one sort
    rows = words.select("block", "code", "word", F.sum("n").over(by).alias("count"), first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = token_files.model(path)
        for batch in batches:
            ids, size = model.encode_many(batch.column("word"))
            raw, ends = ids.astype("<u2").tobytes(), (2 * np.cumsum(size)).tolist()
            cut = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("code"), batch.column("count"), pa.array(cut, pa.binary()), batch.column("first")], names=["block", "code", "count", "ids", "first"])

    return rows.mapInArrow(run, "block long, code int, count long, ids binary, first boolean")


def id_counts(table: DataFrame) -> DataFrame:
    """``(id, n)``: how often training texts hold each subword id; at most one row for each id of the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            size = np.array([len(x) // 2 for x in raw], dtype=np.int64)
            np.add.at(total, np.frombuffer(b"".join(raw), dtype="<u2"), np.repeat(batch.column("count").to_numpy(), size))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    return table.filter("first AND count > 0").select("ids", "count").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def resolved(texts: DataFrame, table: DataFrame, train_docs: int, train_words: int, distinct: int) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, base_score, ids)``: texts whose codes met their words."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    scale = np.log10(train_words + train_docs + distinct + (train_docs > 0) + 1)
    end = np.log10(train_docs + 1) - scale

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("code").to_numpy())
        count = right.column("count").to_numpy()[order]
        raw = right.column("ids").take(pa.array(order)).to_pylist()
        size = np.array([len(x) // 2 for x in raw], dtype=np.int64)
        flat, start = np.frombuffer(b"".join(raw), dtype="<u2"), np.cumsum(size) - size
        log, known = np.log10(count + 1) - scale, count > 0
        out = []
        for codes in left.column("codes").to_pylist():
            code = np.frombuffer(codes, dtype="<u4").astype(np.int64)
            out.append((len(code) + 1, int(known[code].sum()) + (train_docs > 0), float(log[code].sum() + end), ragged(flat, start[code], size[code]).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"])

    both = texts.groupBy("block").cogroup(table.groupBy("block"))
    return both.applyInArrow(join, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary")


# --- network --------------------------------------------------------------------------


@dataclass
class Network:
    """For each id its input row, its class and the log of its share of the class; the residual path; the trained weights."""

    unit: np.ndarray
    group: np.ndarray
    share: np.ndarray
    end: int
    family: np.ndarray
    member: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def shape_of(token: str) -> int:
    """Whether a token ends a word, is of letters, and of ASCII."""
    core = token.removesuffix("</w>")
    return 4 * token.endswith("</w>") + 2 * core.isalpha() + core.isascii()


def network(counts: np.ndarray, tokens: list[str], end: int, seed: int = 7) -> Network:
    """An untrained network, which is a unigram model of the counts."""
    prior = counts + TOKEN_PRIOR
    order = np.lexsort((np.arange(len(counts)), -counts))
    group, unit = np.empty(len(counts), dtype=np.int64), np.empty(len(counts), dtype=np.int64)
    shape = np.array([shape_of(t) for t in tokens])
    single, rest = order[:SINGLE], order[SINGLE:]
    group[single] = np.arange(len(single))
    for s in range(8):  # the others by shape, then by steps of equal mass
        own = rest[shape[rest] == s]
        mass = np.cumsum(prior[own])
        step = np.minimum((mass * STEPS / mass[-1]).astype(np.int64), STEPS - 1) if len(own) else own
        group[own] = len(single) + s * STEPS + step
    unit[order[:INPUTS]] = np.arange(min(INPUTS, len(order)))
    unit[order[INPUTS:]] = INPUTS + group[order[INPUTS:]]
    total = np.bincount(group, weights=prior, minlength=SINGLE + 8 * STEPS)  # a multiple of MEMBERS
    share = np.log(prior / total[group])
    rng = np.random.default_rng(seed)
    small = lambda *size: rng.normal(0, 0.3, size).astype(np.float32)
    rows, classes = INPUTS + len(total), len(total)
    weights = {"rows": np.concatenate([small(rows, WIDTH) for _ in range(3)], axis=1)}  # query, key and value side by side
    weights["place"] = np.zeros(QUERIES + CONTEXT, dtype=np.float32)
    families = classes // MEMBERS
    weights["family"] = np.zeros((WIDTH, families), dtype=np.float32)
    weights["member"] = np.zeros((families, WIDTH, MEMBERS), dtype=np.float32)
    chance = np.tile(np.maximum(total, 1e-6) / np.maximum(total, 1e-6).sum(), (rows, 1))
    return Network(unit, group, share, end, *_levels(chance), weights)


def _levels(chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the chances of the families, and of the classes within them, after each input row."""
    parts = chance.reshape(len(chance), -1, MEMBERS)
    family = parts.sum(axis=2)
    return np.log(family).astype(np.float32), np.log(parts / family[:, :, None]).astype(np.float32).reshape(-1, MEMBERS)


def pair_counts(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """How often each class follows each input row in some texts."""
    rows, classes = len(net.family), net.family.shape[1] * MEMBERS
    before = np.concatenate([np.append(net.end, x) for x in ids])
    after = np.concatenate([np.append(x, net.end) for x in ids])
    return np.bincount(net.unit[before] * classes + net.group[after], minlength=rows * classes)


def with_pairs(net: Network, counts: np.ndarray) -> Network:
    """The residual path from the pair counts: the log-probability of each class after each input row."""
    rows = len(net.family)
    seen = counts.reshape(rows, -1).astype(np.float64)
    prior = np.exp(np.repeat(net.family, MEMBERS, axis=1).astype(np.float64) + net.member.reshape(rows, -1))
    chance = (seen + PAIR_PRIOR * prior) / (seen.sum(axis=1, keepdims=True) + PAIR_PRIOR)
    return Network(net.unit, net.group, net.share, net.end, *_levels(chance), net.weights)


BACK = np.arange(QUERIES)[:, None] + CONTEXT - np.arange(QUERIES + CONTEXT)[None, :]  # how far a key lies before its query
SEEN = (BACK >= 0) & (BACK <= CONTEXT + QUERIES - 1)
NEAR = np.where(SEEN, BACK, 0)
SCALE = np.float32(WIDTH**-0.5)


@dataclass
class Lines:
    """Texts one after the other, each after ``CONTEXT`` empty places and filled up to whole windows; -1 where there is no place.

    Input rows and aimed ids by place; where the lines of the texts start, and how many windows they have.
    """

    rows: np.ndarray
    aims: np.ndarray
    first: np.ndarray
    size: np.ndarray


def lines(net: Network, ids: list[np.ndarray]) -> Lines:
    n = np.array([len(x) for x in ids], dtype=np.int64)
    size = n // QUERIES + 1  # the end takes a place
    long = CONTEXT + size * QUERIES
    first = np.cumsum(long) - long
    rows, aims = np.full(long.sum(), -1, dtype=np.int16), np.full(long.sum(), -1, dtype=np.int32)
    every = np.concatenate(ids)
    at = np.arange(len(every)) + np.repeat(first + CONTEXT - (np.cumsum(n) - n), n)
    rows[first + CONTEXT] = net.unit[net.end]
    rows[at + 1] = net.unit[every]
    aims[at] = every
    aims[first + CONTEXT + n] = net.end
    return Lines(rows, aims, first, size)


def _counted(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``size``."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def strips(made: Lines, wide: int = STRIP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the keys, places of the queries, and texts: of strips of ``wide`` windows, then of the windows left over."""
    whole = made.size // wide
    for skip, count, of in ((0 * whole, whole, wide), (whole * wide, made.size - whole * wide, 1)):
        if count.any():
            start = np.repeat(made.first + skip * QUERIES, count) + _counted(count) * of * QUERIES
            at = start[:, None] + np.arange(CONTEXT + of * QUERIES)
            yield at, at[:, CONTEXT:], np.repeat(np.arange(len(count)), count)


def windows(net: Network, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows and a mask of the keys of each window, and the text of each window; -1 pads."""
    made = lines(net, ids)
    at, _, owner = next(strips(made, 1))
    keys = made.rows[at]
    return keys, keys >= 0, owner


def targets(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """The ids to predict in each window's places; -1 pads."""
    made = lines(net, ids)
    return made.aims[next(strips(made, 1))[1]]


def _by_window(places: np.ndarray, first: int = 0, step: int = 1) -> np.ndarray:
    """A view of the places of strips (in one piece of memory) by window, from ``first`` on by ``step``; neighbours share ``CONTEXT`` places."""
    wide = (places.shape[1] - CONTEXT) // QUERIES
    a, b, *rest = places.strides
    shape = (len(places), -(-(wide - first) // step), CONTEXT + QUERIES, *places.shape[2:])
    return np.ndarray(shape, places.dtype, places, first * QUERIES * b, (a, step * QUERIES * b, b, *rest))


def _cut(logit: np.ndarray) -> None:
    """No more than ``TOP``, in place; most batches are below and only read."""
    if logit.size and logit.max() > TOP:
        np.minimum(logit, np.float32(TOP), out=logit)


def _softmax(logit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns ``logit`` into probabilities before their division by the sum of the row; the cells of ``at``, that sum, and the logarithm at those cells."""
    _cut(logit)
    cells = np.arange(0, logit.size, logit.shape[1]) + at
    chosen = logit.reshape(-1).take(cells)
    np.exp(logit, out=logit)
    total = (logit @ np.ones((logit.shape[1], 1), dtype=np.float32))[:, 0]
    return cells, total, chosen - np.log(total)


def forward(net: Network, keys: np.ndarray, valid: np.ndarray, group: np.ndarray) -> dict:
    """Masked attention over a batch of windows, or of strips of windows; the log-probability of the class ``group`` in each place.

    Attention weights stay undivided in ``a``; ``inverse`` has what each query divides by, and ``h`` is divided.
    """
    w, rows, wide = net.weights, np.maximum(keys, 0), (keys.shape[1] - CONTEXT) // QUERIES
    sides = w["rows"].take(rows, axis=0)
    q = sides[:, CONTEXT:, :WIDTH].reshape(len(keys), wide, QUERIES, WIDTH)
    seen = _by_window(sides)
    k, v = seen[..., WIDTH : 2 * WIDTH], seen[..., 2 * WIDTH :]
    score = q @ k.swapaxes(2, 3)
    score *= SCALE
    score += np.where(SEEN, w["place"].take(NEAR), np.float32(-1e9))
    cut = np.flatnonzero(~valid.all(axis=1))
    if len(cut):
        score[cut] += np.where(_by_window(valid[cut]), np.float32(0), np.float32(-1e9))[:, :, None, :]
    _cut(score)
    np.exp(score, out=score)
    inverse = 1 / (score.reshape(-1, score.shape[3]) @ np.ones((score.shape[3], 1), dtype=np.float32) + np.float32(1e-30))
    h = (score @ v).reshape(-1, WIDTH)
    h *= inverse
    before, group = rows[:, CONTEXT:].reshape(-1), group.astype(np.uint16)
    family = group // MEMBERS
    member = group - family * np.uint16(MEMBERS)
    top = h @ w["family"]
    top += net.family.take(before, axis=0)
    top_cells, top_total, log = _softmax(top, family)
    by = family.argsort(kind="stable")  # the places of a family together
    edge = [0, *accumulate(np.bincount(family, minlength=len(w["member"])).tolist())]
    moved = h.take(by, axis=0)
    inner = np.empty((len(h), MEMBERS), dtype=np.float32)
    for f, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if b > a:
            np.matmul(moved[a:b], w["member"][f], out=inner[a:b])
    inner += net.member.take((before.astype(np.int64) * len(w["member"]) + family).take(by), axis=0)
    cells, inner_total, log_inner = _softmax(inner, member.take(by))
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    log += log_inner.take(back)
    return {
        "rows": rows, "q": q, "k": k, "v": v, "a": score, "inverse": inverse, "h": h, "top": top, "top_cells": top_cells, "top_total": top_total,
        "by": by, "back": back, "edge": edge, "moved": moved, "inner": inner, "cells": cells, "inner_total": inner_total, "log": log,
    }


def log_scores(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text, its end included."""
    made, total = lines(net, ids), np.zeros(len(ids))
    for at, asked, owner in strips(made):
        size = SCORE_BATCH * QUERIES // asked.shape[1]
        for i in range(0, len(at), size):
            keys, t = made.rows[at[i : i + size]], made.aims[asked[i : i + size]].reshape(-1)
            aim = np.maximum(t, 0)
            p = forward(net, keys, keys >= 0, net.group.take(aim))["log"] + net.share.take(aim)
            p = np.where(t >= 0, p, 0.0).reshape(len(keys), -1).sum(axis=1)
            total += np.bincount(owner[i : i + size], weights=p, minlength=len(ids))
    return total / np.log(10)


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers and the sums of ``values`` by them; two columns are added at once, as a complex number."""
    rows, pairs = rows.reshape(-1), values.reshape(-1, values.shape[-1]).view(np.complex64)
    many, k = int(rows.max()) + 1, pairs.shape[1]
    sums = np.zeros(many * k, dtype=np.complex64)
    np.add.at(sums, np.arange(many * k).reshape(many, k).take(rows, axis=0).reshape(-1), pairs.reshape(-1))
    at = np.flatnonzero(np.bincount(rows))
    return at, sums.reshape(many, k).take(at, axis=0).view(np.float32)


def gradient(net: Network, keys: np.ndarray, valid: np.ndarray, group: np.ndarray) -> tuple[dict[str, np.ndarray], float, int]:
    """Gradient of the summed loss in the windows' places, that loss and their number; ``group`` is -1 where there is no place."""
    (at, sums), grads, loss, n = _gradient(net, keys, valid, group)
    rows = np.zeros_like(net.weights["rows"])
    rows[at] = sums
    return {"rows": rows, **grads}, loss, n


def _gradient(net: Network, keys: np.ndarray, valid: np.ndarray, group: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, np.ndarray], float, int]:
    """``gradient`` with the input rows that the windows hold apart: their numbers and gradients; it is zero for the others."""
    known = (group.reshape(-1) >= 0).astype(np.float32)
    f, w = forward(net, keys, valid, np.maximum(group.reshape(-1), 0)), net.weights
    by, top, inner, moved, h = f["by"], f["top"], f["inner"], f["moved"], f["h"]
    known_by = known.take(by)
    top *= (known / f["top_total"])[:, None]
    top.reshape(-1)[f["top_cells"]] -= known
    inner *= (known_by / f["inner_total"])[:, None]
    inner.reshape(-1)[f["cells"]] -= known_by
    dmoved, dmember = np.empty_like(h), np.zeros_like(w["member"])
    for k, (a, b) in enumerate(zip(f["edge"][:-1], f["edge"][1:], strict=True)):
        if b > a:
            np.matmul(inner[a:b], w["member"][k].T, out=dmoved[a:b])
            dmember[k] = (inner[a:b].T @ moved[a:b]).T
    dh = dmoved.take(f["back"], axis=0)
    dh += top @ w["family"].T
    dh *= f["inverse"]
    mean = (dh * h) @ np.ones((WIDTH, 1), dtype=np.float32)  # what the attention weights give back on average
    (m, n), wide = keys.shape, f["q"].shape[1]
    dh = dh.reshape(m, wide, QUERIES, WIDTH)
    ds = dh @ f["v"].swapaxes(2, 3)
    ds -= mean.reshape(m, wide, QUERIES, 1)
    ds *= f["a"]
    place = np.bincount(NEAR.reshape(-1), weights=ds.reshape(m * wide, -1).sum(axis=0), minlength=QUERIES + CONTEXT)
    ds *= SCALE
    sides = np.zeros((m, n, 3 * WIDTH), dtype=np.float32)
    np.matmul(ds, f["k"], out=sides[:, CONTEXT:, :WIDTH].reshape(m, wide, QUERIES, WIDTH))
    other = np.zeros((m, n, 2 * WIDTH), dtype=np.float32)
    for i, own in enumerate((_by_window(sides, 0, 2)[..., WIDTH:], _by_window(other, 1, 2))[:wide]):  # every second window, as neighbours share places
        np.matmul(ds[:, i::2].swapaxes(2, 3), f["q"][:, i::2], out=own[..., :WIDTH])
        np.matmul(f["a"][:, i::2].swapaxes(2, 3), dh[:, i::2], out=own[..., WIDTH:])
    if wide > 1:
        sides[:, :, WIDTH:] += other
    return _scatter(f["rows"], sides), {"place": place.astype(np.float32), "family": h.T @ top, "member": dmember}, float(-(f["log"] * known).sum()), int(known.sum())


def train_on(net: Network, texts: Iterator[list[np.ndarray]], turn: int, square: dict[str, np.ndarray] | None = None) -> int:
    """Adagrad over all windows of texts, in an order that ``turn`` seeds; returns the number of places."""
    square = square if square is not None else {k: np.full_like(v, 1e-2) for k, v in net.weights.items()}
    rng = np.random.default_rng(turn)
    count = 0
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by windows of a strip: input rows and classes that wait for a batch

    def step(keys: np.ndarray, group: np.ndarray) -> None:
        nonlocal count
        (at, sums), grads, _, n = _gradient(net, keys, keys >= 0, group)
        count += n
        for name, g in grads.items():
            square[name] += g * g
            net.weights[name] -= np.float32(RATE) * g / np.sqrt(square[name])
        seen = square["rows"].take(at, axis=0)
        seen += sums * sums
        square["rows"][at] = seen
        sums *= np.float32(RATE)
        sums /= np.sqrt(seen, out=seen)
        net.weights["rows"][at] -= sums

    for ids in texts:
        made = lines(net, ids)
        groups = np.where(made.aims >= 0, net.group[np.maximum(made.aims, 0)], -1).astype(np.int16)
        for at, asked, _ in strips(made):
            order, wide = rng.permutation(len(at)), asked.shape[1] // QUERIES
            rows = made.rows[at[order]], groups[asked[order]]
            if wide in held:
                rows = tuple(np.concatenate(x) for x in zip(held[wide], rows, strict=True))
            size = BATCH // wide
            whole = len(rows[0]) // size * size
            for i in range(0, whole, size):
                step(*(x[i : i + size] for x in rows))
            held[wide] = tuple(x[whole:] for x in rows)
    for rows in held.values():
        if len(rows[0]):
            step(*rows)
    return count


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in chunks(batch, pc.binary_length(batch.column("ids")), 1 << 19):
            yield part, [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in part.column("ids").to_pylist()]


def _summed(rows: DataFrame) -> tuple[np.ndarray, int] | None:
    """Vectors and counts of the tasks, ``(part, n, sums)``, added up by a tree; one row reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for k, raw in zip(batch.column("n").to_pylist(), batch.column("sums"), strict=True):
                values = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                total, n = values if total is None else total + values, n + k
        if total is not None:
            yield _sums(0, n, total)

    tree = rows.repartition(8, "part").mapInArrow(add, SUMS).coalesce(1).mapInArrow(add, SUMS).collect()
    return (np.frombuffer(tree[0]["sums"], dtype=np.float64), tree[0]["n"]) if tree else None


SUMS = "part long, n long, sums binary"


def _sums(part: int, n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([values.astype(np.float64).tobytes()], pa.binary())], names=["part", "n", "sums"])


def trained(texts: DataFrame, net: Network, rounds: int = ROUNDS) -> Network:
    """``net`` with the pair counts of all training texts, after data-parallel training on them."""
    spark = texts.sparkSession
    rows = texts.filter("NOT held_out").select("ids")
    first = spark.sparkContext.broadcast(net)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for _, ids in _ids_of(batches):
            now = pair_counts(first.value, ids)
            total, n = now if total is None else total + now, n + len(ids)
        if n:
            yield _sums(TaskContext.get().partitionId(), n, total)

    found = _summed(rows.mapInArrow(pairs, SUMS))
    if found is None:
        return net
    net = with_pairs(net, found[0])
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = shared.value
            own = Network(own.unit, own.group, own.share, own.end, own.family, own.member, {k: v.copy() for k, v in own.weights.items()})
            part = TaskContext.get().partitionId()
            n = train_on(own, (ids for _, ids in _ids_of(batches)), turn)
            if n:
                yield _sums(part, n, n * np.concatenate([v.reshape(-1) for v in own.weights.values()]).astype(np.float64))

        made = _summed(rows.mapInArrow(run, SUMS))
        if made is None:
            return net
        mean, at, weights = made[0] / made[1], 0, {}
        for name, v in net.weights.items():
            weights[name] = mean[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        net = Network(net.unit, net.group, net.share, net.end, net.family, net.member, weights)
    return net


# --- documents ------------------------------------------------------------------------


def lm_scores(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every document."""
    spark = docs.sparkSession
    both = saved(blocks(docs))
    texts, words = both.filter("code IS NULL").select("block", "doc_id", "held_out", "codes"), both.filter("code IS NOT NULL").select("block", "code", "word", "n")
    table = saved(word_table(words, path))
    known = table.filter("first AND count > 0").agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("words")).first()
    train_docs = texts.filter("NOT held_out").count()
    rows = saved(resolved(texts, table.drop("first"), train_docs, known["words"], known["distinct"]))
    tokenizer = token_files.model(path).tokenizer
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    end = tokenizer.token_to_id(END)
    counts = np.zeros(len(names))
    for r in id_counts(table).collect():  # at most one row for each id
        counts[r["id"]] = r["n"]
    counts[end] += train_docs
    shared = spark.sparkContext.broadcast(trained(rows, network(counts, names, end)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = int(known["words"]) + train_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _ids_of(batches):
            cols = [part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            more = [pa.array(np.full(len(ids), total, dtype=np.int64)), part.column("base_score"), pa.array(log_scores(shared.value, ids))]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
