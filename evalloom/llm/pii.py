"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns give the base spans. The field looks at islands, runs of words that each hold a digit or an at sign; outside of them it has no
candidates, so leaving them out does not change its best labelling. A candidate is a span of at most ``MAX_TOKENS`` tokens; its features
describe the whole span (digits, groups, separators, checksums, both neighbours), which a label for each token could
not express. A labelling is a set of non-overlapping typed spans, its score the sum of theirs; dynamic programming over
token boundaries chooses boundaries and types together, and gives the likelihood's gradient in training.

The weights are fitted on the driver by Adagrad on at most ``TRAIN_ISLANDS`` islands, those with the least hash, labelled by the base
patterns: a bounded sample of labelled rows. A span of the field joins the base spans where it overlaps none of them and its score is above ``MARGIN``.

Defined results: null text counts as empty; repeated rows each get their spans; an empty table trains nothing; a text of any length is scanned whole;
``find_spans`` carries the other columns and replaces one called ``spans``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_chunks, text_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, TRAIN_ISLANDS, EPOCHS, RATE, MARGIN = 20, 600, 10, 0.5, 1.0
SIGNAL = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


# --- base patterns --------------------------------------------------------------------


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out: list[Span] = []
    if not SIGNAL.search(text):
        return out
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


# --- the field ------------------------------------------------------------------------


def islands(text: str) -> list[tuple[int, int]]:
    """Runs of words that hold a digit or an at sign, with one space between neighbours."""
    out: list[tuple[int, int]] = []
    if not SIGNAL.search(text):
        return out
    for m in re.finditer(r"\S+", text):
        if SIGNAL.search(m[0]):
            if out and text[out[-1][1] : m.start()] == " ":
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
    return out


def _kind_of(char: str) -> str:
    if char.isalpha():
        return "letter"
    if char.isdigit():
        return "digit"
    return "none" if not char else "space" if char.isspace() else char if char in "+(.-@" else "other"


def _step(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


CHARS = ("none", "letter", "digit", "space", "+", "(", ".", "-", "@", "other")
NAMES = (
    ["bias", "luhn", "octets", "word_end"]
    + [f"{n}{k}" for n, size in (("digits", 9), ("groups", 6), ("letters", 4), ("dots", 5), ("at", 3), ("dashes", 4), ("spaces", 4), ("brackets", 3), ("odd", 3)) for k in range(size)]
    + [f"{side}:{c}" for side in ("left", "right", "first") for c in CHARS]
)
PLACE = {n: i for i, n in enumerate(NAMES)}


def features(span: str, left: str, right: str) -> list[int]:
    """Places of the features that hold for a span between two characters."""
    groups = DIGITS.findall(span)
    digits = sum(map(len, groups))
    letters = sum(c.isalpha() for c in span)
    count = {c: span.count(c) for c in ".@- ()"}
    odd = len(span) - digits - letters - sum(count.values()) - span.count("+")
    on = [
        "bias", f"digits{_step(digits, 1, 3, 7, 10, 12, 13, 16, 20)}", f"groups{_step(len(groups), 1, 2, 3, 4, 5)}", f"letters{_step(letters, 1, 4, 10)}",
        f"dots{_step(count['.'], 1, 2, 3, 4)}", f"at{_step(count['@'], 1, 2)}", f"dashes{_step(count['-'], 1, 2, 3)}", f"spaces{_step(count[' '], 1, 2, 3)}",
        f"brackets{_step(count['('] + count[')'], 1, 2)}", f"odd{_step(odd, 1, 3)}", f"left:{_kind_of(left)}", f"right:{_kind_of(right)}", f"first:{_kind_of(span[0])}",
    ]
    if 16 <= digits <= 19 and not letters and luhn("".join(groups)):
        on.append("luhn")
    if len(groups) == 4 and span == ".".join(groups) and all(map(_octet, groups)):
        on.append("octets")
    if count["@"] == 1 and span[-1].isalpha() and "." in span[span.index("@") :]:
        on.append("word_end")
    return [PLACE[n] for n in on]


class Island:
    """Token boundaries and candidate spans of a stretch of text."""

    def __init__(self, text: str, start: int, end: int):
        tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        self.size = len(tokens)
        self.spans: list[tuple[int, int]] = []  # in tokens, end exclusive
        self.chars: list[tuple[int, int]] = []
        rows = []
        opens = [text[a].isalnum() or text[a] in "+(" for a, _ in tokens]
        closes = [text[b - 1].isalnum() for _, b in tokens]
        for i, (a, _) in enumerate(tokens):
            if not opens[i]:
                continue
            signal = False
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                b = tokens[j][1]
                signal = signal or text[tokens[j][0]] in "0123456789@"
                if signal and closes[j]:
                    self.spans.append((i, j + 1))
                    self.chars.append((a, b))
                    rows.append(features(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]))
        self.on = np.zeros((len(rows), len(NAMES)), dtype=np.float32)
        for r, on in enumerate(rows):
            self.on[r, on] = 1
        self.ending: list[list[int]] = [[] for _ in range(self.size + 1)]
        for k, (_, j) in enumerate(self.spans):
            self.ending[j].append(k)

    def best(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best labelling: (candidate, kind) pairs; a token outside scores nothing."""
        value, back = np.zeros(self.size + 1), [None] * (self.size + 1)
        kind = scores.argmax(axis=1) if len(scores) else scores
        for j in range(1, self.size + 1):
            value[j] = value[j - 1]
            for k in self.ending[j]:
                now = value[self.spans[k][0]] + scores[k, kind[k]]
                if now > value[j]:
                    value[j], back[j] = now, k
        out, j = [], self.size
        while j:
            if back[j] is None:
                j -= 1
            else:
                out.append((back[j], int(kind[back[j]])))
                j = self.spans[back[j]][0]
        return out[::-1]

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """The probability of each candidate and kind, from sums over all labellings in both directions."""
        total = np.logaddexp.reduce(scores, axis=1)
        ahead, back = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for j in range(1, self.size + 1):
            terms = [ahead[j - 1], *(ahead[self.spans[k][0]] + total[k] for k in self.ending[j])]
            ahead[j] = np.logaddexp.reduce(terms)
        starting: list[list[int]] = [[] for _ in range(self.size + 1)]
        for k, (i, _) in enumerate(self.spans):
            starting[i].append(k)
        for i in range(self.size - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[self.spans[k][1]] + total[k] for k in starting[i])])
        outside = np.array([ahead[i] + back[j] for i, j in self.spans]) - ahead[-1]
        return np.exp(scores + outside[:, None])


def fit(samples: list[tuple[str, str, str]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (feature x kind) from islands with the characters around them, labelled by the base patterns."""
    weights, square = np.zeros((len(NAMES), len(KINDS)), dtype=np.float32), np.full((len(NAMES), len(KINDS)), 1e-6, dtype=np.float32)
    made = []
    for left, text, right in samples:
        whole = left + text + right
        island = Island(whole, len(left), len(left) + len(text))
        truth = np.zeros((len(island.spans), len(KINDS)), dtype=np.float32)
        place = {c: k for k, c in enumerate(island.chars)}
        taken: list[tuple[int, int]] = []
        for kind, a, b in base_spans(whole):
            if (a, b) in place and all(b <= x or y <= a for x, y in taken):
                truth[place[a, b], KINDS.index(kind)] = 1
                taken.append((a, b))
        if len(island.spans):
            made.append((island, truth))
    for _ in range(epochs):
        for island, truth in made:
            step = island.on.T @ (truth - island.expected(island.on @ weights)) - 1e-3 * weights
            square += step * step
            weights += RATE * step / np.sqrt(square)
    return weights


def field_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> list[Span]:
    out = []
    for a, b in islands(text):
        island = Island(text, a, b)
        if island.spans:
            scores = island.on @ weights - margin
            out += [(KINDS[kind], *island.chars[k]) for k, kind in island.best(scores)]
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's own, both by kind as listed, then start."""
    base = base_spans(text)
    if not SIGNAL.search(text):
        return base, base
    starts, ends = sorted(a for _, a, _ in base), sorted(b for *_, b in base)
    # a span overlaps none when as many base spans start before its end as end before its start
    more = [s for s in field_spans(text, weights) if bisect_left(starts, s[2]) == bisect_right(ends, s[1])]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# --- documents ------------------------------------------------------------------------


def train(docs: DataFrame, most: int = TRAIN_ISLANDS) -> np.ndarray:
    """Weights from the ``most`` islands with the least hash; at most 200 characters of an island are used."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(text[max(a - 8, 0) : a], text[a : min(b, a + 200)], text[min(b, a + 200) : b + 8]) for text in batch.column("text").to_pylist() for a, b in islands(text)]
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["left", "island", "right"])

    found = map_chunks(docs.select(text_of().alias("text")), run, "left string, island string, right string").distinct()
    cols = ["left", "island", "right"]
    sample = found.withColumn("h", F.xxhash64(*cols)).orderBy("h", *cols).limit(most).select(*cols).collect()
    return fit([tuple(r) for r in sample])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_spans(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add ``spans``: kind, start and end in code points, and whether a base pattern found it."""
    docs = docs.drop("spans")
    schema, names = T.StructType([*docs.schema.fields, T.StructField("spans", SPANS)]), docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in chunks(batch, pc.binary_length(batch.column(text_col))):
                out = []
                for text in part.column(text_col).to_pylist():
                    base, spans = all_spans(text or "", weights)
                    own = set(base)
                    out.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in own} for s in spans])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=[*names, "spans"])

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with each personal span of ``text`` replaced by its kind in brackets; overlapping spans go as one."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None or not SIGNAL.search(text):
                return text
            out, at, end = [], 0, 0
            for kind, a, b in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
                if a >= end:
                    out += [text[at:a], f"[{kind.upper()}]"]
                end = max(end, b)
                at = end
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda k: k == kind


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, for every document."""
    rows = find_spans(docs.select("doc_id", text_of().alias("text")), train(docs))
    rows = rows.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
