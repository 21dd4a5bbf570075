"""SimHash near-duplicates against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from evalloom.llm import simhash


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, budget=3):
    """rows: (doc_id, fingerprint); the least id that each row reaches."""
    known = sorted({f for _, f in rows})
    parent = {f: f for f in known}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                parent[root(b)] = root(a)
    least = {}
    for d, f in rows:
        least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f"{f:016x}", least[root(f)]) for d, f in rows}


def check(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    want = components([(d, plain_fingerprint(t)) for d, t in docs])
    assert len(got) == len(docs)
    assert set(got) == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(40):
        base = rng.choice(vocabulary, 150).tolist()
        for k in range(4):
            text = list(base)
            for _ in range(k):
                text[rng.integers(150)] = "Changed"
            docs.append((len(docs) * 3 % 1000, " ".join(text)))
    check(spark, docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É è\x0bé"), (9, "a b " * 30_000), (8, "a b " * 30_000)]
    check(spark, docs)
    empty = spark.createDataFrame([], "doc_id long, text string, fingerprint int, bits int")
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_trie_against_all_pairs(spark, monkeypatch, rows):
    """Also with large groups dealt again and the node pairs walked in small parts."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = {0, 2**64 - 1, 7, 15, 1 << 63}
    for _ in range(1500):
        v = int(rng.choice(centre))
        for _ in range(rng.integers(0, 6)):
            v ^= 1 << int(rng.integers(64))
        values.add(v)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = simhash.trie_links(spark.createDataFrame(signed, "bits long")).collect()
    assert all(((a ^ b) % 2**64).bit_count() >= 1 for a, b in links)
    parent = {v: v for (v,) in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[root(a)] = root(b)
    want = components([(v, v % 2**64) for (v,) in signed])
    roots = {}
    for v, _, least in want:
        roots.setdefault(least, set()).add(root(v))
    assert all(len(x) == 1 for x in roots.values())
    assert len({next(iter(x)) for x in roots.values()}) == len(roots)


def test_trie_in_small_parts(monkeypatch):
    """Node pairs walked a few at a time, and longer fingerprints that share a value."""
    monkeypatch.setattr(simhash, "PAIRS", 40)
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 2**12, 300).astype(np.uint64) * np.uint64(2**30))
    full = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    groups = np.repeat(np.arange(3), 100)
    label = simhash.trie_join(np.concatenate([np.sort(values[groups == g]) for g in range(3)]), groups, 2, 48)
    ordered = np.concatenate([np.sort(values[groups == g]) for g in range(3)])
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(300):
        for j in range(i):
            if groups[i] == groups[j] and int(ordered[i] ^ ordered[j]).bit_count() <= 2 and ordered[i] != ordered[j]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    distinct = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (groups[1:] != groups[:-1])))
    first = np.maximum.accumulate(np.where(distinct, np.arange(300), 0))
    assert all(label[i] == label[j] for i in range(300) for j in range(i) if root(first[i]) == root(first[j]) and distinct[i] and distinct[j])
    same = np.zeros(6, dtype=np.uint64)
    near = np.zeros((6, 2), dtype=np.uint64)
    near[3:] = full[0]
    assert simhash.trie_join(same, np.zeros(6, dtype=int), 2, 48, near, 4).tolist() == [0, 0, 0, 3, 3, 3]


@pytest.mark.parametrize("pairs", [40, 100_000])
def test_all_rows_of_equal_values(monkeypatch, pairs):
    """Interleaved groups of near copies on one value, and on two values within the budget: components of all pairs."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    n, limit = 240, 20
    centre = rng.integers(0, 2**63, (24, 4)).astype(np.uint64)
    full = centre[np.arange(n) % 24]
    for i in range(n):
        for _ in range(9):  # pairs of a group differ in 18 bits at most
            full[i, rng.integers(4)] ^= np.uint64(1 << int(rng.integers(64)))
    groups = np.repeat([0, 1], n // 2)
    values = np.tile(np.repeat(np.array([5, 6], dtype=np.uint64), n // 4), 2)
    label = simhash.trie_join(values, groups, 2, 8, full, limit)
    want = np.arange(n)
    for i in range(n):
        for j in range(i):
            if groups[i] == groups[j] and np.bitwise_count(full[i] ^ full[j]).sum() <= limit:
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert len(set(want)) == 48
    assert label.tolist() == want.tolist()


def test_one_of_each(spark):
    """Copies and texts of similarity 0.9 leave one, the least doc_id; unrelated and merely related texts stay."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, groups = [], []
    for g in range(30):
        base = rng.choice(vocabulary, 400).tolist()
        group = []
        for k in range(4):
            text = list(base)
            if k:
                text[int(rng.integers(400 // 4 * (k - 1), 400 // 4 * k))] = "Changed"
                text[-k] = "ending"
            docs.append((1000 - 7 * len(docs), " ".join(text), f"s{g}", len(docs)))
            group.append(docs[-1][0])
        half = base[:200] + rng.choice(vocabulary, 200).tolist()
        docs.append((5000 + g, " ".join(half), "half", 0))
        groups.append(min(group))
    docs += [(9000, None, "x", 1), (9001, "", "x", 1), (9002, "a b", "y", 2), (9002, "a b", "y", 2), (None, "a b", "y", 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, key_a long").repartition(3)
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted([*groups, *(5000 + g for g in range(30)), 9000, 9002])
    assert simhash.one_of_each(frame.limit(0)).count() == 0


def test_similarity_is_exact_on_both_sides(spark):
    """Pairs just above 0.8 leave one text in more than nine of ten cases, pairs below it always both."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs, pairs = [], []
    for i in range(300):
        base = rng.choice(vocabulary, 400).tolist()
        other = list(base)
        for at in rng.choice(80, int(rng.integers(4, 14)), replace=False):
            other[int(at) * 5] = f"x{rng.integers(10**6)}"
        sets = [{tuple(t[k : k + 5]) for k in range(396)} for t in (base, other)]
        same = len(sets[0] & sets[1])
        pairs.append((2 * i, same / (len(sets[0]) + len(sets[1]) - same)))
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(i in kept for i, _ in pairs)
    below = [i for i, j in pairs if j < 0.8]
    near, high = [i for i, j in pairs if 0.8 <= j < 0.86], [i for i, j in pairs if j >= 0.86]
    assert len(below) > 50 and all(i + 1 in kept for i in below)
    assert len(near) > 50 and sum(i + 1 not in kept for i in near) >= 0.9 * len(near)
    assert len(high) > 20 and sum(i + 1 not in kept for i in high) >= 0.97 * len(high)


def test_families_of_related_texts(spark):
    """A family whose texts share two thirds stays whole, its exact and near copies go, all in few comparisons."""
    rng = np.random.default_rng(13)
    shared = [f"s{i}" for i in range(300)]
    docs = []
    for i in range(120):
        own = shared + [f"o{i}_{k}" for k in range(150)]
        docs.append((10 * i, " ".join(own)))
        if i % 4 == 0:
            docs += [(10 * i + 1, " ".join(own).upper()), (10 * i + 2, " ".join([*own[:-2], "almost", "same"]))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {10 * i for i in range(120)}


def test_spanning_pairs():
    rng = np.random.default_rng(14)
    forest = simhash.SpanningForest(50)
    plain = simhash.Forest(50)
    for _ in range(6):
        a, b = rng.integers(0, 50, 12), rng.integers(0, 50, 12)
        forest.link(a, b)
        plain.link(a, b)
    assert forest.label.tolist() == plain.label.tolist()
    again = simhash.Forest(50)
    pairs = [np.concatenate(x) for x in zip(*forest.pairs)]
    again.link(*pairs)
    assert again.label.tolist() == plain.label.tolist() and len(pairs[0]) == 50 - len(set(plain.label.tolist()))
