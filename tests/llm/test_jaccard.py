import random
import re

import numpy as np

from strataloom.llm import flushes, jaccard
from strataloom.llm.common import shingles

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, **k):
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, node long, component_id long")
    return sorted((tuple(r) for r in jaccard.jaccard_components(docs, **k).drop("th", "root").collect()), key=str)


def near_copies(rng, n, size, edits, vocabulary=5000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"x{rng.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "A", "a b", "a  b", "a b c", *near_copies(rng, 60, 200, 9), *near_copies(rng, 30, 30, 2), *near_copies(rng, 20, 600, 30)]
    rows = [(rng.randrange(10_000), t) for t in texts]
    rows += [(None, texts[8]), rows[9], rows[9], (None, "lonely words stand here"), (None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, words=5, num=80, den=100) == brute(rows, 5, 80, 100)


def met(a, b):
    """Whether a and b share as many signatures in some band of each as both need there."""
    for part_a, need_a in ((a[0][: a[1]], a[2][0]), (a[0][a[1] :], a[2][1])):
        for part_b, need_b in ((b[0][: b[1]], b[2][0]), (b[0][b[1] :], b[2][1])):
            if len(np.intersect1d(part_a, part_b)) >= max(need_a, need_b):
                return True
    return False


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100)):
        for size in [*range(1, 40), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            for _ in range(8):
                keep = a[: len(a) - rng.integers(0, max(1, len(a) * (den - num) // den + 1))]
                b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, len(a) // 8 + 1)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    assert met(jaccard.signatures(a, num, den), jaccard.signatures(b, num, den))
                x, y = sorted((jaccard.sketch(a), jaccard.sketch(b)), key=len)
                assert np.bitwise_count(x ^ jaccard.folded(y, len(x))).sum() <= len(a) + len(b) - 2 * both


def test_fingerprints_are_a_round_trip():
    rng = np.random.default_rng(8)
    for low, ranges in ((2, 1), (3, 8), (6, 64)):
        sig = rng.integers(0, 1 << 62, 5000).astype(np.uint64) >> np.uint64(62 - 16 - 8 * low + (2 if low == 6 else 0))
        doc, at = rng.integers(0, 1 << 16, 5000), rng.integers(0, 1 << 32, 5000)
        got = [flushes.unpacked(*row, low, 6) for row in flushes.packed(sig, flushes.loads(doc.astype("<u2"), at.astype("<u4")), low, ranges)]
        back = [(s, *(c.tolist() for c in flushes.columns(x, "<u2", "<u4"))) for s, x in got]
        assert sorted((int(s), d, p) for g in back for s, d, p in zip(*g)) == sorted(zip(sig.tolist(), doc.tolist(), at.tolist()))


def test_shingles():
    assert len(shingles("a b c d", 3)) == 2 and len(shingles("a b", 3)) == 1 and len(shingles(None, 3)) == 0
    assert np.array_equal(shingles("A B\tC", 3), shingles("a b c", 3))


def test_odd_rows(odd_docs, no_docs):
    rows = jaccard.jaccard_components(odd_docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (None, 4), (6, 6), (7, 6), (8, 8)], key=str)
    assert jaccard.jaccard_components(no_docs).collect() == []


def test_chains_of_three(spark):
    """b links a and c; where a is in all buckets of b and c, and a bucket's only head, the star never compares b and c."""
    rows = []
    for i in range(3000):
        a = [f"v{i}x{k}" for k in range(22)]
        b = [*a[:-1], "y"]
        c = ["z", *b[1:]]
        one, two, three = (jaccard.signatures(shingles(" ".join(w), 3), 90, 100)[0] for w in (a, b, c))
        if len(rows) < 600 and np.isin(np.intersect1d(two, three), one).all():
            rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((a, b, c))]
    assert len(rows) > 300 and found(spark, rows) == brute(rows)


def test_a_large_group_is_joined_by_few_pairs(spark, monkeypatch):
    """Where heads have joined nothing, members of a bucket are tried by about as many pairs as there are members, not by their square."""
    tried, verified = [], jaccard.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "verified", counted)
    rng = random.Random(6)
    rows = list(enumerate([*near_copies(rng, 150, 300, 3), *near_copies(rng, 60, 200, 9), *near_copies(rng, 5, 100, 2)]))
    assert found(spark, rows) == brute(rows)
    assert 3 * sum(tried) < 150 * 149 // 2


def test_sketches_go_once_to_like_buckets(spark, monkeypatch):
    """Members of a large group share many buckets of nearly the same members: a node's sketch isn't sent for each."""
    sent, members = [], []
    across, map_arrow = jaccard.across, jaccard.map_arrow

    def opened(rows, *rest):
        members.append(rows.filter("m > 8").count())
        return across(rows, *rest)

    def counted(df, fn, schema):
        if schema == "sig long, head long, node long":
            sent.append(df.count())
        return map_arrow(df, fn, schema)

    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "across", opened)
    monkeypatch.setattr(jaccard, "map_arrow", counted)
    rng = random.Random(8)
    rows = list(enumerate([*near_copies(rng, 150, 300, 3), *near_copies(rng, 90, 200, 9)]))
    assert found(spark, rows) == brute(rows)
    assert 3 * sent[0] < members[0]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "GROUP", 32)
    assert found(spark, rows) == brute(rows)
