import numpy as np
import pytest

from strataloom.llm import neighbours


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        got = {}
        for i, x in rows:
            if i != q:
                s = float((np.array(x, float) * np.array(v, float)).sum())
                got[i] = max(s, got.get(i, -np.inf))
        out[q] = sorted(got, key=lambda i: (-got[i], i))[:k]
    return out


def test_recall_with_cells_and_salts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 24))
    x[100:400] = x[100]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    s = neighbours.Settings(block_values=24 * 1024, leaf=32, query_block=64)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 20, s).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    hits = sum(len(set(want[q]) & {i for _, i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    by_id = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - np.dot(by_id[q], by_id[i])) < 1e-9 for _, i, s in found)


def one_block(x, k=20, **settings):
    """Recall and the share of rows verified of a search of every 20th row among all, in one block."""
    s = neighbours.Settings(**settings)
    space = neighbours.plan(x.shape[1], x[:0], 0, s)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 20)
    shells = space.shell(neighbours.scaled(x)[1])
    found, read = {i: [] for i in asked.tolist()}, 0
    for shell in sorted(set(shells.tolist()), reverse=True):
        here = shells == shell
        known = np.array([sorted(f, reverse=True)[k - 1][0] if len(f) >= k else -np.inf for f in found.values()])
        for i, got, score, n in neighbours.search(ids[here], x[here], asked, x[asked], known, space, shell, k, s):
            found[int(asked[i])] += zip(score.tolist(), got.tolist())
            read += n
    hits = 0
    for i in asked.tolist():
        score = x @ x[i]
        score[i] = -np.inf
        least = np.sort(score)[-k]
        hits += sum(score[j] >= least - 1e-9 * abs(least) for _, j in sorted(found[i], reverse=True)[:k])
    return hits / k / len(asked), read / len(asked) / len(x)


def test_the_test_stops_searches(spark, sf):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 64))
    x = centres[rng.integers(0, 300, 12_000)] + 0.5 * rng.normal(size=(12_000, 64))
    recall, share = one_block(x)
    assert recall >= 0.9 and share < 1 / 3
    x *= np.exp(rng.normal(size=(12_000, 1)))  # lengths differ: shells
    recall, share = one_block(x)
    assert recall >= 0.9 and share < 1 / 3
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    recall, share = one_block(x)
    assert recall >= 0.9 and share < 0.9


@pytest.mark.parametrize("factor", [1e-3, 1e3, 1e150])
def test_scale_changes_nothing(factor):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(150, 40)), 10, axis=0)
    assert one_block(x * factor)[0] >= 0.97


def test_a_huge_vector_hides_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 40))
    x[7, 3] = 1e160
    assert one_block(x)[0] >= 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, 5.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 20, 1.0), (0, 3, 9, -1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 9, -1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_chi_square():
    x = np.random.default_rng(0).chisquare(12, 200_000)
    for p in (0.1, 0.5, 0.98):
        assert abs((x < neighbours.quantile(p, 12)).mean() - p) < 0.01
