import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.functions.buzhash import ChunkSizes, chunk_pairs, rolled
from strataloom.functions.codec import encode_internal, encode_leaf, sha256
from strataloom.operators import chunking, diff, merkle

SMALL = ChunkSizes(256, 64, 1024)
KV = "key binary, value binary"
KEYED = st.dictionaries(st.binary(min_size=1, max_size=50), st.binary(max_size=120), min_size=1, max_size=100)


def frame(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], KV)


def some(seed, n, letters=False):
    rng = random.Random(seed)
    top = 128 if letters else 256
    return sorted({bytes(rng.randrange(top) for _ in range(rng.randint(1, 30))): bytes(rng.randrange(top) for _ in range(rng.randint(0, 90))) for _ in range(n)}.items())


def root_of(pairs, sizes):
    """The root, node by node, in plain Python."""
    refs = [(c[0][0], sha256(encode_leaf(c))) for c in chunk_pairs(pairs, sizes)]
    levels = 1
    while len(refs) > 1:
        refs = [(c[0][0], sha256(encode_internal([(k, v.hex()) for k, v in c]))) for c in chunk_pairs([(k, bytes.fromhex(h)) for k, h in refs], sizes)]
        levels += 1
    return (refs[0][1] if refs else merkle.EMPTY_ROOT), levels


@settings(max_examples=200, deadline=None)
@given(KEYED)
def test_prefix_sums_chunk_as_rolling_does(pairs):
    pairs = sorted(pairs.items())
    by_byte = rolled(pairs, SMALL)
    assert [len(c) for c in chunk_pairs(pairs, SMALL)] == (by_byte if len(by_byte) < len(pairs) else [len(pairs)])


@settings(max_examples=50, deadline=None)
@given(KEYED, st.binary(min_size=1, max_size=50), st.binary(max_size=50))
def test_an_insertion_anywhere_changes_few_chunks(pairs, key, value):
    before = {encode_leaf(c) for c in chunk_pairs(sorted(pairs.items()), SMALL)}
    after = {encode_leaf(c) for c in chunk_pairs(sorted((pairs | {key: value}).items()), SMALL)}
    assert len(before & after) >= len(before) - 8


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("sizes", [SMALL, ChunkSizes(1024, 128, 4096), ChunkSizes(64, 16, 256)])
def test_partitions_agree_with_one_stream(spark, partitions, sizes):
    pairs = some(7, 1500)
    got = {}
    for r in chunking.chunked(frame(spark, pairs), sizes, partitions).collect():
        got.setdefault(r.chunk, []).append((bytes(r.key), bytes(r.value)))
    assert [sorted(got[c]) for c in sorted(got)] == chunk_pairs(pairs, sizes)


def test_short_ranges_and_the_collapse_rule(spark):
    tiny = some(1, 12)
    assert chunking.chunked(frame(spark, tiny), None, 8).select("chunk").distinct().count() == 1
    big = [(bytes([i]), random.Random(i).randbytes(20_000)) for i in range(20)]
    tree = merkle.build(frame(spark, big), None, 4)
    assert tree.leaves.count() == 1 and tree.leaves.head().n_bytes == 5 + sum(9 + len(v) for _, v in big)
    assert tree.root == sha256(encode_leaf(big))


@pytest.mark.parametrize("partitions", [1, 5])
def test_deep_trees(spark, partitions):
    pairs = some(3, 4000)
    tree = merkle.build(frame(spark, pairs[::-1]), SMALL, partitions)
    root, levels = root_of(pairs, SMALL)
    assert (tree.root, tree.levels) == (root, levels) and levels >= 3


def test_upper_levels_by_spark(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DRIVER_REFS", 20)
    pairs = some(4, 3000)
    tree = merkle.build(frame(spark, pairs), SMALL, 3)
    assert (tree.root, tree.levels) == root_of(pairs, SMALL)


def test_golden_roots(spark):
    df = spark.range(50_000).selectExpr("cast(concat('user:', lpad(id, 8, '0')) as binary) key", "cast(concat('name-', id) as binary) value")
    tree = merkle.build(df)
    assert tree.root == "d9f7880972a18da8fda4c6677cb290801a0bdbb4d0cc3fc2c78862169aa58cc5"
    assert (tree.levels, tree.leaves.count() + tree.nodes.count()) == (3, 306)
    assert merkle.build(df.limit(0)).root == merkle.EMPTY_ROOT


def test_one_change_makes_few_nodes_and_a_pruned_diff(spark):
    pairs = some(9, 4000)
    changed = [(k, v + b"!" if i == 2000 else v) for i, (k, v) in enumerate(pairs)]
    a, b = merkle.build(frame(spark, pairs), SMALL), merkle.build(frame(spark, changed), SMALL)
    new = b.leaves.select("leaf_hash").subtract(a.leaves.select("leaf_hash")).count()
    assert 1 <= new <= 3
    stored = a.pairs.unionByName(b.pairs).dropDuplicates(["leaf_hash", "key"])
    rows = diff.pruned(stored, a.leaves, b.leaves).collect()
    assert [(r.change_type, bytes(r.key), bytes(r.old_value), bytes(r.new_value)) for r in rows] == [("modified", pairs[2000][0], pairs[2000][1], pairs[2000][1] + b"!")]


def test_diffs_against_a_plain_one(spark):
    """Many cases in one job: a column tells them apart as a key prefix."""
    rng = random.Random(8)
    left, right, want = [], [], set()
    for case in range(60):
        a = {bytes([case, rng.randrange(30)]): bytes([rng.randrange(3)]) for _ in range(rng.randint(0, 25))}
        b = {bytes([case, rng.randrange(30)]): bytes([rng.randrange(3)]) for _ in range(rng.randint(0, 25))}
        left += a.items()
        right += b.items()
        for k in a.keys() | b.keys():
            if a.get(k) != b.get(k):
                want.add(("added" if k not in a else "deleted" if k not in b else "modified", k, a.get(k), b.get(k)))
    x, y = frame(spark, left), frame(spark, right)
    plain = lambda df: {tuple(None if v is None else v if isinstance(v, str) else bytes(v) for v in r) for r in df.collect()}
    changes = diff.diff(x, y)
    assert plain(changes) == want
    assert plain(diff.inverse(changes)) == plain(diff.diff(y, x))
    assert plain(diff.applied(x, changes)) == plain(y)
    assert diff.counts(diff.diff(x, x)).head().asDict() == {"added": 0, "deleted": 0, "modified": 0}
