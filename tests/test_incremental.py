"""Trees made of other trees equal trees built anew, whatever changed."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.functions.buzhash import ChunkSizes, chunk_pairs
from strataloom.functions.codec import decode_node, encode_leaf, sha256
from strataloom.operators import merkle

SIZES = ChunkSizes(256, 64, 1024)


def built(pairs: dict[bytes, bytes], sizes: ChunkSizes = SIZES):
    """Leaves with their pairs, the root and the number of levels, in plain Python."""
    leaves, held = [], {}
    for chunk in chunk_pairs(sorted(pairs.items()), sizes):
        body = encode_leaf(chunk)
        leaves.append(merkle.OldLeaf(chunk[0][0], chunk[-1][0], sha256(body), len(chunk), len(body)))
        held[leaves[-1].name] = chunk
    root, nodes, level = merkle.capped([(x.first, x.name) for x in leaves], 0, sizes)
    return leaves, held, root, nodes, level


def checked(pairs: dict[bytes, bytes], changes: dict[bytes, bytes | None], sizes: ChunkSizes = SIZES):
    leaves, held, *_ = built(pairs, sizes)
    read: list[str] = []

    def fetch(wanted):
        read.extend(x.name for x in wanted)
        return {x.name: held[x.name] for x in wanted}

    got = merkle.grown(leaves, changes, fetch, sizes, 10_000)
    after = {k: v for k, v in {**pairs, **changes}.items() if v is not None}
    want, now, root, nodes, _ = built(after, sizes)
    if got is not None:
        assert got.root == root and got.leaves == want and {n[0] for n in got.nodes} == {n[0] for n in nodes}
        assert all(now[name] == rows for name, rows in got.fresh.items())
        assert set(now) - set(held) == set(got.fresh)
    return got, len(read), len(leaves)


def value(rng: random.Random) -> bytes:
    return rng.randbytes(rng.randrange(0, 60))


@pytest.mark.parametrize("seed", range(12))
def test_random_changes(seed):
    rng = random.Random(seed)
    pairs = {b"%07d" % rng.randrange(10**6): value(rng) for _ in range(4000)}
    assert built(pairs)[4] >= 2
    for n in (0, 1, 3, 30, 400):
        changes: dict[bytes, bytes | None] = {k: None for k in rng.sample(sorted(pairs), n)}
        changes |= {k: value(rng) for k in rng.sample(sorted(pairs), n)}
        changes |= {b"%07d" % rng.randrange(10**6): value(rng) for _ in range(n)}
        got, read, leaves = checked(pairs, changes)
        assert got is not None and (n > 3 or read <= 6 * 3 * n + 2 < leaves)


def test_edges_of_the_key_range():
    rng = random.Random(1)
    pairs = {b"k%06d" % i: value(rng) for i in range(2000)}
    keys = sorted(pairs)
    for changes in ({b"a": b"first"}, {b"z": b"last"}, {keys[0]: None}, {keys[-1]: None}, dict.fromkeys(keys[:300]), dict.fromkeys(keys[-300:]), dict.fromkeys(keys[700:1200]), {b"none": None}, {keys[5]: b"x" * 9000}):
        assert checked(pairs, changes)[0] is not None


def test_what_is_built_anew():
    rng = random.Random(2)
    pairs = {b"k%06d" % i: value(rng) for i in range(2000)}
    assert checked(dict(list(pairs.items())[:5]), {b"a": b"1"})[0] is None  # few leaves
    assert checked(pairs, dict.fromkeys(pairs))[0] is None  # nothing is left
    assert checked(pairs, {b"a": b"1"}, ChunkSizes(256, 32, 1024))[0] is None  # a hash that depends on the chunk
    leaves, held, *_ = built(pairs)
    assert merkle.grown(leaves, {x.first: None for x in leaves}, lambda w: {x.name: held[x.name] for x in w}, SIZES, 5) is None


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=30), st.binary(max_size=50), min_size=10, max_size=300), st.dictionaries(st.binary(min_size=1, max_size=30), st.none() | st.binary(max_size=50), max_size=20), st.data())
def test_any_pairs(pairs, changes, data):
    old = data.draw(st.lists(st.sampled_from(sorted(pairs)), max_size=10, unique=True))
    checked(pairs, {**changes, **{k: data.draw(st.none() | st.binary(max_size=50)) for k in old}}, ChunkSizes(64, 64, 256))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=30), st.binary(max_size=50), min_size=1, max_size=200))
def test_trees_hold_their_pairs(pairs):
    leaves, held, root, nodes, _ = built(pairs, ChunkSizes(64, 64, 256))
    assert [kv for x in leaves for kv in held[x.name]] == sorted(pairs.items())
    bodies = {n[0]: n[4] for n in nodes} | {x.name: encode_leaf(held[x.name]) for x in leaves}

    def walk(name):
        kind, found = decode_node(bodies[name])
        return found if kind == 1 else [kv for first, child in found for kv in walk(child) if walk(child)[0][0] == first]

    assert walk(root) == sorted(pairs.items()) and all(sha256(b) == n for n, b in bodies.items())
