import pytest
from hypothesis import given
from hypothesis import strategies as st

from strataloom.functions import codec
from strataloom.model import CorruptedData

PAIRS = st.lists(st.tuples(st.binary(max_size=100), st.binary(max_size=100)), max_size=50)


@given(PAIRS)
def test_pairs_and_leaves_come_back(pairs):
    assert codec.decode_pairs(codec.encode_pairs(pairs)) == pairs
    assert codec.decode_node(codec.encode_leaf(pairs)) == (codec.LEAF, pairs)
    assert all(codec.decode_pair(codec.encode_pair(*p)) == p for p in pairs)


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=100), st.binary(min_size=32, max_size=32).map(bytes.hex)), max_size=20))
def test_internal_nodes_come_back(children):
    assert codec.decode_node(codec.encode_internal(children)) == (codec.INTERNAL, children)


@given(st.binary(min_size=32, max_size=32), st.text(), st.binary(min_size=32, max_size=32), st.integers(-(2**62), 2**62))
def test_commits_come_back(root, message, parent, ts):
    text = message.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    assert codec.decode_commit(codec.encode_commit(root.hex(), message, parent.hex(), ts)) == (root.hex(), text, parent.hex(), ts)


def test_commit_bytes():
    body = codec.encode_commit("a" * 64, 'x<y> & "z"\n é', "0" * 64, 7)
    assert body == ('{"root_hash":"%s","message":"x\\u003cy\\u003e \\u0026 \\"z\\"\\n\\u2028é","parent":"%s","timestamp":7}' % ("a" * 64, "0" * 64)).encode()


@pytest.mark.parametrize("data", [b"", b"\x03\0\0\0\0", b"\x01\0\0\0\1", b"\x01\0\0\0\0x", b"\x02\0\0\0\1\0\0\0\1a" + b"h" * 31, b"\x01\xff\xff\xff\xff"])
def test_corrupt_nodes(data):
    with pytest.raises(CorruptedData):
        codec.decode_node(data)


@pytest.mark.parametrize("data", [b"", b"{}", b"[]", b'{"root_hash":"zz","message":"","parent":"00","timestamp":1}'])
def test_corrupt_commits(data):
    with pytest.raises(CorruptedData):
        codec.decode_commit(data)


def test_golden_hashes():
    assert codec.sha256(codec.encode_leaf([])) == "957b88b12730e646e0f33d3618b77dfa579e8231e3c59c7104be7165611c8027"
    assert codec.sha256(codec.encode_leaf([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")])) == "4e3c7bcc5e90f00c34d2a9c3458e894a6e2e3beb3677f792aa11152a18ca7a27"
    assert codec.sha256(codec.encode_leaf([(b"user", b"alice"), (b"age", b"25")])) == "22a7936b29f0cef70fc0200d37cc477f69dda5b17161c0182540f1d6c265c62f"
    assert codec.sha256(codec.encode_internal([(b"apple", "aa" * 32), (b"banana", "bb" * 32)])) == "185fe926ad73f716bf1383223db4afe8b95e6421ff446c232404ab5920ea803d"
