"""Byte formats: key-value pairs, leaf and internal nodes, commits; as Spark expressions and in Python."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CorruptedData

LEAF, INTERNAL = 1, 2
Pair = tuple[bytes, bytes]


def u32(n: Column) -> Column:
    """A count as four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def pair_bytes(key: Column, value: Column) -> Column:
    """The serialised pair: each part after its length."""
    return F.concat(u32(F.octet_length(key)), key, u32(F.octet_length(value)), value)


def pair_size(key: Column, value: Column) -> Column:
    return F.octet_length(key).cast("long") + F.octet_length(value) + 8


def encode_pair(key: bytes, value: bytes) -> bytes:
    return struct.pack(">I", len(key)) + key + struct.pack(">I", len(value)) + value


def encode_pairs(pairs: Sequence[Pair]) -> bytes:
    return struct.pack(">I", len(pairs)) + b"".join(encode_pair(k, v) for k, v in pairs)


def encode_leaf(pairs: Sequence[Pair]) -> bytes:
    return bytes([LEAF]) + encode_pairs(pairs)


def encode_internal(children: Sequence[tuple[bytes, str]]) -> bytes:
    return bytes([INTERNAL]) + struct.pack(">I", len(children)) + b"".join(struct.pack(">I", len(k)) + k + bytes.fromhex(h) for k, h in children)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Reader:
    """Reads fields off bytes; anything short or left over is corrupt."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CorruptedData(f"wanted {n} bytes at {self.at}, have {len(self.data) - self.at}")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def count(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def sized(self) -> bytes:
        return self.take(self.count())

    def end(self) -> None:
        if self.at != len(self.data):
            raise CorruptedData(f"{len(self.data) - self.at} bytes are left over")


def decode_pair(data: bytes) -> Pair:
    r = Reader(data)
    pair = r.sized(), r.sized()
    r.end()
    return pair


def decode_pairs(data: bytes) -> list[Pair]:
    r = Reader(data)
    pairs = [(r.sized(), r.sized()) for _ in range(r.count())]
    r.end()
    return pairs


def decode_node(data: bytes) -> tuple[int, list]:
    """(LEAF, pairs) or (INTERNAL, [(key, hash)])."""
    r = Reader(data)
    kind = r.take(1)[0]
    if kind == LEAF:
        found: list = [(r.sized(), r.sized()) for _ in range(r.count())]
    elif kind == INTERNAL:
        found = [(r.sized(), r.take(32).hex()) for _ in range(r.count())]
    else:
        raise CorruptedData(f"no node has kind {kind}")
    r.end()
    return kind, found


ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


def encode_commit(root_hash: str, message: str, parent: str, ts: int) -> bytes:
    """The commit's canonical JSON: this field order, no spaces, and < > & U+2028 U+2029 escaped."""
    text = message.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    body = json.dumps({"root_hash": root_hash, "message": text, "parent": parent, "timestamp": ts}, ensure_ascii=False, separators=(",", ":"))
    return body.translate(ESCAPED).encode()


def decode_commit(data: bytes) -> tuple[str, str, str, int]:
    try:
        x = json.loads(data)
        root, parent = x["root_hash"], x["parent"]
        if any(len(bytes.fromhex(h)) != 32 for h in (root, parent)):
            raise ValueError("a hash doesn't have 32 bytes")
        return root, x["message"], parent, int(x["timestamp"])
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptedData(f"not a commit: {e}") from e
