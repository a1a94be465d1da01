"""Hashes that two documents share, met without a row each: sorted fingerprints in flushes, dealt by ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints have so many bits more than the corpus has hashes, so few meet by chance; that only costs checks.
SPARE_BITS = 13
#: A flush of fingerprints: so many, and as many documents as a number of 15 bits can tell apart.
FLUSH, FLUSH_DOCS = 1 << 19, 1 << 15
#: Fingerprints of a range, which one reducer holds at a time.
RANGE = 1 << 20


def shape(docs: DataFrame) -> tuple[int, int]:
    """How many bytes of a fingerprint follow its leading 16 bits, and the number of ranges.

    Characters over 5 bound the words of all texts; it sets these two, not what is found.
    """
    total = max(1, (docs.select(F.sum(F.length("text"))).first()[0] or 0) // 5)
    return min(6, max(2, -(-(total.bit_length() + SPARE_BITS - 16) // 8))), min(1 << 16, 1 << (total // RANGE).bit_length())


def prints(hashes: np.ndarray, low_bytes: int) -> np.ndarray:
    return hashes >> np.uint64(48 - 8 * low_bytes)


def packed(sig: np.ndarray, load: np.ndarray, low_bytes: int, ranges: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Fingerprints and their loads (a row of bytes each) as (range, counts, low bytes, loads), for each range that has any.

    Sorted fingerprints share their leading 16 bits with many others, so of these only counts are
    kept; low_bytes bytes of the rest follow as they are.
    """
    order = np.argsort(sig, kind="stable")
    sig, load = sig[order], load[order]
    counts = np.bincount((sig >> np.uint64(8 * low_bytes)).astype(np.int64), minlength=1 << 16).astype("<u4")
    low = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    width = (1 << 16) // ranges
    ends = np.r_[0, np.cumsum(counts.reshape(ranges, width).sum(1, dtype=np.int64))]
    return [(r, counts[r * width : (r + 1) * width].tobytes(), low[a:e].tobytes(), load[a:e].tobytes()) for r, (a, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < e]


def unpacked(r: int, counts: bytes, low: bytes, load: bytes, low_bytes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, "<u4")
    high = np.repeat(np.arange(r * len(n), (r + 1) * len(n), dtype=np.uint64), n)
    wide = np.zeros((len(high), 8), np.uint8)
    wide[:, :low_bytes] = np.frombuffer(low, np.uint8).reshape(-1, low_bytes)
    return (high << np.uint64(8 * low_bytes)) + wide.view("<u8")[:, 0], np.frombuffer(load, np.uint8).reshape(-1, width)


def columns(load: np.ndarray, *kinds: str) -> list[np.ndarray]:
    """A load's columns of the given little-endian types."""
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(load[:, at : at + size]).view(kind)[:, 0])
        at += size
    return out


def loads(*columns_: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize) for c in columns_], axis=1)
