"""The rolling hash that places chunk boundaries, vectorised over a run of bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .codec import Pair, encode_pair

WINDOW = 64

# The format's hash of each byte below 0x40; all other bytes hash to 0.
TABLE = [
    0x458BE752, 0xC10748CC, 0xFBBCDBB8, 0x6DED5B68, 0xB10A82B5, 0x20D75648, 0xDFC5665F, 0xA8428801,
    0x7EBF5191, 0x841135C7, 0x65CC53B3, 0x280A597C, 0x16F60255, 0xC78CBC3E, 0x294415F5, 0xB938D494,
    0xEC85C4E6, 0xB7D33EDC, 0xE549B544, 0xFDEDA5AA, 0x882BF287, 0x3116571E, 0xA6FC8D2D, 0x1B5F3F3C,
    0x2E7D4E29, 0x49E95D76, 0x540D0A26, 0xF87B1A02, 0x84B4A028, 0xD7F89C1E, 0xF309CBE0, 0x600A2F4F,
    0x5F33E848, 0xB149A5D5, 0x1E39E8BD, 0x2A1FC67A, 0x934D46E4, 0x8F902F30, 0xFC4B0223, 0xFB6D4314,
    0x5F6B9B30, 0x6F2D9C6C, 0x58597E40, 0x3CBBB848, 0x7C3B5360, 0x3F0AB26C, 0x9EA521C8, 0x1C1B0D14,
    0x3E9DE0C0, 0x289D8F1C, 0x0C01F56C, 0x61BD8E3C, 0xD6E2E980, 0x9C098894, 0x9E0E2534, 0x049DC09C,
    0x64A0DC24, 0xB07C0440, 0x8E5B0A50, 0xF05C1E10, 0x4C449E3C, 0x5C8C6C30, 0x88507800, 0x08B09A40,
]

VALUES = np.zeros(256, np.uint32)
VALUES[: len(TABLE)] = TABLE


@dataclass(frozen=True)
class ChunkSizes:
    """Bytes: a boundary's expected distance, and a chunk's least and largest size."""

    target: int = 4096
    least: int = 512
    most: int = 16384


def rotated(x: np.ndarray, by: np.ndarray, left: bool) -> np.ndarray:
    by = (by % 32).astype(np.uint32)
    back = (np.uint32(32) - by) % np.uint32(32)
    return (x << by) | (x >> back) if left else (x >> by) | (x << back)


def hits(data: bytes | np.ndarray, target: int) -> np.ndarray:
    """Ends (bytes before and with it) of all full windows in data whose hash is a multiple of target.

    A window's hash is the exclusive or of its bytes' values, each rotated by its distance from the
    end. Rotating each value back by its place makes that a difference of prefix sums under
    exclusive or; since the window is a multiple of 32, what leaves it cancels what came in.
    """
    b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if len(b) < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(len(b))
    prefix = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(rotated(VALUES[b], at, False))])
    ends = np.arange(WINDOW, len(b) + 1)
    h = rotated(prefix[WINDOW:] ^ prefix[:-WINDOW], ends - 1, True)
    return ends[h % np.uint32(target) == 0]


def cuts(ends: np.ndarray, found: np.ndarray, start: int, sizes: ChunkSizes) -> list[int]:
    """Chunk ends of a run of pairs that end at the ascending offsets ends, for a chunk open since start.

    A chunk ends with the first pair that holds a hit at least `least` bytes on, or reaches `most` bytes.
    """
    out: list[int] = []
    while True:
        k = int(np.searchsorted(found, start + sizes.least))
        by_hit = int(found[k]) if k < len(found) else 1 << 62
        e = int(np.searchsorted(ends, min(by_hit, start + sizes.most)))
        if e == len(ends):
            return out
        start = int(ends[e])
        out.append(start)


def rolled(pairs: Sequence[Pair], sizes: ChunkSizes) -> list[int]:
    """Numbers of pairs per chunk, byte by byte: for sizes whose least is below the window."""
    out, n, h, count, hit = [], 0, 0, 0, False
    window, values = [0] * WINDOW, VALUES.tolist()
    for key, value in pairs:
        for byte in encode_pair(key, value):
            gone, window[count % WINDOW] = window[count % WINDOW], byte
            h = ((h << 1 | h >> 31) & 0xFFFFFFFF) ^ values[gone] ^ values[byte]
            count += 1
            hit |= count >= sizes.least and h % sizes.target == 0
        n += 1
        if count >= sizes.least and (count >= sizes.most or hit):
            out.append(n)
            n, h, count, hit, window = 0, 0, 0, False, [0] * WINDOW
    return out + ([n] if n else [])


def chunk_pairs(pairs: Sequence[Pair], sizes: ChunkSizes | None = None) -> list[list[Pair]]:
    """Sorted pairs as chunks; if that makes as many chunks as pairs, all are one chunk."""
    sizes = sizes or ChunkSizes()
    if not pairs:
        return []
    if sizes.least < WINDOW:
        counts = rolled(pairs, sizes)
    else:
        data = b"".join(encode_pair(k, v) for k, v in pairs)
        ends = np.cumsum([len(k) + len(v) + 8 for k, v in pairs])
        at = np.searchsorted(ends, cuts(ends, hits(data, sizes.target), 0, sizes)) + 1
        counts = np.diff([0, *at.tolist()]).tolist()
        if sum(counts) < len(pairs):
            counts.append(len(pairs) - sum(counts))
    if len(counts) >= len(pairs):
        return [list(pairs)]
    out, i = [], 0
    for n in counts:
        out.append(list(pairs[i : i + n]))
        i += n
    return out
