"""Quality rules: how much of a text lies in repeated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, hashed, map_arrow, mix, table

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, top_chars array<long>, dup_chars array<long>"
)


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares of word characters: in lines seen before, in the commonest n-gram, in n-grams seen twice or more."""

    min_words: int = 50
    max_repeat_words: int = 50
    dup_lines: float = 0.30
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    dup: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25})


def same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it stands in keys; and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    sizes = np.diff(np.r_[at, len(k)])
    count, later = np.empty(len(k), np.int64), np.empty(len(k), bool)
    count[order] = np.repeat(sizes, sizes)
    later[order] = ~first
    return count, later


def measure(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The measures of each text, all texts of a batch at once.

    Windows are compared by 64-bit rolling hashes with the text's number mixed in. An n-gram can
    repeat only where its first n-1 words do, so each length looks only at what the last one left.
    """
    raw = [(t or "").encode() for t in texts]
    split = [b.split() for b in raw]
    n_docs = len(raw)
    n_words = np.fromiter(map(len, split), np.int64, n_docs)
    doc = np.repeat(np.arange(n_docs), n_words)
    h = hashed(list(chain.from_iterable(split)))
    n = len(h)
    ends = np.repeat(np.cumsum(n_words), n_words)
    bytes_ = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, n_docs)
    offset = np.r_[0, np.cumsum(size)]

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[offset[1:]] - total[offset[:-1]]

    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    cp = ((bytes_ & 0xC0) != 0x80) & ~space[bytes_]
    n_symbols, word_chars = per_doc(symbol[bytes_]), per_doc(cp)
    chars = np.fromiter((len(w) for w in chain.from_iterable(split)), np.int64, n)
    wide = np.fromiter(map(bytes.isascii, raw), bool, n_docs)
    if not wide.all():  # words of texts beyond ASCII: bytes less continuation bytes
        for i in np.flatnonzero(~wide).tolist():
            a = ends[np.searchsorted(doc, i)] - n_words[i] if n_words[i] else 0
            chars[a : a + n_words[i]] = [len(w.decode()) for w in split[i]]
    before = np.r_[0, np.cumsum(chars)]

    dup_lines, dup_line_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i, b in enumerate(raw):
        if b"\n" in b:
            seen: set[bytes] = set()
            for line in b.split(b"\n"):
                if line in seen:
                    dup_lines[i] += 1
                    dup_line_chars[i] += sum(len(w.decode()) for w in line.split())
                elif line.strip():
                    seen.add(line)

    salt = mix(doc.astype(np.uint64) + ODD)
    at, key, rolling = np.arange(n), None, h.copy()
    top: dict[int, np.ndarray] = {}
    dup: dict[int, np.ndarray] = {}
    repeat_words = np.zeros(n_docs, np.int64)

    def covered(starts: np.ndarray, k: int) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + k, -1)
        return np.cumsum(edge[:-1]) > 0

    for k in range(2, max([3, *rules.top, *rules.dup]) + 1):
        at = at[at + k <= ends[at]]
        rolling = rolling[: max(0, n - k + 1)] * ODD + h[k - 1 :] if n >= k else rolling[:0]
        count, _ = same(mix(rolling[at]) ^ salt[at])
        if k in rules.top:
            best = np.zeros(n_docs, np.int64)
            twice = count > 1
            np.maximum.at(best, doc[at[twice]], count[twice] * (before[at[twice] + k] - before[at[twice]]))
            top[k] = best
        at = at[count > 1]
        if k == 3 or k in rules.dup:
            inside = covered(at, k)
            if k == 3:
                repeat_words = np.bincount(doc[inside], minlength=n_docs)
            if k in rules.dup:
                dup[k] = np.bincount(doc[inside], weights=chars[inside], minlength=n_docs).astype(np.int64)

    base_failed = (n_words < rules.min_words) | (100 * repeat_words > rules.max_repeat_words * n_words)
    failed = dup_line_chars > rules.dup_lines * word_chars
    for found, limits in ((top, rules.top), (dup, rules.dup)):
        for k, limit in limits.items():
            failed |= found[k] > limit * word_chars
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words.astype(np.int64), "base_failed": base_failed, "kept": ~(base_failed | failed),
        "dup_line_chars": dup_line_chars, "top_chars": np.stack([top[k] for k in sorted(top)], 1), "dup_chars": np.stack([dup[k] for k in sorted(dup)], 1),
    }


def assess(docs: DataFrame, rules: RepetitionRules | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) and the measures of SCHEMA for every row; no shuffle.

    A null or empty text has no words and fails; repeated rows come out each; a null doc_id stays
    null; other columns are dropped, so clashing names do no harm; an empty table gives no row.
    """
    rules = rules or RepetitionRules()
    carry = carry or ["doc_id"]
    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                got = measure(part.column(len(carry)).to_pylist(), rules)
                cols = [pa.array(list(v), pa.list_(pa.int64())) if v.ndim > 1 else pa.array(v) for v in got.values()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), *cols], [*carry, *names])

    return map_arrow(docs.select(*(F.col(c) for c in carry), F.col("text").alias("__text")), run, ", ".join([*types, SCHEMA]))


def keep(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    columns = docs.columns
    held = [f"__{i}" for i in range(len(columns))]  # no column of docs may clash with a measure
    own = docs.select(*(F.col(c).alias(h) for c, h in zip(columns, held)), "text")
    return assess(own, rules, held).filter("kept").select(*(F.col(h).alias(c) for c, h in zip(columns, held)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).drop("dup_line_chars", "top_chars", "dup_chars")
