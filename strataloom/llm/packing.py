"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

WINDOW, END_ID = 2048, 1
#: Bytes of ids in open windows; only memory, as no placement depends on the number of windows.
OPEN_BYTES = 32 << 20
CACHE_WORDS = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit bytes.

    The byte-level pattern always ends a token before a single space that stands between
    characters other than spaces, so a text's ids are those of its space-led words in turn. Each word
    goes to the library once while it stays in a cache of two generations; texts in which a
    space meets another or the text's edge, or that hold a token added to the vocabulary, go to the
    library whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        size = self.model.get_vocab_size()
        self.leads = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Put the ids of space-led words into the cache: many words to a call, cut where an id leads with a space."""
        groups = [new[i : i + 400] for i in range(0, len(new), 400)]
        for group, found in zip(groups, self.model.encode_batch_fast(["".join(" " + w for w in g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(self.leads[ids])
            if len(at) == len(group):
                raw, at = ids.tobytes(), (at * 4).tolist()
                for w, a, b in zip(group, at, [*at[1:], len(raw)]):
                    self.young[w] = raw[a:b]
            else:
                for w in group:
                    self.young[w] = self.whole(" " + w)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if not any(a in t for a in self.added) else ["", t] for t in texts]
        if len(self.young) > self.cache_words:
            self.old, self.young = self.young, {}
        seen = set().union(*(p[1:] for p in split if "" not in p)) if split else set()
        new, old, young = [], self.old, self.young
        for w in seen:
            if w not in young:
                if (found := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = found
        self.learn(new)
        out = []
        for text, parts in zip(texts, split):
            if not text:
                out.append(b"")
            elif "" in parts:
                out.append(self.whole(text))
            else:
                out.append(self.whole(parts[0]) + b"".join(map(young.__getitem__, parts[1:])))
        return out


class SumOfSquares:
    """Online packer: each remainder goes to the fill level that leaves the least sum of squared level counts.

    counts[h] is the number of open windows filled to level h; a full window closes. Where the open
    windows hold open_bytes of ids, they are laid end to end, the fullest first, and cut into full
    ones, so memory is bounded. finish() does that too, and cuts what is left at powers of two, so
    nothing is padded.
    """

    def __init__(self, window: int = WINDOW, open_bytes: int = OPEN_BYTES):
        self.window, self.open_bytes = window, open_bytes
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list]] = {}
        self.held = 0
        self.sequence = 0

    def emit(self, pieces: list) -> Iterator[tuple]:
        offset, sequence, self.sequence = 0, self.sequence, self.sequence + 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence, offset
            offset += n

    def level(self, size: int) -> int:
        """The level to fill, 0 for a new window; ties to the fullest."""
        c, w = self.counts, self.window
        had = np.flatnonzero(c[1 : w - size + 1]) + 1
        if not len(had):
            return 0
        cost = 2 * (np.where(had + size < w, c[np.minimum(had + size, w)], -0.5) - c[had]) + 2
        best = len(had) - 1 - int(np.argmin(cost[::-1]))
        return int(had[best]) if cost[best] <= 2 * c[size] + 1 else 0

    def put(self, piece: tuple, h: int) -> Iterator[tuple]:
        pieces = []
        if h:
            pieces = self.levels[h].pop()
            self.counts[h] -= 1
            self.held -= 4 * h
        pieces.append(piece)
        h += len(piece[2]) // 4
        if h == self.window:
            yield from self.emit(pieces)
        else:
            self.levels.setdefault(h, []).append(pieces)
            self.counts[h] += 1
            self.held += 4 * h

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, w = len(ids) // 4, self.window
        whole = total // w * w
        for at in range(0, whole, w):
            yield from self.emit([(doc, at, ids[4 * at : 4 * (at + w)], total)])
        if whole < total:
            yield from self.put((doc, whole, ids[4 * whole :], total), self.level(total - whole))
        if self.held > self.open_bytes:
            yield from self.drained()

    def cut(self, pieces: list, sizes: Iterator[int]) -> Iterator[list]:
        """The pieces in runs of the given sizes, cut where a run ends; what is left at last comes short."""
        now, room = [], next(sizes)
        for doc, start, ids, total in pieces:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                now.append((doc, start, part, total))
                start, room = start + len(part) // 4, room - len(part) // 4
                if not room:
                    yield now
                    now, room = [], next(sizes)
        if now:
            yield now

    def drained(self) -> Iterator[tuple]:
        """Full windows of all open ones laid end to end; the rest is the only window left open."""
        rest = [p for h in sorted(self.levels, reverse=True) for pieces in self.levels[h] for p in pieces]
        self.levels, self.held = {}, 0
        self.counts[:] = 0
        for pieces in self.cut(rest, repeat(self.window)):
            h = sum(len(p[2]) // 4 for p in pieces)
            if h == self.window:
                yield from self.emit(pieces)
            else:
                self.levels, self.held = {h: [pieces]}, 4 * h
                self.counts[h] = 1

    def finish(self) -> Iterator[tuple]:
        yield from self.drained()
        for h, (pieces,) in self.levels.items():
            for part in self.cut(pieces, chain((1 << k for k in range(h.bit_length() - 1, -1, -1) if h >> k & 1), repeat(1))):
                yield from self.emit(part)
        self.levels, self.held = {}, 0
        self.counts[:] = 0


_tokenizers: dict[str, WordTokenizer] = {}


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer, packer = _tokenizers[path], SumOfSquares(window)
    task = TaskContext.get()
    packer.sequence = (task.partitionId() if task else 0) << 40
    end = np.array([END_ID], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    for b in batches:
        rows: list[tuple] = []
        for k in range(0, b.num_rows, 200):
            part = b.slice(k, 200)
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode_batch(texts)):
                rows += packer.add(doc, ids + end)
        if rows:
            yield batch(rows)
    if rows := list(packer.finish()):
        yield batch(rows)


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence of at most window tokens.

    Each input partition packs its own documents in their order, so there is no shuffle and a lost
    task is redone alike; sequence_id is the partition's number times 2**40 plus a count. A null or
    empty text is the end id alone; a document with a null id keeps its place with a null id;
    repeated rows are packed each; an empty table gives no row; other columns are ignored.
    """
    path = path or tokenizer_path()
    return map_arrow(docs.select("doc_id", "text"), lambda it: pack_batches(it, path, window), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
