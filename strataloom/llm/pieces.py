"""SentencePiece encoding and decoding by suffix-array matching of all pieces against a batch's text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

SPACE = "▁"
LONGEST = 16
CACHE_WORDS = 250_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class SuffixArray:
    """The suffixes of a text in order of their first LONGEST characters, by prefix doubling on packed characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes = np.concatenate([codes, np.zeros(LONGEST, codes.dtype)])
        _, rank = np.unique(self.codes, return_inverse=True)
        rank = rank.astype(np.int64)
        width = 1
        while width < LONGEST:
            key = rank[:n] * (len(rank) + 1) + np.concatenate([rank, np.zeros(width, np.int64)])[width : width + n]
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]]) + 1 if n else np.zeros(0, np.int64)
            rank = np.zeros(n + LONGEST, np.int64)
            rank[order] = new
            width *= 2
        self.order = order if n else np.zeros(0, np.int64)

    def ranges(self, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the order the suffixes that begin with each piece stand; all pieces are searched at once."""
        out = []
        steps = int(np.ceil(np.log2(len(self.order) + 1))) + 1
        for upper in (False, True):
            lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(self.order))
            for _ in range(steps):
                open_ = lo < hi
                mid = (lo + hi) // 2
                at = self.order[np.minimum(mid, len(self.order) - 1)]
                sign = np.zeros(len(pieces), np.int8)
                live = open_.copy()
                for c in range(pieces.shape[1]):
                    live &= c < sizes
                    k = np.flatnonzero(live)
                    if not len(k):
                        break
                    text, piece = self.codes[at[k] + c], pieces[k, c]
                    differs = text != piece
                    d = k[differs]
                    sign[d] = np.where(text[differs] < piece[differs], -1, 1)
                    live[d] = False
                right = open_ & ((sign < 0) | (upper & (sign == 0)))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            out.append(lo)
        return out[0], out[1]


class PieceCoder:
    """Ids of whole texts as the model's own byte-pair merging gives them, and texts of ids.

    A batch's words that aren't cached are laid end to end under a suffix array. Every piece is
    searched for in it by bisection, which gives all edges (start, end, piece). Edges are sorted by
    end and relaxed forward: a position's last piece is the one whose start is reached by a piece
    that merging leaves unmerged before it. Merging is decided by adjacent pieces, so that path is
    unique and is the merge result; a pair's verdict comes from merging the pair and is kept.
    Characters without a piece become byte pieces.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: model.get_score(i) for i in normal}
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.size = n
        byte_of = {i: b for b, i in self.byte.items()}
        live = frozenset(normal)
        self.bytes = [bytes([byte_of[i]]) if i in byte_of else t.replace(SPACE, " ").encode() if i in live else b"" for i, t in enumerate(self.text)]
        long = [i for i in normal if len(self.text[i]) > 1]
        self.long = np.array(long)
        self.sizes = np.array([len(self.text[i]) for i in long])
        self.matrix = np.zeros((len(long), max([1, *self.sizes])), np.uint32)
        for row, i in enumerate(long):
            self.matrix[row, : len(self.text[i])] = np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the best-scored neighbours, the leftmost of equals, until no two make a piece."""
        symbols = list(symbols)
        while len(symbols) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(symbols, symbols[1:])]
            k = max(range(len(scores)), key=scores.__getitem__)
            if scores[k] == -np.inf:
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves piece left before piece right as they are; left -1: the word's start."""
        a = self.text[left] if 0 <= left < self.size else ""
        b = self.text[right] if right < self.size else ""
        if not b:  # a character without a piece never merges
            return True
        return self.merge([*a, *b]) == ([a, b] if a else [b])

    def segment(self, new: list[str]) -> Iterator[bytes]:
        """The ids of each word, all words at once."""
        if not new:
            return
        joined = "".join(new)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes) - sizes
        index = SuffixArray(codes)
        lo, hi = index.ranges(self.matrix, self.sizes)
        count = hi - lo
        piece = np.repeat(np.arange(len(lo)), count)
        at = index.order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        size, ids = self.sizes[piece], self.long[piece]
        ends = np.repeat(starts + sizes, sizes)  # of each character's word: pieces don't cross words
        inside = at + size <= ends[at]
        at, size, ids = at[inside], size[inside], ids[inside]
        alphabet, which = np.unique(codes, return_inverse=True)
        single = np.array([self.id.get(chr(c), self.size + c) for c in alphabet.tolist()])[which]
        at, size, ids = np.concatenate([at, np.arange(n)]), np.concatenate([size, np.ones(n, np.int64)]), np.concatenate([ids, single])
        order = np.argsort((at + size) * (LONGEST + 1) + LONGEST - size, kind="stable")
        last, back = [-2] * (n + 1), [0] * (n + 1)
        begins = [False] * (n + 1)
        for s in starts.tolist():
            begins[s] = True
        pairs, limit = self.pairs, self.size + 0x110000
        for s, e, t in zip(at[order].tolist(), (at + size)[order].tolist(), ids[order].tolist()):
            if back[e] or last[e] != -2:
                continue
            left = -1 if begins[s] else last[s]
            if left == -2:
                continue
            key = (left + 1) * limit + t
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.fits(left, t)
            if ok:
                last[e], back[e] = t, e - s
        for s, k in zip(starts.tolist(), sizes.tolist()):
            e, out = s + k, []
            while e > s:
                out.append(last[e])
                e -= back[e]
            ids_: list[int] = []
            for t in out[::-1]:
                if t < self.size:
                    ids_.append(t)
                else:
                    ids_ += [self.byte.get(x, self.unknown) for x in chr(t - self.size).encode()] if self.byte else [self.unknown]
            yield np.array(ids_, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Words without the first of the spaces that lead each; pieces don't hold a space after another character."""
        if not text:
            return []
        parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:
            if p:
                out.append(SPACE * run + p)
                run = 0
            else:
                run += 1
        return [*out, SPACE * (run - 1)] if run else out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.young) > self.cache_words:
            self.old, self.young = self.young, {}
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        young, old, new = self.young, self.old, []
        for w in set().union(*split):
            if w not in young:
                if (found := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = found
        young.update(zip(new, self.segment([SPACE + w for w in new])))
        return [b"".join(map(young.__getitem__, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before a text goes; broken bytes become U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row; no shuffle. Null and empty texts have no ids; other columns are ignored."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = coder(path).encode_batch([t or "" for t in b.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            at = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids). Null ids give a null text, ids out of range raise IndexError."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else coder(path).decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(coded.select("doc_id", "ids"), run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids) and restored: whether decoding gives the text again.

    U+2581 in a text comes back as a space, as in the model's own library, and counts as restored.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            c = coder(path)
            got = c.encode_batch(texts)
            same = [c.decode(np.frombuffer(g, "<u4")) == t.replace(SPACE, " ") for g, t in zip(got, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) // 4 for g in got], pa.int64()), pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "restored"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, restored boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
