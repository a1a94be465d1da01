import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataloom.llm import packing


def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_words_give_the_tokenizers_ids():
    rng = random.Random(5)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \n b\t c", "x y z", "don't <|endoftext|> stop", "<|endoftext|>", "a<|endoftext|>b c d", "a  <|endoftext|>", "é日本 😀 ok", "a\x1cb c\x85 d"]
    texts += ["".join(rng.choice("abc  \n\t.'é1") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    t, own = tokenizer(), packing.WordTokenizer(packing.tokenizer_path(), cache_words=50)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        for text, got in zip(part, own.encode_batch(part)):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def held(rows, window):
    """Every sequence is gapless from 0 and within the window; every document's pieces cover it once."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r[5]].append((r[6], r[2]))
        by_doc[r[0]].append((r[1], r[2], r[4]))
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return by_doc, pad, total


def level_by_hand(counts, size, window):
    """The least sum of squares over every level, all counted anew; ties to the fullest level, a new window last."""
    best = None
    for h in [x for x in range(window - size, 0, -1) if counts[x]] + [0]:
        after = list(counts)
        after[h] -= h > 0
        if h + size < window:
            after[h + size] += 1
        squares = sum(c * c for c in after[1:window])
        if best is None or squares < best[0]:
            best = (squares, h)
    return best[1]


def test_every_placement_is_the_least_sum_of_squares():
    rng = random.Random(3)
    p = packing.SumOfSquares(32)
    for i in range(2000):
        size = rng.choice([1, 5, 7, 11, 16, 17, 31])
        assert p.level(size) == level_by_hand(p.counts.tolist(), size, 32)
        list(p.add(i, np.zeros(size, "<u4").tobytes()))


@pytest.mark.parametrize("open_bytes", [packing.OPEN_BYTES, 700])
def test_packer_is_a_round_trip_without_padding(open_bytes):
    rng = random.Random(2)
    p = packing.SumOfSquares(64, open_bytes)
    docs = {i: np.arange(n, dtype="<u4") + 1000 * i for i, n in enumerate(rng.choice([1, 3, 20, 63, 64, 65, 200]) for _ in range(500))}
    rows = []
    for i, ids in docs.items():
        rows += p.add(i, ids.tobytes())
        assert p.held <= open_bytes + 4 * 64
    rows += p.finish()
    by_doc, pad, total = held(rows, 64)
    assert total == sum(map(len, docs.values())) and pad == 0
    for i, ids in docs.items():
        at = 0
        for start, n, whole in sorted(by_doc[i]):
            assert start == at and whole == len(ids)
            at += n
        assert at == len(ids)
    for doc, start, n, crc, *_ in rows:
        assert crc == zlib.crc32(docs[doc][start : start + n].tobytes())


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [tuple(r) for r in packing.op4_packing(spark, sf).collect()]
    by_doc, pad, total = held(rows, 2048)
    t = tokenizer()
    assert set(by_doc) == set(docs) and pad == 0
    for doc, start, n, crc, whole, *_ in rows:
        ids = np.array([*t.encode(docs[doc], add_special_tokens=False).ids, 1], "<u4")
        assert whole == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert sum(r.length == r.doc_tokens for r in rows if r.doc_id in (4, None)) >= 2
    assert packing.pack(no_docs).collect() == []
