import random
import zlib

import numpy as np
import pytest
import sentencepiece

from strataloom.llm import pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.model_path(), cache_words=200)


def test_ids_are_the_models(model, coder):
    rng = random.Random(3)
    texts = ["", " ", "a", "  a  b ", "a\nb", "héllo ▁x", "\t\xa0x", "日本😀", "<s> </s> <unk> <0x41>", " " * 50 + "x" + " " * 17 + "y  ", "\x00a", "123 4"]
    texts += ["".join(rng.choice("abcdeinthrs  \n▁é日😀.,12") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        for text, got in zip(part, coder.encode_batch(part)):
            ids = np.frombuffer(got, "<u4")
            assert ids.tolist() == model.encode(text), text
            assert coder.decode(ids) == text.replace("▁", " ")


def test_suffix_array_ranges():
    text = "banana bandana"
    index = pieces.SuffixArray(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    names = ["an", "ban", "na", "zz", "a"]
    matrix = np.zeros((len(names), 3), np.uint32)
    for i, n in enumerate(names):
        matrix[i, : len(n)] = [ord(c) for c in n]
    lo, hi = index.ranges(matrix, np.array([len(n) for n in names]))
    for n, a, b in zip(names, lo, hi):
        assert sorted(index.order[a:b].tolist()) == [i for i in range(len(text)) if text.startswith(n, i)]


def test_query(spark, sf, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op7_sentencepiece(spark, sf).collect():
        ids = np.array(model.encode(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32, r.restored) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_encode_and_decode(spark, odd_docs, no_docs):
    coded = pieces.encode(odd_docs)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(coded).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=str)
    assert pieces.encode(no_docs).collect() == [] and pieces.digests(no_docs).collect() == []
