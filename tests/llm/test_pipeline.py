import re

import corpus_pipeline
from strataloom.llm import quality
from strataloom.llm.common import table
from tests.llm.test_jaccard import brute


def test_stages_follow_each_other(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        found = out.collect()
        ids = {r.doc_id for r in found}
        assert len(ids) == len(found) and ids <= kept
        if name != "substrings":
            assert all(r == rows[r.doc_id] for r in found)
        kept, docs = ids, spark.createDataFrame(found, docs.schema)
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert 0.4 * len(rows) < len(kept) < len(rows) and labels
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs.columns
    assert docs.count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").collect() == []


def test_middle_stages_against_brute_force(spark, sf):
    """Near duplicates and substrings of all documents: what stays, and that no run of 50 words stays twice."""
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.repetition(spark, docs, sf).select("doc_id").collect()}
    rules = quality.measure([t for _, t in rows], quality.RepetitionRules())["kept"]
    assert kept == {d for (d, _), k in zip(rows, rules) if k}
    left = corpus_pipeline.near_duplicates(spark, docs, sf)
    left = spark.createDataFrame(left.collect(), docs.schema)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, n, least in brute(rows, 5, 80, 100) if not n or d == least)
    seen: dict[tuple, int] = {}
    for r in corpus_pipeline.substrings(spark, left, sf).collect():
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        for i in range(len(words) - 49):
            assert seen.setdefault(tuple(words[i : i + 50]), r.doc_id) == r.doc_id


def test_rows_of_one_id(spark, sf):
    """Rows that share an id but no link both stay; equal rows are one."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(1, texts["a"], "en", "s", 1), (1, texts["b"], "en", "s", 1), (1, texts["a"], "en", "s", 1), (2, texts["b"], "en", "s", 1), (3, texts["c"], "en", "s", 1), (None, texts["c"], "en", "s", 1)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, texts["a"]), (1, texts["b"]), (3, texts["c"]), (None, texts["c"])], key=str)
