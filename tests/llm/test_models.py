import zlib

import numpy as np

from strataloom.llm import langid, toxicity


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op9_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.rejected for r in held]) < 0.02


def test_words_and_texts_score_alike():
    texts = ["der die das ist gut", "the cat is on it", "", "123 --", "das der ist", None]
    model = langid.fit(["der die und das ist nicht"] * 30 + ["the of and is it that"] * 30, ["de"] * 30 + ["en"] * 30, langid.Settings())
    scorer = langid.Scorer(model)
    langs, score = scorer.score(texts)
    assert langs[:2] == ["de", "en"] and [langs[i] for i in (2, 3, 5)] == ["und"] * 3 and score[2] == 0
    for t, p in zip(texts[:2], score):
        (at, share), = langid.counted([t], model.settings)
        assert abs(langid.softmax((share @ model.logits[at] + model.bias) / model.temperature).max() - p) < 1e-5


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert model.labels == []
    rows = langid.identify(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == 10 and all(r["__lang"] == "und" and r["__rejected"] for r in rows)
    assert langid.keep(no_docs).collect() == [] and langid.keep(odd_docs).columns == odd_docs.columns


def test_toxicity_learns_words(spark):
    good = [f"a{i % 7} b{i % 5} c{i % 3} d" for i in range(400)]
    bad = [f"a{i % 7} you idiot, b{i % 5} c" for i in range(100)]
    s = toxicity.Settings()
    model = toxicity.fit([toxicity.features(t, s.bits) for t in good + bad], np.r_[np.zeros(400), np.ones(100)], s)
    got = toxicity.scores(["a1 IDIOT! b2 you", "a1 b2 c1 d", "", None], model)
    assert got[0] > 0.7 and got[1] < 0.3 and got[2] == got[3] and len(model.at) < 200


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hit = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    false = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.01


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (None, 1), (5, None), (99, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).collect() == []
