import random
import re
from collections import Counter

from strataloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)

    def cover(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        at = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        top = max((k * sum(map(len, g)) for g, k in c.items() if k > 1), default=0)
        return len(at), sum(len(w[j]) for j in at), top

    out |= {"n_dup_lines": dup, "dup_line_chars": dup_chars, "n_repeat_words": cover(3)[0]}
    out |= {"top": [cover(n)[2] for n in (2, 3, 4)], "dup": [cover(n)[1] for n in (5, 6, 7, 8, 9, 10)]}
    return out


def test_measures_match_brute_force(spark, sf):
    rng = random.Random(1)
    texts = [None, "", " \n\x0b", "a", "é é x é é x\n\n\né é x é é x", *("".join(rng.choice(["a ", "b ", "c\n", "é# "]) for _ in range(rng.randint(0, 80))) for _ in range(200))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = quality.measure(texts, quality.RepetitionRules())
    for i, t in enumerate(texts):
        want = brute(t)
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"):
            assert got[k][i] == want[k], (k, t)
        assert got["top_chars"][i].tolist() == want["top"] and got["dup_chars"][i].tolist() == want["dup"], t


def test_verdicts(spark, sf):
    rows = quality.op3_quality_rules(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_odd_rows(odd_docs, no_docs):
    rows = quality.assess(odd_docs).collect()
    assert len(rows) == 10 and all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert quality.assess(no_docs).collect() == []
    assert quality.keep(odd_docs).columns == odd_docs.columns
    assert sorted(r.doc_id for r in quality.keep(odd_docs).collect()) == [6, 7]
