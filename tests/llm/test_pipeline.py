"""The pipeline's stages against brute-force versions on the smallest tables."""

import re

import corpus_pipeline
import pytest
from textloom.llm import langid, minhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append({r["doc_id"]: r for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append({r["doc_id"]: r for r in docs.collect()})
    return out


def test_columns_stay(stages):
    for rows in stages[:-1]:
        assert {tuple(r.asDict()) for r in rows.values()} == {("doc_id", "text", "lang", "source", "n_chars")}


def test_language_keeps_clean_documents(spark, stages):
    lost = set(stages[0]) - set(stages[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert lost == {r["doc_id"] for r in found if r["lang_pred"] == "und" or r["score"] < 0.5}
    assert all(len(re.findall(r"[^\W\d_]+", stages[0][i]["text"] or "")) < 5 for i in lost)


def test_exact_copies(stages):
    best = {}
    for i, r in stages[1].items():
        best[r["text"] or ""] = max(i, best.get(r["text"] or "", -1))
    assert set(stages[2]) == set(best.values())


def test_near_copies(stages):
    sets = {i: minhash.shingle_set(r["text"] or "", 5) for i, r in stages[2].items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(stages[3]) == {i for i in ids if find(i) == i}


def test_leaks(spark, stages):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in stages[3].items():
        w = words(r["text"])
        grams = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        share = max(sum(tuple(x[j : j + 5]) in grams for j in range(len(x) - 4)) / max(1, len(x) - 4) for x in items)
        assert (i in stages[4]) == (share < 0.5), (i, share)


def test_tokens(stages):
    import hashlib

    assert set(stages[5]) == set(stages[4])
    for i, r in stages[5].items():
        assert r["decoded_sha256"] == hashlib.sha256((stages[4][i]["text"] or "").encode()).hexdigest()
