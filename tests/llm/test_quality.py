"""The quality classifier: neighbours by brute force, edge cases, held-out accuracy through the registered query."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import quality, queries

SF = "/root/testdata/sf0.01"
GOOD = ["the river runs past the old mill and the green hills", "a small boat was seen near the harbour at dawn"]
BAD = ["buy!!! now### cheap### deal!!! click!!!", "win### cash!!! free!!! now### now###"]


def test_vote_equals_a_loop():
    rng = np.random.default_rng(1)
    for ties in (False, True):
        model = quality.unit(rng.integers(-2, 3, (60, 3)).astype(np.float32) if ties else rng.standard_normal((60, 8)).astype(np.float32))
        labels = rng.integers(0, 2, 60).astype(np.float32)
        rows = model[rng.integers(0, 60, 700)]
        got = quality.vote(rows, model, labels, 0.7, neighbours=5)
        cosines = rows @ model.T
        for i in range(len(rows)):
            near = sorted(range(60), key=lambda j: (-cosines[i, j], j))[:5]
            w = [max(float(cosines[i, j]), 0) for j in near]
            want = sum(a * float(labels[j]) for a, j in zip(w, near, strict=True)) / sum(w) if sum(w) else 0.7
            assert abs(got[i] - want) < 1e-6


def test_latent_finds_the_largest_singular_vectors():
    x = np.random.default_rng(2).standard_normal((40, 30)).astype(np.float32) * np.geomspace(20, 0.1, 30, dtype=np.float32)
    v = quality.latent(x, 4)
    want = np.linalg.svd(x, full_matrices=False)[2][:4]
    assert np.allclose(np.abs((v.T * want).sum(axis=1)), 1, atol=1e-3)


def test_small_tables(spark):
    rows = [(i, (GOOD if i % 2 else BAD)[i // 2 % 2] + f" w{i % 3}", i % 2, "x") for i in range(40)]
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows] + [(None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(100, None, 0, "x"), (101, "", 0, "x"), (None, BAD[0], 0, "x"), (3, GOOD[0], 1, "x"), (102, "日本 \U0001f600", 0, "x"), (103, GOOD[0] * 20_000, 0, "x")], "doc_id long, text string, score int, places string")
    model = quality.fit(quality.labelled_sample(docs, labels))
    got = quality.score(docs, model).collect()
    assert len(got) == 46 and got[0].__fields__ == ["doc_id", "score"]
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert len(by_id[3]) == 2 and by_id[None][0] < 0.3
    assert all(by_id[i][0] < 0.3 if i % 2 == 0 else by_id[i][0] > 0.7 for i in range(40))
    assert by_id[100] == by_id[101] == by_id[102] == [model.base] and by_id[103][0] > 0.7
    empty = quality.fit(quality.labelled_sample(docs.limit(0), labels))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.labelled_sample(docs, labels, max_docs=7).count() == 7


def test_registered_query_held_out(spark):
    found = queries.op11_quality(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) and len(held) > 50
