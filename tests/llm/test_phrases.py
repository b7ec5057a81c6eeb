"""Phrase mining against loops over whole small corpora, with border failures and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, most):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(zip(*(w[i:] for i in range(m)), strict=False))
    return f, n


def brute(docs, most, least, share, top):
    f, n = counted(docs, most)
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def random_docs(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "c", "dé", "É", "\x1cx", "\xa0", "日本", "x-y", "...", "B"]
    docs = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 25))
        docs.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "? ", "\x0b"]) for w in words), rng.choice(["en", "fr", None, ""])))
    return docs + docs[:20] + [(None, "en"), ("", None), ("a b " * 5000, "en"), ("  \t\n.,", "xx")]


@pytest.mark.parametrize(("seed", "most", "least", "share", "top", "sample", "bits"), [(1, 3, 10, 50, 2000, 4, 1 << 16), (2, 4, 5, 50, 7, 3, 1 << 20), (3, 3, 2, 90, 30, 50, 128), (4, 2, 3, 50, 2000, 2, 1 << 12)])
def test_equals_loops(spark, seed, most, least, share, top, sample, bits):
    docs = random_docs(seed)
    table = spark.createDataFrame([(i, t, x, "r", -1) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string, rank string, n int").repartition(3)
    got = phrases.collocations(table, most=most, least=least, share=share, top=top, sample=sample, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, most, least, share, top)


def test_border_failures_lead_to_further_passes(spark):
    """The sample has none of the words: all that is frequent is found by failures, a length a pass."""
    docs = [("x y z w", "en")] * 6
    table = spark.createDataFrame(docs, "text string, lang string")
    found, passes = phrases.mine(table, most=4, least=5, sample=1 << 30, bits=1 << 12)
    f, n = counted(docs, 4)
    assert passes == 4
    assert {(r["phrase"], r["words"]): r["n"] for r in found.collect()} == {(" ".join(p), len(p)): a for p, a in f["en"].items()} | {("", 0): n["en"]}


def test_everything_sampled_takes_one_pass(spark):
    table = spark.createDataFrame(random_docs(5), "text string, lang string")
    assert phrases.mine(table, least=3, sample=1, bits=1 << 20)[1] == 1


def test_large_numbers_stay_exact(spark, monkeypatch):
    """Products beyond 64 bits, by counts that no table here could hold."""
    big = 3 * 10**12
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7), ("en", "", 0, 9 * big)]
    monkeypatch.setattr(phrases, "mine", lambda docs, *_: (spark.createDataFrame(rows, "lang string, phrase string, words int, n long"), 1))
    got = phrases.collocations(spark.createDataFrame([("", "en")], "text string, lang string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, big + 1, big + 7, 9 * big, 10**6 * big * big // ((big + 1) * (big + 7)))]


def test_empty_tables(spark):
    table = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(table).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_filters_hold_what_they_were_built_from(spark):
    words = [("en", f"w{i}", 1) for i in range(500)] + [("fr", f"w{i} w{i + 1}", 2) for i in range(500)]
    table = spark.createDataFrame(words, "lang string, phrase string, words int")
    first = phrases.build_filters(table.where("words = 1"), 3, 1 << 14)
    both = phrases.build_filters(table.where("words = 2"), 3, 1 << 14, first)
    import xxhash

    h = lambda lang, w: xxhash.xxh3_64_intdigest(w.encode(), xxhash.xxh3_64_intdigest(lang))
    own = np.array([h("en", f"w{i}") for i in range(500)], np.uint64)
    assert phrases._holds(first[0], own).all() and phrases._holds(both[0], own).all() and not first[1].any()
    a, b = (np.array([h("fr", f"w{i + d}") for i in range(500)], np.uint64) for d in (0, 1))
    assert phrases._holds(both[1], phrases._longer(a, b)).all()
    others = np.array([h("de", f"w{i}") for i in range(500)], np.uint64)
    assert phrases._holds(first[0], others).mean() < 0.05


def test_registered_query_is_its_operator(spark):
    assert queries.QUERIES["op13_collocations"] is queries.op13_collocations and "op13_collocations" in queries.ORACLE_SQL
