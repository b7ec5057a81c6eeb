import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunk, clean, enrich


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_white_space_is_pythons(spark):
    texts = ["", " ", "a", " a b　", "a\x1cb\x85c", "\x0ba\tb\n", "a​b", " x   y"]
    df = column(spark, texts)
    assert values(df, T.words("v")) == [t.split() for t in texts]
    assert values(df, T.strip("v")) == [t.strip() for t in texts]
    assert values(df, T.collapse("v")) == [" ".join(t.split()) for t in texts]


def test_scripts_and_ratio(spark):
    df = column(spark, ["", "abc", "aඅ", "அஆxx", "x" * 19 + "अ", "x" * 20 + "अ"])
    assert values(df, T.has_script("v", "si")) == [False, False, True, False, False, False]
    assert [round(x, 3) for x in values(df, T.class_ratio("v", T.script_class(["devanagari", "ta"])))] == [0, 0, 0, 0.5, 0.05, 0.048]
    assert values(df, clean.is_foreign(F.col("v"))) == [False, False, False, True, True, False]


def test_roman_and_names(spark):
    df = column(spark, ["IV", "xx", "XXI", "", None])
    assert values(df, T.roman_value(F.col("v"))) == [4, 20, None, None, None]
    assert values(column(spark, ["a b/c", "é.x"]), T.safe_name("v")) == ["a_b_c", "é_x"]


def test_replacements_are_in_order(spark):
    assert values(column(spark, ["aab"]), T.replace_all(F.col("v"), [("a", "b"), ("bb", "c")])) == ["cb"]


def python_windows(text, size, overlap, least):
    words, out = text.split(), []
    for n, i in enumerate(range(0, len(words), size - overlap)):
        piece = " ".join(words[i : i + size])
        if len(piece) > least:
            out.append((n, piece))
    return out


@pytest.mark.parametrize("size,overlap,least", [(400, 80, 40), (7, 3, 10), (5, 0, 0)])
def test_windows_equal_a_plain_loop(spark, size, overlap, least):
    rng = random.Random(size)
    texts = [None, "", "  "] + [" ".join("w" * rng.randint(1, 9) for _ in range(n)) for n in (1, 319, 320, 321, 400, 401, 720)]
    got = chunk.word_windows(column(spark, texts), size, overlap, least, text="v").collect()
    want = [(i, n, p) for i, t in enumerate(texts) for n, p in python_windows(t or "", size, overlap, least)]
    assert sorted(map(tuple, got)) == want
    with pytest.raises(ValueError):
        chunk.word_windows(column(spark, texts), 5, 5, 0, text="v")


def test_dense_ids_compute_their_input_once(spark):
    """Ranges drawn twice, from two samples, may differ: then ids repeat and skip."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def word(i):
        seen.add(1)
        return str(i)

    got = chunk.dense_ids(spark.range(0, 1000, 1, 4).select(F.col("id").alias("x"), word("id").alias("t")), "x").collect()
    assert sorted(tuple(r) for r in got) == [(i, i, str(i)) for i in range(1000)] and seen.value == 1000


def test_dense_ids_beyond_samples(spark):
    """Ranges are drawn from samples of larger tables: counts and places must come from the same ones."""
    rows = spark.range(0, 30_000, 1, 4).select(F.xxhash64("id").alias("pos"), F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 5)).alias("text"))
    rows = rows.groupBy("pos").agg(F.first("text").alias("text"))
    got = chunk.dense_ids(chunk.word_windows(rows, 3, 1, 1), "pos", "chunk_no").select("id", "pos", "chunk_no").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["pos"], r["chunk_no"]))] == list(range(len(got)))


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("y"))
    got = chunk.dense_ids(df, "x").collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and all(r["id"] == r["x"] for r in got)
    assert chunk.dense_ids(df.limit(0), "x").count() == 0


def test_funnel_counts_each_row_once(spark):
    long = "some words that are long enough to stay here"
    texts = ["short", long, f"  {long} ", "copyright " + long, "अ" * 40, None, long]
    got = {r["i"]: r["reason"] for r in clean.funnel(column(spark, texts), "i", text="v").collect()}
    assert got == {0: "too_short", 1: "passed", 2: "duplicate", 3: "boilerplate", 4: "non_english", 5: "too_short", 6: "duplicate"}


def test_distinct_first_and_urls(spark):
    df = column(spark, ["http://A/b/?q=1", "http://a/b", "http://a/c//", "http://a/c"])
    got = clean.distinct_first(df, clean.canonical_url(F.col("v")), "i").collect()
    assert sorted((r["i"], r["v"]) for r in got) == [(0, "http://A/b/?q=1"), (2, "http://a/c//")]


def test_rules(spark):
    df = column(spark, ["X Upper y", "the lower case", "nothing", None])
    keys = [("up", "first"), ("upper", "second"), ("lower", "third"), ("LOWEX", "no"), ("x upp", "tie")]
    assert values(df, enrich.longest_key_rule(F.col("v"), keys)) == ["second", "third", "", ""]
    rules = [("b", 1, 5, "one"), ("b", 3, 9, "two")]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate([("b", 0), ("b", 1), ("b", 5), ("b", 6), ("c", 3), ("b", 10)])], "i int, v string, c int")
    assert values(rows, enrich.first_range_rule(F.col("v"), F.col("c"), rules)) == ["", "one", "one", "two", "", ""]
    assert values(column(spark, ["since", "none"]), enrich.expand_synonyms(F.col("v"), [(["sin"], "wrong"), (["nce", "zz"], "ends")])) == ["wrong ends", ""]
    assert values(df, enrich.label(F.col("v"), {"nothing": "N"}, "D")) == ["D", "D", "N", "D"]


def test_best_version(spark):
    rows = [(1, 0, False), (1, 1, False), (2, 0, False), (2, 1, True), (3, 0, True), (3, 1, True), (4, 0, True), (4, 1, False)]
    df = spark.createDataFrame(rows, "k int, pos int, liked boolean")
    got = {r["k"]: r["pos"] for r in enrich.best_version(df, "k", "pos", F.col("liked")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}
