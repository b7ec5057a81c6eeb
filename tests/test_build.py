from pyspark.sql import functions as F

from textloom import config
from textloom.operators import enrich
from textloom.operators.ingest import write_chunks
from textloom.plans import build
from textloom.schema import normalize_chunks
from textloom.sources import paths


def test_build_chunks(spark, tmp_path):
    words = " ".join(f"river{i}" for i in range(700))
    rows = [(0, words, "gita one", "en"), (1, "   ", "x", "en"), (2, "short text of a few words but over thirty", None, "si"), (3, words, "gita one", "en")]
    raw = spark.createDataFrame(rows, "pos int, text string, section string, language string").repartition(3)
    plan = build.Build(config.domain("Hinduism"), labels={"gita one": "Gita"}, preambles=[("gita", "A poem.")], synonyms=[(["river"], "water")], quality=True)
    got = build.build_chunks(raw, plan).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3] and [r["book"] for r in got] == ["Gita"] * 3 + ["unknown"]
    assert got[0]["embed_text"] == f"A poem. Scripture: Gita. {got[0]['text']} water"
    assert got[3]["embed_text"].startswith("Scripture: unknown. short text") and got[3]["language"] == "si"
    write_chunks(build.build_chunks(raw, plan), str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert "embed_text" not in stored.columns and normalize_chunks(stored, "Hinduism").where("language = 'si'").count() == 1


def test_merge_sections(spark):
    a = spark.createDataFrame([("x", "en")], "text string, language string")
    b = spark.createDataFrame([("y",)], "text string")
    assert sorted(map(tuple, build.merge_sections(a, b).select("source_no", "text", "language").collect())) == [(0, "x", "en"), (1, "y", None)]


def test_paths(spark):
    files = spark.createDataFrame([("/r/si/mark/02.htm",), ("/r/si/mark3.htm",), ("/r/old/mark/x/3.html",), ("/r/old/mark/x/4.html",)], "path string")
    wanted = spark.createDataFrame([("si", "mark", n) for n in (2, 3, 4, 5)], "language string, book string, chapter int")
    got = {r["chapter"]: r["path"] for r in paths.locate_chapters(wanted, files).collect()}
    assert got == {2: "/r/si/mark/02.htm", 3: "/r/si/mark3.htm", 4: "/r/old/mark/x/4.html", 5: None}
    row = spark.range(1).select(paths.language_code(F.lit("Tamil")).alias("a"), paths.verse_url("http://x/{book}/{chapter}", F.lit("1 John"), F.lit(2)).alias("b")).first()
    assert tuple(row) == ("ta", "http://x/1+John/2")


def test_chapter_files_by_names(spark):
    names = [
        "/r/SI/Mark/002.HTM",  # case aside, leading zeros
        "/r/si/psalm119.htm",  # book "psalm" or "psalm1"
        "/r/si/1john3.html",
        "/x/1john/y/z/12.html",
        "/r/ta/1john/03.htm",
        "/r/ta/1john3.htm",  # the folder comes first
        "/r/si/a.b(c/7.htm",  # signs of patterns are plain text
        "/r/si/axb(c/8.htm",
        "/r/si/mark/x.htm",
    ]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    wanted = [("si", "mark", 2, 0), ("si", "psalm", 119, 1), ("si", "psalm1", 19, 1), ("si", "1john", 3, 2), ("si", "1john", 12, 3), ("ta", "1john", 3, 4), ("si", "a.b(c", 7, 6), ("si", "a.b(c", 8, None), ("en", "1john", 3, 4)]
    table = spark.createDataFrame([w[:3] for w in wanted], "language string, book string, chapter int")
    got = {tuple(r)[:3]: r["path"] for r in paths.locate_chapters(table, files).collect()}
    assert got == {w[:3]: None if w[3] is None else names[w[3]] for w in wanted}


def test_verses_are_assembled_in_order(spark):
    texts = [(0, "1", "en", "first"), (1, " 1 ", "en", "second"), (2, "2", "hi", "no"), (3, "2", None, " only "), (4, "3", "English", "a"), (5, "3", "en", "b"), (6, "3", "en", "c"), (7, "9", "en", "no verse")]
    rows = spark.createDataFrame([(*t, t[3] in ("second", "a", "b")) for t in texts], "pos int, id string, language string, text string, good boolean").repartition(3)
    verses = spark.createDataFrame([("3", "2", "1"), ("1", "1", "10"), ("2", "1", "9"), ("4", "1", "1")], "id string, chapter string, verse string")
    got = [r["line"] for r in enrich.assemble_verses(rows, verses, F.col("good")).collect()]
    assert got == ["Chapter 1, Verse 9: only", "Chapter 1, Verse 10: second", "Chapter 2, Verse 1: b"]


def test_merged_lookups(spark):
    tables = [spark.createDataFrame(t, "k string, v int") for t in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)], [("c", 5)])]
    assert sorted(map(tuple, enrich.merge_lookups(*tables, key="k").collect())) == [("a", 1), ("b", 3), ("c", 5)]
