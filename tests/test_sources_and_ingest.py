import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import ingest
from textloom.sources import html, jsonfiles, lines
from textloom.operators.ingest import read_sections
from textloom.streaming.ingest import ingest_sections, ingest_with_progress, read_ingested, reset_sections


def test_section_files(spark, tmp_path):
    (tmp_path / "1_John__si.json").write_text(json.dumps(["a", "b"]), encoding="utf-8")
    (tmp_path / "mn.json").write_bytes(b'\xef\xbb\xbf["x"]')
    (tmp_path / "bad.json").write_text("{nope", encoding="utf-8")
    (tmp_path / "latin.json").write_bytes('["é"]'.encode("latin-1"))
    got = jsonfiles.sections(jsonfiles.read_whole(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, got)) == [("1 John", "si", 0, "a"), ("1 John", "si", 1, "b"), ("latin", "en", 0, "é"), ("mn", "en", 0, "x")]


def test_nested_and_verse_documents(spark):
    nested = {"a": [{"text": " first text of fifteen "}, {"b": {"text": "second text of fifteen", "c": {"text": "third text of fifteen"}}}], "text": "short", "d": {"text": "first text of fifteen"}}
    assert jsonfiles.harvest(json.dumps(nested)) == ["first text of fifteen", "second text of fifteen", "third text of fifteen"]
    docs = spark.createDataFrame([("p", json.dumps(nested)), ("q", None), ("r", "[")], "path string, text string")
    assert jsonfiles.harvest_texts(docs).count() == 3
    verses = spark.createDataFrame([("p", '{"verses": [{"verse": 1, "text": " In "}, {"verse": 2, "text": "  "}]}')], "path string, text string")
    assert [tuple(r) for r in jsonfiles.verses(verses).collect()] == [("p", 0, "1 In")]


PARA = "This paragraph is long enough to be kept by the filters."


def test_pages(spark):
    page = (
        f'<body><nav><a href="/d/doc1?x=1">m</a></nav><p>{PARA} outside</p><div class="main Content-Body"><p>{PARA}<br>[pg 3]</p><p>Next page of this long enough paragraph here</p>'
        f'<p><a href="/d/doc1/">{PARA}</a></p><p>short</p><a href="#top/d/doc">t</a><a href="mailto:x@h/d/doc">u</a><a href="http://o/d/doc2">o</a></div></body>'
    )
    pages = spark.createDataFrame([(1, "http://h/i", page), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.paragraphs(pages).collect()] == [(1, 0, PARA)]
    assert [r["link"] for r in html.links(pages, "/d/doc").collect()] == ["http://h/d/doc1?x=1"]
    chapter = '<div><span class="verse">1</span> 1 In the <i>beginning</i><br><span class="verse">2 </span>And<span class="verse">x</span>no</div>'
    got = html.chapter_verses(spark.createDataFrame([(1, chapter)], "page_id long, html string"))
    assert [r["text"] for r in got.orderBy("pos").collect()] == ["In the beginning", "And"]


def test_paragraphs_of_the_first_container():
    texts = lambda page: [t for t, _ in html.page_paragraphs(page)]
    # The first pattern that any div matches, not the first div: class doc-body before id main-content.
    page = '<body><p>a</p><div id="main_content"><p>b</p><div class="x docbody"><p>c</p></div><p>d</p></div><div class="doc-body"><p>e</p></div></body>'
    assert texts(page) == ["c"]
    assert texts(page.replace("docbody", "").replace("doc-body", "")) == ["b", "c", "d"]
    assert texts("<p>a</p><body><p>b</p></body><p>c</p>") == ["b"] and texts("<p>a<p>b") == ["a", "b"] and texts(None) == []
    # Pieces are stripped and joined by a blank; elements that are dropped take all they hold along, blockquotes hold paragraphs.
    assert texts("<p>x <i> y</i>z<script>no</script><!-- c --> w</p>") == ["x y z w"]
    assert texts("<header><div class='doc-body'><p>no</p></div></header><blockquote>a <p>b</p> c</blockquote><footer><p>no") == ["a b c", "b"]
    assert html.page_paragraphs("<p>ab<a href=x>cde<b>fg</b></a>h<a>i</a></p></a><p>j</p>") == [("ab cde fg h i", 6), ("j", 0)]
    many = "<div><li>x" * 20_000 + "<p>end"
    assert texts(many) == ["end"]


def test_documents_of_several_pages(spark):
    def paragraph(n):
        return f"<p>Paragraph number {n}. {PARA}</p>"

    rows = [
        (1, "http://h/index", '<a href="/b?x=1">b</a><a href="/A/">a</a><a href="/none">n</a>' + paragraph(0)),
        (2, "http://h/a", paragraph(2) + paragraph(1) + paragraph(3)),
        (3, "http://h/B/", paragraph(1) + paragraph(4) + paragraph(1)),
        (4, "http://h/a/", paragraph(9)),
        (5, "http://h/lone", paragraph(7) + paragraph(7)),
        (6, "http://h/dead", '<a href="/none">n</a>' + paragraph(8)),
        (7, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.documents(pages).orderBy("doc_id", "page_no", "pos").collect()
    number = lambda r: int(r["text"].split()[2][:-1])
    found = {d: [number(r) for r in got if r["doc_id"] == d] for d in {r["doc_id"] for r in got}}
    # Pages in order of links, each paragraph once; of two pages of one address the first; a page without links as it is.
    assert found == {1: [1, 4, 2, 3], 2: [2, 1, 3], 3: [1, 4, 1], 4: [9], 5: [7, 7]}


def test_documents_query_equals_a_loop(spark):
    from textloom.plans.queries import html_documents

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    kept = {}
    for r in html.paragraphs(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        kept.setdefault(r["page_id"], []).append((r["pos"], r["text"]))
    hosts, want = {}, []
    for r in sorted(pages):
        hosts.setdefault(r["url"].split("/")[2], []).append(r["page_id"])
    for ids in hosts.values():
        seen = set()
        for i in ids:
            for pos, text in sorted(kept.get(i, [])):
                if text not in seen:
                    seen.add(text)
                    want.append((ids[0], i, pos, text))
    assert sorted(map(tuple, html_documents(spark, sf).collect())) == sorted(want) and want


def test_hymns(spark):
    text = ["BOOK I", "HYMN I. Agni.", "intro line", "1. I laud Agni, the chosen priest of all,", "God, minister.", "[note]", "see Note here", "2. Short", "BOOK 9", "HYMN VII. Indra", "3. As a good cow to him who milks, we call", "hymn C. Soma", "4. exactly twenty chars", "5. more than twenty chars"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, line_no int, text string")
    got = [r["text"] for r in lines.hymn_verses(rows).orderBy("pos").collect()]
    assert got == [
        "Rig Veda 1.1.1 (Agni): I laud Agni, the chosen priest of all, God, minister. see Note here",
        "Rig Veda 1.7.3 (Indra): As a good cow to him who milks, we call",
        "Rig Veda 1.7.5 (Indra): more than twenty chars",
    ]
    text = ["1. A verse before any hymn is left out", "HYMN II.", "1. A verse  in the   first book of all", "Page 9", "sees a Page and goes on", "abc", "[x]", "2. Note that this verse starts with a word of asides", "BOOK X", "BOOK 0", "HYMN 3. T", "4. A verse that stays in the first book"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, line_no int, text string")
    got = [r["text"] for r in lines.hymn_verses(rows).orderBy("pos").collect()]
    assert got == [
        "Rig Veda 1.2.1: A verse in the first book of all sees a Page and goes on",
        "Rig Veda 1.2.2: Note that this verse starts with a word of asides",
        "Rig Veda 1.2.4: A verse that stays in the first book",  # the heading's pattern reads no digits
    ]


def test_missing_path_has_no_files(spark, tmp_path):
    assert jsonfiles.read_whole(spark, str(tmp_path / "none")).count() == 0


def test_progress(spark):
    expected = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "key string, other string")
    done = spark.createDataFrame([("a", 3), ("B", 0)], "key string, n int")
    assert [r["key"] for r in ingest.pending(expected, done, "key", "other").collect()] == ["c"]
    assert [r["key"] for r in ingest.reset_progress(done, empty=True, keep="z").collect()] == ["a"]
    assert ingest.reset_progress(done).count() == 0 and ingest.reset_progress(done, name="a").count() == 1 and ingest.reset_progress(done, suffix="B").count() == 1
    assert [r["key"] for r in ingest.similar_keys(done, "ab").collect()] == ["a", "B"]
    again = ingest.upsert_section(done, done.where("key = 'a'").withColumn("n", F.lit(9)), "key")
    assert sorted(map(tuple, again.collect())) == [("B", 0), ("a", 9)]


def test_sections_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("x", "1"), ("y", "2")], "section string, text string")
    ingest.write_sections(rows, path)
    for _ in range(2):
        ingest.write_sections(spark.createDataFrame([("y", "3")], "section string, text string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("section", "text").collect()) == [("x", "1"), ("y", "3")]


def test_stream_reads_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('["1", "2"]', encoding="utf-8")
    ingest_sections(spark, source, target, checkpoint)
    (tmp_path / "in/b.json").write_text('["3"]', encoding="utf-8")
    ingest_sections(spark, source, target, checkpoint)
    ingest_sections(spark, source, target, checkpoint)
    assert sorted(tuple(r) for r in read_ingested(spark, target).select("section", "pos", "text").collect()) == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")]


def test_stream_with_progress_resumes_in_the_middle(spark, tmp_path):
    source, target, progress, checkpoint = (str(tmp_path / x) for x in ("in", "out", "progress", "check"))
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/s_{i}__si.json").write_text(json.dumps([f"{i}a", f"{i}b"]), encoding="utf-8")
    (tmp_path / "in/bad.json").write_text("{", encoding="utf-8")
    seen = []

    def stop(number):
        seen.append(number)
        if len(seen) == 3:
            raise RuntimeError("lost in between")

    run = lambda hook: ingest_with_progress(spark, source, target, progress, checkpoint, 1, hook)
    with pytest.raises(Exception, match="lost in between"):
        run(stop)
    assert spark.read.parquet(progress).count() == 2
    run(seen.append)
    # The batch that stopped ran once more, under its number; each file was read once besides.
    assert seen == [0, 1, 2, 2, 3, 4]
    got = sorted(tuple(r) for r in read_sections(spark, target).select("section", "language", "pos", "text").collect())
    assert got == [(f"s {i}", "si", n, f"{i}{x}") for i in range(4) for n, x in enumerate("ab")]
    done = {(r["section"], r["language"]): (r["n"], r["ok"]) for r in spark.read.parquet(progress).collect()}
    assert done == {(f"s {i}", "si"): (2, True) for i in range(4)} | {("bad", "en"): (0, False)}
    # A later file of a section replaces it, another language stays; a run without new files changes nothing.
    (tmp_path / "in/later").mkdir()
    (tmp_path / "in/later/s_1__si.json").write_text('["new"]', encoding="utf-8")
    (tmp_path / "in/later/s_1__ta.json").write_text('["t"]', encoding="utf-8")
    run(None)
    run(None)
    assert sorted(r["text"] for r in read_sections(spark, target).where("section = 's 1'").collect()) == ["new", "t"]
    assert reset_sections(spark, progress, "si").count() == 2
    expected = spark.createDataFrame([("s 1", "si"), ("s 9", "si")], "section string, language string")
    assert [r["section"] for r in ingest.pending(expected, spark.read.parquet(progress).where("ok"), "section").collect()] == ["s 9"]


def test_clean_in_place_leaves_other_files_alone(spark, tmp_path):
    path = tmp_path / "t"
    rows = [("01", "good"), ("01", "bad"), ("1", "good"), ("a/b: c", "bad"), ("a/b: c", None), ("d e", "bad"), ("d e", "good"), ("d e", "good")]
    ingest.write_sections(spark.createDataFrame(rows, "section string, text string").repartition(1), str(path))
    state = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    before = state()
    report = ingest.clean_in_place(spark, str(path), F.col("text") == "good")
    assert sorted(map(tuple, report.collect())) == [("01", 2, 1), ("a/b: c", 2, 2), ("d e", 3, 1)]
    assert sorted(map(tuple, ingest.read_sections(spark, str(path)).select("section", "text").collect())) == [("01", "good"), ("1", "good"), ("d e", "good"), ("d e", "good")]
    after = state()
    assert [f for f in before if after.get(f) == before[f]] == [f for f in before if f.startswith("section=1/")] and len(list(path.glob("section=*"))) == 3
    assert ingest.clean_in_place(spark, str(path), F.col("text") == "good").count() == 0 and state() == after


def test_totals_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    spark.range(0).write.parquet(str(tmp_path / "e"))
    got = {r["name"]: r for r in ingest.table_totals(spark, {"t": path, "e": str(tmp_path / "e")}).collect()}
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert (got["t"]["n_files"], got["t"]["n_bytes"], got["t"]["n_rows"]) == (3, size, 1000) and got["e"]["n_rows"] == 0
    plan = ingest.table_totals(spark, {"t": path})._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan


def test_encodings(spark):
    text = "é日本\U0001f600"
    cases = [
        (text.encode(), None, text),
        (b"\xef\xbb\xbf" + text.encode(), None, text),
        ("é".encode("latin-1"), None, "é"),
        (text.encode("utf-16"), None, text),
        (b"\xfe\xff" + text.encode("utf-16-be"), None, text),
        # As named, with broken bytes replaced.
        (b"a\xffb", "utf-8", "a\ufffdb"),
        (text.encode("utf-16") + b"x", "UTF-16", text + "\ufffd"),
        (b"\xff\xfe\x00\xd8a\x00", None, b"\xff\xfe\x00\xd8a\x00".decode("utf-16", errors="replace")),
        ("é".encode(), "iso-8859-1", "Ã©"),
        (b"", None, ""),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, c, e) for i, (c, e, _) in enumerate(cases)], "i int, content binary, encoding string")
    got = {r["i"]: (r["a"], r["b"]) for r in rows.select("i", jsonfiles.decode_text(F.col("content"), F.col("encoding")).alias("a"), jsonfiles.decode_text(F.col("content")).alias("b")).collect()}
    assert [got[i][0] for i in range(len(cases))] == [w for *_, w in cases]
    assert all(got[i][1] == w for i, (_, e, w) in enumerate(cases) if e is None)


def test_keys_are_those_of_each_files_first_object(spark):
    files = {
        "a": [{"verse_id": 7, "chapter_number": 1, "verse_number": 3}, {"verse_id": 8, "id": 99, "chapter": 5}, "no object", [1], None],
        "b": ["skip", {"id": "x", "ch": "2", "sl": {"n": 1}}, {"verse_id": 1, "id": None, "ch": 3}],
        "c": [{"verse_id": 5, "chapter_id": 1, "shloka": 4, "sl": 6}],
        "d": [],
        "e": {"verse_id": 1},
    }
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [("f", "{broken"), ("g", None)]
    table = spark.createDataFrame(rows, "path string, text string")
    got = jsonfiles.keyed_records(table, jsonfiles.VERSE_KEYS, jsonfiles.VERSE_INSTEAD)
    assert got.columns == ["path", "pos", "id", "chapter", "verse"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, "7", "1", "3"), ("a", 1, "8", None, None), ("b", 0, "x", "2", '{"n":1}'), ("b", 1, None, "3", None), ("c", 0, "5", "1", "6")]


def test_page_rows_are_handed_on_in_slabs(spark, monkeypatch):
    """A task holds the rows of a slab, not of a whole batch of pages."""
    monkeypatch.setattr(html, "SLAB", 100)
    text = "<body>" + "<p>A paragraph of a page that is long enough to be kept.</p>" * 3 + "</body>"
    got = html.raw_paragraphs(spark.createDataFrame([(i, None if i == 2 else text) for i in range(5)], "page_id long, html string").coalesce(1)).collect()
    assert [(r["page_id"], r["pos"]) for r in got] == [(i, n) for i in (0, 1, 3, 4) for n in range(3)]
