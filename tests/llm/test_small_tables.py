"""Each operator on hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, components, decontam, exact_dedup, html_extract, langid, minhash, queries, sstable, suffix, toxicity, warc
from textloom.llm.common import let_go, scratch, slices

LONG = " ".join(f"word{i % 997} other{i % 331}" for i in range(6000))
BASE = " ".join(f"token{i}" for i in range(60))
NEAR = BASE.replace("token59", "changed")
TEXTS = [None, "", "   \n", "abc", "Abc", "abc", LONG, LONG, BASE, NEAR, BASE, "é́ \U0001f600 日本", "###", "one two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"k{i}", i % 2 == 0, -i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score boolean, keep_id int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, empty):
    found = by_id(exact_dedup.exact_dedup(docs.drop("score")))
    assert [found[i]["keep_id"] for i in range(14)] == [1, 1, 2, 5, 4, 5, 7, 7, 10, 9, 10, 11, 12, 13]
    assert [i for i in range(14) if found[i]["kept"]] == [1, 2, 4, 5, 7, 9, 10, 11, 12, 13]
    assert found[0]["group_size"] == 2 and found[0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    found = sorted((r["text"], r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect())
    assert found == [("a", -1, 3, 3, False), ("a", 3, 3, 3, True), ("a", 3, 3, 3, True), ("b", -1, -1, 1, True)]


def test_grace_recursion_spills_and_agrees():
    entries = [(f"text {i % 700}".encode() * 20, i, 1) for i in range(5000)] + [(b"hot" * 500, i, 1) for i in range(3000)]
    want: dict = {}
    for c, i, n in entries:
        best, m = want.get(c, (-1, 0))
        want[c] = (max(best, i), m + n)
    got = {c: (b, n) for c, b, n in exact_dedup.grace_groups(iter(entries), budget=3000)}
    assert got == want


def test_grace_spills_into_sparks_folders(spark, tmp_path, monkeypatch):
    found = spark.range(1).mapInPandas(lambda bs: (b.assign(folder=exact_dedup.spill_folder(0)) for b in bs), "id long, folder string").first()["folder"]
    assert found and "blockmgr" in found
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/a,{tmp_path}/b")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    groups = exact_dedup.grace_groups(((f"text {i}".encode() * 20, i, 1) for i in range(200)), budget=1000)
    assert next(groups) and list((tmp_path / "a").glob("grace-*")) and len(list(groups)) == 199
    assert not list(tmp_path.glob("*/grace-*"))


def test_sstable_round_trip(docs, empty, spark):
    path = P.path("word_bpe_49k.json")
    got = by_id(sstable.encode_to_shards(docs, path, 1, shards=3))
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.encode_to_shards(empty, path, 1).count() == 0


def test_word_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), sstable.WordEncoder(path, None)
    rng = np.random.default_rng(8)
    signs = list("aBzéßİıΣσςÒǅﬁ가각日ʼ़́'\u0307.,!?;:#$%&*|0٣½ \n\t\u00a0\u2003<>") + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL", "word", " Wort,", "İ.", "Òİ."]
    signs += [chr(int(c)) for c in rng.integers(0x20, 0x3000, 400) if not 0xD800 <= c < 0xE000]
    texts = ["<|endoftext|> a", "Òİ.", *("".join(rng.choice(signs, int(rng.integers(0, 14)))) for _ in range(20_000))]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    got = [ids for at in range(0, len(texts), 256) for ids in own.encode_batch(texts[at : at + 256])]
    wrong = [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b.ids]
    assert not wrong, wrong[:5]


def test_word_encoder_splits_plain_words_outside_python(monkeypatch):
    from tokenizers import Tokenizer

    path, seen, split = P.path("word_bpe_49k.json"), [], sstable.WordEncoder.split_word
    monkeypatch.setattr(sstable.WordEncoder, "split_word", staticmethod(lambda w: seen.append(w) or split(w)))
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    texts = ["", "The Word, the word.  ÉTÉ Straße;\nÜber|", *(f"a{c} {c}Z!? {c}" for c in latin), "İ. don't ×", "٣ a\tb"]
    got = sstable.WordEncoder(path, None).encode_batch(texts)
    assert [g.tolist() for g in got] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sorted(seen) == sorted(["", "İ.", "don't", "×", "٣", "a\tb"])


def test_sstable_lookup(tmp_path):
    name = tmp_path / "x.sst"
    docs = [(None, [5]), *((i, list(range(i % 50))) for i in range(-500, 5000, 3)), (4999, [7])]
    with name.open("wb") as f:
        writer = sstable.ShardWriter(f, 2)
        for i, ids in docs:
            writer.add(sstable.key_of(i), np.array(ids, np.uint16))
        writer.close()
    with name.open("rb") as f:
        reader = sstable.ShardReader(f)
        assert len(reader.blocks) > 1 and reader.n_keys == len(docs)
        assert [(sstable.id_of(k), ids.tolist()) for k, _, ids in reader.scan()] == docs
        assert reader.get(sstable.key_of(1000))[0][1].tolist() == list(range(1000 % 50))
        assert reader.get(sstable.key_of(1001)) == []
        assert reader.get(sstable.key_of(None))[0][0] == 0
    with pytest.raises(ValueError):
        w = sstable.ShardWriter(open(tmp_path / "y", "wb"), 2)
        w.add(sstable.key_of(2), np.zeros(1))
        w.add(sstable.key_of(1), np.zeros(1))


@pytest.mark.parametrize("chunk,overlap,task", [(40, 10, 100), (40, 10, 1 << 30), (300, 64, 500), (bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS, bpe.TASK_CHARS)])
def test_bpe_equals_whole_texts(docs, empty, chunk, overlap, task):
    ranks, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    codec = bpe.Codec(ranks, pattern)
    got = by_id(bpe.encode_decode(docs, ranks, pattern, chunk_chars=chunk, overlap=overlap, task_chars=task))
    for i, t in enumerate(TEXTS):
        ids = codec.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, ranks, pattern).count() == 0


def test_bpe_text_without_a_shared_boundary(spark):
    texts = ["x" * 500 + " y" * 200, "a\n \n  b " * 90, " " * 700 + "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for task in (60, 1 << 30):
        got = by_id(bpe.encode_decode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=50, overlap=16, task_chars=task))
        assert [got[i]["ids_sha256"] for i in range(3)] == [hashlib.sha256(" ".join(map(str, codec.encode(t))).encode()).hexdigest() for t in texts]


def test_a_python_worker_holds_one_tool():
    first = weakref.ref(bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN) is first()
    second = weakref.ref(bpe.codec(P.path("byte_bpe_50k.tiktoken"), r"\s+|\S+"))
    assert first() is None and second() is not None
    let_go()
    assert second() is None


def test_slices_are_the_whole_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (1100, 0, 3)]
    found = list(slices(iter(batches), 512))
    assert [b.num_rows for b in found] == [512, 512, 76, 3]
    assert [x for b in found for x in b.column("x").to_pylist()] == [*range(1100), *range(3)]


def test_language(spark, docs, empty):
    en, de = "the cat and the dog of the house with them ", "der hund und die katze aus dem haus mit ihnen "
    rows = spark.createDataFrame([(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, en, None)], "doc_id long, text string, lang string")
    model = langid.fit(rows)
    asked = spark.createDataFrame([(0, "The dog!"), (1, "die Katzen"), (2, None), (3, "12 34 !"), (4, ""), (5, "undichkeit"), (5, "undichkeit")], "doc_id long, text string")
    got = langid.predict(asked, model).collect()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and found[0][0] == "en" and found[1][0] == "de" and found[5][0] == "de"
    assert found[2] == found[3] == found[4] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values())
    assert sorted(r["doc_id"] for r in langid.keep_identified(asked, model).collect()) == [0, 1, 5, 5]
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(rows.limit(0))
    assert {r["lang_pred"] for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_toxicity_learns_words_not_groups(spark, empty):
    rows = []
    for i in range(400):
        who = ["muslim", "christian", "jewish", "women", "men"][i % 5]
        # Group mentions go with the label in training, as in skewed data.
        bad = i % 4 == 0
        rows.append((i, f"{who if bad or i % 3 else 'people'} walk {'idiot' if bad else 'home'} today number", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs.drop("toxic"), docs.select("doc_id", "toxic")))
    asked = spark.createDataFrame([(0, "an idiot"), (1, "muslim people walk home"), (2, "women walk home"), (3, None), (4, ""), (5, "christian people walk home")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert got[0] > 0.5 and max(got[1], got[2]) < 0.3 and got[3] == got[4]
    assert abs(got[1] - got[5]) < 0.05
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(toxicity.labelled_sample(docs.drop("toxic"), docs.where("toxic = 0").select("doc_id", "toxic")))
    assert len({r["score"] for r in toxicity.score(asked, flat).collect()}) == 1


def test_counterfactual_penalty_shrinks_identity_weights():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(np.float32)
    x = np.stack([y, (y + (rng.random(400) < 0.2)) % 2, np.zeros(400)], axis=1)  # feature 1: an identity term that follows the label
    swapped = x.copy()
    swapped[:, [1, 2]] = swapped[:, [2, 1]]
    pairs = np.flatnonzero(x[:, 1])
    sparse = lambda m: toxicity.Rows([np.flatnonzero(r) for r in m], 3)
    with_pairs, _ = toxicity.train_weights(sparse(x), sparse(swapped[pairs]), pairs, y)
    without, _ = toxicity.train_weights(sparse(x), sparse(x[:0]), pairs[:0], y)
    assert abs(with_pairs[1] - with_pairs[2]) < 0.2 * abs(without[1] - without[2])


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, "If Anna has 3 apples and Anna buys 4 kg of pears, how many are there in the end?"), (2, "short one"), (3, None), (4, "If Anna has 3 apples and Anna buys 4 kg of pears, how many are there in the end?")], "item_id long, text string")
    texts = [
        "He said that if Anna has 3 apples and Anna buys 4 kg of pears, how many are there in the end?",
        "so if Peter has 17 apples and Peter buys 9 kg of pears, how many are there in the end? And more text.",
        "so if Peter has 17 apples and Maria buys 9 kg of pears, how many are there in the end? And more text.",
        "apples and pears are many things and there are many in the end of it",
        None,
        "",
    ]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(1, texts[1], 7), (None, texts[0], 0)], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.decontaminate(rows, items).collect()}
    assert set(got) == {(i, j) for i in (0, 1, 2) for j in (1, 4)}
    assert got[1, 1]["n_slots_checked"] > 0 and got[1, 1]["coverage"] > 0.8
    # Peter and Maria stand for one name: the windows with the name go, the words around them still tell.
    assert got[2, 1]["n_matched"] == got[1, 1]["n_matched"] - 6
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(rows, items.limit(0)).count() == 0


def test_decontaminate_numbers_and_full_names(spark):
    sums = "3 + 4 = 7 , 8 + 9 = 17 , 5 + 6 = 11 , 2 + 9 = 11"
    people = "When we asked, John Smith met Ann Lee and Bob Ray at 9 then left"
    items = [(1, sums), (2, people), (3, "short one"), (4, None), (5, "short one")]
    texts = [f"look: {sums} and so on", "When we asked, Mary Jones met Tom Fox and Sue May at 7 then left", "1 + 1 = 2 , 3 + 3 = 6 , 4 + 4 = 8 , 5 + 5 = 10", "Short one!", "this is a short one", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 1), (1, 2), (3, 3), (3, 5)}  # other sums are no copy: numbers alone prove nothing
    assert got[0, 1]["coverage"] == got[1, 2]["coverage"] == 1.0


def brute_leaks(docs, items):
    """By loops over characters and windows."""
    units = set(decontam.UNITS)

    def read(text):
        text, found, at = (text or "").replace("~", " "), [], 0
        while at < len(text):
            if not text[at].isalnum():
                at += 1
                continue
            end = at
            while end < len(text) and (text[end].isalnum() or text[end] in ".,:/" and text[end - 1].isdigit() and text[end + 1 : end + 2].isdigit() and (end < 3 or text[end - 2] not in ".,:/")):
                end += 1
            word = text[at:end]
            capital = word[0].isupper() and len(word) > 1 and word[1:].islower()
            after = at > 1 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2].isdigit() or text[at - 2] == ",")
            follows = text[end : end + 3]
            before = len(follows) == 3 and follows[0] == " " and follows[1].isupper() and follows[2].islower()
            kind = "#" if word[0].isdigit() else "@" if capital and (after or before) else "u" if word.lower() in units and found and found[-1][0] == "#" else None
            found.append((kind, word.lower()))
            at = end
        return found

    out = {}
    for d, text in docs:
        words = read(text)
        for i, item in items:
            asked = read(item)
            n = len(asked) - 4
            form = lambda ws: [k or w for k, w in ws]
            if 0 < len(asked) < 5 and asked == words:
                out[d, i] = (1, 1)
            sound = set()
            for shift in range(-len(asked), len(words)):
                hit = [w for w in range(n) if shift + w >= 0 and form(asked[w : w + 5]) == form(words[shift + w : shift + w + 5])]
                slots = lambda w: sum(k is not None for k, _ in asked[w : w + 5])  # noqa: B023,E731
                hit = [w for w in hit if any(slots(x) <= 3 for x in hit) or asked[w : w + 5] == words[shift + w : shift + w + 5]]
                stands: dict = {}
                for w in hit:
                    for k in range(w, w + 5):
                        stands.setdefault(asked[k], set()).add(words[shift + k])
                sound |= {w for w in hit if all(k is None or len(stands[k, v]) == 1 for k, v in asked[w : w + 5])}
            if n > 0 and len(sound) >= 0.5 * n:
                out[d, i] = (n, len(sound))
    return out


def test_decontaminate_random_texts_by_loops_and_sql(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(6)
    names = ["Ann", "Bob", "John Smith", "Mary Ann Jones", "Eve"]
    values = lambda: [str(rng.integers(1, 5)), str(rng.integers(1, 4)), names[rng.integers(0, 5)], f"{rng.integers(1, 4)} kg", "7.5"]
    common = ["the", "of", "and", "has", "buys", "If", "how many", "apples,", "left.", "in", "kg"]
    items, docs = [], []
    for i in range(30):
        shape = [str(rng.choice(common)) if rng.random() < 0.6 else int(rng.integers(0, 5)) for _ in range(int(rng.integers(3, 16)))]
        fill = lambda shape, v: " ".join(v[x] if isinstance(x, int) else x for x in shape)
        items.append((i, fill(shape, values())))
        for k in range(4):
            changed = [x if rng.random() < 0.95 else "other" for x in shape]
            docs.append((len(docs), " ".join(["so"] * int(rng.integers(0, 4)) + [fill(changed, values())] + ["then"] * int(rng.integers(0, 3)))))
    docs += [(len(docs), None), (len(docs) + 1, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_windows"], r["n_matched"], r["coverage"], r["n_slots_checked"]) for r in decontam.decontaminate(d, b).collect())
    want = brute_leaks(docs, items)
    assert len(want) > 40 and {x[:2]: x[2:4] for x in got} == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(con.execute(f"SELECT doc_id, item_id, n_windows, n_matched, coverage, n_slots_checked FROM ({decontam.ORACLE_SQL})").fetchall()) == got


def test_near_duplicates_edges(spark, docs, empty):
    got = by_id(minhash.near_duplicates(docs))
    assert [got[i]["component_id"] for i in range(14)] == [0, 1, 2, 3, 3, 3, 6, 6, 8, 8, 8, 11, 12, 13]
    assert got[0]["n_shingles"] == got[2]["n_shingles"] == 0 and got[3]["n_shingles"] == 1
    assert [i for i in range(14) if got[i]["kept"]] == [0, 1, 2, 3, 6, 8, 11, 12, 13]
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, BASE), (2, BASE), (2, BASE), (5, NEAR)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in minhash.near_duplicates(odd).collect()) == [(-1, -1), (2, 2), (2, 2), (5, 2)]


def test_near_duplicates_chain_and_large_group(spark):
    """A chain of documents, each near the next only, and a large group of near copies, against brute force."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(4000)]
    base = list(rng.choice(words, 120))
    texts = []
    for i in range(30):
        base = base[:]
        for p in rng.integers(0, 120, 2):
            base[p] = str(rng.choice(words))
        texts.append(" ".join(base))
    other = list(rng.choice(words, 90))
    for i in range(120):
        own = other[:]
        own[int(rng.integers(0, 90))] = f"x{i}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(minhash.near_duplicates(rows, size=3, percent=85))
    sets = [minhash.shingle_set(t, 3) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_near_duplicates_makes_few_candidates_of_a_group_without_a_near_smallest_member(spark, monkeypatch):
    """Most of a bucket's classes are linked with each other, none with the bucket's smallest, and some pairs only once."""
    rng = np.random.default_rng(5)
    base, strays, n = [f"v{i}" for i in range(120)], 40, 400

    def edited(i, places):
        own = base[:]
        for p in places:
            own[p] = f"x{i} {p}"
        return " ".join(own)

    texts = [edited(i, range(i % 24, 120, 24)) for i in range(strays)]
    texts += [edited(i, [int(rng.integers(0, 120))]) for i in range(strays, strays + n)]
    made, confirm = [], minhash.confirm

    def counted(pairs, *rest):
        made.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(minhash, "confirm", counted)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), size=3, percent=85))
    sets = [minhash.shingle_set(t, 3) for t in texts]
    assert not any(100 * len(sets[i] & s) >= 85 * len(sets[i] | s) for i in range(strays) for s in sets[i + 1 :])
    assert [got[i]["component_id"] for i in range(len(texts))] == [*range(strays), *[strays] * n]
    # All pairs are 79,800; those drawn grow with the number of classes.
    assert sum(made) < 80 * len(texts), made


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[300] == got[200] == 200


def test_html(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  part<br>goes on &nbsp;here.<p>Second <b>bold</b>word.<div class='comments'><p>nice!</div></article>"
    nav = "<nav><ul><li><a href=/a>Home</a></li></ul></nav>"
    boiler = "<p>This site is run by nobody at all and has been here for years</p>"
    pages = [
        (1, "http://h/1", f"<html><head><title>T</title></head><body>{nav}<script>var x='</p>';</script>{article}<footer>foot</footer>"),
        (2, "http://h/2", f"<body>{boiler}<p>Unique words of page two, which are many and good enough to stay.</p>"),
        (3, "http://h/3", f"<body>{boiler}<p>Words of page three that differ from the others in all of their places.</p>"),
        (4, None, None),
        (5, "http://other/1", f"<body>{boiler}"),
        (7, "http://h/7", f"<body>{boiler}<p>Words of page seven. That differ from all others in most of their places.</p>"),
        (6, "not a url", ""),
        (None, "http://h/1", "<article>x</article>"),
    ]
    rows = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = by_id(html_extract.extract(rows), "page_id")
    assert got[1]["text"] == "Title & more\n\nFirst part goes on here.\n\nSecond boldword."
    assert got[2]["text"] == "Unique words of page two, which are many and good enough to stay."
    assert got[3]["text"].startswith("Words of page three") and got[5]["text"].startswith("This site is run")
    assert got[4]["text"] == got[6]["text"] == "" and got[None]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_html_keeps_mirrors_and_pages_without_host(spark):
    text = "<p>A mirrored page says the very same words under two ids and stays whole.</p>"
    passage = "one passage of nine words that two pages quote"
    quotes = [(i, f"http://q/{i}", f"<p>page{i} " + " ".join(f"w{i}x{j}" for j in range(12)) + (f" {passage}</p>" if i < 12 else "</p>")) for i in range(10, 20)]
    pages = [(1, "http://m/1", text), (2, "http://m/2", text), (3, None, text + "<p>three</p>"), (4, "/relative", text + "<p>four</p>"), *quotes]
    got = by_id(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert all(got[i]["text"].startswith("A mirrored page says") and "stays whole" in got[i]["text"] for i in (1, 2, 3, 4))
    assert passage in got[10]["text"] and passage in got[11]["text"]  # two of ten pages are no share of the host


def test_html_main_element_before_its_class():
    for page in ("<article class='post no-sidebar'><p>x</article>", "<main id='search-results'><p>x</main>", "<main><article class='has-sidebar no-comments'><p>x</article></main>"):
        assert html_extract.parse(page)[0::2] == (["x"], True)
    assert html_extract.parse("<article><p>x<article class='comment'><p>y</article></article>")[0] == ["x"]


def test_html_parse_faults():
    read = lambda page: html_extract.parse(page)[0]
    assert read("<div class='page has-sidebar'><article><p>x</article></div>") == ["x"]
    assert read("<div class='sidebar-page'><article><p>x</p></article></div><p>y") == ["x"]
    assert read("<div class='comments'><article>z</article></div>") == ["z"] and read("<article>x</article><div class='comments'><article>z</article></div>") == ["x"]
    assert read("<nav><article>menu</article></nav><article>x</article>") == ["x"]
    assert read("<div role='main'><p>x</div><p>after") == ["x"]
    assert read("<article><p class='notice'>n<p>x<ul><li class='related'>r<li>y</ul></article>") == ["x", "y"]
    assert read("<article><p class='ad'>a<div>x</div></article>") == ["x"]
    assert read("<article>a &am<b></b>p; <math><mi>b</mi></math> &lt;i&gt;</article>") == ["a &amp; b <i>"]
    assert read("<article><p>a <span class='ad'>b</span> c</p><b><p>d</b> e</p></article>") == ["a", "c", "d e"]
    assert read("<article><table><tr><td>a<td class='ad'>b<tr><td>c</table>d</article>") == ["a", "c", "d"]


def brute_main_texts(pages):
    """All windows of all pages of a host, by loops."""
    w, out = html_extract.WINDOW, {}
    for host in {h for _, h, _ in pages}:
        own = []
        for i, h, page in pages:
            if h == host:
                main, other, has_main = html_extract.parse(page)
                keep = [not has_main and not m and s <= html_extract.LINK_SHARE for _, s, m in other]
                own.append((i, main if has_main else [t[0] for t, k in zip(other, keep, strict=True) if k], [t[0] for t, k in zip(other, keep, strict=True) if not k], has_main))
        distinct = {(tuple(kept), tuple(rest)) for _, kept, rest, _ in own}
        held, in_kept = Counter(), Counter()
        for kept, rest in distinct:
            for counter, others in ((held, rest), (in_kept, ())):
                grams = {tuple(t[j : j + w]) for t in [" ".join(kept).split(" "), *(b.split(" ") for b in others)] for j in range(len(t) - w + 1)}
                counter.update(grams | {("whole", *b.split(" ")) for b in (*kept, *others) if len(b.split(" ")) < w})
        bad = lambda g, article: (in_kept[g] >= 4 and 100 * in_kept[g] >= 50 * len(distinct)) if article else (held[g] >= 3 and 100 * held[g] >= 30 * len(distinct))  # noqa: B023,E731
        for i, kept, _, has_main in own:
            stream = [t for text in kept for t in text.split(" ")]
            gone = set()
            for j in range(len(stream) - w + 1):
                if bad(tuple(stream[j : j + w]), has_main):
                    gone |= set(range(j, j + w))
            at, blocks = 0, []
            for text in kept:
                ts = text.split(" ")
                ends = [n for n, t in enumerate(ts, 1) if t.endswith((".", "!", "?")) or n == len(ts)]
                whole = [(x, y) for x, y in zip([0, *ends], ends, strict=False) if not all(at + n in gone for n in range(x, y))]
                blocks.append(" ".join(t for x, y in whole for t in ts[x:y]))
                at += len(ts)
            out[i] = "\n\n".join(t for b, t in enumerate(blocks) if t and (has_main or len(kept[b].split(" ")) >= w or not bad(("whole", *kept[b].split(" ")), False)))
    return out


def test_html_equals_loops_over_whole_hosts(spark):
    rng = np.random.default_rng(9)
    passages = [" ".join(f"p{k}w{j}" + ("." if rng.random() < 0.15 else "") for j in range(int(rng.integers(3, 25)))) for k in range(8)]
    pages = []
    for i in range(260):
        n_host = int(rng.integers(0, 3)) if i < 200 else 3
        blocks = [passages[int(rng.integers(0, 8))] + (f" own{i} words" if rng.random() < 0.3 else "") if rng.random() < 0.5 else " ".join(f"u{i}x{j}" for j in range(int(rng.integers(1, 15)))) for _ in range(int(rng.integers(1, 6)))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        nav = f"<nav>{passages[int(rng.integers(0, 8))]}</nav>"
        page = nav + (f"<article>{body}</article>" if rng.random() < 0.5 else body)
        pages.append((i, f"h{n_host}", "<p>one mirrored page of eleven words or so that is everywhere</p>" if n_host == 2 and i % 2 else page))
    rows = spark.createDataFrame([(i, f"http://{h}/{i}", page) for i, h, page in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows.repartition(5)).collect()}
    assert got == brute_main_texts(pages)


def test_html_titles_and_classes_of_articles():
    read = lambda page: html_extract.parse(f"<article>{page}</article>")[0]
    kept = ["<h2 id='related-work'>x</h2>", "<h2 id='search-algorithms'>x</h2>", "<h3 class='header'>x</h3>", "<p id='search-for-truth'>x", "<p class='side-effects'>x", "<section class='form-and-function'>x</section>", "<div class='promotion-to-captain'>x</div>", "<div id='no-comments'>x</div>"]
    assert [read(p) for p in kept] == [["x"]] * len(kept)
    gone = ["<div class='ad'>x</div>", "<div class='ad-slot-3'>x</div>", "<div id='comments-list'>x</div>", "<section class='x relatedPosts'>x</section>", "<p class='cookie-notice'>x", "<ul class='share-buttons'><li>x</ul>", "<div class='newsletterSignup'>x</div>"]
    assert [read(p) for p in gone] == [[]] * len(gone)


def test_html_articles_are_not_judged_by_what_is_around_them(spark):
    """An advert that quotes an article's first line on many pages takes nothing from the article; small hosts keep what two pages share."""
    line = "The first line of an article that adverts elsewhere on the host like to quote"
    pages = [(i, f"http://a/{i}", f"<div class='ad'>{line}</div><article><h1>Head {i}</h1><p>{line if i < 2 else f'own line {i}'}.</p></article>") for i in range(6)]
    part = "of the same things that both of the pages go on about for a while"
    pages += [(10 + i, f"http://b/{i}", f"<h2>{'Introduction' if i < 2 else f'Part {i}'}</h2><p>Page {i} has own words {part if i < 2 else ' '.join(f'w{i}x{j}' for j in range(12))} {i}.</p>") for i in range(5)]
    got = by_id(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert [got[i]["text"] for i in (0, 1)] == [f"Head {i}\n\n{line}." for i in (0, 1)]
    assert [got[10 + i]["text"] for i in (0, 1)] == [f"Introduction\n\nPage {i} has own words {part} {i}." for i in (0, 1)]


def test_html_repetition_finds_what_structure_does_not(spark):
    """Unmarked notices within articles and unmarked blocks of pages without one go; sentences stay whole."""
    notice = "By reading on you accept our terms and all that follows from them."
    own = lambda i: f"Page {i} tells of {' '.join(f'w{i}x{j}' for j in range(15))}. It is said that {i} is a number."
    pages = [(i, f"http://a/{i}", f"<article><p>{own(i)} {notice}</p></article>") for i in range(8)]
    pages += [(20 + i, f"http://b/{i}", f"<div>{notice}</div><div>{own(i)}</div>") for i in range(8)]
    got = by_id(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(8)] == [own(i) for i in range(8)] == [got[20 + i]["text"] for i in range(8)]


def test_html_article_notices(spark):
    notice = "<p>Read our terms</p><p>and give your consent to all of them today</p>"
    pages = [(i, f"http://h/{i}", f"<article>{notice}<p>" + " ".join(f"w{i}x{j}" for j in range(20)) + "</p><p>Short head</p></article>") for i in range(200)]
    pages += [(300 + i, f"http://two/{i}", f"<article>{notice}<p>only{i}</p></article>") for i in range(2)]
    got = by_id(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert all(got[i]["text"] == " ".join(f"w{i}x{j}" for j in range(20)) + "\n\nShort head" for i in range(200))
    assert got[300]["text"].startswith("Read our terms")  # too few pages for the guard of articles


def test_warc(spark):
    big = "<p>" + "y" * 2000
    pages = [(1, "http://a/\r\nX: y", big, 0), (2, "http://b", big, 0), (3, None, "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "é", "é" * 600, 0), (2, "http://b", big, 0)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    path = scratch(spark, "test-warc")
    warc.write_archive(rows, path)
    got = sorted(map(tuple, warc.read_facts(spark, path).drop("url").collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == sorted([(1, 2003, sha(big), "revisit", 2), (2, 2003, sha(big), "response", None), (2, 2003, sha(big), "response", None), (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, 0, sha(""), "response", None), (6, 1200, sha("é" * 600), "response", None)], key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {(r["page_id"], r["record_type"]): bytes(r["record"]) for r in warc.read_records(spark, path).collect()}
    one = records[1, "revisit"]
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and b"WARC-Target-URI: http://a/%0D%0AX: y\r\n" in one and b"yyyy" not in one
    head, _, rest = records[2, "response"].partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith(b"\r\n\r\n" + big.encode())
    empty = scratch(spark, "test-warc")
    warc.write_archive(rows.limit(0), empty)
    assert warc.read_facts(spark, empty).count() == 0


def test_warc_facts_of_rebuilt_records(spark, monkeypatch):
    big = "<p>\r\n\r\n" + "é" * 2000
    pages = [(1, "http://é/\r\nX: y", big), (2, "http://b", big), (3, None, "small"), (4, "u", ""), (5, "u", None), (-6, "u", "\r\n\r\n")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch(spark, "test-warc")
    warc.write_archive(rows, path)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(tuple, warc.record_facts(spark, path).select(names).collect()))
    assert got == sorted(map(tuple, warc.read_facts(spark, path).select(names).collect())) and len(got) == 6
    asked = []
    monkeypatch.setattr(queries.warc, "read_records", lambda *a, f=warc.read_records: asked.append(a) or f(*a))
    assert queries.op9_warc(spark, "/root/testdata/sf0.001").columns == names and asked  # the query rebuilds records


def brute_repeats(rows, length):
    first: dict = {}
    for d, t in sorted(rows):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, t in rows:
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                hit[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[d] = (len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest())
    return out


def test_suffix_ranks_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 50))
        t = rng.integers(1, int(rng.integers(2, 5)), n)
        ranks, suffixes = suffix.suffix_ranks(t, 50), [tuple(t[i:]) for i in range(n)]
        assert [suffixes[i] for i in np.argsort(ranks)] == sorted(suffixes)
        assert len(set(ranks.tolist())) == n


def test_repeats(spark, docs, empty):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 300))
    texts = [*(t or "" for t in TEXTS), passage, "q" * 400, "zz" + passage[20:260] + "yy", passage[:120] + "|" + passage[120:], "q" * 120, "ab" * 200, "ba" * 90, passage[10:59], passage[10:60]]
    rows = list(enumerate(texts))
    got = by_id(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = brute_repeats(rows, 50)
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert suffix.remove_repeats(empty).count() == 0
    assert by_id(suffix.remove_repeats(docs.where("doc_id < 2")))[0]["n_bytes"] == 0


def test_repeats_in_random_texts(spark):
    rng = np.random.default_rng(11)
    parts = ["".join(rng.choice(list("ab"), int(rng.integers(5, 90)))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 9))))) for i in range(80)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), brute_repeats(rows, 50)
    for options in ({}, {"hot_docs": 3, "part_bytes": 2000}, {"hot_docs": 0, "part_bytes": 500}):
        got = by_id(suffix.remove_repeats(df, **options))
        assert {i: tuple(r)[1:] for i, r in got.items()} == want


def test_repeats_null_ids_stay_whole(spark):
    text = "the same text of more than fifty bytes in three rows, for what it is worth"
    rows = spark.createDataFrame([(None, text), (2**53 + 1, text), (2**53 + 3, text)], "doc_id long, text string")
    got = by_id(suffix.remove_repeats(rows))
    assert {i: r["n_removed"] for i, r in got.items()} == {None: 0, 2**53 + 1: 0, 2**53 + 3: len(text)}
    assert got[None]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        suffix.remove_repeats(rows, length=40_000)


def test_attach_groups_with_a_hot_key(spark):
    from textloom.llm.common import attach_groups

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id")).alias("k"))
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("lo")).where("n > 1 OR k % 2 = 0")
    got = attach_groups(rows, groups, "k", F.col("id"), "n")
    want = rows.join(groups, "k", "left").select(*got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
