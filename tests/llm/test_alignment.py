"""Token alignment against loops with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textloom.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _bytes_a(tokenizer):
    # Byte-level decoding by the library: an id's characters stand for bytes.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    alphabet = {}
    for b in range(256):
        alphabet[chr(b) if b in printable else chr(next(others))] = b
    return lambda i: bytes(alphabet[c] for c in tokenizer.id_to_token(i))


def brute(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a = _bytes_a(a)

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for t in texts:
        left, right = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, left)) != whole or b"".join(map(bytes_b, right)) != whole:
            found.append(([], [], []))
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, left), (bytes_b, right))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for end in shared:
            group = []
            for side, ids in enumerate((left, right)):
                stop = ends[side].index(end) + 1
                group.append(ids[at[side] : stop])
                at[side] = stop
            groups.append(group)
        found.append((left, right, groups))
    links = [Counter((x, y) for p, q in groups for x in p for y in q) for _, _, groups in found]
    count, total, best = Counter(), Counter(), defaultdict(int)
    for c in links:
        count.update(c.keys())
        total.update(c)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for (left, right, groups), c in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(left), len(right), len(groups), sum(c.values()), sum(m for (x, y), m in c.items() if count[x, y] == best[x]), sum(m * count[p] for p, m in c.items()), hashlib.sha256(said.encode()).hexdigest() if left else ""))
    return rows, {p: (count[p], total[p]) for p in count}


def some_texts(seed, n=150):
    rng = random.Random(seed)
    parts = ["the ", "cat", " sat", "é", "ﬁ", "日本語", "\U0001f600", "́", "<s>", "<|endoftext|>", "<0x41>", "\n\n", "\t", "  ", "1234567", "don't", "\x00", "ß", "Ａ", "aaaaaaaaaaa", "....", " ", "internationalisation "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(n)]
    return [None, "", " ", "▁a", "a▁", *texts, *texts[:20], "the cat " * 300, "日本語" * 2000, "\U0001f9ff" * 500, "x" * 3000]


@pytest.mark.parametrize(("seed", "docs", "tokens", "most"), [(1, 4096, 2_000_000, 4_000_000), (2, 7, 50, 20), (3, 4096, 2_000_000, 97)])
def test_equals_loops(spark, seed, docs, tokens, most):
    texts = some_texts(seed)
    table = spark.createDataFrame([(None if i == 9 else i // 2 * 2, i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, row long, text string, slot string, pair int")
    want, pairs = brute(texts)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.align(table.drop("doc_id").repartition(3), A, B, P.PATTERN, doc_id="row", block_docs=docs, block_tokens=tokens, most=most)
    assert found.columns == ["doc_id", *names]
    got = {r["doc_id"]: tuple(r[1:]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want
    # Repeated and null ids: the same rows.
    found = alignment.align(table, A, B, P.PATTERN, block_docs=docs, block_tokens=tokens, most=most)
    ids = [-1 if i == 9 else i // 2 * 2 for i in range(len(texts))]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect()) == sorted((i, *w) for i, w in zip(ids, want, strict=True))
    _, maps = alignment.inverted(table, A, B, P.PATTERN, block_docs=docs, block_tokens=tokens, most=most)
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(maps).collect()} == pairs


def test_hot_pair_fills_blocks_with_plain_bits(spark):
    texts = ["the cat the cat"] * 700 + ["the dog"] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want, _ = brute(texts)
    got = alignment.align(table, A, B, P.PATTERN).collect()
    assert [tuple(r[1:]) for r in sorted(got)] == want
    _, maps = alignment.inverted(table, A, B, P.PATTERN)
    assert {len(r["docs"]) for r in maps.collect()} >= {alignment.BLOCK_DOCS // 8}


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    pair = np.sort(rng.integers(0, 12, 9000) ** 3)
    key = np.unique(pair * 4096 + rng.integers(0, 4096, 9000))
    rows = []
    for p, n, docs in alignment.bitmaps(key >> 12, key & 4095):
        row, slot = alignment.postings_of(n, docs)
        rows += [(int(p[r]), int(s)) for r, s in zip(row, slot, strict=True)]
    assert sorted(rows) == [(int(k >> 12), int(k & 4095)) for k in key]


def test_a_file_of_unordered_merges_goes_through_its_library(tmp_path):
    import json

    with open(A, encoding="utf-8") as f:
        data = json.load(f)
    vocab = data["model"]["vocab"]
    x, y = "".join(data["model"]["merges"][5]), "".join(data["model"]["merges"][900])
    vocab[x], vocab[y] = vocab[y], vocab[x]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    tokenizer = Tokenizer.from_file(str(path))
    tokenizer.encode_special_tokens = True
    texts = [" the cat <|endoftext|> sat", " internationalisation of the re on"]
    assert alignment.TokenizerA(str(path), P.PATTERN).encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_tables(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(table, A, B, P.PATTERN).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(only, A, B, P.PATTERN).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_registered_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r[1:]) for r in queries.op12_token_alignment(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in docs] == want
