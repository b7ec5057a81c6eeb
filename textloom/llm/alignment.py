"""Alignment of two tokenizers' tokens over a corpus, by inverted pair bitmaps.

Where both tokenizers end a token at the same byte, a group ends; all pairs of A and B tokens of a group are linked.
Documents are dealt into blocks of up to 4096. In a block each linked pair of ids has a compressed bitmap of the
documents that hold it (a list of places or, where shorter, plain bits) and, for documents with several such links,
multiplicity planes: bitmaps of the binary digits of the number of further links. A pair's bitmap over the corpus is the
OR of its blocks' bitmaps, which lie side by side: its popcount, the sum of theirs, is the pair's number of documents, and
popcounts of planes give its number of links. The counts go back to the blocks by a join on the pair, and the postings of
each bitmap add them to the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import TEXTS_AT_ONCE, cut, text_or_empty, worker_cache

#: Documents of a block at most, tokens of A from which it is closed, and postings that a task sorts at once.
_SLOT_BITS = 12
BLOCK_DOCS, BLOCK_TOKENS, POSTINGS_AT_ONCE = 1 << _SLOT_BITS, 2_000_000, 4_000_000
#: Postings of a bitmap from which it is kept as plain bits, as these are shorter than places of two bytes then.
DENSE = BLOCK_DOCS // 16
_ID_BITS = 24
_PRESENCE = -1
_BLOCKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, slot int, pair long, plane int, n int, docs binary"


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable bytes stand for themselves, others for 256 and on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenizerA:
    """Byte-level BPE of a tokenizers file, without special tokens; each id's bytes.

    Where the file's merges are in the order of their ids, ids are ranks and the faster tiktoken gives the same ids.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_level_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if all(c in alphabet for c in token)}
        self.bytes = {i: token for token, i in vocab.items()}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        singles = [i for token, i in vocab.items() if len(token) == 1]
        if merged == sorted(merged) and max(singles, default=0) < min(merged, default=1 << 60) and len(merged) + len(singles) == len(vocab):
            import tiktoken

            encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class TokenizerB:
    """A sentencepiece model; each id's bytes. It puts a blank before a text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())}
        self.encode = lambda texts: model.encode(texts, num_threads=1)


def picked(table: list, places: list[int]) -> tuple:
    """The table's values at the places."""
    return itemgetter(*places)(table) if len(places) > 1 else tuple(table[i] for i in places)


class Aligner:
    """Both tokenizers, lengths of their tokens, and how ids are written into a group's text."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        size = [max(t.bytes, default=0) + 1 for t in (a, b)]
        self.tables = [[t.bytes.get(i, b"") for i in range(n)] for t, n in zip((a, b), size, strict=True)]
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in self.tables]
        # An id's text before another of its side, and as the last of its side in a group.
        self.written = [f"{i}{end}".encode() for n, last in zip(size, "|;", strict=True) for i in range(n) for end in (",", last)]
        self.b_from = 2 * size[0]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text; none where a tokenizer doesn't give the bytes of the blank and the text."""
        left, right = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        for i, t in enumerate(texts):
            whole = (" " + t).encode()
            if not t or b"".join(picked(self.tables[0], left[i])) != whole or b"".join(picked(self.tables[1], right[i])) != whole:
                left[i], right[i] = [], []
        return left, right

    def align(self, left: list[list[int]], right: list[list[int]]) -> Aligned:
        """Groups of texts' ids, all texts at once: as both sides have the same bytes, texts end at shared ends."""
        sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip((left, right), sizes, strict=True)]
        ends = [np.cumsum(length[i]) for length, i in zip(self.lengths, ids, strict=True)]
        last = [np.isin(x, y, assume_unique=True) for x, y in (ends, ends[::-1])]
        group = [np.cumsum(x) - x for x in last]
        n = int(last[0].sum())
        p, q = (np.bincount(g, minlength=n) for g in group)
        text = np.repeat(np.arange(len(left)), sizes[0])[last[0]]
        n_links = np.zeros(len(left), np.int64)
        np.add.at(n_links, text, p * q)
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        codes[np.arange(len(ids[0])) + (np.cumsum(q) - q)[group[0]]] = 2 * ids[0] + last[0]
        codes[np.arange(len(ids[1])) + np.cumsum(p)[group[1]]] = self.b_from + 2 * ids[1] + last[1]
        written = picked(self.written, codes.tolist())
        bounds = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]).tolist()
        digests = [hashlib.sha256(b"".join(written[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]
        rows = [sizes[0].tolist(), sizes[1].tolist(), np.bincount(text, minlength=len(left)).tolist(), n_links.tolist(), digests]
        return Aligned(rows, ids, group, text)


class Aligned:
    """Counts and digests of texts; ids and groups of the tokens of both sides; the text of each group."""

    def __init__(self, rows: list[list], ids: list[np.ndarray], group: list[np.ndarray], text: np.ndarray) -> None:
        self.rows, self.ids, self.group, self.text = rows, ids, group, text


def bitmaps(pair: np.ndarray, slot: np.ndarray):
    """(pair, n, docs) of each distinct pair, of postings in order: an Arrow column of compressed bitmaps."""
    import pyarrow as pa

    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(pair)))
    for dense in (False, True):
        own = np.flatnonzero((n >= DENSE) == dense)
        if not len(own):
            continue
        if dense:
            column = []
            for i in own:
                bits = np.zeros(BLOCK_DOCS, np.uint8)
                bits[slot[start[i] : start[i] + n[i]]] = 1
                column.append(np.packbits(bits).tobytes())
            docs = pa.array(column, pa.binary())
        else:
            kept = np.repeat(n < DENSE, n)
            offsets = np.concatenate([[0], np.cumsum(2 * n[own])]).astype(np.int32)
            docs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(slot[kept].astype("<u2"))])
        yield pair[start[own]], n[own], docs


def postings_of(n: np.ndarray, docs) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of all postings of bitmaps (n, docs)."""
    rows, slots = [], []
    for i in np.flatnonzero(n >= DENSE):
        found = np.flatnonzero(np.unpackbits(np.frombuffer(docs[int(i)].as_py(), np.uint8)))
        rows.append(np.full(len(found), i))
        slots.append(found)
    few = np.flatnonzero(n < DENSE)
    rows.append(np.repeat(few, n[few]))
    slots.append(np.frombuffer(b"".join(docs.take(few).to_pylist()), "<u2"))
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


class Block:
    """Documents that a task takes together."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.tokens, self.groups = number, 0, 0, 0
        self.sides: tuple[list, list] = ([], [])
        self.slots: list[np.ndarray] = []

    def add(self, aligned: Aligned) -> None:
        """Each (group, id) once, with its number."""
        for side, ids, group in zip(self.sides, aligned.ids, aligned.group, strict=True):
            key, counts = np.unique((group + self.groups) << _ID_BITS | ids, return_counts=True)
            side.append((key, counts))
        self.slots.append(aligned.text + self.docs)
        self.groups += len(aligned.text)
        self.docs += len(aligned.rows[0])
        self.tokens += len(aligned.ids[0])

    def postings(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, slot, links) in order of pair and slot, some of A's ids at a time where there are more than ``most``."""
        if not self.groups:
            return
        slot = np.concatenate(self.slots)
        (key_a, count_a), (key_b, count_b) = ([np.concatenate(x) for x in zip(*side, strict=True)] for side in self.sides)
        mask = (1 << _ID_BITS) - 1
        group_a, id_a, id_b = key_a >> _ID_BITS, key_a & mask, key_b & mask
        n_b = np.bincount(key_b >> _ID_BITS, minlength=self.groups)
        first_b = np.cumsum(n_b) - n_b
        slices = max(1, -(-int(n_b[group_a].sum()) // most))
        for part in range(slices):
            at = np.flatnonzero(id_a % slices == part)
            times = n_b[group_a[at]]
            left = np.repeat(at, times)
            right = np.repeat(first_b[group_a[at]] - (np.cumsum(times) - times), times) + np.arange(len(left))
            key = id_a[left] << (_ID_BITS + _SLOT_BITS) | id_b[right] << _SLOT_BITS | slot[group_a[left]]
            order = np.argsort(key)
            key, links = key[order], (count_a[left] * count_b[right])[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if len(start):
                yield key[start] >> _SLOT_BITS, key[start] & (BLOCK_DOCS - 1), np.add.reduceat(links, start)

    def rows(self, most: int) -> Iterator[tuple]:
        """(pair, plane, n, docs) of its bitmaps, as columns."""
        for pair, slot, links in self.postings(most):
            for found in bitmaps(pair, slot):
                yield found[0], _PRESENCE, *found[1:]
            further, plane = links - 1, 0
            while (further >> plane).any():
                own = (further >> plane & 1) == 1
                for found in bitmaps(pair[own], slot[own]):
                    yield found[0], plane, *found[1:]
                plane += 1


def _blocks(make_aligner, docs: DataFrame, block_docs: int, block_tokens: int, most: int) -> DataFrame:
    """A row a document (block, slot, its counts and digest) and a row a bitmap (block, pair, plane, n, docs), in one pass."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(_BLOCKS)])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        aligner, form = make_aligner(), to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)

        def batch(n: int, columns: dict):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in form], schema=form)

        def closed():
            for pair, plane, n, found in block.rows(most):
                number = pa.array(np.full(len(pair), block.number))
                yield batch(len(pair), {"block": number, "pair": pa.array(pair), "plane": pa.array(np.full(len(pair), plane, np.int32)), "n": pa.array(n.astype(np.int32)), "docs": found})

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, min(TEXTS_AT_ONCE, block_docs - block.docs))
                at += b.num_rows
                aligned = aligner.align(*aligner.encode(b.column("text").to_pylist()))
                slots = pa.array(np.arange(block.docs, block.docs + b.num_rows, dtype=np.int32))
                names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                columns = {f: pa.array(c, form.field(f).type) for f, c in zip(names, aligned.rows, strict=True)}
                yield batch(b.num_rows, {"doc_id": b.column("doc_id"), "block": pa.array(np.full(b.num_rows, block.number)), "slot": slots, **columns})
                block.add(aligned)
                if block.docs >= block_docs or block.tokens >= block_tokens:
                    yield from closed()
                    block = Block(block.number + 1)
        yield from closed()

    return docs.mapInArrow(run, schema)


def _aligner(a_path: str, b_path: str, pattern: str):
    def make() -> Aligner:
        cache, key = worker_cache(), ("alignment", a_path, b_path, pattern)
        if key not in cache:
            cache[key] = Aligner(TokenizerA(a_path, pattern), TokenizerB(b_path))
        return cache[key]

    return make


def inverted(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS, most: int = POSTINGS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(documents with block and slot, bitmaps by block, pair and plane), written to the shared folder."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    written = cut(_blocks(_aligner(a_path, b_path, pattern), rows, block_docs, block_tokens, most), "alignment")
    return written.where("slot IS NOT NULL").drop("pair", "plane", "n", "docs"), written.where("pair IS NOT NULL").select("block", "pair", "plane", "n", "docs")


def pair_counts(maps: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, n_links (popcounts over all blocks) and whether n_docs is the highest of a."""
    present = F.col("plane") == _PRESENCE
    digits = F.when(present, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(plane, 0))"))
    counts = maps.groupBy("pair").agg(F.sum(F.when(present, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * digits).alias("n_links"))
    counts = counts.withColumns({"a": F.shiftright("pair", _ID_BITS), "b": F.col("pair").bitwiseAND((1 << _ID_BITS) - 1)})
    # An id of A has as many pairs as B has ids at most.
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _score_block(table):
    import pyarrow as pa

    n, docs = table["n"].to_numpy(), table["docs"].combine_chunks()
    row, slot = postings_of(n, docs)
    plane, count, best = table["plane"].to_numpy(), table["n_docs"].to_numpy(), np.array(table["best"].to_pylist(), np.int64)
    links = np.left_shift(1, np.maximum(plane, 0).astype(np.int64))[row]
    sums = np.zeros((2, BLOCK_DOCS), np.int64)
    np.add.at(sums[0], slot, links * best[row])
    np.add.at(sums[1], slot, links * count[row])
    at = np.flatnonzero(sums[1])
    return pa.table({"block": pa.array(np.full(len(at), table["block"][0].as_py())), "slot": pa.array(at.astype(np.int32)), "n_best": pa.array(sums[0][at]), "count_sum": pa.array(sums[1][at])})


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS, most: int = POSTINGS_AT_ONCE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A reads a blank and the text, B the text, to which it adds the blank. A pair's count is its number of rows over all
    of docs; n_best counts the links whose pair has the highest count of its A id, ties included; count_sum adds the
    counts of all links. Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no
    tokens. Repeated rows and ids are rows of their own; null ids stay null; other columns are ignored.
    """
    rows, maps = inverted(docs, a_path, b_path, pattern, text, doc_id, block_docs, block_tokens, most)
    scored = maps.join(pair_counts(maps).select("pair", "n_docs", "best"), "pair")
    sums = scored.groupBy("block").applyInArrow(_score_block, "block long, slot int, n_best long, count_sum long")
    found = rows.join(sums, ["block", "slot"], "left")
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
