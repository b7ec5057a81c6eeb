"""Byte-level BPE encoding and decoding.

Every text is cut into chunks that overlap, and all chunks are pre-tokenised by themselves, each from its own first
character. A scan's future depends on its position alone, so where two neighbours' scans share a boundary in their
overlap they agree from there on: that is where the text is cut into pieces. Pieces are encoded apart and their ids
joined in order. A cut never follows white space, the only place where the pattern looks ahead, so a piece alone gives
the same matches as within its text. A text of one chunk is one piece. The chunks and pieces of texts above TASK_CHARS
are dealt out over all tasks; those of other texts stay in the task that reads the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, map_texts, partitions, text_or_empty, worker_tool

CHUNK_CHARS, OVERLAP_CHARS, TASK_CHARS = 4096, 256, 1 << 18


class Codec:
    """tiktoken with the given ranks and pattern."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Ends of the pattern's matches in [low, high] that don't follow white space; the scan starts at 0."""
        ends = (m.end() for m in self.pattern.finditer(text, 0))
        out = []
        for e in ends:
            if e > high:
                break
            if e >= low and not text[e - 1].isspace():
                out.append(e)
        return out


def codec(ranks_path: str, pattern: str) -> Codec:
    return worker_tool(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def chunks_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(number, chunk with its overlap, is the last) of a text's chunks; one at least."""
    n = max(1, -(-len(text) // size))
    for k in range(n):
        yield k, text[k * size : (k + 1) * size + overlap], k == n - 1


def edges_of(c: Codec, k: int, chunk: str, last: bool, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk's scan, as places in the text: in its first characters, and in what it shares with the next."""
    at = k * size
    heads = [at + p for p in c.boundaries(chunk, 1, overlap)] if k else []
    # The last matches before the chunk's end may be longer in the whole text.
    tails = [] if last else [at + p for p in c.boundaries(chunk, size + 1, len(chunk))[:-2]]
    return heads, tails


def stitch(edges: list[tuple[list[int], list[int]]]) -> list[int]:
    """Where neighbouring scans first agree. Past a joint without a shared boundary nothing is known: the rest is one piece."""
    cuts = []
    for (_, tails), (heads, _) in zip(edges, edges[1:], strict=False):
        shared = set(tails).intersection(heads)
        if not shared:
            break
        cuts.append(min(shared))
    return cuts


def encode_text(c: Codec, text: str, size: int, overlap: int) -> np.ndarray:
    """Ids of a text by its chunks, in one task."""
    chunks = list(chunks_of(text, size, overlap))
    cuts = stitch([edges_of(c, *chunk, size, overlap) for chunk in chunks]) if len(chunks) > 1 else []
    return np.concatenate([np.array(c.encode(text[a:b]), np.uint32) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])


def _chunks(size: int, overlap: int):
    def chunks(batches):
        for batch in batches:
            rows = [(r, *x) for r, t in zip(batch["_row"], batch["text"], strict=True) for x in chunks_of(t, size, overlap)]
            for at in range(0, len(rows), 256):
                yield pd.DataFrame(rows[at : at + 256], columns=["_row", "k", "chunk", "last"])

    return chunks


def _edges(ranks_path: str, pattern: str, size: int, overlap: int):
    def edges(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            found = [edges_of(c, k, text, last, size, overlap) for k, text, last in zip(batch["k"].tolist(), batch["chunk"], batch["last"], strict=True)]
            yield pd.DataFrame({"_row": batch["_row"], "k": batch["k"], "heads": [x[0] for x in found], "tails": [x[1] for x in found]})

    return edges


def _encode_pieces(ranks_path: str, pattern: str):
    def encode(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            ids = [np.array(c.encode(t), "<u4").tobytes() for t in batch["piece"]]
            yield pd.DataFrame({"_row": batch["_row"], "at": batch["at"], "ids": ids})

    return encode


def _pieces(batches):
    for batch in batches:
        rows = [(r, a, t[a:b]) for r, t, cuts in zip(batch["_row"], batch["text"], batch["cuts"], strict=True) for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        for at in range(0, len(rows), 256):
            yield pd.DataFrame(rows[at : at + 256], columns=["_row", "at", "piece"])


def _summary(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    ids = ids.tolist()
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode_long(rows: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """_row, parts (little-endian 4-byte ids of its pieces in order) of rows (_row unique, text), all tasks sharing the chunks."""
    n = partitions(rows.sparkSession)
    chunks = rows.mapInPandas(_chunks(chunk_chars, overlap), "_row long, k int, chunk string, last boolean").repartition(n, "_row", "k")
    edges = chunks.mapInPandas(_edges(ranks_path, pattern, chunk_chars, overlap), "_row long, k int, heads array<long>, tails array<long>")
    order = Window.partitionBy("_row").orderBy("k")
    shared = F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))
    joints = edges.withColumns({"cut": shared, "end": F.lead("k").over(order).isNull()})
    # As stitch has it.
    broken = F.max((F.col("cut").isNull() & ~F.col("end")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cuts = joints.withColumn("broken", broken).groupBy("_row").agg(F.sort_array(F.collect_list(F.when(F.col("broken") == 0, F.col("cut")))).alias("cuts"))
    pieces = rows.join(cuts, "_row").mapInPandas(_pieces, "_row long, at long, piece string").repartition(n, "_row", "at")
    ids = pieces.mapInPandas(_encode_pieces(ranks_path, pattern), "_row long, at long, ids binary")
    joined = ids.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return joined.select("_row", F.transform("parts", lambda p: p["ids"]).alias("parts"))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256 (of the decoded bytes) of every row.

    Null and empty texts have no tokens; repeated rows and ids give a row each; null ids stay null; other columns are
    ignored. Texts up to task_chars aren't shuffled; the chunks of longer ones go through encode_long.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def make():
        c = codec(ranks_path, pattern)
        return lambda texts: list(zip(*[_summary(c, encode_text(c, t, chunk_chars, overlap)) for t in texts], strict=True))

    def make_long():
        c = codec(ranks_path, pattern)
        return lambda parts: list(zip(*[_summary(c, np.frombuffer(b"".join(p), "<u4")) for p in parts], strict=True))

    small = F.length("text") <= task_chars
    large = cut(rows.where(~small).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    parts = encode_long(large.select("_row", "text"), ranks_path, pattern, chunk_chars, overlap)
    joined = large.select("_row", "doc_id").join(parts, "_row").select("doc_id", "parts")
    return map_texts(rows.where(small), make, fields).unionByName(map_texts(joined, make_long, fields, text="parts"))
