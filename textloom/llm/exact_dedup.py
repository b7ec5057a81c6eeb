"""Exact deduplication by Grace hashing.

Every partition first folds its own copies in an open-addressing table (so a text that a third of all rows share
leaves each task once). What is left is dealt by a hash of the content to buckets, and a bucket whose table outgrows
the memory budget is split again and again into spill files of the task's own temporary folder, by a new hash at each
level, until each part fits. Tables compare complete contents, never digests only.
"""

from __future__ import annotations

import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach_groups, cut, let_go, slices

#: Bytes of content that one table holds before it is flushed or spilled.
TABLE_BYTES = 64 << 20
FANOUT = 16
_HEAD = "<qqB q"
Entry = tuple[bytes, "int | None", int]


class OpenTable:
    """Open addressing with linear probing over whole contents; keeps the largest id and the row count of each."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.bytes = seed, 0
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[int | None] = []
        self.count: list[int] = []

    def add(self, content: bytes, best: int | None, n: int = 1) -> None:
        h = xxhash.xxh3_64_intdigest(content, self.seed)
        mask = len(self.slots) - 1
        at = h & mask
        while (j := self.slots[at]) >= 0:
            if self.hashes[j] == h and self.contents[j] == content:
                self.count[j] += n
                if best is not None and (self.best[j] is None or best > self.best[j]):
                    self.best[j] = best
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(best)
        self.count.append(n)
        self.bytes += len(content) + 96
        if len(self.hashes) * 10 > len(self.slots) * 6:
            self._grow()

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (len(self.slots) * 2)
        mask = len(self.slots) - 1
        for j, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = j

    def entries(self) -> Iterator[Entry]:
        return zip(self.contents, self.best, self.count, strict=True)


def _read_spill(path: str) -> Iterator[Entry]:
    with open(path, "rb") as f:
        while head := f.read(struct.calcsize(_HEAD)):
            size, best, known, n = struct.unpack(_HEAD, head)
            yield f.read(size), best if known else None, n


def spill_folder(level: int) -> str | None:
    """One of the folders that Spark gives its executor for spilling; None, the system's, outside of a task."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return folders[level % len(folders)] or None


def grace_groups(entries: Iterable[Entry], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[Entry]:
    """One entry per distinct content. Memory: one table of ``budget`` bytes (one content at least) a level."""
    table = OpenTable(level)
    entries = iter(entries)
    for content, best, n in entries:
        table.add(content, best, n)
        if table.bytes > budget and len(table.hashes) > 1:
            break
    else:
        yield from table.entries()
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=spill_folder(level)) as folder:
        files = [open(os.path.join(folder, str(i)), "wb") for i in range(FANOUT)]
        for source in (table.entries(), entries):
            for content, best, n in source:
                f = files[xxhash.xxh3_64_intdigest(content, 1000 + level) % FANOUT]
                f.write(struct.pack(_HEAD, len(content), best or 0, best is not None, n))
                f.write(content)
        del table
        for f in files:
            f.close()
            yield from grace_groups(_read_spill(f.name), budget, level + 1)
            os.remove(f.name)


_PARTIAL = pa.schema([("content", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])
_GROUP = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _rows(batches: Iterable[pa.RecordBatch], first: bool) -> Iterator[Entry]:
    let_go()
    for b in slices(batches):
        ids = b.column(1).to_pylist()
        yield from zip((x.as_py() for x in b.column(0)), ids, [1] * len(ids) if first else b.column(2).to_pylist(), strict=True)


def _fold_locally(budget: int):
    def fold(batches):
        table = OpenTable()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(table.contents, pa.binary()), pa.array(table.best, pa.int64()), pa.array(table.count, pa.int64())], schema=_PARTIAL)

        for content, best, n in _rows(batches, True):
            table.add(content, best, n)
            if table.bytes > budget:
                yield flush()
                table = OpenTable()
        if table.hashes:
            yield flush()

    return fold


def _fold_buckets(budget: int):
    def fold(batches):
        import hashlib

        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _GROUP, strict=True)], schema=_GROUP)

        for content, best, n in grace_groups(_rows(batches, False), budget):
            out.append((hashlib.sha256(content).hexdigest(), best, n))
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return fold


def content_groups(docs: DataFrame, content: Column, doc_id: str = "doc_id", budget: int = TABLE_BYTES) -> DataFrame:
    """digest (SHA-256 hex), keep_id (largest id), group_size of every distinct content."""
    rows = docs.select(F.encode(content, "UTF-8").alias("content"), F.col(doc_id).cast("long").alias("id"))
    parts = rows.mapInArrow(_fold_locally(budget), "content binary, best long, n long")
    dealt = parts.repartition(F.xxhash64("content"))
    return dealt.mapInArrow(_fold_buckets(budget), "digest string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=lambda c: c, budget: int = TABLE_BYTES) -> DataFrame:
    """All rows and columns of docs, with keep_id, group_size, kept and text_sha256 added (replaced if they exist).

    normalise maps the text column before comparison (default: no change). A null text counts as empty; of equal
    texts the largest doc_id stays; a null doc_id never beats another; rows that repeat a doc_id count one by one and
    are kept or dropped together. An empty table gives an empty result.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*added)
    content = normalise(F.coalesce(F.col(text), F.lit("")))
    groups = cut(content_groups(docs, content, doc_id, budget).where("group_size > 1"), "exact-groups")
    groups = groups.withColumnRenamed("digest", "text_sha256")
    rows = docs.withColumn("text_sha256", F.sha2(content, 256))
    out = attach_groups(rows, groups, "text_sha256", F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col(doc_id)).otherwise(F.col("keep_id"))
    return out.select(
        *docs.columns,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(doc_id).eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
