"""Token ids in sorted-string-table shards.

A shard file holds documents in key order:

    data blocks | block index | Bloom filter | footer

A data block is zstd-compressed and holds entries ``shared key bytes, own key bytes, value bytes`` (varints), the rest of
the key, and the value: the document's start within the shard (varint) and its ids (2 or 4 bytes each, little-endian).
The index has each block's first key, offset and length; a lookup asks the Bloom filter, bisects the index and reads one
block. Keys are ``00`` for a null id, else ``01`` and the id as 8 big-endian bytes with the sign bit flipped.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import partitions, scratch, text_or_empty, worker_cache

BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of rows that are encoded at once, about.
ROWS_BYTES = 8 << 20
MAGIC = b"TLSST001"
_FOOTER = "<QQQQQQB8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
#: Distinct parts of words whose ids a worker keeps; beyond it the cache starts anew.
PART_CACHE = 1_200_000
#: Signs at a word's end that the tokenizer always parts from the letters before.
_END_SIGNS = ".,!?;:#$%&*|"
#: Words that Arrow splits into parts as split_word does: of Latin letters, whose lower case is one letter for all.
_PLAIN_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN = _PLAIN_LETTERS + r"[.,!?;:#$%&*|]*$"
#: How the vocabulary marks a word's last piece. Where it has no such mark, every part is encoded apart.
_WORD_END = "</w>"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_bits(keys: Iterable[bytes], n: int) -> np.ndarray:
    """Bit positions of each key in a filter of n bits."""
    pairs = np.array([(xxhash.xxh3_64_intdigest(k, 1), xxhash.xxh3_64_intdigest(k, 2) | 1) for k in keys], np.uint64).reshape(-1, 2)
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return ((pairs[:, :1] + steps * pairs[:, 1:]) % np.uint64(n)).astype(np.int64)


class ShardWriter:
    """Writes one shard to a binary file object; keys must come in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.offset = self.tokens = 0
        self.block, self.block_first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_first = key
        value = _varint(self.tokens) + ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zstd.compress(bytes(self.block))
            self._write(data)
            self.index.append((self.block_first, self.offset - len(data), len(data)))
            self.block = bytearray()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self._flush()
        at_index = self.offset
        self._write(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        at_bloom = self.offset
        n_bits = max(64, len(self.keys) * BLOOM_BITS)
        bits = np.zeros(math.ceil(n_bits / 8) * 8, np.uint8)
        if self.keys:
            bits[_bloom_bits(self.keys, n_bits).ravel()] = 1
        self._write(np.packbits(bits, bitorder="little").tobytes())
        self._write(struct.pack(_FOOTER, at_index, at_bloom - at_index, at_bloom, n_bits, len(self.keys), self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a random-access file object."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        foot = self._read(size - _FOOTER_BYTES, _FOOTER_BYTES)
        at_index, n_index, at_bloom, self.n_bits, self.n_keys, self.n_tokens, self.width, magic = struct.unpack(_FOOTER, foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at = self._read(at_index, n_index), 0
        self.first, self.blocks = [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.first.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((offset, length))
        self.bloom = np.unpackbits(np.frombuffer(self._read(at_bloom, math.ceil(self.n_bits / 8)), np.uint8), bitorder="little")

    def _read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(*self.blocks[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            end = at + own + size
            start, at = _read_varint(data, at + own)
            yield key, start, np.frombuffer(data[at:end], f"<u{self.width}")
            at = end

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[tuple[int, np.ndarray]]:
        """(start in shard, ids) of every document with this key."""
        if not self.blocks or not self.bloom[_bloom_bits([key], self.n_bits)].all():
            return []
        found = []
        for block in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[block] > key:
                break
            found += [(start, ids) for k, start, ids in self._entries(block) if k == key]
        return found


class WordEncoder:
    """A public tokenizer's ids of whole texts, by way of the ids of each distinct word between blanks or line feeds.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order. The
    tokenizers library encodes each part of a word that is not in the cache; a special token's string in a text is that
    token, as in the library's own call, or with ``special_as_text`` ordinary text. Arrow finds the distinct words of many
    texts and their distinct parts, so Python looks at each of these once, not at every word.
    """

    def __init__(self, path: str, end_id: int | None, special_as_text: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.end = b"" if end_id is None else int(end_id).to_bytes(self.width, "little")
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def split_word(word: str) -> tuple[str, ...]:
        """Parts that the tokenizer encodes apart: letters, lower-cased as it would, and signs after them."""
        letters = word.rstrip(_END_SIGNS)
        if not letters.isalpha():
            return (word,)
        # A capital sigma's lower case depends on its place for Python, not for the tokenizer.
        low = letters if "\u03a3" in letters else letters.lower()
        # Some capitals, as I with a dot, become a letter and a sign, which the tokenizer joins to the signs after it.
        if not low.isalpha():
            return (word,)
        return (low,) if len(letters) == len(word) else (low, word[len(letters) :])

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in found]

    def _encode_letters(self, parts: list[str]) -> list[bytes]:
        """As _encode_parts, for parts of letters: encoded as one text and cut after the ids that end a word.

        Each part has one such id at least, so as many as there are parts are one for each; else each part is encoded apart.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, f"<u{self.width}")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.width
        if len(cuts) != len(parts) or cuts[-1] != ids.nbytes:
            return self._encode_parts(parts)
        data, cuts = ids.tobytes(), cuts.tolist()
        return [data[b:e] for b, e in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _split(self, words):
        """First and second parts of an Arrow array of words; where there is no second it is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(words, _PLAIN)
        own, other = words.filter(plain), pc.invert(plain)
        others = [self.split_word(w) for w in _strings(words.filter(other))]
        # Places of each word among the plain ones, and then the others.
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(other)]))
        first = pa.array([p[0] for p in others], words.type)
        second = pa.array([p[1] if len(p) > 1 else "" for p in others], words.type)
        first = pa.concat_arrays([pc.utf8_lower(pc.ascii_rtrim(own, characters=_END_SIGNS)), first])
        second = pa.concat_arrays([pc.replace_substring_regex(own, _PLAIN_LETTERS, ""), second])
        return first.take(pa.array(order)), second.take(pa.array(order))

    def _ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts one after the other, and how many each has."""
        if len(self.parts) > PART_CACHE:
            self.parts.clear()
        missing = [p for p in parts if p not in self.parts]
        letters = [p for p in missing if p.isalpha()]
        others = [p for p in missing if not p.isalpha()]
        for own, encode in ((letters, self._encode_letters), (others, self._encode_parts)):
            for at in range(0, len(own), 512):
                self.parts.update(zip(own[at : at + 512], encode(own[at : at + 512]), strict=True))
        found = list(map(self.parts.__getitem__, parts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        return np.frombuffer(b"".join(found), f"<u{self.width}"), sizes

    def encode_batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        first, second = self._split(coded.dictionary)
        parts = pa.concat_arrays([first, second]).dictionary_encode()
        ids, sizes = self._ids_of(_strings(parts.dictionary))
        # Two parts make a word, words make the texts.
        pairs = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        ids, sizes = _gather(ids, sizes, pairs), sizes[pairs].reshape(-1, 2).sum(axis=1)
        at_words = coded.indices.to_numpy()
        ids, ends = _gather(ids, sizes, at_words), np.concatenate([[0], np.cumsum(sizes[at_words])])
        cuts = ends[rows.offsets.to_numpy() - rows.offsets[0].as_py()].tolist()
        end = np.frombuffer(self.end, ids.dtype)
        return [np.concatenate([ids[b:e], end]) for b, e in zip(cuts, cuts[1:], strict=False)]


def _strings(array) -> list[str]:
    """An Arrow array's strings; to_pylist makes a scalar of each first."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _gather(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of values, of the given sizes one after the other, in another order, one after the other."""
    starts, own = (np.cumsum(sizes) - sizes)[order], sizes[order]
    places = np.repeat(starts - (np.cumsum(own) - own), own)
    places += np.arange(len(places))
    return values[places]


def to_arrow(rows: list[tuple], schema: T.StructType):
    """A record batch of rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], names=kinds.names)


def open_filesystem(uri: str):
    """pyarrow's file system for a URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("uri", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])
ENTRIES = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")), T.StructField("shard", T.IntegerType())])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """Encodes every whole text and writes one shard file a range of doc_id under ``path`` (a URI that pyarrow opens).

    Null texts are empty (only the end id, if any); null ids come first; rows that repeat an id stay, one entry each,
    in order of their texts; other columns are ignored; an empty table gives no shards. A retried task writes a new
    attempt's file and moves it over the old, so shards are whole. Returns the manifest, one row a shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    dealt = rows.repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        cache = worker_cache()
        if (encoder := cache.get(("words", tokenizer, end_id))) is None:
            encoder = cache[("words", tokenizer, end_id)] = WordEncoder(tokenizer, end_id)
        files, root = open_filesystem(path)
        files.create_dir(root, recursive=True)
        name, shard = f"{root}/shard-{task.partitionId():06d}.sst", task.partitionId()
        attempt = f"{root}/.attempt-{task.taskAttemptId()}"
        with files.open_output_stream(attempt) as out:
            writer = ShardWriter(out, encoder.width)
            while first is not None:
                rows = max(1, first.num_rows * ROWS_BYTES // max(first.nbytes, 1))
                for at in range(0, first.num_rows, rows):
                    part = first.slice(at, rows)
                    for i, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_batch(part.column("text").to_pylist()), strict=True):
                        writer.add(key_of(i), ids)
                first = next(batches, None)
            writer.close()
        files.move(attempt, name)
        yield to_arrow([(shard, f"{path}/shard-{shard:06d}.sst", len(writer.keys), writer.tokens, writer.offset)], MANIFEST)

    manifest = dealt.mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and shard of every entry of the shards' files."""
    from pyspark.sql import Window

    # The manifest has a row a shard: small enough for one task whatever the corpus.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for shard, uri, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "uri", "base")), strict=True):
                files, name = open_filesystem(uri)
                with files.open_input_file(name) as f:
                    rows = [(id_of(k), base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard) for k, start, ids in ShardReader(f).scan()]
                yield to_arrow(rows, ENTRIES)

    spread = bases.repartition(partitions(manifest.sparkSession), "shard")
    return spread.mapInArrow(read, ENTRIES)


def encode_to_shards(docs: DataFrame, tokenizer: str, end_id: int | None, **options) -> DataFrame:
    """write_shards into the shared folder, then read_shards."""
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "sst"), tokenizer, end_id, **options))
