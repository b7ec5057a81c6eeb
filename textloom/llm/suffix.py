"""Removal of byte strings that also start in an earlier document, by a distributed difference-cover suffix sort.

Suffixes are dealt before they are sorted. Each window of ``length`` bytes has an anchor, the k-gram of least hash in
it; equal windows have equal anchors at equal places, so all windows of one anchor go to one part. Four jobs follow:

1. anchors of all texts are counted by part, packed and folded in each task, to find those of two documents or more;
2. texts with such anchors give, for each anchor, the context that its windows span; equal contexts are folded. A hot
   anchor's windows are contexts of their own, and go to parts by their own hash;
3. each part sorts the suffixes of its different contexts by the difference-cover algorithm (sort the sampled triples,
   recurse on their names, merge the remaining suffixes) and compares adjacent prefixes of ``length`` bytes; a window is
   covered if its run holds a smaller document;
4. the covered windows come back to their texts, are joined to spans and cut out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import partitions, text_or_empty

#: Bytes of an anchor; bytes of text that are hashed at once; bytes of context that one suffix array sorts at most
#: (more only if one anchor's different contexts are longer).
ANCHOR, PIECE_BYTES, ARRAY_BYTES = 24, 1 << 17, 1 << 20
#: Anchors, and bytes of contexts, that a task folds before it passes them on.
FOLD_ANCHORS, FOLD_BYTES = 2_000_000, 48 << 20
#: Bytes of packed texts, about, that a task unpacks at once.
TEXT_BYTES = 4 << 20
#: Bytes of text for which there is a part, about; more where executors have memory for it.
PART_BYTES = 12 << 20
#: An anchor is hot if it is in more documents than this, and in more than a HOT_SHARE-th of what its part counts: so a
#: part has fewer than HOT_SHARE hot anchors.
HOT_DOCS, HOT_SHARE = 20_000, 8
#: Parts up to so many are dealt to a partition each.
MOST_EVEN = 20_000
#: Strings longer than this are refused, as places in contexts are stored in 16 bits.
MOST_LENGTH = 30_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U32 = np.uint64(0xFFFFFFFF)


# ---- anchors -------------------------------------------------------------------------------------------------------


def _gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes of a, built from those of powers of two."""
    have, power, size, out, done = a.astype(np.uint64) + np.uint64(1), _BASE, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = have
            else:
                n = len(a) - done - size + 1
                out = have[:n] * _power(done) + out[size : size + n]
            done += size
        if size * 2 > k:
            break
        have = have[:-size] * power + have[size:]
        power, size = power * power, size * 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(texts: list[bytes], length: int, k: int = ANCHOR) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text of ``length`` bytes or more: its index, and its anchors' hashes, places, first and last windows, in order."""
    w = length - k + 1
    piece: list[int] = []
    total = 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            piece.append(i)
            total += len(t)
            if total >= PIECE_BYTES:
                yield from _piece_anchors(texts, piece, length, k, w)
                piece, total = [], 0
    if piece:
        yield from _piece_anchors(texts, piece, length, k, w)


def _piece_anchors(texts, piece, length, k, w):
    sizes = np.array([len(texts[i]) for i in piece])
    a = np.frombuffer(b"".join([texts[i] for i in piece]), np.uint8)
    h = _gram_hashes(a, k)
    # Place in the low 32 bits, whatever the piece's size: among equal high bits the leftmost is least, in all equal windows alike.
    least = _window_min((h & ~_U32) | np.arange(len(h), dtype=np.uint64), w) & _U32
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for i, s, e in zip(piece, starts, ends, strict=True):
        owner = least[s : e - length + 1].astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        place = owner[first]
        yield i, h[place], place - s, first, last


# ---- difference cover ----------------------------------------------------------------------------------------------


def _tie_ranks(keys: np.ndarray) -> np.ndarray:
    """Of each key, 1 + the number of keys that are strictly less."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) + 1
    return out


def suffix_ranks(t: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of t (positive symbols, below 2^21 for up to 2^21 of them, else below 2^31) by ``depth`` symbols at least; equal where those are equal.

    Difference cover {1, 2} mod 3: triples at sampled places are sorted and named; the names are ranked by recursion
    (to a third of the depth); the places left are ranked by their symbol and the next sampled rank, and merged.
    """
    n = len(t)
    padded = np.concatenate([t.astype(np.int64), np.zeros(4, np.int64)])
    sampled = [np.arange(r, n, 3) for r in (1, 2)]
    places = np.concatenate(sampled)
    rest = np.arange(0, n, 3)
    if len(places) == 0:
        return np.ones(n, np.int64)
    bits, heads = 21, padded[:-1] << 21 | padded[1:]
    if n >= 1 << 21:  # pairs of symbols get names, so that three fit in a key
        bits, heads = 31, _tie_ranks(padded[:-1] << 31 | padded[1:])
    names = _tie_ranks(heads[places] << bits | padded[places + 2])
    if depth > 3 and len(np.unique(names)) < len(names):
        # Names that are dense keep the symbols of the recursion small; 0 parts the two sequences.
        names = np.unique(names, return_inverse=True)[1] + 1
        m = len(sampled[0])
        inner = suffix_ranks(np.concatenate([names[:m], [0], names[m:], [0]]), -(-depth // 3))
        names = _tie_ranks(np.concatenate([inner[:m], inner[m + 1 : -1]]))
    rank = np.zeros(n + 4, np.int64)
    rank[places] = names

    def one(p: np.ndarray) -> np.ndarray:
        return padded[p] << 31 | rank[p + 1]

    def two(p: np.ndarray) -> np.ndarray:
        return heads[p] << bits | rank[p + 2]

    rest_one, rest_two = one(rest), two(rest)
    less_one, less_two = np.sort(rest_one), np.sort(rest_two)
    out = np.zeros(n, np.int64)
    out[sampled[0]] = rank[sampled[0]] + np.searchsorted(less_one, one(sampled[0]))
    out[sampled[1]] = rank[sampled[1]] + np.searchsorted(less_two, two(sampled[1]))
    out[rest] = np.searchsorted(less_one, rest_one) + np.searchsorted(np.sort(one(sampled[0])), rest_one) + np.searchsorted(np.sort(two(sampled[1])), rest_two) + 1
    return out


def covered_windows(contexts: list[bytes], docs: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(index of a context, its window starts that are equal to a window of a smaller document's context)."""
    joined = np.frombuffer(b"\x00".join(contexts), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(c) for c in contexts])
    at = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    n_windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), n_windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    places = at[owner] + start
    order = np.argsort(suffix_ranks(joined, length)[places], kind="stable")
    places, owner, start = places[order], owner[order], start[order]
    windows = np.lib.stride_tricks.sliding_window_view(joined.astype(np.uint16), length)
    new = np.ones(len(places), bool)
    for i in range(1, len(places), 65_536):
        j = min(len(places), i + 65_536)
        new[i:j] = (windows[places[i:j]] != windows[places[i - 1 : j - 1]]).any(axis=1)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner], first)
    hit = docs[owner] > np.repeat(least, np.diff(np.concatenate([first, [len(owner)]])))
    owner, start = owner[hit], start[hit]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if not len(owner):
        return []
    bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return [(int(owner[b]), start[b:e]) for b, e in zip(bounds, [*bounds[1:], len(owner)], strict=True)]


# ---- jobs ----------------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first (ascending) as differences, compressed."""
    n = np.array([len(arrays[0])], "<u8").tobytes()
    body = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)).tobytes(), *[x.tobytes() for x in arrays[1:]]]
    return zstandard.ZstdCompressor(level=1).compress(n + b"".join(body))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw[:8], "<u8")[0]), 8, []
    for kind in types:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    out[0] = np.cumsum(out[0])
    return out


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places of that key) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    bounds = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    for b, e in zip(bounds, [*bounds[1:], len(keys)], strict=True):
        yield int(ordered[b]), order[b:e]


def _anchor_key(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash in the high half, 32 bits of the hash in the low half."""
    return (((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32)) | (h & _U32)


#: kind is HOT_KEYS, 0 for what passes to documents, 1 or 2 for what the next job folds.
ROUTED = "part int, kind int, a binary, b binary"
HOT_KEYS, TEXT = -1, 9


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "a", "b"])


def _shards(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part to which a document's own rows go."""
    distinct, place = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % parts for i in distinct.tolist()], np.int64)[place]


def _pack_texts(parts: int):
    """Texts to rows (shard, TEXT, (ids, sizes), texts): those of a shard are compressed together."""

    def flush(ids: list[int], texts: list[bytes]) -> pd.DataFrame:
        doc, sizes = np.array(ids, "<i8"), np.array([len(t) for t in texts], "<i8")
        rows = []
        for shard, at in _split(_shards(doc, parts)):
            blob = b"".join([texts[i] for i in at.tolist()])
            rows.append((shard, TEXT, _pack(doc[at], sizes[at]), zstandard.ZstdCompressor(level=3).compress(blob)))
        return _frame(rows)

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= FOLD_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return run


def _texts(packed: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """ids and texts of rows of _pack_texts, some at a time."""
    ids: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0
    for a, b in zip(packed["a"], packed["b"], strict=True):
        doc, sizes = _unpack(a, "<i8", "<i8")
        blob = zstandard.ZstdDecompressor().decompress(b)
        ends = np.cumsum(sizes)
        ids.append(doc)
        texts += [blob[s:e] for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        size += len(blob)
        if size >= TEXT_BYTES:
            yield np.concatenate(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield np.concatenate(ids), texts


def _count_anchors(length: int, parts: int):
    """Texts to rows (part, SINGLE, ids, keys), (part, MANY, keys with numbers of documents, -) and flags that are known already."""

    def flush(keys: list[np.ndarray], ids: list[np.ndarray]) -> list[tuple]:
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        again = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        keep = np.concatenate([[True], ~again])
        key, doc = key[keep], doc[keep]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([first, [len(key)]]))
        many = np.repeat(n > 1, n)
        rows = _flag_rows(key[many], doc[many], parts)
        shared, n_shared = key[first[n > 1]], n[n > 1].astype("<u4")
        for part, at in _split((shared >> np.uint64(32)).astype(np.int64)):
            rows.append((part, 2, _pack(shared[at], n_shared[at]), None))
        key, doc = key[~many], doc[~many]
        for part, at in _split((key >> np.uint64(32)).astype(np.int64)):
            at = at[np.argsort(doc[at], kind="stable")]
            rows.append((part, 1, _pack(doc[at], (key[at] & _U32).astype("<u4")), None))
        return rows

    def count(batches):
        np.seterr(over="ignore")
        keys, ids, n = [], [], 0
        for batch in batches:
            doc_ids = batch["doc_id"].to_numpy(np.int64)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for i, h, *_ in anchors(texts, length):
                keys.append(_anchor_key(h, parts))
                ids.append(np.full(len(h), doc_ids[i]))
                n += len(h)
                if n >= FOLD_ANCHORS:
                    yield _frame(flush(keys, ids))
                    keys, ids, n = [], [], 0
        if keys:
            yield _frame(flush(keys, ids))

    return count


def _flag_rows(key: np.ndarray, doc: np.ndarray, parts: int) -> list[tuple]:
    """Rows (shard, FLAGS, ids, keys): documents' anchors that another document has."""
    rows = []
    for shard, at in _split(_shards(doc, parts)):
        at = at[np.argsort(doc[at], kind="stable")]
        rows.append((shard, 0, _pack(doc[at], key[at]), None))
    return rows


def _find_shared(parts: int, hot_docs: int):
    """Rows of _count_anchors, dealt by part (flags by shard), to flags by shard and hot anchors for every shard."""

    def find(batches):
        singles, many = [], []
        for batch in batches:
            passed = batch[batch["kind"] == 0]
            if len(passed):
                yield passed
            for part, kind, a in zip(batch["part"], batch["kind"], batch["a"], strict=True):
                if kind == 1:
                    doc, low = _unpack(a, "<i8", "<u4")
                    singles.append((doc, low.astype(np.uint64) | np.uint64(int(part) << 32)))
                elif kind == 2:
                    many.append(_unpack(a, "<u8", "<u4"))
        doc, key = (np.concatenate([x[i] for x in singles] or [np.zeros(0, kind)]) for i, kind in ((0, np.int64), (1, np.uint64)))
        shared, n_shared = (np.concatenate([x[i] for x in many] or [np.zeros(0, kind)]) for i, kind in ((0, np.uint64), (1, np.uint32)))
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        last = np.concatenate([first[1:], [len(key)]]) if len(key) else first
        keys, place = np.unique(np.concatenate([key[first], shared]), return_inverse=True)
        n_docs = np.bincount(place, np.concatenate([last - first, n_shared]), len(keys))
        hot = keys[n_docs > max(hot_docs, n_docs.sum() / HOT_SHARE)]
        if len(hot):
            packed = _pack(hot)
            yield _frame([(part, HOT_KEYS, packed, None) for part in range(parts)])
        if len(key):
            hit = (doc[first] != doc[last - 1]) | np.isin(key[first], shared)
            hit = np.repeat(hit, last - first)
            if hit.any():
                yield _frame(_flag_rows(key[hit], doc[hit], parts))

    return find


def _context_rows(found: dict[bytes, tuple[int, int, int]], parts: int) -> list[tuple]:
    """Rows (part, CONTEXTS, (ids, starts, places, sizes), contexts)."""
    by_part: dict[int, list[tuple]] = {}
    for context, (part, doc, start, place) in found.items():
        by_part.setdefault(part, []).append((doc, start, place, context))
    rows = []
    for part, own in by_part.items():
        own.sort(key=lambda x: x[0])
        doc, start, place = (np.array([x[i] for x in own], kind) for i, kind in ((0, "<i8"), (1, "<i8"), (2, "<u2")))
        size = np.array([len(x[3]) for x in own], "<u2")
        rows.append((part, 1, _pack(doc, start, place, size), zstandard.ZstdCompressor(level=3).compress(b"".join(x[3] for x in own))))
    return rows


def _cover_rows(covers: list[tuple[int, int, int]], parts: int) -> list[tuple]:
    """Rows (shard, COVERS, (ids, first windows, last windows), -)."""
    if not covers:
        return []
    doc, first, last = (np.array(x, np.int64) for x in zip(*covers, strict=True))
    rows = []
    for shard, at in _split(_shards(doc, parts)):
        at = at[np.argsort(doc[at], kind="stable")]
        rows.append((shard, 0, _pack(doc[at], first[at], last[at]), None))
    return rows


def _fold(found: dict, covers: list, context: bytes, part: int, doc: int, start: int, place: int) -> None:
    """Keeps the smallest document of a context; the windows of the others are covered."""
    if (known := found.get(context)) is None:
        found[context] = (part, doc, start, place)
        return
    if doc == known[1]:
        # The same document again: whether it is covered depends on smaller ones, so it waits with the first.
        covers.append((context, doc, start))
        return
    if doc < known[1]:
        found[context] = (part, doc, start, place)
        doc, start = known[1], known[2]
    covers.append((context, doc, start))


def _contexts(length: int, parts: int):
    """Flags, then texts, of a shard, to contexts by part and covers that are known already."""

    def flagged(packed: pd.DataFrame, ids: np.ndarray) -> Iterator[tuple]:
        for doc_ids, texts in _texts(packed):
            texts = [t if x else b"" for t, x in zip(texts, np.isin(doc_ids, ids).tolist(), strict=True)]
            for i, *found in anchors(texts, length):
                yield doc_ids, i, texts[i], *found

    def run(batches):
        np.seterr(over="ignore")
        flags: list[tuple] = []
        hot = np.zeros(0, np.uint64)
        ids = keys = None
        found: dict = {}
        later: list = []
        size = 0
        for batch in batches:
            is_flag = batch["kind"] == 0
            for a in batch.loc[is_flag, "a"]:
                flags.append(_unpack(a, "<i8", "<u8"))
            for a in batch.loc[batch["kind"] == HOT_KEYS, "a"]:
                hot = np.union1d(hot, _unpack(a, "<u8")[0])
            own = batch[batch["kind"] == TEXT]
            if not len(own) or not flags:
                continue
            if ids is None:
                ids, keys = np.concatenate([x[0] for x in flags]), np.concatenate([x[1] for x in flags])
                order = np.argsort(ids, kind="stable")
                ids, keys = ids[order], keys[order]
            for doc_ids, i, text, h, place, first, last in flagged(own, ids):
                low, high = np.searchsorted(ids, doc_ids[i]), np.searchsorted(ids, doc_ids[i], "right")
                key = _anchor_key(h, parts)
                hit = np.flatnonzero(np.isin(key, keys[low:high]))
                doc = int(doc_ids[i])
                parts_of = (key[hit] >> np.uint64(32)).tolist()
                for p, s, e, part, is_hot in zip(place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), parts_of, np.isin(key[hit], hot).tolist(), strict=True):
                    for w in range(s, e + 1) if is_hot else ():
                        window = text[w : w + length]
                        size += length
                        _fold(found, later, window, zlib.crc32(window) % parts, doc, w, p - w)
                    if not is_hot:
                        context = text[s : e + length]
                        size += len(context)
                        _fold(found, later, context, part, doc, s, p - s)
                if size >= FOLD_BYTES:
                    yield _frame(_settle(found, later, length, parts))
                    found, later, size = {}, [], 0
        if found:
            yield _frame(_settle(found, later, length, parts))

    return run


def _settle(found: dict, later: list, length: int, parts: int) -> list[tuple]:
    """Rows of folded contexts: covers where a smaller document is known; contexts for each that may yet be covered.

    A document that has a context twice, and is its smallest, needs each of its places: these follow as rows of kind 2.
    """
    covers, twice = [], []
    for context, doc, start in later:
        part, least, _, place = found[context]
        if doc > least:
            covers.append((doc, start, start + len(context) - length))
        else:
            twice.append((part, doc, start, place, context))
    rows = _context_rows(found, parts) + _cover_rows(covers, parts)
    by_part: dict[int, list] = {}
    for x in twice:
        by_part.setdefault(x[0], []).append(x)
    for part, own in by_part.items():
        own.sort(key=lambda x: x[1])
        doc, start, place = (np.array([x[i] for x in own], kind) for i, kind in ((1, "<i8"), (2, "<i8"), (3, "<u2")))
        size = np.array([len(x[4]) for x in own], "<u2")
        rows.append((part, 1, _pack(doc, start, place, size), zstandard.ZstdCompressor(level=3).compress(b"".join(x[4] for x in own))))
    return rows


def _sort_parts(length: int, parts: int, k: int = ANCHOR):
    """Contexts of a part to covers by shard; covers pass."""

    def run(batches):
        found: dict[bytes, list] = {}
        covers: list[tuple[int, int, int]] = []
        for batch in batches:
            passed = batch[batch["kind"] == 0]
            if len(passed):
                yield passed
            for kind, a, b in zip(batch["kind"], batch["a"], batch["b"], strict=True):
                if kind != 1:
                    continue
                doc, start, place, size = _unpack(a, "<i8", "<i8", "<u2", "<u2")
                blob, at = zstandard.ZstdDecompressor().decompress(b), 0
                for d, s, p, n in zip(doc.tolist(), start.tolist(), place.tolist(), size.tolist(), strict=True):
                    context = blob[at : at + n]
                    at += n
                    # [least document, place of the anchor, starts in that document]
                    if (known := found.get(context)) is None:
                        found[context] = [d, p, [s]]
                    elif d == known[0]:
                        known[2].append(s)
                    else:
                        if d < known[0]:
                            found[context] = [d, p, [s]]
                            d, starts = known[0], known[2]
                        else:
                            starts = [s]
                        covers += [(d, x, x + n - length) for x in starts]
                if len(covers) > 500_000:
                    yield _frame(_cover_rows(covers, parts))
                    covers = []
        groups: dict[bytes, list[bytes]] = {}
        for context, (_, p, _) in found.items():
            groups.setdefault(context[p : p + k], []).append(context)
        block: list[bytes] = []
        size = 0
        for own in groups.values():
            # Different contexts of one window each have no window in common.
            if len(own) > 1 and max(map(len, own)) > length:
                block += own
                size += sum(map(len, own))
                if size >= ARRAY_BYTES:
                    covers += _covers_of(block, found, length)
                    block, size = [], 0
                if len(covers) > 500_000:
                    yield _frame(_cover_rows(covers, parts))
                    covers = []
        if block:
            covers += _covers_of(block, found, length)
        if covers:
            yield _frame(_cover_rows(covers, parts))

    return run


def _covers_of(block: list[bytes], found: dict, length: int) -> list[tuple[int, int, int]]:
    out = []
    docs = np.array([found[c][0] for c in block], np.int64)
    for i, starts in covered_windows(block, docs, length):
        doc, _, places = found[block[i]]
        cuts = np.flatnonzero(np.diff(starts) > 1) + 1
        for run in np.split(starts, cuts):
            out += [(doc, x + int(run[0]), x + int(run[-1])) for x in places]
    return out


def spans(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the bytes of windows first to last."""
    order = np.argsort(first, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(first[order].tolist(), (last[order] + length).tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut_out(length: int):
    """Covers, then texts, of a shard, to the result."""

    def run(batches):
        covers: list[list[np.ndarray]] = []
        ids = None
        for batch in batches:
            is_cover = batch["kind"] == 0
            covers += [_unpack(a, "<i8", "<i8", "<i8") for a in batch.loc[is_cover, "a"]]
            own = batch[~is_cover]
            if not len(own):
                continue
            if ids is None:
                ids, first, last = (np.concatenate([x[i] for x in covers]) if covers else np.zeros(0, np.int64) for i in range(3))
                order = np.argsort(ids, kind="stable")
                ids, first, last = ids[order], first[order], last[order]
            for doc_ids, texts in _texts(own):
                rows = []
                for doc, data, x, y in zip(doc_ids.tolist(), texts, np.searchsorted(ids, doc_ids), np.searchsorted(ids, doc_ids, "right"), strict=True):
                    at, kept, removed = 0, [], 0
                    cuts = spans(first[x:y], last[x:y], length) if x < y else []
                    for s, e in cuts:
                        kept.append(data[at:s])
                        removed += e - s
                        at = e
                    kept.append(data[at:])
                    rows.append((doc, len(data), removed, len(cuts), b"".join(kept)))
                out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
                yield out

    return run


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    """rows with each part in a partition of its own.

    Spark deals rows by a hash, which would put some parts together and leave other partitions empty. So it is given, for
    each part, a number whose hash is that of one partition. Above MOST_EVEN parts it is left to the hash.
    """
    if parts > MOST_EVEN:
        return rows.repartition(parts, "part")
    tried = rows.sparkSession.range(0, parts * 40 + 1000, 1, 8).select(F.col("id").cast("int").alias("key"))
    found = dict(tried.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("partition")).agg(F.min("key")).collect())
    keys = F.array(*[F.lit(found.get(p, p)) for p in range(parts)])
    return rows.repartition(parts, F.get(keys, F.col("part")))


def _with_texts(routed: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Rows of shards, then the shard's packed texts, in one partition each."""
    return _deal(routed.unionByName(texts), parts).sortWithinPartitions("kind")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, keep_bytes: bool = False, part_bytes: int = PART_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs) and kept_sha256 (and with keep_bytes kept, the bytes left) of every row.

    Removed is each byte of the UTF-8 text that a string of ``length`` bytes covers which also starts in a document
    with a smaller doc_id, judged on the whole input. Null texts are empty; texts shorter than ``length`` stay whole.
    Rows that repeat a doc_id are one document for this and don't cover each other; a null id is smaller than none, so
    such rows stay whole and cover no others. An empty table gives an empty result; other columns are ignored.
    """
    if not ANCHOR <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {ANCHOR} to {MOST_LENGTH}")
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = every.where("doc_id IS NOT NULL")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-n_bytes // part_bytes))
    packed = rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(_pack_texts(parts), ROUTED)
    counted = rows.mapInPandas(_count_anchors(length, parts), ROUTED)
    flags = _deal(counted, parts).mapInPandas(_find_shared(parts, hot_docs), ROUTED)
    contexts = _with_texts(flags, packed, parts).mapInPandas(_contexts(length, parts), ROUTED)
    covers = _deal(contexts, parts).mapInPandas(_sort_parts(length, parts), ROUTED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    out = _with_texts(covers, packed, parts).mapInPandas(_cut_out(length), schema)
    data, none = F.encode("text", "UTF-8"), F.lit(0).cast("long")
    whole = every.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), data.alias("kept"), F.sha2(data, 256).alias("kept_sha256"))
    out = out.unionByName(whole)
    return out if keep_bytes else out.drop("kept")
