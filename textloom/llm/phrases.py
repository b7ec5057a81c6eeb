"""Phrase collocations by Toivonen's mining.

A sample of the documents proposes phrases at a lowered threshold. One full pass then counts, exactly and over all
documents, the proposed phrases and their negative border: phrases that aren't proposed though all of their shorter parts
are (single words have no parts, so all words are counted). A border phrase that turns out frequent is a failure: phrases
that hold it were not counted. It is added to the proposals, and a further pass counts what is on the border now and was
not before, until no failure is left. Every frequent phrase has then been counted, exactly once.

Proposals are tested in tasks through Bloom filters of a fixed size, whatever the corpus. A false positive makes a pass
count a phrase that it need not have counted; it never changes a count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import attach_groups, cut, partitions, text_or_empty

#: One document in so many is in the sample; share of the expected number of occurrences from which it proposes a phrase, twice
#: at least.
SAMPLE, LOWERED = 8, 0.8
#: Bits of a Bloom filter for each proposed phrase, and of a filter at most (16 MB), the bound of what is broadcast. More make
#: passes on very large corpora cheaper.
PHRASE_BITS, FILTER_BITS = 8, 1 << 27
#: Words that a task counts together, distinct words that it remembers, and rows that it hands over at once.
_WORDS_AT_ONCE, _WORDS_KEPT = 1_500_000, 400_000
_ROWS_AT_ONCE = 20_000
_BREAK, _NOTHING = -1, -2
#: A-Z in lower case, TAB as a blank, and each separator of pieces as a line feed.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ROWS = "lang string, phrase string, words int, n long"


def tokens_of(text: str) -> list[bytes]:
    """Words in order; a line feed between pieces; empty strings mean nothing."""
    return text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but their last words and of their last words."""
    return _mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + last)


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash."""
    return h % np.uint64(bits), _mixed(h + np.uint64(1)) % np.uint64(bits)


def _holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for place in _bits(h, 64 * len(words)):
        out &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return out


class _Ids(dict):
    """Ids of one language's words; new words get the next id of ``known``."""

    def __init__(self, lang: str, code: int, known: _Known) -> None:
        import xxhash

        super().__init__({b"": _NOTHING, b"\n": _BREAK})
        self.code, self.known, self.hash = code, known, xxhash.xxh3_64_intdigest
        self.seed = self.hash(lang)

    def __missing__(self, word: bytes) -> int:
        known = self.known
        found = self[word] = len(known.words)
        known.words.append(word)
        known.codes.append(self.code)
        known.hashes.append(self.hash(word, self.seed))
        return found


class _Known:
    """Words that a task has met: text, language and hash by id."""

    def __init__(self) -> None:
        self.words, self.codes, self.hashes, self.langs, self.ids = [], array("l"), array("Q"), [], {}

    def of(self, lang: str) -> _Ids:
        if lang not in self.ids:
            self.ids[lang] = _Ids(lang, len(self.langs), self)
            self.langs.append(lang)
        return self.ids[lang]


def _grams(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases of n words that start at the places, as n arrays of ids, and how often each occurs."""
    code = ids[at]
    for j in range(1, n):
        code = code << 32 | ids[at + j]
        if j < n - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [ids[at[first] + j] for j in range(n)], counts


def count_words(known: _Known, ids: np.ndarray, most: int, old: list | None, new: list | None) -> Iterator:
    """Arrow batches (lang, phrase, words, n) of the phrases of ids that this pass counts.

    new: filters of the proposed phrases by length, or None for all phrases; old: those of the pass before, whose
    phrases and border have been counted, or None where nothing has.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(known.words):
        return
    words, hashes = pa.array(known.words, pa.binary()), np.array(known.hashes, np.uint64)
    codes, langs = np.array(known.codes, np.int64), pa.array(known.langs, pa.string())

    def batch(parts: list[np.ndarray], counts: np.ndarray, lang: np.ndarray | None = None):
        if len(counts) > _ROWS_AT_ONCE:
            for at in range(0, len(counts), _ROWS_AT_ONCE):
                some = slice(at, at + _ROWS_AT_ONCE)
                yield from batch([p[some] for p in parts], counts[some], None if lang is None else lang[some])
            return
        if not len(counts):
            return
        text = pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in parts], pa.scalar(b" ")) if parts else pa.array([b""] * len(counts), pa.binary())
        lang = codes[parts[0]] if lang is None else lang
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), text.cast(pa.string()), pa.array(np.full(len(counts), len(parts), np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "n"])

    spoken = ids >= 0
    if old is None:
        counts = np.bincount(ids[spoken], minlength=len(words))
        yield from batch([np.flatnonzero(counts)], counts[counts > 0])
        totals = np.bincount(codes, counts, len(langs)).astype(np.int64)
        yield from batch([], totals[totals > 0], np.flatnonzero(totals))

    def proposed(filters: list | None, level: int, where: np.ndarray, h: np.ndarray) -> np.ndarray:
        if filters is None:
            return where
        out = np.zeros(len(where), bool)
        at = np.flatnonzero(where)
        out[at] = _holds(filters[level - 1], h[at])
        return out

    def word_is_proposed(filters: list | None) -> np.ndarray:
        if filters is None:
            return spoken
        return spoken & _holds(filters[0], hashes)[ids]

    h = hashes[ids]
    is_new, is_old = word_is_proposed(new), None if old is None else word_is_proposed(old)
    for n in range(2, most + 1):
        border = is_new[:-1] & is_new[1:]
        counted = border if is_old is None else border & ~(is_old[:-1] & is_old[1:])
        parts, counts = _grams(ids, np.flatnonzero(counted), n)
        yield from batch(parts, counts)
        if n < most:
            h = _longer(h[:-1], hashes[ids[n - 1 :]])
            is_new = proposed(new, n, border, h)
            is_old = None if is_old is None else proposed(old, n, is_old[:-1] & is_old[1:], h)


def count_phrases(docs: DataFrame, most: int, filters: Broadcast | None = None) -> DataFrame:
    """lang, phrase, words, n of the phrases of docs (lang, text) that a pass with filters (old, new) counts.

    Without filters all phrases are counted. words = 0 has a language's number of words.
    """

    def run(batches):
        old, new = filters.value if filters else (None, None)
        known, pending, size = _Known(), [], 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                table = known.of(lang)
                tokens = tokens_of(text.as_py())
                ids = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
                pending += [ids[ids != _NOTHING], np.array([_BREAK])]
                size += len(tokens)
                if size >= _WORDS_AT_ONCE:
                    yield from count_words(known, np.concatenate(pending), most, old, new)
                    pending, size = [], 0
                    if len(known.words) > _WORDS_KEPT:
                        known = _Known()
        if pending:
            yield from count_words(known, np.concatenate(pending), most, old, new)

    # Tasks have added up what they can in arrays: rows are dealt out first, so that no task holds a table of all its phrases.
    rows = docs.select("lang", "text").mapInArrow(run, _ROWS).repartition(partitions(docs.sparkSession), "lang", "phrase")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def build_filters(phrases: DataFrame, most: int, bits: int, old: list | None = None) -> list:
    """Bloom filters, one a length below ``most``, of phrases (lang, phrase, words) and what ``old`` ones hold.

    Tasks set bits, Spark joins them word by word of 64 bits: the driver gets ``bits`` / 64 rows a filter at most.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            found = [[] for _ in range(most)]
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                hashes = [xxhash.xxh3_64_intdigest(w.encode(), xxhash.xxh3_64_intdigest(lang)) for w in phrase.split(" ")]
                found[len(hashes)].append(hashes)
            for n in range(1, most):
                rows = np.array(found[n], np.uint64).reshape(-1, n)
                h = rows[:, 0]
                for j in range(1, n):
                    h = _longer(h, rows[:, j])
                place = np.unique(np.concatenate(_bits(h, bits)))
                at, first = np.unique(place >> np.uint64(6), return_index=True)
                values = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int64)), pa.array(values.view(np.int64))], ["words", "place", "value"])

    rows = phrases.where((F.col("words") > 0) & (F.col("words") < most)).select("lang", "phrase")
    table = rows.mapInArrow(run, "words int, place long, value long").groupBy("words", "place").agg(F.bit_or("value").alias("value")).toArrow()
    out = [np.zeros(bits // 64, np.uint64) if old is None else old[n].copy() for n in range(most - 1)]
    which, place, value = (table[c].to_numpy() for c in ("words", "place", "value"))
    for n in range(1, most):
        own = which == n
        out[n - 1][place[own]] |= value[own].view(np.uint64)
    return out


def mine(docs: DataFrame, most: int = 3, least: int = 10, sample: int = SAMPLE, bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """(lang, phrase, words, n of every phrase of up to ``most`` words with n >= least; number of full passes) of docs (lang, text).

    Rows with words = 0 have the number of all words of each language. Texts of the sample are chosen by a hash. Null
    texts are empty, a null language is ``und``.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    lowered = max(2, int(LOWERED * least / sample))
    # Phrases of all ``most`` words are part of no longer one: they need no proposal.
    proposals = count_phrases(chosen, max(most - 1, 1)).where((F.col("words") > 0) & (F.col("n") >= lowered))
    proposals = cut(proposals.select("lang", "phrase", "words"), "phrases-proposed")
    bits = min(bits, 1 << max(10, (PHRASE_BITS * proposals.count()).bit_length()))
    old, new, found, passes = None, build_filters(proposals, most, bits), None, 0
    while True:
        passes += 1
        filters = docs.sparkSession.sparkContext.broadcast((old, new))
        counted = cut(count_phrases(docs, most, filters).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases-counted")
        filters.destroy()
        found = counted if found is None else found.unionByName(counted)
        extendable = counted.where((F.col("words") > 0) & (F.col("words") < most)).select("lang", "phrase", "words")
        failures = cut(extendable.join(proposals, ["lang", "phrase", "words"], "left_anti"), "phrases-failures")
        if not failures.take(1):
            return found, passes
        old, new = new, build_filters(failures, most, bits, new)
        proposals = proposals.unionByName(failures)


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 3, least: int = 10, share: int = 50, top: int = 2000, sample: int = SAMPLE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``most`` words.

    A phrase lies within a piece between separators; a is how often it occurs, overlaps included, and ``least`` at
    least. l and r are the numbers of its two parts at the cut of the lowest score, floor(10^6 a a / (l r)), of equal
    ones at the first. Phrases inside a longer candidate with at least ``share`` percent of their occurrences are left
    out. Order: score, a, both descending, phrase. Null texts are empty, a null language is ``und``; repeated rows count
    each time, and other columns are ignored. Empty tables and texts without such phrases give no rows.
    """
    found, _ = mine(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), most, least, sample, bits)
    w = F.split("phrase", " ")
    candidates = found.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.struct("lang", _part(w, 1, F.col("k")).alias("phrase")), "right": F.struct("lang", _part(w, F.col("k") + 1, F.col("words")).alias("phrase"))})
    cuts = cut(cuts, "phrases-cuts")

    # How many cuts need a part is its weight: parts of very many phrases go by broadcast, a bounded number of them.
    needs = cuts.select(F.explode(F.array("left", "right")).alias("part")).groupBy("part").agg(F.count("*").alias("n_cuts"))
    parts = found.where("words >= 1").select(F.struct("lang", "phrase").alias("part"), F.col("n").alias("f"))
    parts = cut(parts.join(needs, "part"), "phrases-parts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = attach_groups(cuts, parts.select(F.col("part").alias(side), F.col("f").alias(name), "n_cuts"), side, F.xxhash64("phrase"), "n_cuts").drop("n_cuts")
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumns({"over": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "under": left * right}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _part(w, i, m))))
    inside = candidates.where("words >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # First within parts of a language, so that no task sorts all phrases of a large one; the root of the number of
    # partitions keeps both these parts and what is left of them small.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(isqrt(partitions(docs.sparkSession)))))
    firsts = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, m, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL)
SELECT b.lang, rank, b.phrase, a, l, r, n, score
FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR m = 3 OR 100 * longer < 50 * a) b JOIN n ON n.lang = b.lang WHERE rank <= 2000"""
