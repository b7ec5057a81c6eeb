"""Near-duplicate detection by min-max hashing.

Every permutation of a document's shingles gives two values, its minimum and its maximum, so a signature takes half
the hash evaluations. Signatures are banded; documents that share a band are candidates. Candidates are confirmed on
their full shingle sets, and confirmed links are closed to components.

Groups of copies are never expanded into all pairs. Documents with equal shingle sets are one class, of which the
smallest id stands for all. In a bucket, each class is first compared with the bucket's smallest. Only where a bucket's
classes are then in several components are those outside the main one compared with the classes of other components: in
rounds, each with a larger random share of the bucket, the last with all of it. A round's links join components before the
next, so one group's many links are not all made: the links between components that a sample leaves are expected to be
as many as the classes by the inverse of its share (Karger, Klein and Tarjan), and a round samples GROWTH times as much.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach_groups, cut, let_go, map_texts, partitions, slices, text_or_empty, worker_tool
from textloom.llm.components import components

#: BANDS bands of ROWS values each; half of all values are minima, half maxima. At a similarity of 0.85 a pair shares
#: no band with a chance of (1 - 0.85^6)^32 = 3e-7, at 0.8 of 5e-5.
BANDS, ROWS = 32, 6
#: Words of 64 places, over which a set's shingles are dealt; for each place the parity of their number is kept.
PARITY_WORDS = 16
#: Classes of a bucket that a part of it has, about.
PART_ROWS = 256
#: Classes of a bucket with which one outside its main component is compared in the first round, about, and how many
#: times as many in each round after it.
FIRST_ROWS, GROWTH = 4, 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORDS_KEPT = 100_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def shingle_set(text: str, size: int) -> set[tuple[str, ...]]:
    """Distinct shingles of ``size`` words; with fewer words the whole sequence as one; without words none."""
    words = words_of(text)
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


class Signer:
    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(20)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.size, self.mult, self.plus = size, odd(BANDS * ROWS // 2)[:, None], odd(BANDS * ROWS // 2)[:, None]
        self.place, self.fold = odd(size + 1), odd(BANDS * ROWS).reshape(BANDS, ROWS)
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes of the text's shingles, sorted."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            if (x := known.get(w)) is None:
                x = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        if len(words) <= self.size:
            return np.array([xxhash.xxh3_64_intdigest(" ".join(words), 1)], np.uint64)
        n = len(words) - self.size + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.size):
            out += h[i : i + n] * self.place[i]
            out ^= out >> np.uint64(29)
            out *= self.place[-1]
        out ^= out >> np.uint64(32)
        return np.unique(out)

    def parity(self, shingles: np.ndarray) -> np.ndarray:
        odd = np.bincount((shingles % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit value a band."""
        low = np.full(len(self.mult), np.iinfo(np.uint64).max)
        high = np.zeros(len(self.mult), np.uint64)
        for at in range(0, len(shingles), 1024):
            v = self.mult * shingles[None, at : at + 1024]
            v += self.plus
            np.minimum(low, v.min(axis=1), out=low)
            np.maximum(high, v.max(axis=1), out=high)
        out = (np.concatenate([low, high]).reshape(BANDS, ROWS) * self.fold).sum(axis=1, dtype=np.uint64)
        out ^= out >> np.uint64(31)
        return (out * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the whole set, null if empty), bands, parity."""

    def make():
        signer = worker_tool(("minhash", size), lambda: Signer(size))

        def sign(texts):
            sets = [signer.shingles(t) for t in texts]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return [len(s) for s in sets], keys, [signer.bands(s) if len(s) else None for s in sets], [signer.parity(s) if len(s) else None for s in sets]

        return sign

    return map_texts(docs, make, "n_shingles long, set_key binary, bands array<long>, parity array<long>")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _at_most_common(n: Column, m: Column, parity: Column, other: Column) -> Column:
    """No two sets of n and m shingles have more in common: each place of different parity stands for one that only one has."""
    apart = sum((F.bit_count(parity[i].bitwiseXOR(other[i])) for i in range(1, PARITY_WORDS)), F.bit_count(parity[0].bitwiseXOR(other[0])))
    return F.floor((n + m - apart) / 2)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    texts: doc_id, text of all ids. A text travels once for each of up to ``salts`` parts of its pairs, so an id that
    is in a large share of all pairs is dealt over all tasks.
    """
    salts = partitions(pairs.sparkSession)

    def attach(rows: DataFrame, key: str, other: str, to: str) -> DataFrame:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(salts)))
        needs = rows.select(F.col(key).alias("doc_id"), "_salt").distinct()
        copies = texts.join(needs, "doc_id").select(F.col("doc_id").alias(key), "_salt", F.col("text").alias(to))
        return rows.join(copies, [key, "_salt"]).drop("_salt")

    both = attach(attach(pairs, "b", "a", "text_b"), "a", "b", "text_a")

    def check(batches):
        import pyarrow as pa

        let_go()
        last: tuple = (None, None, None)
        for batch in slices(batches):
            keep = []
            # A row's texts at a time: all of a batch would stand beside its Arrow columns.
            for a, x, y in zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True):
                a, x, y = a.as_py(), x.as_py(), y.as_py()
                if last[0] != a or last[2] != x:
                    last = (a, shingle_set(x, size), x)
                s, t = last[1], shingle_set(y, size)
                common = len(s & t)
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.sortWithinPartitions("a").mapInArrow(check, "a long, b long")


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (bucket, rep and others) of buckets whose classes are in several components, with component, main (that of
    most of the bucket's classes) and n_rows (of the bucket)."""
    kept = rows.columns
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = cut(rows.select(*kept, F.coalesce("component", "rep").alias("component")), "near-rows")
    counts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "component")).alias("most")
    apart = counts.groupBy("bucket").agg(most, F.sum("n").alias("n_rows"), F.count("*").alias("n_components")).where("n_components > 1")
    apart = cut(apart.select("bucket", F.col("most.component").alias("main"), "n_rows"), "near-buckets")
    return attach_groups(rows, apart, "bucket", F.col("rep"), "n_rows").where("main IS NOT NULL")


def _across(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of a bucket in different components that may be linked: each class outside the main
    component with ``width`` others of its bucket, drawn by hashes, and with all where the bucket has no more.

    A bucket's classes are dealt over parts of PART_ROWS or so, at first over smaller ones; those outside its main
    component go to so many parts in a row that these have ``width`` classes.
    """
    parts = F.ceil(F.col("n_rows") / min(width, PART_ROWS)).cast("int")
    place = lambda use: F.pmod(F.xxhash64(F.lit(f"{use} {width}"), "bucket", "rep"), parts).cast("int")
    steps = F.sequence(F.lit(0), F.least(parts, F.lit(-(-width // PART_ROWS))) - 1)
    outside = rows.where("component != main").withColumns({"parts": parts, "at": place("from"), "step": F.explode(steps)})
    outside = outside.select("bucket", F.pmod(F.col("at") + F.col("step"), "parts").alias("part"), *[F.col(c).alias(f"p_{c}") for c in ("rep", "n_shingles", "component", "parity")])
    # Most pairs of a large group that aren't linked to its smallest member by now are ruled out by the parities of
    # their sets, which prove that they differ too much, without a look at their texts.
    n, m = F.col("n_shingles"), F.col("p_n_shingles")
    most = _at_most_common(n, m, F.col("parity"), F.col("p_parity"))
    possible = _similar_sizes(n, m, percent) & (100 * most >= percent * (n + m - most))
    # Of two outside the main component each may meet the other: one order is enough.
    once = (F.col("component") == F.col("main")) | (F.col("p_rep") < F.col("rep"))
    near = rows.withColumn("part", place("of")).join(outside, ["bucket", "part"]).where((F.col("component") != F.col("p_component")) & once & possible)
    return near.select(F.least("p_rep", "rep").alias("a"), F.greatest("p_rep", "rep").alias("b")).distinct()


def link(members: DataFrame, parities: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of all classes with a link.

    members: bucket, rep, n_shingles, lead, lead_n (bucket's smallest rep); parities: rep, parity; texts: doc_id, text.
    """
    ratio = _similar_sizes(F.col("n_shingles"), F.col("lead_n"), percent)
    pairs = cut(members.where((F.col("rep") != F.col("lead")) & ratio).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    edges = cut(confirm(pairs, texts, size, percent), "near-edges")
    found = components(edges)

    rows = _apart(members.select("bucket", "rep", "n_shingles"), found)
    rows, width = cut(rows.join(parities, "rep"), "near-apart"), FIRST_ROWS
    while rows.take(1):
        more = _across(rows, width, percent).join(pairs, ["a", "b"], "left_anti")
        more = cut(more, "near-pairs")
        edges = cut(confirm(more, texts, size, percent), "near-edges")
        if edges.take(1):
            found = components(edges.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        pairs = pairs.unionByName(more)
        rows = rows.where(F.col("n_rows") > width).select("bucket", "rep", "n_shingles", "parity")
        rows, width = cut(_apart(rows, found), "near-apart"), width * GROWTH
    return found


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs of other characters than blank and TAB to CR, with A-Z lower-cased; a set is the text's distinct
    shingles of ``size`` words, or its whole sequence if shorter. Documents are linked where
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable and kept tells whether that
    is the row's own. Null texts and texts without words have empty sets and no links. Rows that repeat an id are
    compared by their own texts and share the id's links; a null id is linked with nothing and kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    signed = cut(signatures(rows, size), "near-signed")
    known = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs")), "near-classes")
    single = F.col("n_docs") == 1
    keyed = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    placed = attach_groups(keyed, classes.where(~single), "set_key", F.coalesce("doc_id", F.lit(0)), "n_docs")
    placed = cut(placed.select("doc_id", "n_shingles", "set_key", F.coalesce("rep", F.when(F.col("set_key").isNotNull(), F.col("doc_id"))).alias("rep")), "near-placed")

    reps = known.join(classes.select("set_key", "rep"), (known["set_key"] == classes["set_key"]) & (known["doc_id"] == classes["rep"]), "left_semi")
    banded = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "value"))
    banded = banded.select(F.xxhash64("band", "value").alias("bucket"), "rep", "n_shingles")
    least = F.min(F.struct("rep", "n_shingles"))
    buckets = banded.groupBy("bucket").agg(least.alias("least"), F.count("*").alias("n_rows")).where("n_rows > 1")
    buckets = cut(buckets.select("bucket", F.col("least.rep").alias("lead"), F.col("least.n_shingles").alias("lead_n"), "n_rows"), "near-buckets")
    members = cut(attach_groups(banded, buckets, "bucket", F.col("rep"), "n_rows").where("n_rows IS NOT NULL").drop("n_rows"), "near-members")

    # Written first, so that Spark knows the size of the ids and may broadcast them instead of dealing out all texts.
    needed = cut(members.select(F.col("rep").alias("doc_id")).distinct(), "near-needed")
    texts = cut(rows.join(needed, "doc_id", "left_semi"), "near-texts")
    parities = reps.select(F.col("doc_id").alias("rep"), "parity")
    found = link(members, parities, texts, size, percent)
    weights = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n_docs").alias("n_docs"))
    found = cut(found.join(weights, "node").withColumnRenamed("node", "rep"), "near-components")
    out = attach_groups(placed, found, "rep", F.coalesce("doc_id", F.lit(0)), "n_docs")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
