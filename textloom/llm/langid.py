"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to its longest known character
n-grams (five down to one). The model is fitted on a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, map_texts, slices, text_or_empty, worker_tool

#: Labelled rows that are used for fitting at most.
TRAIN_DOCS = 8_000
#: Occurrences in the sample that a word or n-gram of the model has at least: one alone says no more than its parts do.
LEAST_COUNT = 2
#: A larger model is an error (fit with fewer rows): it is broadcast.
MODEL_BYTES = 256 << 20
LONGEST_GRAM = 5
#: Words that count towards the confidence of a score at most.
CONFIDENT_WORDS = 30
UNKNOWN = "und"
_WORDS_KEPT = 100_000


class Model:
    """Log frequencies by language, less their maximum: a row of ``logs`` for each of ``keys`` (joined by line feeds).

    ``sizes`` has 0 for a whole word and its length for an n-gram of a word between ^ and $.
    """

    def __init__(self, langs: list[str], keys: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.langs, self.keys, self.sizes = langs, keys, sizes.astype(np.uint8)
        self.logs = np.zeros(counts.shape, np.float32)
        for size in range(LONGEST_GRAM + 1):
            own = self.sizes == size
            smooth = counts[own] + 0.5
            logs = np.log(smooth / smooth.sum(axis=0)) if len(smooth) else smooth
            self.logs[own] = logs - logs.max(axis=1, keepdims=True) if len(logs) else logs

    def n_bytes(self) -> int:
        return len(self.keys) * 4 + self.logs.nbytes + self.sizes.nbytes


class Scorer:
    def __init__(self, model: Model) -> None:
        import regex

        self.find, self.langs, self.logs = regex.compile(r"\p{L}+").findall, model.langs, model.logs
        keys = model.keys.split("\n") if len(model.sizes) else []
        self.words = {k: i for i, (k, n) in enumerate(zip(keys, model.sizes, strict=True)) if n == 0}
        self.grams = {k: i for i, (k, n) in enumerate(zip(keys, model.sizes, strict=True)) if n}
        self.start()

    def start(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.langs))), np.float32)

    def word(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return self.logs[known]
        padded = f"^{word}$"
        for n in range(LONGEST_GRAM, 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return self.logs[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def _row(self, word: str) -> int:
        n = self.rows[word] = len(self.rows)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.word(word)
        return n

    def __call__(self, text: str) -> tuple[str, float]:
        words = self.find(text.lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.rows) > _WORDS_KEPT:
            self.start()
        get, row = self.rows.get, self._row
        at = [i if (i := get(w)) is not None else row(w) for w in words]
        total = np.bincount(at, minlength=1)
        used = np.flatnonzero(total)
        mean = total[used].astype(np.float64) @ self.table[used] / len(words)
        z = np.exp((mean - mean.max()) * min(len(words), CONFIDENT_WORDS))
        best = int(z.argmax())
        return self.langs[best], float(z[best] / z.sum())


def _grams(padded: Column, n: int) -> Column:
    """Structs (size, key) of all n-grams of a word."""
    at = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1)))
    # One parameter only: transform would give a second one the element's place.
    grams = F.transform(at, lambda i: F.struct(F.lit(n).alias("size"), F.substring(padded, i, F.lit(n)).alias("key")))
    return F.coalesce(grams, F.array().cast("array<struct<size:int,key:string>>"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs: int = TRAIN_DOCS) -> Model:
    """Fits on at most max_docs rows with id, text and label, chosen by a hash of doc_id; counting runs on Spark.

    Of rows that repeat a chosen id one counts. The driver gets the counts of the model's words and n-grams as Arrow
    columns, nothing of the texts.
    """
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max_docs).distinct()
    sample = rows.join(F.broadcast(chosen), "id")  # at most max_docs ids
    sample = cut(sample.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.*"), "language-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return Model([], "", np.zeros(0), np.zeros((0, 0)))
    by_lang = [F.count_if(F.col("lang") == x).alias(f"n{i}") for i, x in enumerate(langs)]
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''").groupBy("word").agg(*by_lang)
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    keys = [F.array(F.struct(F.lit(0).alias("size"), F.col("word").alias("key"))), *[_grams(padded, n) for n in range(1, LONGEST_GRAM + 1)]]
    counts = [f"n{i}" for i in range(len(langs))]
    parts = words.select(*counts, F.explode(F.concat(*keys)).alias("x")).groupBy("x.size", "x.key").agg(*[F.sum(c).alias(c) for c in counts])
    found = parts.where(sum((F.col(c) for c in counts[1:]), F.col(counts[0])) >= LEAST_COUNT).toArrow()
    table = np.stack([found[c].to_numpy() for c in counts], axis=1)
    model = Model(langs, "\n".join(found["key"].to_pylist()), found["size"].to_numpy(), table)
    if model.n_bytes() > MODEL_BYTES:
        raise ValueError(f"the model has {model.n_bytes()} bytes, more than {MODEL_BYTES}; fit on fewer rows")
    return model


def _shared_scorer(df: DataFrame, model: Model) -> Callable[[], Scorer]:
    shared, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most MODEL_BYTES

    return lambda: worker_tool(("langid", name), lambda: Scorer(shared.value))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row.

    Null and empty texts and texts without letters get ``und`` and 0, as does every text if the model knows no
    language. Ties go to the language that sorts first; repeated rows each get a result; null ids stay null; other
    columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    scorer = _shared_scorer(docs, model)

    def make():
        score = scorer()
        return lambda texts: list(zip(*map(score, texts), strict=True))

    return map_texts(rows, make, "lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language the model tells with a score of ``least`` or more.

    Null texts and texts without letters go.
    """
    scorer = _shared_scorer(docs, model)

    def keep(batches):
        import pyarrow as pa

        score = scorer()
        for batch in slices(batches):
            found = [score(t or "") for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
