"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings. Every labelled text that names a group is paired with
its counterfactual, in which identity terms are swapped for others of their kind, and the squared change of the logit is
added to the loss: the model learns nothing from who is mentioned. Fitting takes a bounded sample of labelled rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, map_texts, text_or_empty, worker_cache

#: Labelled rows that are used for fitting at most.
TRAIN_DOCS = 8_000
#: A feature of the model is in so many of the sample's texts at least, and its shares in the two classes differ by so many standard errors.
LEAST_DOCS, LEAST_Z = 4, 2.5
#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7)
L2, COUNTERFACTUAL, STEPS, RATE = 2e-4, 1.0, 300, 0.3
#: Identity terms by kind; a counterfactual replaces each by the next of its kind.
IDENTITY = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["women", "men"],
    ["woman", "man"],
    ["girl", "boy"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "deaf", "blind"],
    ["old", "young"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["frauen", "männer"],
    ["frau", "mann"],
    ["ausländer", "einwanderer", "flüchtlinge"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["femmes", "hommes"],
    ["femme", "homme"],
    ["étrangers", "immigrés", "réfugiés"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["mujeres", "hombres"],
    ["mujer", "hombre"],
    ["extranjeros", "inmigrantes", "refugiados"],
]
_WORDS_KEPT = 300_000


def swaps() -> dict[str, str]:
    return {w: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, w in enumerate(kind)}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float) -> None:
        self.place = {f: i for i, f in enumerate(features)}
        self.weights, self.bias = weights, bias


class Scorer:
    """Features and score of a text; words' features are cached."""

    def __init__(self, model: Model) -> None:
        import regex

        self.model, self.find = model, regex.compile(r"\p{L}+").findall
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> set[str]:
        return set(self.find(text.lower()))

    def features(self, words: set[str]) -> list[int]:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        place, known, out = self.model.place, self.known, set()
        for w in words:
            if (own := known.get(w)) is None:
                own = known[w] = tuple(place[f] for f in word_features(w) if f in place)
            if own:
                out.update(own)
        return sorted(out)

    def __call__(self, text: str) -> float:
        z = self.model.bias + float(self.model.weights[self.features(self.words(text))].sum())
        return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


class Rows:
    """A sparse 0/1 matrix by rows: of each text the places of its features."""

    def __init__(self, places: list, width: int) -> None:
        sizes = np.array([len(p) for p in places], np.int64)
        self.n, self.width = len(places), width
        self.row = np.repeat(np.arange(len(places)), sizes)
        self.place = np.concatenate([np.asarray(p, np.int64) for p in places]) if len(places) else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.place], self.n)

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, e[self.row], self.width)


def train_weights(own: Rows, swapped: Rows, pairs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Full-batch Adam on log loss + L2 |w|^2 + COUNTERFACTUAL * mean over pairs of (logit change)^2.

    own: features of the texts; pairs: indices of texts with a counterfactual; swapped: features of those.
    """
    n, f = own.n, own.width
    w, b = np.zeros(f), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(f), np.zeros(f), 0.0, 0.0
    for step in range(1, STEPS + 1):
        logits = own.times(w)
        error = 1 / (1 + np.exp(-np.clip(logits + b, -40, 40))) - y
        g = own.transposed_times(error) / n + 2 * L2 * w
        if len(pairs):
            change = (swapped.times(w) - logits[pairs]) * (2 * COUNTERFACTUAL / len(pairs))
            back = np.zeros(n)
            back[pairs] = change
            g += swapped.transposed_times(change) - own.transposed_times(back)
        gb = float(error.mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= RATE * (mb / fix) / (vb / fix2 + 1e-16) ** 0.5 if gb else 0
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", doc_id: str = "doc_id", max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of at most max_docs labelled ids, chosen by a hash of doc_id, written to the shared folder.

    Null labels and ids don't count; of several labels of an id the largest does, of several texts the first in order;
    ids without a document are lost.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id")  # at most max_docs ids
    return cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", doc_id: str = "doc_id") -> Model:
    """Fits on a bounded table of rows (doc_id, text, toxic 0/1), as from labelled_sample.

    Features are counted on Spark; the driver gets those that tell the classes apart by LEAST_Z and, of each text, the
    places of those features. Null texts are empty.
    Without rows of both classes the model has no features and scores the base rate.
    """
    sample = labelled.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"), F.col(toxic).cast("int").alias("toxic"))
    words = sample.select("id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word != ''")
    own = [F.col("word"), *[F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]]
    by_text = words.select("id", "toxic", F.explode(F.array_compact(F.array(*own))).alias("feature")).groupBy("feature", "id").agg(F.max("toxic").alias("toxic"))
    counts = by_text.groupBy("feature").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n"))
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return Model([], np.zeros(0), float(np.log((n1 + 1) / (n - n1 + 1))))
    p = F.col("n") / n
    z = (F.col("n1") / n1 - (F.col("n") - F.col("n1")) / (n - n1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    best = counts.where((F.col("n") >= LEAST_DOCS) & (F.col("n") < n)).where(F.abs(z) >= LEAST_Z)
    model = Model(sorted(best.select("feature").toArrow()["feature"].to_pylist()), np.zeros(0), 0.0)

    def make():
        scorer, swap = Scorer(model), swaps()

        def places(texts):
            own, swapped = [], []
            for t in texts:
                ws = scorer.words(t)
                other = {swap.get(w, w) for w in ws}
                own.append(scorer.features(ws))
                swapped.append(scorer.features(other) if other != ws else None)
            return own, swapped

        return places

    got = map_texts(sample.select("toxic", "text"), make, "own array<int>, swapped array<int>").toArrow()
    values = {c: [x.values.to_numpy() if x.is_valid else None for x in got[c]] for c in ("own", "swapped")}
    pairs = np.array([i for i, x in enumerate(values["swapped"]) if x is not None], int)
    width = len(model.place)
    weights, bias = train_weights(Rows(values["own"], width), Rows([values["swapped"][i] for i in pairs], width), pairs, got["toxic"].to_numpy().astype(float))
    return Model(list(model.place), weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the score of no features; null ids stay null."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # features of at most TRAIN_DOCS texts

    def make():
        cache = worker_cache()
        if cache.get("toxicity", ("",))[0] != name:
            cache["toxicity"] = (name, Scorer(shared.value))
        scorer = cache["toxicity"][1]
        return lambda texts: [[scorer(t) for t in texts]]

    return map_texts(rows, make, "score double")
