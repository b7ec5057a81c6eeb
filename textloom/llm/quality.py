"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts gives a term space (words, runs of symbols, shapes of words, repetition), whose
truncated singular value decomposition gives each text a short vector. The labelled vectors are broadcast; every
document's cosine with all of them is computed exactly, block by block as a matrix product, and the labels of the nearest
vote with their similarity as weight.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_texts, text_or_empty, worker_cache
from textloom.llm.toxicity import labelled_sample as _sample

#: Labelled rows that are used at most; terms of the model, those in most of the sample's texts; length of the vectors.
TRAIN_DOCS, TERMS, WIDTH = 4_000, 4_096, 48
#: Texts of the sample that a term is in at least.
LEAST_DOCS = 3
NEIGHBOURS = 25
#: Share of tokens that repeat the token before them from which they are a term.
LEAST_SAME = 0.1
_TOKENS_KEPT = 300_000
#: Documents whose products with the labelled vectors a task holds at a time.
BLOCK = 256


class Reader:
    """The terms of a text, each as often as it occurs; with ``place`` the places of those that it knows.

    What a token between white space holds is cached.
    """

    def __init__(self, place: dict[str, int] | None = None) -> None:
        self.find, self.place = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+").findall, place
        self.known: dict[str, list] = {}
        self.again, self.same = self.named(["<again>"]), self.named(["<same>"])

    def named(self, terms: list[str]) -> list:
        return terms if self.place is None else [self.place[t] for t in terms if t in self.place]

    def terms(self, token: str) -> list[str]:
        found = []
        for part in self.find(token):
            if part[0].isalpha():
                shape = "<upper>" if len(part) > 1 and part.isupper() else "<title>" if part[0].isupper() else "<lower>" if part.islower() else "<mixed>"
                found += [part.lower(), shape]
            else:
                found.append("<number>" if part[0].isdigit() else part)
        return found

    def __call__(self, text: str) -> list:
        order, known, found = text.split(), self.known, []
        if len(known) > _TOKENS_KEPT:
            known.clear()
        for token in order:
            if (terms := known.get(token)) is None:
                terms = known[token] = self.named(self.terms(token))
            found += terms
        same = sum(map(eq, order, order[1:]))
        found += self.again * (len(order) - len(set(order)))
        if same >= LEAST_SAME * len(order):
            found += self.same * same
        return found


def weights_of(places: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of a text's terms and their weights: square root of the count times inverse document frequency."""
    counts = np.bincount(np.array(places, np.int64), minlength=1)
    distinct = np.flatnonzero(counts)
    return distinct, np.sqrt(counts[distinct].astype(np.float32)) * idf[distinct]


@dataclass(frozen=True)
class Model:
    """Plain values: terms with idf, projection (terms x width), unit vectors and labels of the labelled texts, base rate."""

    terms: list[str]
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def latent(x: np.ndarray, width: int) -> np.ndarray:
    """Right singular vectors (columns) of the ``width`` largest singular values of x, by subspace iteration from a fixed start."""
    width = min(width, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(width + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :width].astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", quality: str = "quality", doc_id: str = "doc_id", max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, quality of at most max_docs labelled ids, chosen by a hash of doc_id; written to the shared folder."""
    return _sample(docs, labels, text, quality, doc_id, max_docs).withColumnRenamed("toxic", "quality")


def fit(labelled: DataFrame, text: str = "text", quality: str = "quality", doc_id: str = "doc_id", terms: int = TERMS, width: int = WIDTH) -> Model:
    """Fits on a bounded table of rows (doc_id, text, quality 0/1), as from labelled_sample.

    Terms are counted on Spark; the driver gets the ``terms`` most frequent and, of each text, the weights of those.
    Null texts are empty. Without rows the model has no terms and scores 0.5.
    """
    sample = labelled.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"), F.col(quality).cast("int").alias("quality"))

    def read():
        reader = Reader()
        return lambda texts: [[sorted(set(reader(t))) for t in texts]]

    counts = map_texts(sample.select("text"), read, "terms array<string>").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    best = counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(terms).toArrow()
    names, n_docs = best["term"].to_pylist(), best["n"].to_numpy()
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    idf = (np.log((n + 1) / (n_docs + 1)) + 0.1).astype(np.float32)
    place = {t: i for i, t in enumerate(names)}

    def weigh():
        reader = Reader(place)

        def run(texts):
            pairs = [weights_of(reader(t), idf) for t in texts]
            return [[p.tolist() for p, _ in pairs], [w.tolist() for _, w in pairs]]

        return run

    got = map_texts(sample.select("id", "quality", "text"), weigh, "places array<int>, weights array<float>").toArrow().sort_by("id")
    x = np.zeros((n, len(names)), np.float32)
    for i in range(n):
        x[i, got["places"][i].values.to_numpy()] = got["weights"][i].values.to_numpy()
    x = unit(x)
    projection = latent(x, width) if n and names else np.zeros((len(names), 1), np.float32)
    return Model(names, idf, projection, unit(x @ projection), got["quality"].to_numpy().astype(np.float32), float(ones / n) if n else 0.5)


def vote(vectors: np.ndarray, model_vectors: np.ndarray, labels: np.ndarray, base: float, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest by cosine, weighted by it; without a positive cosine the base rate.

    vectors are unit or zero rows. Of equal cosines at the border the first in the sample's order count.
    """
    out = np.full(len(vectors), base)
    k = min(neighbours, len(labels))
    for at in range(0, len(vectors) if k else 0, BLOCK):
        cosines = vectors[at : at + BLOCK] @ model_vectors.T
        border = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        above, ties = cosines > border, cosines == border
        left = k - above.sum(axis=1, keepdims=True)
        near = above | (ties & (np.cumsum(ties, axis=1) <= left))
        weight = np.where(near, np.maximum(cosines, 0), 0).astype(np.float64)
        total = weight.sum(axis=1)
        out[at : at + BLOCK] = np.where(total > 0, (weight @ labels) / np.maximum(total, 1e-12), base)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id and score (0 to 1) of every row, by its whole text.

    Null, empty and unknown texts get the base rate of the sample; repeated rows get a row each, null ids stay null and
    other columns are ignored. The broadcast is bounded: TERMS and TRAIN_DOCS rows of WIDTH numbers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    values = (model.terms, model.idf, model.projection, model.vectors, model.labels, model.base)
    shared, name = docs.sparkSession.sparkContext.broadcast(values), uuid.uuid4().hex

    def make():
        cache = worker_cache()
        if cache.get("quality", ("",))[0] != name:
            cache["quality"] = (name, Reader({t: i for i, t in enumerate(shared.value[0])}))
        reader = cache["quality"][1]
        _, idf, projection, vectors, labels, base = shared.value

        def run(texts):
            own = np.zeros((len(texts), projection.shape[1]), np.float32)
            for i, t in enumerate(texts):
                places, weights = weights_of(reader(t), idf)
                own[i] = weights @ projection[places]
            return [vote(unit(own), vectors, labels, base, neighbours).tolist()]

        return run

    return map_texts(rows, make, "score double")
