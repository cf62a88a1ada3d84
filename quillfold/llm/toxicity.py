"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used to train: the classifier is a linear
model in numpy, fitted on the class-prior-corrected risk
    pi * E_P[loss(f)] + max(0, E_U[loss(-f)] - pi * E_P[loss(-f)]),
whose second term, an estimate of the risk on clean text, must not fall below zero: when a step's estimate
does, the step goes up that term instead. The prior is the share of toxic rows among the labels of the training fold.

Features of a whole text: its distinct lower-cased words, and their prefixes of PREFIXES letters,
so that inflected and compounded forms share weight. The vocabulary has the features that at least
`min_positive` confirmed examples hold, LIFT times as often as unlabelled text does or more.

Sample bounds (documented parameters): at most `max_positive` toxic examples and `max_unlabelled`
unlabelled documents, the first by a hash of the id. Their features are counted by Spark; the driver gets the
vocabulary and the sample as its numbers, never words. The model is a few thousand weights; it alone
is broadcast. Scoring is one map over the documents, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the bias alone; without
confirmed examples every score is 0; of labels repeated for an id the highest counts; labels with a
null id or class are ignored; repeated documents are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import crc32_mod, discard, materialise

PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
LIFT = 2.0
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words, and their prefixes marked by a trailing star."""
    words = set(_WORD.findall(text.lower())) if text else set()
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) >= n)
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = self.weights
        words = set(_WORD.findall(text.lower())) if text else set()
        hits = words & known.keys()
        for n in PREFIXES:
            hits |= {w[:n] + "*" for w in words if len(w) >= n} & known.keys()
        margin = self.bias + sum(known[h] for h in sorted(hits))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40.0, 40.0))))


class Sparse:
    """Rows of active features; a product and a transposed product."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.height = width, len(rows)
        self.columns = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=self.height)

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _bounds(n_positive: int, n_unlabelled: int, min_positive: int | None) -> tuple[int, float]:
    """In how many confirmed examples a feature must occur, at least and for each unlabelled text that holds it."""
    return max(3, n_positive // 200) if min_positive is None else min_positive, LIFT * n_positive / max(1, n_unlabelled)


def _descend(positive: list[np.ndarray], unlabelled: list[np.ndarray], vocabulary: dict[str, int], prior: float, steps: int = 200, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Fit the linear model by Adam on the non-negative risk, with the logistic loss."""
    width = len(vocabulary) + 1  # the last is the bias
    p, u = (Sparse([np.append(d, width - 1) for d in docs], width) for docs in (positive, unlabelled))
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    w[-1] = np.log(prior / (1.0 - prior))
    held = np.full(width, decay)
    held[-1] = 0.0
    for t in range(1, steps + 1):
        fp, fu = p.dot(w), u.dot(w)
        clean = np.logaddexp(0, fu).mean() if u.height else 0.0
        clean -= prior * np.logaddexp(0, fp).mean()
        of_positive = -prior * p.transposed_dot(_sigmoid(-fp)) / p.height
        of_clean = (u.transposed_dot(_sigmoid(fu)) / u.height if u.height else 0.0) - prior * p.transposed_dot(_sigmoid(fp)) / p.height
        g = (of_positive + of_clean if clean >= 0 else -of_clean) + held * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-4}, float(w[-1]))


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """doc_id and features of the documents with the first `most` of these ids by hash; one text for each id."""
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(features(t.as_py())) for t in part.column(1)], pa.list_(pa.string()))], names=["doc_id", "found"])

    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, found array<string>"))


def _encode(sample: DataFrame, vocabulary: dict[str, int]) -> list[np.ndarray]:
    """The sample's rows as numbers of the vocabulary, in order of the ids: only these go to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in batches:
            numbers = pa.array([[known[f] for f in found.as_py() if f in known] for found in part.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), numbers], names=["doc_id", "numbers"])

    rows = sample.mapInArrow(run, "doc_id long, numbers array<int>").toArrow().sort_by("doc_id")
    return [np.array(r.as_py(), dtype=np.int64) for r in rows["numbers"]]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_positive: int = 4000, max_unlabelled: int = 8000, min_positive: int | None = None, **options) -> Model:
    """Learn from labels outside the held-out fold and from unlabelled documents outside it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = crc32_mod(F.col("doc_id"), folds) != held_out
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(seen)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share")).head()["share"]
    if not share:
        return Model({}, -40.0)
    positive = _sample(docs, known.where("toxic = 1").select("doc_id"), max_positive)
    unlabelled = _sample(docs, docs.where("doc_id IS NOT NULL").where(seen).select("doc_id"), max_unlabelled)
    n_positive, n_unlabelled = positive.count(), unlabelled.count()
    if not n_positive:
        return Model({}, -40.0)
    least, common = _bounds(n_positive, n_unlabelled, min_positive)
    count = lambda sample, name: sample.select(F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias(name))
    counts = count(positive, "n").where(F.col("n") >= least).join(count(unlabelled, "others"), "f", "left")
    chosen = counts.where(F.col("n") >= common * F.coalesce("others", F.lit(0))).select("f").toArrow()["f"].to_pylist()
    vocabulary = {f: i for i, f in enumerate(sorted(chosen))}
    model = _descend(_encode(positive, vocabulary), _encode(unlabelled, vocabulary), vocabulary, min(max(share, 1e-4), 0.9), **options)
    discard(positive)
    discard(unlabelled)
    return model


def score_documents(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in part.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc32_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose own text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array([not shared.value.score(t.as_py()) >= THRESHOLD for t in part.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
