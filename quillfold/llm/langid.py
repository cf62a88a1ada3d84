"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 characters, words padded with a space) by
falling count, ties by code. A document's out-of-place distance to a language sums, over the n-grams of its own
profile, how far each stands from its place in the language's profile; an n-gram that is not there counts
as the full length. The nearest language wins, ties to the smaller name.

The language profiles come from at most about `per_language` documents for each language (a documented bound,
chosen by a hash of the id). Counting them is a distributed sum over n-grams. Only the profiles, `length`
n-grams for each language, are broadcast; more than MOST_LANGUAGES of them are refused. Prediction is one map over whole texts, without a shuffle.

Defined results: `und` and score 0 for a null text, a text without letters, or where nothing was learned;
a document's repeated rows are predicted alike; further columns are ignored. The score is the runner-up's
share of the two nearest distances: 0.5 for a tie, 1 for an exact match or a single language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.llm.common import crc32_mod

LENGTH = 300
UNKNOWN = "und"
#: Languages that a model may have: every worker holds their profiles.
MOST_LANGUAGES = 10_000
#: Rows of the table of languages up to which it is broadcast.
BROADCAST_LANGUAGES = 10_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once for each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, sorted, and their counts. A code holds up to three 21-bit characters."""
    empty = np.empty(0, dtype=np.int64)
    if not text:
        return empty, empty
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return empty, empty
    codes = np.where(letter, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    inside = codes != 32
    two = (codes[:-1] << 21) | codes[1:]
    three = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inside[1:-1]]
    return np.unique(np.concatenate((codes[inside], two[inside[:-1] | inside[1:]], three)), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, best first."""
    return codes[np.lexsort((codes, -counts))[:length]]


class Profiles:
    """The profiles of all languages as one matrix of ranks."""

    def __init__(self, by_language: dict[str, np.ndarray], length: int = LENGTH):
        self.names, self.length = sorted(by_language), length
        self.codes = np.unique(np.concatenate([by_language[n] for n in self.names])) if self.names else np.empty(0, dtype=np.int64)
        self.ranks = np.full((len(self.names), len(self.codes) + 1), length, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, by_language[name])] = np.arange(len(by_language[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = profile(codes, counts, self.length)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        far = np.where(there == self.length, self.length, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.names[best], 1.0
        first, second = np.partition(far, 1)[:2]
        return self.names[best], float(second / (first + second)) if second else 0.5


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, per_language: int = 2000, length: int = LENGTH, seed: int = 5) -> Profiles:
    """Learn profiles from the text and lang of documents outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(crc32_mod(F.col("doc_id"), folds) != held_out)
    share = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("_lang"), (F.lit(float(per_language)) / F.col("n")).alias("_share"))
    few = share.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    share = F.broadcast(share) if few else share
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(share, F.col("lang") == F.col("_lang")).where(draw < F.col("_share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                held.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, found in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counts = sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Each task keeps its `length` best of a language before they are dealt, so no language's n-grams are gathered.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")).alias("place")
    best = counts.select("lang", "code", place).where(F.col("place") <= length).limit(length * MOST_LANGUAGES + 1).toArrow()
    if best.num_rows > length * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    codes, place = best["code"].to_numpy(), best["place"].to_numpy()
    lang = np.array(best["lang"].to_pylist(), dtype=object)
    found = {name: np.flatnonzero(lang == name) for name in set(lang.tolist())}
    return Profiles({name: codes[at[np.argsort(place[at])]] for name, at in found.items()}, length)


def predict_documents(docs: DataFrame, profiles: Profiles, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [shared.value.predict(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    predicted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
