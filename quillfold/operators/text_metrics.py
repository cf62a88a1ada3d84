"""How alike and how varied texts are: Self-BLEU, n-gram variety, transport between sets of vectors, citations by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.operators.ngram_clips import clipped_counts
from quillfold.operators.relational import cut_lineage


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _grams(w: Column, n: int) -> Column:
    """n and 96 bits of hash of each run of n words."""
    none = F.array().cast("array<struct<n:int,a:bigint,b:int>>")
    one = lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice(w, i + 1, n)).alias("a"), F.hash(F.slice(w, i + 1, n)).alias("b"))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).otherwise(none)


def self_bleu(texts: DataFrame, group: str, row_id: str, text: str, order: int = 4) -> DataFrame:
    """group, row_id and bleu of each text against all others of its group (null without others): how little a group's texts vary.

    A text's counts are clipped by the largest ones among the others (see `ngram_clips`), so texts are never paired. Precisions beyond
    single words are smoothed by one; brevity goes by the nearest length among the others, the shorter of two. A row for each
    row_id; texts without words and rows without a group take no part.
    """
    rows = texts.select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(text).alias("text"))
    sizes = cut_lineage(clipped_counts(rows, order))  # a row of numbers for each text
    lengths = sizes.groupBy("g", "len").agg(F.count(F.lit(1)).alias("same"))
    by_length = Window.partitionBy("g").orderBy("len")  # a row for each length
    below, above = F.lag("len").over(by_length), F.lead("len").over(by_length)
    nearer = F.when(F.col("same") > 1, F.col("len")).when(above.isNull() | (F.col("len") - below <= above - F.col("len")), below).otherwise(above)
    nearest = lengths.select("g", "len", nearer.alias("near"))
    scored = sizes.join(nearest, ["g", "len"])
    logs = None
    for n in range(1, order + 1):
        total, extra = F.greatest(F.col("len") - n + 1, F.lit(0)), F.lit(0 if n == 1 else 1)
        log = F.try_divide((total - F.col("lost")[n - 1] + extra).cast("double"), total + extra)
        logs = F.log(log) if logs is None else logs + F.log(log)
    brevity = F.least(F.lit(0.0), 1 - F.col("near") / F.col("len"))
    bleu = F.when(F.col("near").isNotNull(), F.coalesce(F.exp(logs / order + brevity), F.lit(0.0)))
    return scored.select(F.col("g").alias(group), F.col("id").alias(row_id), bleu.alias("bleu"))


def ngram_variety(texts: DataFrame, text: str, n: int = 2, *by: str) -> DataFrame:
    """Distinct n-grams over all n-grams of the texts, by group: distinct_n, n_grams."""
    grams = texts.select(*by, words(F.col(text)).alias("w")).select(*by, F.explode(_grams(F.col("w"), n)).alias("e"))
    return grams.groupBy(*by, "e").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n_grams"), (F.count(F.lit(1)) / F.sum("c")).alias("distinct_n"))


# ---- transport between sets of vectors


def relaxed_bound(cost: np.ndarray) -> float:
    """Each vector goes to its nearest one of the other set: no transport of equal weights costs less."""
    return float(max(cost.min(axis=1).mean(), cost.min(axis=0).mean()))


def transport_cost(cost: np.ndarray, sharpness: float = 200.0, rounds: int = 500, tolerance: float = 1e-7) -> float:
    """Cost of moving equal weights from rows to columns: Sinkhorn in logarithms, its plan rounded to the exact margins (so never under the optimum)."""
    n, m = cost.shape
    a, b = np.full(n, 1 / n), np.full(m, 1 / m)
    scale = max(float(cost.max()), 1e-300) / sharpness
    k, f, g = -cost / scale, np.zeros(n), np.zeros(m)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        f = np.log(a) - lse(k + g[None, :], 1)
        g = np.log(b) - lse(k + f[:, None], 0)
        if np.abs(np.exp(k + f[:, None] + g[None, :]).sum(axis=1) - a).sum() < tolerance:
            break
    plan = np.exp(k + f[:, None] + g[None, :])
    plan *= np.minimum(1, a / plan.sum(axis=1))[:, None]
    plan *= np.minimum(1, b / plan.sum(axis=0))[None, :]
    short_a, short_b = a - plan.sum(axis=1), b - plan.sum(axis=0)
    if short_a.sum() > 0:
        plan += np.outer(short_a, short_b) / short_a.sum()
    return float((plan * cost).sum())


def mover_distances(vectors: DataFrame, set_id: str, vector: str, pairs: DataFrame, beyond: float | None = None) -> DataFrame:
    """left, right, lower and distance of pairs (left, right) of sets of vectors: mean Euclidean cost of turning one into the other.

    The relaxed bound comes first; where it exceeds `beyond`, the pair cannot be nearer and the transport is not worked out (distance
    null). A set is what one text has: it is gathered by its id, as its transport needs it whole. Vectors that are null or hold a null take no part;
    pairs of a set without vectors are left out.
    """
    usable = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))
    sets = cut_lineage(vectors.where(usable).groupBy(F.col(set_id).alias("_set")).agg(F.collect_list(F.col(vector).cast("array<double>")).alias("v")))
    of = lambda side: sets.select(F.col("_set").alias(side), F.col("v").alias(f"_{side}"))
    both = pairs.select("left", "right").join(of("left"), "left").join(of("right"), "right").select("left", "right", "_left", "_right")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lower, distance = [], []
            for x, y in zip(frame["_left"], frame["_right"], strict=True):
                p, q = np.stack(list(x)), np.stack(list(y))
                cost = np.sqrt(np.maximum(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2), 0))
                lower.append(relaxed_bound(cost))
                distance.append(None if beyond is not None and lower[-1] > beyond else transport_cost(cost))
            yield pd.DataFrame({"left": frame["left"], "right": frame["right"], "lower": lower, "distance": pd.array(distance, dtype="Float64")})

    kinds = dict(pairs.dtypes)
    return both.mapInPandas(score, f"left {kinds['left']}, right {kinds['right']}, lower double, distance double")


# ---- citations

# The reporters of federal decisions.
REPORTERS = r"U\. ?S\.|S\. ?Ct\.|L\. ?Ed\.(?: ?2d)?|F\. ?(?:2d|3d|4th)|F\. ?Supp\.(?: ?[23]d)?|F\. ?App'x"


def citations(text: Column) -> Column:
    """The reporter citations of a text, as volume, reporter and page stand in it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\b\d{{1,4}} (?:{REPORTERS}) \d{{1,5}}\b"), F.lit(0))


def citation_density(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """n_texts, n_citations, n_words and citations for each 1,000 words of all texts of a group (null without words)."""
    each = texts.select(*by, F.size(citations(F.col(text))).alias("c"), F.size(words(F.col(text))).alias("w"))
    sums = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("c").alias("n_citations"), F.sum("w").alias("n_words"))
    return sums.withColumn("density", F.try_divide(1000.0 * F.col("n_citations"), F.col("n_words")))
