"""Nearest neighbours: inverted lists of coarse centroids with product-quantised residuals, and bounds that make the answer exact.

Coarse centroids and codebooks are fitted at the driver on at most TRAIN_ROWS rows (a documented bound, the first by a hash);
every row is indexed. A row stands in the list of its nearest centroid, its residual coded by the nearest codeword in each
of dim / SUB subspaces, with the distance between the row and what its code stands for (`err`), and the vector.

A query visits the lists of its nearest centroids first; how many is set on the fitted rows (see `tune`). In a list the query's
asymmetric distance table (query residual against codewords) gives each row's distance to within `err`: rows that
cannot be among the k nearest by that are left out, the others are ranked by the exact distance of the original vectors. The k-th of these
distances bounds what is still to be found: the query then visits each further list whose centroid and radius do not rule it out.
So neighbours are never lost, whatever the rows are like: the fit decides only how much is read. On data with structure that
is a few lists and few exact distances; where all directions are alike it is most lists.

Lists of more than LIST_ROWS rows (such as those of one very common vector) are dealt in parts by a hash of the row;
parts meet queries by co-grouping, queries in blocks of about BLOCK_QUERIES. Only centroids and codebooks are broadcast.
Equal distances go by the smaller id at each cut.

Bounds are taken of vectors that are shifted by their mean, scaled by a power of two that brings the median to about one, and held between
-CLIP and CLIP, which brings no two of them farther apart; they are lowered by more than rounding can add (SLACK).

Defined results: see `vectors.usable` (zero vectors take no part, rows that repeat an id are rows of their own); a score
beyond double is infinite; fewer candidates than k give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.llm.common import materialise
from quillfold.llm.vectors import matrix, sample, squared_distances, usable

TRAIN_ROWS = 20_000
TUNE_QUERIES = 256
MAX_LISTS = 1024
LIST_ROWS = 16_384
BLOCK_QUERIES = 16_384
MOST_TASKS = 20_000
SUB = 4
WORDS = 256
#: Largest component of scaled vectors, and what bounds give way by, as a share of the lengths that they come from.
CLIP, SLACK = 2.0**100, 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids; an empty one takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        d = squared_distances(x, centres)
        near = d.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[: (~full).sum()]]
    return centres


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    scale: float
    shift: np.ndarray

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Shifted, scaled and held, so that no two rows are farther apart than before (times the scale)."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.clip((x * 0.5 - self.shift * 0.5) * self.scale * 2.0, -CLIP, CLIP)

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = squared_distances(self.placed(x), self.centres)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each row's residual in the list given for it, the distance to what they stand for, and that to the centroid."""
        rest = self.placed(x) - self.centres[lists]
        codes = [squared_distances(rest[:, a:b], book).argmin(1) for (a, b), book in zip(self.cuts, self.books, strict=True)]
        meant = np.concatenate([book[c] for c, book in zip(codes, self.books, strict=True)], axis=1)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(((rest - meant) ** 2).sum(1)), np.sqrt((rest**2).sum(1))

    def tables(self, q: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of each query's residual to every codeword: (queries, subspaces, words)."""
        rest = self.placed(q) - self.centres[which]
        out = np.zeros((len(q), len(self.cuts), WORDS))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, m, : len(book)] = squared_distances(rest[:, a:b], book)
        return out


def train(x: np.ndarray, lists: int) -> Index:
    shift = (x / len(x)).sum(0)
    with np.errstate(over="ignore"):
        far = np.abs(x * 0.5 - shift * 0.5).max(1)
    middle = float(np.median(far[far > 0])) if (far > 0).any() else 0.0
    scale = float(2.0 ** -np.clip(np.floor(np.log2(middle)) + 1, -1000, 1000)) if middle > 0 else 1.0
    cuts = [(a, min(a + SUB, x.shape[1])) for a in range(0, x.shape[1], SUB)]
    empty = Index(np.empty((0, x.shape[1])), [], cuts, scale, shift)
    x = empty.placed(x)
    centres = kmeans(x, lists)
    rest = x - centres[squared_distances(x, centres).argmin(1)]
    return Index(centres, [kmeans(rest[:, a:b], WORDS, rounds=6) for a, b in cuts], cuts, scale, shift)


def tune(index: Index, x: np.ndarray, k: int, reach: float) -> tuple[int, int]:
    """In how many lists a row stands (one) and how many a query visits first: the fewest by which a share `reach` of the k nearest rows of x is met."""
    lists = len(index.centres)
    asked = np.unique(np.linspace(0, len(x) - 1, min(TUNE_QUERIES, len(x))).astype(int))
    order = index.nearest_lists(x[asked], lists)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    scaled = index.placed(x)
    d = squared_distances(scaled[asked], scaled)
    d[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not near.size:
        return 1, lists
    held = index.nearest_lists(x[near.ravel()], 1).reshape(near.shape)
    met = np.take_along_axis(rank, held, axis=1)
    return 1, int(np.sort(met.ravel())[min(met.size - 1, int(np.ceil(reach * met.size)))]) + 1


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one query, in double precision; those whose squares leave its range by scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = x - q
        d = np.sqrt((apart**2).sum(1))
        odd = np.flatnonzero(((d < 1e-140) & (d >= 0)) | ~np.isfinite(d))
        if len(odd):
            most = np.abs(apart[odd]).max(1)
            power = np.where(np.isfinite(most) & (most > 0), np.frexp(most)[1], 0)
            d[odd] = np.ldexp(np.sqrt((np.ldexp(apart[odd], -power[:, None]) ** 2).sum(1)), power)
    return d


def search_list(index: Index, which: int, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, errs: np.ndarray, x: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query rows, candidate rows, their ids, exact distances) of the k nearest rows of one list within each query's bound, of equal ones those with the smaller ids."""
    order = np.lexsort((rows, ids))
    rows, ids, errs, x = rows[order], ids[order], errs[order], x[order]
    flat = codes[order].astype(np.int64) + np.arange(len(index.cuts)) * WORDS
    length = np.sqrt((index.centres[which] ** 2).sum()) + np.sqrt(sum((book**2).sum(1)[c] for book, c in zip(index.books, codes[order].T, strict=True))) + errs
    step = max(1, min(64, 2_000_000 // max(1, flat.size)))
    for start in range(0, len(q), step):
        some = q[start : start + step]
        tables = index.tables(some, which).reshape(len(some), -1)
        rough = np.zeros((len(some), len(rows)))
        for m in range(flat.shape[1]):
            rough += tables[:, flat[:, m]]
        rough = np.sqrt(rough)
        lower = rough - errs - SLACK * (np.sqrt((index.placed(some) ** 2).sum(1))[:, None] + length)
        own_row = rows == own[start : start + step, None]
        lower[own_row] = np.inf
        # Bounds from above hold for vectors that were not clipped alone, so the limit comes from exact distances of the k that look nearest.
        first = min(k, len(rows))
        rough[own_row] = np.inf
        seeds = np.argpartition(rough, first - 1, axis=1)[:, :first]
        for i, query in enumerate(own[start : start + step]):
            most = bound[start + i]
            if lower[i].min() > most * index.scale:
                continue
            seed = seeds[i][rough[i, seeds[i]] < np.inf]
            if len(seed) >= k:
                most = min(most, distances(x[seed], some[i]).max())
            with np.errstate(over="ignore"):
                inside = np.flatnonzero((lower[i] <= most * index.scale * (1 + SLACK)) & ~own_row[i])
            exact = distances(x[inside], some[i])
            best = np.argsort(exact, kind="stable")[:k]
            best = best[exact[best] <= bound[start + i]]
            yield np.full(len(best), query), rows[inside[best]], ids[inside[best]], exact[best]


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, reach: float = 0.5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with an id divisible by `every`, the k nearest. reach: what the first lists are to hold, see tune."""
    vectors = usable(embeddings, nonzero=True)
    n = vectors.count()
    spark = vectors.sparkSession
    if not n:
        return vectors.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "CAST(0 AS DOUBLE) AS score").limit(0)
    fitted = sample(vectors, TRAIN_ROWS)
    index = train(fitted, max(1, min(MAX_LISTS, round(n**0.5))))
    lists = len(index.centres)
    _, probes = tune(index, fitted, k, reach)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = matrix(part.column(2).to_pylist())
                held = shared.value.nearest_lists(x, 1)[:, 0]
                codes, errs, far = shared.value.encode(x, held)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(held.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errs), pa.array(far)], names=["row", "vec_id", "vec", "list", "code", "err", "far"])

    coded = materialise(vectors.select("row", "vec_id", "vec").mapInArrow(encode, "row long, vec_id long, vec binary, list int, code binary, err double, far double"))
    held = {r["list"]: (r["n"], r["far"]) for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # MAX_LISTS rows at most
    parts = [-(-held[i][0] // LIST_ROWS) if i in held else 0 for i in range(lists)]
    radius = np.array([held[i][1] if i in held else 0.0 for i in range(lists)])
    of_list = F.broadcast(spark.createDataFrame(list(enumerate(parts)), "list int, parts int"))
    cut_codes = coded.drop("far").join(of_list, "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    blocks = max(1, -(-n // (every * BLOCK_QUERIES)))
    # Given as a number, so that tasks with little data and much to compute are not merged.
    tasks = min(MOST_TASKS, -(-blocks * sum(parts) // 4))

    def search(queries: DataFrame, again: bool) -> DataFrame:
        """query, row, vec_id, score: the nearest in each of the first lists of a query (row, vec, bound), or in each of the others that may hold one within its bound."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if not part.num_rows:
                    continue
                x, ix = matrix(part.column(1).to_pylist()), shared.value
                placed, near = ix.placed(x), ix.nearest_lists(x, lists)
                far = np.sqrt(squared_distances(placed, ix.centres))
                slack = SLACK * (np.sqrt((placed**2).sum(1))[:, None] + np.sqrt((ix.centres**2).sum(1)) + radius)
                with np.errstate(over="ignore"):
                    open_ = far - radius - slack <= (part.column(2).to_numpy(zero_copy_only=False) * ix.scale * (1 + SLACK))[:, None]
                for i in range(part.num_rows):
                    goes = [(int(w), p) for w in (near[i, probes:] if again else near[i, :probes]) if not again or open_[i, w] for p in range(parts[w])]
                    take = pa.array(np.full(len(goes), i, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(3)), pa.array([w for w, _ in goes], pa.int32()), pa.array([p for _, p in goes], pa.int32())], names=["query", "vec", "bound", "list", "part"])

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                found = list(search_list(shared.value, int(key[0]), left["row"].to_numpy(), left["vec_id"].to_numpy(), matrix(left["code"], np.uint8), left["err"].to_numpy(), matrix(left["vec"]), matrix(right["vec"]), right["query"].to_numpy(), right["bound"].to_numpy(), k))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0)]
            return pd.DataFrame(dict(zip(("query", "row", "vec_id", "score"), columns, strict=True)))

        keys = ["list", "part", "block"]
        dealt = queries.select("row", "vec", "bound").mapInArrow(visit, "query long, vec binary, bound double, list int, part int").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        codes = cut_codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return codes.repartition(tasks, *keys).groupBy(*keys).cogroup(dealt.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, "query long, row long, vec_id long, score double")

    by_query = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = materialise(best(search(asked.withColumn("bound", F.lit(float("inf"))), False)).drop("rank"))
    bounds = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most")).where(F.col("n") >= k).select(F.col("query").alias("row"), F.col("most").alias("bound"))
    more = search(asked.join(bounds, "row", "left").select("row", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), True)
    whole = best(found.unionByName(more)) if probes < lists else best(found)
    return whole.join(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
