"""Exact top-k inner products by best-first search in M-trees.

Each component is floored to an integer first, so scores are exact. A vector x with |x| <= M is lifted to
(x, sqrt(M^2 - |x|^2)) and a query to (q, 0); then d^2(q, x) = |q|^2 + M^2 - 2 q.x, and the largest inner products are the
nearest neighbours of a metric.

An M-tree has pages of routing objects with covering radius and distance to the parent's routing
object, and leaf pages of objects with their distance to the page's routing object. The search takes pages from
a queue by their lower bound. The stored distances give, by the triangle inequality, a bound that saves
computing the distance to a routing object or an object at all. Bounds have a small slack for
rounding, and only strictly worse pages are cut, so ties are always decided by the id.

Over the cluster: rows are dealt to regions, that of the nearest of at most MAX_REGIONS pivots, and a region of more than
TREE_ROWS rows (such as one of copies of one vector) is dealt further by a hash of the row; a tree is built for each part.
Each query first searches one tree of its own region, which gives it a score to beat, then only those trees whose
region can hold a better row. Trees stand together in batches, one task each: a query is sent once to each batch
that has a tree for it, with the numbers of these trees, and streams past the batch's trees, so queries are never held. Batches are
repeated only for each BLOCK_QUERIES queries. Only pivots and their radii are broadcast.

Integers are kept as doubles where these are exact; where a sum of products could leave 2^53, products are of Python integers, and a
score beyond 64 bits stands at the bound of the type.

Defined results: see `vectors.usable` for which rows take part (rows that repeat an id are rows of their own, and candidates
of each other); fewer candidates than k give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.llm.common import materialise
from quillfold.llm.vectors import matrix, sample, squared_distances, usable

PAGE = 256
FANOUT = 16
TREE_ROWS = 4096
MAX_REGIONS = 1024
#: Trees of one task: at most TREES, and fewer while there are not LEAST_TASKS tasks.
TREES, LEAST_TASKS = 8, 48
BLOCK_QUERIES = 65_536
MOST_TASKS = 20_000
#: Bounds are widened by this and by SLACK_SHARE of the longest vector, for rounding.
SLACK, SLACK_SHARE = 1e-6, 1e-7
EXACT = float(2**53)
BOUND = 2**63


def to_integers(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """Whole numbers, as doubles: scaling by a power of two and the floor are exact."""
    return np.floor(np.clip(x, -1e300, 1e300) * scale)


def dot(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, within 64 bits."""
    if not len(rows) or float(np.abs(rows).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, len(q)) < EXACT:
        return rows @ q
    whole = [int(v) for v in q.tolist()]
    sums = (sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows.tolist())
    return np.array([min(max(s, -BOUND), BOUND - 1) for s in sums], dtype=object)


class Page:
    __slots__ = ("children", "far", "members", "radius", "route", "to_parent", "to_route")

    def __init__(self, route, radius, to_parent):
        self.route, self.radius, self.to_parent = route, radius, to_parent
        self.children: list[Page] = []
        self.members = self.to_route = self.far = None


class MTree:
    """x: whole numbers, one row for each of rows; ids: of the rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        order = np.lexsort((rows, ids))
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        squares = (self.x * self.x).sum(1)
        self.most = float(squares.max())
        self.peak = float(np.abs(self.x).max(initial=0.0))
        self.lift = np.sqrt(self.most - squares)
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), None)
        # Pages stand side by side.
        leaves, stack = [], [self.root]
        while stack:
            page = stack.pop()
            stack += page.children
            if page.members is not None:
                leaves.append(page)
        order = np.concatenate([p.members for p in leaves])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.x, self.ids, self.rows, self.lift = self.x[order], self.ids[order], self.rows[order], self.lift[order]
        start, stack = 0, [self.root]
        while stack:
            page = stack.pop()
            stack += page.children
            page.route = int(place[page.route])
            if page.far is not None:
                page.far[:, 2] = place[page.far[:, 2].astype(np.int64)]
        for page in leaves:
            page.members = (start, start + len(page.members))
            start = page.members[1]

    def _distances(self, rows: np.ndarray, route: int) -> np.ndarray:
        d = self.x[rows] - self.x[route]
        return np.sqrt((d * d).sum(1) + (self.lift[rows] - self.lift[route]) ** 2)

    def _build(self, rows: np.ndarray, parent: int | None) -> Page:
        route = int(rows[0])
        own = self._distances(rows, route)
        page = Page(route, float(own.max()), 0.0 if parent is None else float(self._distances(np.array([route]), parent)[0]))
        if len(rows) <= PAGE:
            page.members, page.to_route = rows, own
            return page
        nearest, best, pivot = np.zeros(len(rows), dtype=np.int64), own.copy(), 0
        fan = min(FANOUT, -(-2 * len(rows) // PAGE))  # pages at least about half full
        for k in range(1, fan):  # farthest-first routing objects
            pivot = int(np.argmax(best))
            if best[pivot] == 0:
                break
            d = self._distances(rows, int(rows[pivot]))
            closer = d < best
            nearest[closer], best[closer] = k, d[closer]
        parts = [rows[nearest == k] for k in range(fan)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1 or max(map(len, parts)) > 0.9 * len(rows):  # copies, or an outlier: cut evenly
            spread = rows[np.argsort(own, kind="stable")]
            parts = np.array_split(spread, min(FANOUT, -(-len(rows) // PAGE)))
        page.children = [self._build(p, route) for p in parts]
        page.far = np.array([[c.to_parent, c.radius, c.route] for c in page.children])
        return page

    def search(self, q: np.ndarray, k: int, own: int, at_least: int | None = None) -> list[tuple[int, int, int]]:
        """The best (score, id, row), best first, without the row `own`; only those with a score of at_least, where it is given."""
        qq = float((q * q).sum())
        slack = SLACK + SLACK_SHARE * float(np.sqrt(qq + self.most))
        plain = self.peak * float(np.abs(q).max(initial=0.0)) * len(q) < EXACT  # no sum of products leaves what doubles hold
        times = (lambda rows: rows @ q) if plain else (lambda rows: dot(rows, q))
        to = lambda score: np.sqrt(np.maximum(qq + self.most - 2.0 * np.asarray(score, dtype=np.float64), 0.0))
        limit = np.inf if at_least is None or abs(at_least) >= BOUND - 1 else float(to(at_least)) + slack
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row): the worst first
        self.computed += 1
        queue = [(0.0, 0, self.root, float(to(times(self.x[self.root.route][None, :])[0])))]
        serial = 0
        while queue:
            bound, _, page, d = heapq.heappop(queue)
            if bound > limit:
                break
            if page.members is not None:
                close = np.abs(d - page.to_route) <= limit
                near = slice(*page.members) if close.all() else np.arange(*page.members)[close]
                scores = times(self.x[near])
                self.computed += len(scores)
                least = max(best[0][0] if len(best) == k else -np.inf, -np.inf if at_least is None else at_least)
                good = (scores >= least).astype(bool)
                for score, i, row in zip(scores[good].tolist(), self.ids[near][good].tolist(), self.rows[near][good].tolist(), strict=True):
                    if row == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (int(score), -i, -row))
                    elif (score, -i, -row) > best[0]:
                        heapq.heapreplace(best, (int(score), -i, -row))
                if len(best) == k and abs(best[0][0]) < BOUND - 1:
                    limit = min(limit, float(to(best[0][0])) + slack)
                continue
            stored = page.far
            open_ = np.abs(d - stored[:, 0]) - stored[:, 1] <= limit
            routes = stored[open_, 2].astype(np.int64)
            self.computed += len(routes)
            exact = to(times(self.x[routes]))
            for j, dist, radius in zip(np.flatnonzero(open_).tolist(), exact.tolist(), stored[open_, 1].tolist(), strict=True):
                if dist - radius <= limit:
                    serial += 1
                    heapq.heappush(queue, (max(0.0, dist - radius), serial, page.children[j], dist))
        return sorted(((s, -i, -row) for s, i, row in best), key=lambda b: (-b[0], b[1], b[2]))


def _search_batches(rows: DataFrame, asked: DataFrame, together: int, tasks: int, blocks: int, k: int, scale: float) -> DataFrame:
    """rows: tree, row, vec_id, vec; asked: batch, trees, query, vec, at_least. Returns query, row, vec_id, score.

    A batch's rows come first and become trees; its queries stream by after them.
    """
    number = lambda name, kind: F.lit(None).cast(kind).alias(name)
    held = rows.withColumn("batch", F.floor(F.col("tree") / together).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.select("batch", "block", "tree", "row", "vec_id", "vec", number("trees", "array<int>"), number("at_least", "long"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    streamed = asked.select("batch", block, F.lit(2**31 - 1).alias("tree"), F.col("query").alias("row"), number("vec_id", "long"), "vec", "trees", "at_least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, trees = None, {}, {}
        for part in batches:
            key = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            tree, row, vec_id = (part.column(i).to_pylist() for i in (2, 3, 4))
            x = to_integers(matrix(part.column(5).to_pylist()), scale)
            out = []
            for i in range(part.num_rows):
                if key[i] != now:
                    now, waiting, trees = key[i], {}, {}
                if vec_id[i] is not None:
                    waiting.setdefault(tree[i], []).append((row[i], vec_id[i], x[i]))
                    continue
                for t in part.column(6)[i].as_py():
                    if t not in trees and t in waiting:
                        members = waiting.pop(t)
                        trees[t] = MTree(np.stack([m[2] for m in members]), np.array([m[1] for m in members]), np.array([m[0] for m in members]))
                    if t in trees:
                        out += [(row[i], r, v, s) for s, v, r in trees[t].search(x[i], k, row[i], part.column(7)[i].as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query", "row", "vec_id", "score"])

    dealt = held.unionByName(streamed).repartition(tasks, "batch", "block").sortWithinPartitions("batch", "block", "tree", "row")
    return dealt.mapInArrow(run, "query long, row long, vec_id long, score long")


def top_inner_products(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with an id divisible by `every`, the k best other rows."""
    vectors = usable(embeddings)
    n = vectors.count()
    if not n:
        return vectors.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "vec_id AS score").limit(0)
    pivots = to_integers(sample(vectors, min(MAX_REGIONS, max(1, n // TREE_ROWS))), scale)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x = to_integers(matrix(part.column(2).to_pylist()), scale)
            d = squared_distances(x, shared.value)
            near = d.argmin(1)
            far = np.sqrt(((x - shared.value[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(near.astype(np.int32)), pa.array(far)], names=["row", "vec_id", "vec", "region", "far"])

    dealt = materialise(vectors.mapInArrow(deal, "row long, vec_id long, vec binary, region int, far double"))
    regions = dealt.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # MAX_REGIONS rows at most
    parts = {r["region"]: -(-r["n"] // TREE_ROWS) for r in regions}
    number, trees = {}, []
    for r in sorted(regions, key=lambda r: r["region"]):
        number[r["region"]] = len(trees)
        trees += [r["region"]] * parts[r["region"]]
    of_region = F.broadcast(spark.createDataFrame([(r, number[r], parts[r]) for r in number], "region int, first int, parts int"))
    tree = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).alias("tree")
    rows = dealt.join(of_region, "region").select(tree, "row", "vec_id", "vec")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "vec", F.col("tree").alias("home"))
    blocks = max(1, -(-n // (every * BLOCK_QUERIES)))
    together = max(1, min(TREES, len(trees) // LEAST_TASKS))
    # Given as a number, so that tasks with little data and much to compute are not merged.
    tasks = min(MOST_TASKS, 3 * blocks * -(-len(trees) // together))

    first = queries.select(F.floor(F.col("home") / together).cast("int").alias("batch"), F.array("home").alias("trees"), "query", "vec", F.lit(None).cast("long").alias("at_least"))
    found = materialise(_search_batches(rows, first, together, tasks, blocks, k, scale))
    reached = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("at_least"))

    # What a tree can score at best follows from its region: q.x <= q.c + |q| r for rows within r of the pivot c.
    bounds = {r["region"]: float(r["far"]) for r in regions}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_tree = np.array(trees)
        radius = np.array([bounds[t] for t in trees])
        for piece in batches:
            q = to_integers(matrix(piece.column(1).to_pylist()), scale)
            if not len(q):
                continue
            size = np.sqrt((q * q).sum(1))[:, None]
            reach = q @ shared.value[of_tree].T + size * radius[None, :]
            best = reach + 1.0 + 1e-9 * size * (radius + np.sqrt((shared.value[of_tree] ** 2).sum(1)))[None, :]
            least = np.array([-np.inf if v is None else v for v in piece.column(3).to_pylist()], dtype=np.float64)
            may = best >= np.where(least >= BOUND - 1024, -np.inf, least)[:, None]
            may[np.arange(len(q)), np.array(piece.column(2).to_pylist())] = False
            at, goes, of = [], [], []
            for i in range(len(q)):
                mine = np.flatnonzero(may[i])
                for batch in np.unique(mine // together).tolist():
                    at.append(batch)
                    goes.append(mine[mine // together == batch].tolist())
                    of.append(i)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(goes, pa.list_(pa.int32())), *(piece.column(c).take(take) for c in (0, 1, 3))], names=["batch", "trees", "query", "vec", "at_least"])

    second = queries.join(reached, "query", "left").select("query", "vec", "home", "at_least")
    asked = second.mapInArrow(choose, "batch int, trees array<int>, query long, vec binary, at_least long")
    every_found = found.unionByName(_search_batches(rows, asked, together, tasks, blocks, k, scale))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = every_found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")
