"""Amended versions of one opinion, and splits that keep groups whole."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.opinions import has_revision_marker
from quillfold.operators.ranks import with_places
from quillfold.operators.relational import cut_lineage, small
from quillfold.operators.similarity import SPACED, entry, similar_pairs, window_text

# Limits that decide the results.
GAP_DAYS, SAME, SAME_IF_MARKED = 400, 0.5, 0.05
SPLITS = ["test", "val", "train"]

#: Different counts by label that the driver may hold.
MOST_CLASSES = 1_000_000


def _later(a: str, b: str) -> Column:
    """Filed later, or the same day with a larger id."""
    return (F.col(f"{a}_filed") > F.col(f"{b}_filed")) | ((F.col(f"{a}_filed") == F.col(f"{b}_filed")) & (F.col(f"{a}_id") > F.col(f"{b}_id")))


def amended_pairs(rows: DataFrame) -> DataFrame:
    """newer, older, since, similarity and reason, of rows (id, court, name, filed, text) that may replace each other.

    Rows meet within a court and name, and only if they share a rare shingle there; the low threshold is asked only of
    pairs of which a text bears a revision marker. Of two rows of one day the larger id is the newer. Texts under five
    words pair with nothing.
    """
    marked = F.coalesce(has_revision_marker(F.col("text")), F.lit(False))
    block = cut_lineage(rows.select("id", "court", "name", "filed", marked.alias("marked")))
    with_marker = small(block.where("marked").select("court", "name", F.lit(SAME_IF_MARKED).alias("floor")).distinct())
    own = entry(F.xxhash64("court", "name"), F.coalesce("floor", F.lit(SAME)), F.when(marked, SAME_IF_MARKED).otherwise(SAME))
    texts = rows.join(with_marker, ["court", "name"], "left").select("id", window_text(F.col("text")).alias("text"), F.array(own).alias("e"))
    near = F.abs(F.date_diff("a_filed", "b_filed")) <= GAP_DAYS
    pairs = similar_pairs(texts, block.withColumn("least", F.lit(SAME_IF_MARKED)), ["court", "name"], near, SPACED).select("a", "b", "similarity")
    of = lambda p: block.select(F.col("id").alias(f"{p}_id"), F.col("filed").alias(f"{p}_filed"), F.col("marked").alias(f"{p}_marked"))
    dated = pairs.withColumnsRenamed({"a": "a_id", "b": "b_id"}).join(of("a"), "a_id").join(of("b"), "b_id").where((F.col("similarity") >= SAME) | F.col("a_marked") | F.col("b_marked"))
    first = _later("a", "b")
    reason = F.when(F.col("similarity") >= SAME, "amended_earlier_version").otherwise("revised_marker")
    return dated.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("newer"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("older"), F.greatest("a_filed", "b_filed").alias("since"), "similarity", reason.alias("reason"))


def drop_superseded(pairs: DataFrame) -> DataFrame:
    """older, newer, similarity, reason: each row dropped, and the latest kept row that replaces it.

    A row that is dropped itself drops nothing. What no open pair names as older is surely kept; what it replaces
    is dropped, and pairs of dropped rows close. Rounds follow the longest chain, not the group, and no group is gathered.
    """
    pairs = cut_lineage(pairs)
    still, gone = pairs, pairs.select("older").limit(0)
    while not still.isEmpty():
        unsure = still.select(F.col("older").alias("newer")).distinct()
        hit = cut_lineage(still.join(unsure, "newer", "left_anti").select("older").distinct())
        gone = gone.unionByName(hit)
        still = cut_lineage(still.join(hit, "older", "left_anti").join(hit.withColumnRenamed("older", "newer"), "newer", "left_anti"))
    kept = pairs.join(gone.select(F.col("older").alias("newer")), "newer", "left_anti")
    best = F.max(F.struct("since", "newer", "similarity", "reason")).alias("best")
    return kept.groupBy("older").agg(best).select("older", "best.newer", "best.similarity", "best.reason")


def runs_of(costs: list[int], step: int, many: int) -> list[int]:
    """How often each of some choices is taken when the cheapest (of equal ones the first) is taken `many` times over, and each time costs `step` more."""

    def upto(most: int) -> list[int]:
        return [max(0, (most - c) // step + 1) for c in costs]

    low, high = min(costs), min(costs) + step * many
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(upto(middle)) >= many else (middle + 1, high)
    taken, left = upto(low - 1), many - sum(upto(low - 1))
    for k, c in enumerate(costs):
        if left and c <= low and (low - c) % step == 0:
            taken[k], left = taken[k] + 1, left - 1
    return taken


def split_classes(classes: list[tuple[dict[str, int], int]], shares: dict[str, int]) -> list[list[int]]:
    """For each class (its groups' counts by label, how many groups) how many of its groups go to each split; shares are whole parts of their sum.

    All in whole numbers: what a split has beyond its target is held times the sum of the shares.
    """
    whole, total = sum(shares.values()), {}
    for counts, many in classes:
        for label, n in counts.items():
            total[label] = total.get(label, 0) + n * many
    over = [{label: -part * n for label, n in total.items()} for part in shares.values()]
    out = []
    for counts, many in classes:
        costs = [sum(n * (2 * side[label] + n * whole) for label, n in counts.items()) for side in over]
        taken = runs_of(costs, 2 * whole * sum(n * n for n in counts.values()), many)
        for side, times in zip(over, taken, strict=True):
            for label, n in counts.items():
                side[label] += times * n * whole
        out.append(taken)
    return out


def group_split(rows: DataFrame, group: str, label: str, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """group, split: whole groups, largest first, each to the split that it leaves nearest to its targets.

    Putting g rows of a label where `over` is what the split has beyond its target changes the squared error by
    g (2 over + g); a group goes where the sum over labels is least (ties: test, val, train). Groups with equal counts by label are
    interchangeable: of one size, such classes stand in a seeded order, and how a class is dealt out follows at once, as every
    group makes its split dearer by the same amount. So the driver holds the distinct classes alone (MOST_CLASSES at most; more are
    refused), and the groups of a class take their splits by their places in a seeded order. Rows without a group take no part.
    """
    shares = dict(zip(SPLITS, (round(s * 1_000_000) for s in (test, val, 1 - test - val)), strict=True))
    if min(shares.values()) <= 0:
        raise ValueError("test and val must be positive and leave something to train")
    counts = rows.where(F.col(group).isNotNull()).groupBy(group, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy(group).agg(F.sum("_n").alias("_size"), F.to_json(F.array_sort(F.collect_list(F.struct(F.col("_label").alias("l"), F.col("_n").alias("n"))))).alias("_class"))
    groups = cut_lineage(groups)
    seeded = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    classes = groups.groupBy("_size", "_class").agg(F.count(F.lit(1)).alias("_many")).withColumn("_at", seeded(F.col("_class")))
    found = classes.limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} different counts by label")
    found.sort(key=lambda r: (-r["_size"], r["_at"], r["_class"]))
    dealt = split_classes([({x["l"]: x["n"] for x in json.loads(r["_class"])}, r["_many"]) for r in found], shares)
    edges = [(r["_class"], t, t + v) for r, (t, v, _) in zip(found, dealt, strict=True)]
    table = small(rows.sparkSession.createDataFrame(edges, "_class string, _test long, _val long"))
    placed = with_places(groups, "_class", "_place", seeded(F.col(group)), F.col(group)).join(table, "_class")
    split = F.when(F.col("_place") <= F.col("_test"), "test").when(F.col("_place") <= F.col("_val"), "val").otherwise("train")
    return placed.select(group, split.alias("split"))
