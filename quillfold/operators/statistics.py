"""How sure scores are and whether they differ: bootstrap intervals, paired tests, effect sizes, agreement, stability.

Each is one plan over any number of rows: what comes to one place is a row for each class, value range, group or replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.operators.evaluation import f1
from quillfold.operators.ranks import tie_ranks, with_rank
from quillfold.operators.relational import beside

REPLICATES = 200
#: Rows of a batch times replicates that are worked on at once.
CELLS_AT_ONCE = 1 << 20
# Of the hash: 32 bits, a multiplier that keeps products under 2**63, and the step from one replicate to the next.
MASK, MULTIPLIER, STEP = 0xFFFFFFFF, 0x45D9F3B, 0x9E3779B9
#: Where the distribution function of Poisson(1) stands at 0, 1, 2 ..., in parts of 2**32: a hash's weight is how many of these it reaches.
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits, in uint64."""
    for _ in range(2):
        h = ((h >> np.uint64(16)) ^ h) * np.uint64(MULTIPLIER) & np.uint64(MASK)
    return (h >> np.uint64(16)) ^ h


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row (by its id) is drawn in each replicate: rows x replicates."""
    key = ids.astype(np.int64).view(np.uint64)
    key = mixed((key ^ (key >> np.uint64(32)) ^ np.uint64(seed)) & np.uint64(MASK))
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STEP)
    h = mixed((key[:, None] + steps[None, :]) & np.uint64(MASK))
    return np.searchsorted(np.array(POISSON, dtype=np.uint64), h, side="right")


def mixed_sql(h: str) -> str:
    """mixed() as SQL that DuckDB runs."""
    step = lambda x: f"(xor({x} // 65536, {x}) * {MULTIPLIER}) & {MASK}"
    return f"list_reduce([{h}, 0, 1, 2], lambda x, k: CASE WHEN k < 2 THEN {step('x')} ELSE xor(x // 65536, x) END)"


def weight_sql(row_id: str, replicate: str, seed: int) -> str:
    key = mixed_sql(f"(xor(xor({row_id}, {row_id} // 4294967296), {seed}) & {MASK})")
    return f"(SELECT list_sum(list_transform({POISSON}, lambda p: CASE WHEN h >= p THEN 1 ELSE 0 END)) FROM (SELECT {mixed_sql(f'(({key} + {replicate} * {STEP}) & {MASK})')} AS h))"


def resampled_counts(rows: DataFrame, row_id: str, cell: list[str], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """replicate, cell and n: the rows of each cell in each replicate of a Poisson bootstrap; replicate 0 is the table itself.

    A row's weights follow from its id alone (an integer), so the table is read once and not resampled. A task sums arrays of weights
    by cell and passes on one for each cell that it has; cells are meant to be classes.
    """
    names = [f"c{k}" for k in range(len(cell))]
    schema = ", ".join([*[f"{n} string" for n in names], "replicate int", "n long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        most = max(1, CELLS_AT_ONCE // replicates)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(cell))), strict=True))
            known = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            where = np.array([known[k] for k in keys], dtype=np.int64)
            for at in range(0, len(ids), most):
                weights = np.concatenate((np.ones((len(ids[at : at + most]), 1), dtype=np.int64), poisson_weights(ids[at : at + most], replicates, seed)), axis=1)
                part = where[at : at + most]
                for key, i in known.items():
                    own = weights[part == i].sum(axis=0)
                    sums[key] = sums[key] + own if key in sums else own
        for key, own in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(own), pa.string()) for v in key], pa.array(np.arange(len(own)), pa.int32()), pa.array(own, pa.int64())], names=[*names, "replicate", "n"])

    told = rows.select(F.col(row_id).cast("long").alias("_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(cell, names, strict=True)]).mapInArrow(scan, schema)
    return told.groupBy("replicate", *names).agg(F.sum("n").alias("n")).select("replicate", *[F.col(n).alias(c) for n, c in zip(names, cell, strict=True)], "n")


def bootstrap_intervals(preds: DataFrame, row_id: str, gold: str, predicted: str, replicates: int = REPLICATES, seed: int = 1, level: float = 0.95) -> DataFrame:
    """metric (accuracy, macro_f1), estimate, lo and hi: what the table gives, and the interval that holds `level` of the replicates."""
    counts = resampled_counts(preds, row_id, [gold, predicted], replicates, seed)
    right = F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(F.lit(0))
    shares = counts.groupBy("replicate").agg(F.try_divide(F.sum(right), F.sum("n")).alias("value")).select("replicate", F.lit("accuracy").alias("metric"), "value")
    side = lambda label, tp, fp, fn: F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    wrong, none = F.col("n") - right, F.lit(0).cast("long")
    sides = counts.where("n > 0").select("replicate", F.explode(F.array(side(gold, right, none, wrong), side(predicted, none, wrong, none))).alias("s")).select("replicate", "s.*")
    labels = sides.groupBy("replicate", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    scores = labels.groupBy("replicate").agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("value")).select("replicate", F.lit("macro_f1").alias("metric"), "value")
    return _interval(shares.unionByName(scores), level, "metric")


def _interval(values: DataFrame, level: float, *by: str) -> DataFrame:
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    bounds = [F.percentile(drawn, F.lit(q)).alias(n) for q, n in (((1 - level) / 2, "lo"), ((1 + level) / 2, "hi"))]
    return values.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), *bounds)


def paired_tests(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row for pairs without nulls: n, mean_difference, cohens_d (of the differences), t, n_nonzero, w_plus, w_minus, z.

    w: Wilcoxon's signed ranks of the differences that are not zero, ties at their mean rank; z: its normal approximation, with the
    variance less what the ties take.
    """
    d = pairs.select((F.col(x).cast("double") - F.col(y).cast("double")).alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
    moments = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("_sd"))
    effect = F.try_divide("mean_difference", "_sd")
    moments = moments.select("n", "mean_difference", effect.alias("cohens_d"), (effect * F.sqrt("n")).alias("t"))
    ranks = tie_ranks(d.where("d <> 0").withColumn("size", F.abs("d")), "size", up=F.count_if(F.col("d") > 0))
    t = F.col("n").cast("double")
    sums = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nonzero"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("_ties"))
    m = F.col("n_nonzero").cast("double")
    z = F.try_divide(F.col("w_plus") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48))
    return beside(moments, sums.withColumn("z", z).drop("_ties"))


def group_difference(rows: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """n_first, n_second, mean_first, mean_second, cohens_d with the pooled deviation, and Welch's t, of two independent groups."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    both = rows.agg(*[f(of(g)).alias(f"{n}_{k}") for k, g in (("first", first), ("second", second)) for n, f in (("n", F.count), ("mean", F.avg), ("_v", F.var_samp))])
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n_first", "n_second", "_v_first", "_v_second"))
    gap = F.col("mean_first") - F.col("mean_second")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    welch = F.sqrt(F.try_divide(v1, n1) + F.try_divide(v2, n2))
    return both.select("n_first", "n_second", "mean_first", "mean_second", F.try_divide(gap, pooled).alias("cohens_d"), F.try_divide(gap, welch).alias("t"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """n and rho of pairs without nulls: the correlation of their ranks (null under three rows or without variance)."""
    known = pairs.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    ranked = with_rank(with_rank(known, "_x", "_rx"), "_y", "_ry")
    flat = (F.count(F.lit(1)) < 3) | (F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(~flat, F.corr("_rx", "_ry")).alias("rho"))


def krippendorff(ratings: DataFrame, unit: str, value: str, kind: str = "interval") -> DataFrame:
    """n_units, n_values and alpha, of ratings without nulls in units that have two or more; kind: nominal (any values) or interval (numbers).

    Disagreement of all pairs of a unit follows from its histogram of values, as does that of all pairs of the table from the whole histogram:
    neither raters nor values are paired. alpha is null where no two values differ.
    """
    number = F.col("v").cast("double") if kind == "interval" else F.lit(0.0)
    known = ratings.select(F.col(unit).alias("u"), F.col(value).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    counts = known.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    several = counts.groupBy("u").agg(F.sum("c").alias("m")).where("m > 1")
    kept = counts.join(several, "u").select("u", "v", "c", "m", number.alias("x"))
    parts = [F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("x")).alias("cx"), F.sum(F.col("c") * F.col("x") * F.col("x")).alias("cxx")]
    apart = 2 * (F.col("n") * F.col("cxx") - F.col("cx") * F.col("cx")) if kind == "interval" else F.col("n") * F.col("n") - F.col("cc")
    by_unit = kept.groupBy("u").agg(*parts)
    observed = by_unit.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("n_values"), F.sum(apart / (F.col("n") - 1)).alias("_observed"))
    whole = kept.groupBy("v", "x").agg(F.sum("c").alias("c")).agg(*parts)
    expected = whole.select(F.try_divide(apart, F.col("n") - 1).alias("_expected"))
    return beside(observed, expected).select("n_units", "n_values", (1 - F.try_divide("_observed", "_expected")).alias("alpha"))


def stability(rows: DataFrame, metrics: list[str], contexts: list[str]) -> DataFrame:
    """context, metric, n_groups and stability = 100 / (1 + deviation / mean) of the metric's means by group of the context.

    Metrics are brought to 0 .. 1 by their range over all rows (without a range: 1); rows without a group or a metric are left out of it.
    One plan by grouping sets for all contexts.
    """
    bounds = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    scaled = beside(rows, bounds).select(*contexts, *[F.when(F.col(c).isNotNull(), F.when(span(c) == 0, F.lit(1.0)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span(c))).alias(c) for c in metrics])
    sets = scaled.groupingSets([[F.col(c)] for c in contexts], *[F.col(c) for c in contexts])
    means = sets.agg(F.grouping_id().alias("_set"), *[F.avg(c).alias(f"_m_{c}") for c in metrics])
    of_set = F.coalesce(*[F.when(F.col("_set") == ((1 << len(contexts)) - 1) ^ (1 << (len(contexts) - 1 - k)), F.lit(c)) for k, c in enumerate(contexts)])
    grouped = F.coalesce(*[F.when((of_set == c) & F.col(c).isNotNull(), F.lit(True)) for c in contexts])
    long = means.where(grouped).select(of_set.alias("context"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_m_{c}").alias("mean")) for c in metrics])).alias("e")).select("context", "e.*").where("mean IS NOT NULL")
    variation = F.try_divide(F.stddev_pop("mean"), F.avg("mean"))
    return long.groupBy("context", "metric").agg(F.count(F.lit(1)).alias("n_groups"), (100 / (1 + variation)).alias("stability"))
