"""Joins, keyed deduplication and aggregates that the corpus steps are made of."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a looked-up table is broadcast.
BROADCAST_ROWS = 200_000
#: Days of a bin in which rows meet the spans that hold their dates.
BIN_DAYS = 365


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose size is checked; a larger one is left to the optimiser."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; all for k = 0."""
    if not k:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")


def active_open(date: Column, start: Column, end: Column) -> Column:
    """Containment where a missing date, start or end passes."""
    return date.isNull() | ((start.isNull() | (start <= date)) & (end.isNull() | (end >= date)))


def active_started(date: Column, start: Column, end: Column) -> Column:
    """Containment where a missing start does not pass."""
    return start.isNotNull() & (start <= date) & (end.isNull() | (end >= date))


def active_pairs(rows: DataFrame, spans: DataFrame, keys: Sequence[str], date: str = "date", start: str = "start", end: str = "end", opened: bool = True, days: int = BIN_DAYS) -> DataFrame:
    """rows joined with the spans of their keys that hold their date, for rows with a date.

    Spans are cut into bins of some days, within what the rows' dates reach, so that a row meets only the spans of its bin: a key
    with any number of spans costs what is near the date. opened: a missing start passes.
    """
    bin_of = lambda c: F.floor(F.date_diff(c, F.lit("1970-01-01").cast("date")) / days).cast("int")
    dated = rows.where(F.col(date).isNotNull()).withColumn("_bin", bin_of(F.col(date)))
    reach = dated.agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
    first = F.greatest(F.coalesce(bin_of(F.col(start)), F.col("_lo")), F.col("_lo"))
    last = F.least(F.coalesce(bin_of(F.col(end)), F.col("_hi")), F.col("_hi"))
    cut = beside(spans if opened else spans.where(F.col(start).isNotNull()), reach).where(first <= last).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_lo", "_hi")
    return dated.join(small(cut), [*keys, "_bin"]).where(active_open(F.col(date), F.col(start), F.col(end))).drop("_bin")


def whole_spans(spans: DataFrame, keys: Sequence[str], person: str = "person", start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, n and person: each person's spans of a key as spans that do not meet, and of equal ones their number and least person."""
    held = spans.where(F.col(person).isNotNull() & F.coalesce(F.col(start) <= F.col(end), F.lit(True)))
    before = Window.partitionBy(*keys, person).orderBy(F.col(start).asc_nulls_first(), F.col(end)).rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(~F.max(F.col(end).isNull()).over(before) & (F.col(start) > F.max(end).over(before)), F.lit(False))
    upto = Window.partitionBy(*keys, person).orderBy(F.col(start).asc_nulls_first(), F.col(end)).rowsBetween(Window.unboundedPreceding, 0)
    numbered = held.withColumn("_apart", apart).withColumn("_run", F.count_if("_apart").over(upto))
    ends = F.when(F.bool_or(F.col(end).isNull()), None).otherwise(F.max(end)).alias(end)
    starts = F.when(F.bool_or(F.col(start).isNull()), None).otherwise(F.min(start)).alias(start)
    return numbered.groupBy(*keys, person, "_run").agg(starts, ends).groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("n"), F.min(person).alias(person))


def interval_decision(rows: DataFrame, spans: DataFrame, row_id: str, key: str, date: str) -> DataFrame:
    """Number of persons of spans (key, person, start, end) active at each row, and the person if there is just one; without a date all of the key are.

    Each key and date is decided once, however many rows ask it, over spans that count the persons who share them: rows meet no persons.
    """
    asked = rows.where(F.col(date).isNotNull()).select(key, date).distinct()
    active = active_pairs(asked, whole_spans(spans, [key]), [key], date).groupBy(key, date).agg(F.sum("n").alias("n_active"), F.min("person").alias("person"))
    whole = spans.groupBy(key).agg(F.count_distinct("person").alias("n_active"), F.min("person").alias("person"))
    undated = rows.where(F.col(date).isNull()).select(row_id, key).join(small(whole), key, "left")
    found = rows.where(F.col(date).isNotNull()).select(row_id, key, date).join(small(active), [key, date], "left").drop(date).unionByName(undated)
    return found.select(row_id, F.coalesce("n_active", F.lit(0)).alias("n_active"), F.when(F.col("n_active") == 1, F.col("person")).alias("person"))


def cascade(rows: DataFrame, row_id: str, lookups: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """The first lookup that knows the row: (method, table of (key, hit), key of the rows), in order."""
    out = rows
    for method, known, key in lookups:
        first = known.groupBy("key").agg(F.min("hit").alias(f"_{method}")).withColumnRenamed("key", key)
        out = out.join(first, key, "left")
    hits = [F.col(f"_{m}") for m, _, _ in lookups]
    method = F.coalesce(*[F.when(h.isNotNull(), F.lit(m)) for h, (m, _, _) in zip(hits, lookups, strict=True)], F.lit("none"))
    return out.select(row_id, F.coalesce(*hits).alias("hit"), method.alias("method"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; the new one wins."""
    rest = [c for c in old.columns if c != key]
    there = F.col("n._there").isNotNull()
    both = old.alias("o").join(new.withColumn("_there", F.lit(1)).alias("n"), key, "full_outer")
    return both.select(key, *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def latest_of(changes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key in an explicit order; rows with a blank key count for nothing."""
    named = changes.withColumn(key, F.trim(F.col(key).cast("string"))).where(F.col(key) != "")
    rest = [c for c in changes.columns if c != key]
    return named.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def override(rows: DataFrame, changes: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Replace the columns that changes has wherever it names the key, even by blanks.

    Of several changes of a key the last one counts: in `order`, or by their values where none is given.
    """
    new = [c for c in changes.columns if c in rows.columns and c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*new), F.struct(*(order or new))).alias("_last"))
    side = small(last.select(key, F.col("_last").alias("_new"), F.lit(True).alias("_matched")))
    joined = rows.join(side, key, "left")
    return joined.select(*[F.when(F.col("_matched"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def upper_median(c: str) -> Column:
    """Of an even number of values, the larger of the middle two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def accuracy(df: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, gold: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn over the labels seen, or over given ones."""
    right, wrong, none = (F.col(gold) == F.col(predicted)).cast("int"), (F.col(gold) != F.col(predicted)).cast("int"), F.lit(0)
    side = lambda label, tp, fp, fn: F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    sides = df.select(F.explode(F.array(side(gold, right, none, wrong), side(predicted, none, wrong, none))).alias("s")).select("s.*")
    counts = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if labels is not None:
        counts = labels.join(counts, "label", "left").fillna(0, ["tp", "fp", "fn"])
    return counts


def macro_f1(df: DataFrame, gold: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return class_counts(df, gold, predicted, labels).agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation (null under three rows or without variance) and the share of equal signs."""
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0) | (F.count(F.lit(1)) < 3)
    return df.agg(F.when(~flat, F.corr(x, y)).alias("r"), F.avg(((F.col(x) > 0) == (F.col(y) > 0)).cast("double")).alias("same_sign"))


def presence(df: DataFrame, fields: Sequence[str], by: str) -> DataFrame:
    """Non-blank values of each field by group and in all (group null)."""
    counts = df.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.trim(F.col(f)) != "").alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields]))
    return counts.select(by, "n", pairs.alias("p")).select(by, "p.field", "p.present", (F.col("n") - F.col("p.present")).alias("missing"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    A session on one machine that names none gets one in its working directory; a cluster without one is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or os.path.abspath("spark-checkpoints")).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of (a, b) pairs, by hooking to the least neighbour and pointer jumping.

    Labels only fall, so the loop ends; lineage is cut each round. A node's neighbours are never gathered.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(near, label.node == near.a).select("node", "component", F.least("component", "near").alias("up"))
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        after = hooked.join(jump, "up", "left").select("node", F.least("up", F.coalesce("upper", "up")).alias("to"), "component")
        after = cut_lineage(after.select("node", F.col("to").alias("component"), (F.col("to") != F.col("component")).alias("moved")))
        label = after.select("node", "component")
        if after.where("moved").isEmpty():
            return label
