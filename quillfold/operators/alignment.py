"""Whether texts' vectors lie where their court and their judge's views put them: centroids of the training split, cosine to the nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.operators.relational import beside

#: Where the classes stand.
POSITIONS = {"Liberal": -1.0, "Moderate": 0.0, "Conservative": 1.0}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return F.try_divide(dot, F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x))))


def centroids(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """by and centroid: the mean of each component; components are summed where the rows lie, so that a task passes on a row for each group and component."""
    parts = rows.where(F.col(vector).isNotNull()).select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"))
    means = parts.groupBy(*by, "k").agg(F.avg("x").alias("m"))
    return means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c")).select(*by, F.transform("c", lambda p: p["m"]).alias("centroid"))


def _nearest(scored: Column) -> Column:
    """Of (score, name) the highest score, then the first name."""
    return F.element_at(F.array_sort(F.transform(scored, lambda s: F.struct((-s["score"]).alias("least"), s["name"].alias("name"), s["score"].alias("score")))), 1)


def style_alignment(rows: DataFrame, training: DataFrame, court: str, vector: str) -> DataFrame:
    """rows with csa (cosine to the centroid of the own court, null if training has none), nearest_court and csa_right.

    The centroids, one for each court, go to every task in one row.
    """
    known = centroids(training.where(F.col(court).isNotNull()), vector, court).agg(F.collect_list(F.struct(F.col(court).alias("name"), "centroid")).alias("_courts"))
    v = F.col(vector).cast("array<double>")
    scored = F.transform("_courts", lambda c: F.struct(c["name"].alias("name"), cosine(v, c["centroid"]).alias("score")))
    own = F.get(F.filter("_scored", lambda s: s["name"] == F.col(court)), F.lit(0))
    found = beside(rows, known).withColumn("_scored", F.filter(scored, lambda s: s["score"].isNotNull())).withColumn("_best", F.when(F.size("_scored") > 0, _nearest(F.col("_scored"))))
    return found.select(*rows.columns, own["score"].alias("csa"), F.col("_best.name").alias("nearest_court"), (F.col("_best.name") == F.col(court)).alias("csa_right"))


def ideology_alignment(rows: DataFrame, training: DataFrame, court: str, ideology: str, vector: str) -> DataFrame:
    """Of rows with a known class: nearest_class among the classes of the own court and ia, the cosine to it, less the further it stands from the own class."""
    named = F.col(ideology).isin(list(POSITIONS))
    known = centroids(training.where(named & F.col(court).isNotNull()), vector, court, ideology).groupBy(court).agg(F.collect_list(F.struct(F.col(ideology).alias("name"), "centroid")).alias("_classes"))
    v = F.col(vector).cast("array<double>")
    scored = F.transform("_classes", lambda c: F.struct(c["name"].alias("name"), cosine(v, c["centroid"]).alias("score")))
    found = rows.where(named).join(F.broadcast(known), court).withColumn("_scored", F.filter(scored, lambda s: s["score"].isNotNull())).where(F.size("_scored") > 0).withColumn("_best", _nearest(F.col("_scored")))
    at = lambda c: F.try_element_at(F.create_map(*[F.lit(x) for p in POSITIONS.items() for x in p]), c)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(at(F.col(ideology)) - at(F.col("_best.name"))) / 2)
    return found.select(*rows.columns, F.col("_best.name").alias("nearest_class"), (F.col("_best.score") * weight).alias("ia"))
