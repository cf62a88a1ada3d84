"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir.

    A session on one machine that names none gets one in its working directory; a cluster without one is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or os.path.abspath("spark-checkpoints")).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillfold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    path = getattr(df, "_quillfold_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a batch that goes to a Python worker, at most: with long texts a batch is what a worker and its buffers hold at once.
BATCH_ROWS = 2_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """df; its session sends BATCH_ROWS rows at a time to Python workers, or as many as it was set to where that is fewer."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def crc32_mod(column, modulus: int):
    """crc32 of an id written as text, modulo a number of folds."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of these is, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranged(df: DataFrame, group: str, *order) -> DataFrame:
    """df in the order of group and `order`, with `_at`, a number that rises in it, and `_range`, the range a row is in.

    Rows are dealt by ranges of both, so a group of any size is spread over tasks.
    """
    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_at", F.monotonically_increasing_id())
    return materialise(dealt.withColumn("_range", F.shiftright("_at", 33)))


def carried(rows: DataFrame, group: str, *sums) -> DataFrame:
    """group, _range and for each aggregate (name, column of each range, how ranges add up) what all earlier ranges of the group give."""
    whole = rows.groupBy(group, "_range").agg(*[each.alias(name) for name, each, _ in sums])
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    return whole.select(F.col(group).alias("_group"), F.col("_range").alias("_in"), *[add(name).over(earlier).alias(f"_{name}") for name, _, add in sums])


def with_places(df: DataFrame, group: str, name: str, *order, kind: str = "int") -> DataFrame:
    """df with the place of each row in its group, from 1; groups may be of any size and none is gathered."""
    rows = ranged(df, group, *order)
    first = rows.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"))
    before = carried(rows, group, ("n", F.count(F.lit(1)), F.sum)).join(first, ["_group", "_in"])
    here = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_in"))
    place = (F.col("_at") - F.col("_first") + F.coalesce("_n", F.lit(0)) + 1).cast(kind)
    return rows.join(before, here, "left").select(*df.columns, place.alias(name))
