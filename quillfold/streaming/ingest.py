"""One-pass bulk reading as a stream: our extension, the corpus steps themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.sources.readers import exists

#: Parts of one level of a log that are merged into one of the next.
FAN = 8
#: The column of a log's parts that tells which batch a row came with.
BATCH = "_batch"


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and value by window and type, with a watermark for late rows; batch frames count alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def ingest_once(spark: SparkSession, folder: str, out: str, checkpoint: str, key: str) -> None:
    """Append the rows whose key is new; one row of each key, whatever arrives again. Runs until what the folder holds now is read; a restart goes on.

    The keys seen so far are the stream's state, kept by key in the checkpoint: a batch touches its own keys and never reads `out`,
    which the sink commits by batch. Rows without a key are left out. `out` and `checkpoint` belong together.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    source = session.readStream.schema(session.read.parquet(folder).schema).parquet(folder)
    fresh = source.where(F.col(key).isNotNull()).dropDuplicates([key])
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulate_log(spark: SparkSession, folder: str, out: str, checkpoint: str, key: str) -> None:
    """Upsert what the folder holds, batch by batch, into a log whose later batches win; rows without a key are left out.

    A batch is written by itself and reads nothing of the log. Of FAN parts of one level, one of the next is made, superseded
    rows left out, and then the parts go: a row is written again for each level at most, and levels grow with the logarithm of the log.
    """

    def append(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in batch.columns if c != key])).alias("r"))
        new.select(key, "r.*", F.lit(number).cast("long").alias(BATCH)).write.mode("overwrite").parquet(f"{out}/level=0/{number:012d}")
        compact(spark, out, key)

    schema = spark.read.parquet(folder).schema
    source = spark.readStream.schema(schema).parquet(folder)
    source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start().awaitTermination()


def _parts(spark: SparkSession, out: str) -> dict[int, list[str]]:
    """The complete parts of a log by level, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[str]] = {}
    for level in files.listStatus(path) if files.exists(path) else []:
        if level.getPath().getName().startswith("level="):
            paths = sorted(p.getPath().toString() for p in files.listStatus(level.getPath()))
            found[int(level.getPath().getName().removeprefix("level="))] = [p for p in paths if exists(spark, f"{p}/_SUCCESS")]
    return found


def _latest(parts: DataFrame, key: str) -> DataFrame:
    rest = [c for c in parts.columns if c not in (key, BATCH)]
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest, BATCH), F.struct(BATCH, *rest)).alias("r")).select(key, "r.*")


def compact(spark: SparkSession, out: str, key: str) -> None:
    """Merge the parts of each level that has FAN of them. Stopped in between, the log reads the same: a merged part repeats rows, later batches still win."""
    level = 0
    while len(parts := _parts(spark, out).get(level, [])) >= FAN:
        name = parts[-1].rsplit("/", 1)[1]
        _latest(spark.read.parquet(*parts), key).write.mode("overwrite").parquet(f"{out}/level={level + 1}/{name}")
        for p in parts:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        level += 1


def read_log(spark: SparkSession, out: str, key: str) -> DataFrame | None:
    """The last row of each key of an accumulated log; null without one."""
    parts = [p for of_level in _parts(spark, out).values() for p in of_level]
    return _latest(spark.read.parquet(*parts), key).drop(BATCH) if parts else None
