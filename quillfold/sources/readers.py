"""Sources and sinks: two CSV dialects, JSON lines, optional inputs; everything is text at rest."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Asked through Spark, so that it works wherever Spark reads."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def encodings(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """For each file UTF-8 if all of it is that, else Latin-1. Executors look at whole files, split where they can be; a row for each file comes back."""
    lines = spark.read.option("lineSep", "\n").text(path)
    by_file = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    return {unquote(r["file"]): "UTF-8" if r["valid"] else "ISO-8859-1" for r in by_file.collect()}


def file_order() -> Column:
    """Of rows as they are read: a value that rises in the order of the file, for the rules by which the first or last row wins.

    Rows of a file's split lie in one task in their order; which task that is does not follow the files, so file and split come first.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, backslash: bool = False, encoding: str = "UTF-8", header: bool = True, order: str | None = None) -> DataFrame:
    """A CSV file, compressed or not by its suffix; quotes are doubled, or with `backslash` escaped. `order` names a file_order column.

    Fields may be of any length and hold line breaks; a missing field is an empty one; a byte order mark is dropped. Each file is
    one task, so large ones are for bulk.read_bulk_csv.
    """
    reader = spark.read.option("header", header).option("multiLine", True).option("maxCharsPerColumn", -1).option("encoding", encoding)
    reader = reader.option("quote", '"').option("escape", "\\" if backslash else '"')
    df = (reader.schema(text_schema(columns)) if columns else reader).csv(path)
    fields = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.removeprefix("﻿")) for c in df.columns]
    return df.select(*fields, *([file_order().alias(order)] if order else []))


def read_any_encoding(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Each file in its own encoding."""
    found, out = encodings(spark, path), None
    for encoding in sorted(set(found.values())) or ["UTF-8"]:
        part = read_csv(spark, [f for f, e in found.items() if e == encoding] or path, encoding=encoding, **options)
        out = part if out is None else out.unionByName(part)
    return out


def read_optional(spark: SparkSession, path: str, columns: Sequence[str], **options) -> DataFrame:
    """An empty table where the file is missing."""
    if exists(spark, path):
        return read_csv(spark, path, columns, **options)
    none = spark.createDataFrame([], text_schema(columns))
    return none.withColumn(options["order"], F.lit(None)) if options.get("order") else none


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """One JSON document for each line; blank lines are no rows."""
    df = spark.read.schema(schema).json(path)
    return df.limit(limit) if limit else df


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document for each file of a folder, named by it; unreadable ones are skipped."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).withColumn("name", name)


def unpivot_slots(df: DataFrame, keys: Sequence[str], slots: Sequence[int], fields: Sequence[str]) -> DataFrame:
    """Wide slots `field (k)` to one row for each filled slot."""
    entry = lambda k: F.struct(F.lit(k).alias("slot"), *[F.col(f"`{f} ({k})`").alias(f) for f in fields])
    rows = df.select(*keys, F.explode(F.array(*[entry(k) for k in slots])).alias("e")).select(*keys, "e.*")
    return rows.where(F.coalesce(*[F.when(F.trim(F.col(f"`{f}`")) != "", F.lit(True)) for f in fields], F.lit(False)))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Only the named columns, in that order; quotes are doubled."""
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A stage's rows as Parquet in a folder of its own, read back: no stage writes over what it reads, and a rerun replaces its own output whole."""
    path = f"{folder.rstrip('/')}/stage={stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Append answers as they come; each task's file is committed whole or not at all."""
    df.write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
