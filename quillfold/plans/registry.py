"""All queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.columns import word_count
from quillfold.plans import cases, catalog, dedup, enrich, files, literals, metrics, steps

MODULES = (catalog, literals, enrich, cases, dedup, files, steps, metrics)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least 20 words, latest of each identical text, counted by source.

    Identical texts meet by a digest: the texts themselves are not shuffled.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    long = docs.where(word_count(F.col("text")) >= 20).select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    latest = long.groupBy("digest").agg(F.max_by("source", "doc_id").alias("source"))
    return latest.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


FLAGSHIP = """
WITH kept AS (
  SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents
  WHERE len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) >= 20
) SELECT source, count(*) AS n_docs FROM kept WHERE rn = 1 GROUP BY source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship_sources": flagship} | {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {"flagship_sources": FLAGSHIP} | {k: v for m in MODULES for k, v in m.ORACLES.items()}
