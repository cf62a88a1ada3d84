"""A training corpus in five stages, each an operator of quillfold.llm over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage's result is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import bpe, jaccard, mixing, repeats, toxicity
from quillfold.llm.common import materialise, table, text_batches
from quillfold.llm.queries import public_ranks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic, each judged by its own text, with an id or without."""
    docs = text_batches(docs)
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number for each row in the order of the ids, nulls last: the id itself where no id is null or repeated."""
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("_row")).count().where("_row IS NULL OR count > 1").isEmpty():
        return docs.withColumn("_row", own)
    return materialise(docs.orderBy(own.asc_nulls_last(), F.xxhash64("text"), F.rand(0)).withColumn("_row", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: the smallest id. Rows of one id, or without one, are documents of their own and link by their texts."""
    rows = _numbered(text_batches(docs))
    gone = materialise(jaccard.join_documents(rows.select(F.col("_row").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_row")))
    # Ids alone decide, so texts stay where they are as long as the ids fit a broadcast.
    side = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_IDS else gone
    return rows.join(side, "_row", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated bytes (a character cut in two goes), and n_chars to match.

    Null and empty texts stay as they are, as do rows without an id; repeated rows are treated alike; an empty table gives none.
    """
    kept = repeats.remove_repeats(text_batches(docs), as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))}
    return kept.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal weight, in random order.

    A null source is one of its own; a null or empty text counts as one character; repeated rows are drawn each by itself.
    """
    return mixing.replicate(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digests of each document of the mix; a null or empty text has no tokens, repeated rows each come back."""
    ranks, pattern = public_ranks()
    return bpe.encode_documents(text_batches(docs), ranks, pattern, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express training, exact byte repeats or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
