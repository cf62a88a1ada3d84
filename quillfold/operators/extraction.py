"""The boundary to language models: they are plugged in, called in batches, and their answers are cleaned here.

An extractor takes a text and returns JSON text. It runs in mapInPandas, with attempts and a linear wait; a text
that still fails gets blanks, so one bad answer costs one row. `stub` answers without a model, for tests and dry runs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.functions.columns import DISPOSITIONS, PARTIES, clamp_enum, head_and_tail, tolerant_json
from quillfold.operators.relational import cut_lineage, latest_of
from quillfold.operators.reports import pending

ANSWER = "issue_text string, facts string, disposition string, prevailing_party string"
FIELDS = ["issue_text", "issue_text_source", "facts", "facts_source", "disposition", "prevailing_party", "outcome_source"]


def stub(body: str) -> str:
    """An answer that depends on the text alone."""
    words = body.split()
    outcome = next((d for d in DISPOSITIONS if d.replace("_", " ") in body.lower()), "unclear")
    return json.dumps({"issue_text": " ".join(words[:12]), "facts": " ".join(words[12:40]), "disposition": outcome, "prevailing_party": "unclear"})


def ask(rows: DataFrame, row_id: str, body: str, extractor: Callable[[str], str], attempts: int = 4, wait: float = 1.0, threads: int = 8) -> DataFrame:
    """row_id and answer (text, null where every attempt failed) for each row; a task has `threads` questions open at a time, each waiting for itself."""
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> str | None:
            for attempt in range(attempts):
                try:
                    return extractor(text or "")
                except Exception:  # any failure of the service is worth another attempt
                    time.sleep(wait * (attempt + 1) if attempt + 1 < attempts else 0)
            return None

        with ThreadPoolExecutor(threads) as pool:
            for part in batches:
                yield pd.DataFrame({row_id: part[row_id], "answer": list(pool.map(one, part[body]))})

    return rows.select(row_id, body).mapInPandas(run, f"`{row_id}` {kind}, answer string")


def apply_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows with FIELDS filled from answers (cluster_id, answer); unknown outcomes become `other`, missing ones `unclear`."""
    said = answers.where("answer IS NOT NULL").select("cluster_id", tolerant_json(F.col("answer"), ANSWER).alias("r"))
    text = lambda c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit("")))
    party = clamp_enum(F.col("r.prevailing_party"), PARTIES, "unclear")
    new = {
        "issue_text": text("issue_text"),
        "issue_text_source": F.when(text("issue_text") != "", "llm_extract").otherwise(""),
        "facts": text("facts"),
        "facts_source": F.when(text("facts") != "", "llm_extract").otherwise(""),
        "disposition": clamp_enum(F.col("r.disposition"), DISPOSITIONS, "other"),
        "prevailing_party": party,
        "outcome_source": F.lit("llm_extract"),
    }
    joined = rows.join(said, "cluster_id", "left")
    old = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return joined.select(*[c for c in rows.columns if c not in FIELDS], *[F.when(F.col("r").isNotNull(), v).otherwise(old(c)).alias(c) for c, v in new.items()])


def enrich_fields(rows: DataFrame, extractor: Callable[[str], str] = stub, cache: DataFrame | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with their fields, the new answers to append to the cache): only rows that lack fields and have no cached answer are asked.

    Answers are written down as they come back, so that both results read them and nothing is asked twice.
    """
    open_ = pending(rows.select("cluster_id", "opinion_text", *[c if c in rows.columns else F.lit("").alias(c) for c in ("issue_text", "facts")]))
    if cache is not None:
        open_ = open_.join(cache.select("cluster_id"), "cluster_id", "left_anti")
    open_ = open_.orderBy("cluster_id").limit(limit) if limit else open_
    asked = cut_lineage(ask(open_.withColumn("body", head_and_tail(F.coalesce("opinion_text", F.lit("")))), "cluster_id", "body", extractor))
    known = asked if cache is None else asked.unionByName(cache.select("cluster_id", "answer"))
    return apply_answers(rows, known.dropDuplicates(["cluster_id"])), asked


def latest_answers(cache: DataFrame, order: str) -> DataFrame:
    """Of an append-only cache the last answer of each id."""
    return latest_of(cache, "id", [F.col(order)])
