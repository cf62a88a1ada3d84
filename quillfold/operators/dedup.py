"""Deduplication of opinions in a fixed order of steps; every dropped row is logged with its reason.

1. Pages that compare two files are stripped to the opinion inside. 2. Such a page goes if a plain row of its case is near.
3. Junk, excluded rows, separate writings and identical texts go. 4. Amended versions go. 5. Near-duplicates
that a shared docket, question, database id, day or author points at become components, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.functions.columns import norm_name_spaced
from quillfold.functions.names import caption_words, dockets
from quillfold.functions.opinions import is_compare_page, junk_reason, strip_compare_page
from quillfold.operators.relational import components, cut_lineage, small
from quillfold.operators.revisions import GAP_DAYS, SAME, amended_pairs, drop_superseded
from quillfold.operators.similarity import PLAIN, entry, similar_pairs

# Fixed values.
AUTHOR_DAYS, SAME_CASE = 365, 0.2
LOG = ["jurisdiction", "cluster_id", "case_name", "date_filed", "reason", "kept_cluster_id", "similarity"]


def _logged(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: cluster_id, reason, kept_cluster_id, similarity (a number or null)."""
    shown = F.coalesce(F.format_string("%.2f", F.bround(F.col("similarity").cast("decimal(20,16)"), 2).cast("double")), F.lit(""))
    named = rows.select("jurisdiction", "cluster_id", "case_name", "date_filed").join(gone, "cluster_id")
    kept = F.coalesce(F.col("kept_cluster_id").cast("string"), F.lit(""))
    return named.select("jurisdiction", "cluster_id", "case_name", "date_filed", "reason", kept.alias("kept_cluster_id"), F.when(F.col("similarity").isNull(), "").otherwise(shown).alias("similarity"))


def compare_twins(rows: DataFrame) -> DataFrame:
    """Of pages that compare (`compared`), those with a plain row of the same court and name within GAP_DAYS: the first such row stays.

    Plain rows are summed up by day first, so a row meets at most one for each day of the span.
    """
    key = ["jurisdiction", "name"]
    days = rows.where("NOT compared").groupBy(*key, F.col("filed").alias("day")).agg(F.min(F.struct("_ord", "cluster_id")).alias("first"))
    near = rows.where("compared").select("cluster_id", *key, "filed").join(days, key).where(F.abs(F.date_diff("filed", "day")) <= GAP_DAYS)
    return near.groupBy("cluster_id").agg(F.min("first").alias("first")).select("cluster_id", F.lit("compare_page_copy").alias("reason"), F.col("first.cluster_id").alias("kept_cluster_id"), F.lit(None).cast("double").alias("similarity"))


def junk_and_exact(rows: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows that are no majority opinions, and all but the latest (then largest id) of identical texts; blank texts are all identical."""
    text = F.coalesce("opinion_text", F.lit(""))
    marked = rows.select("cluster_id", "filed", F.sha2(text, 256).alias("digest"), junk_reason(text).alias("why"))
    if excluded is None:
        wrong = F.lit(False)
    else:
        marked = marked.join(excluded.select("cluster_id", F.lit(True).alias("wrong")).distinct(), "cluster_id", "left")
        wrong = F.coalesce("wrong", F.lit(False))
    marked = marked.withColumn("reason", F.when(F.col("why") == "junk", "junk").when(wrong, "wrong_court").otherwise(F.col("why")))
    plain = marked.where("reason IS NULL")
    latest = plain.groupBy("digest").agg(F.max_by("cluster_id", F.struct("filed", "cluster_id")).alias("kept"))
    same = plain.join(latest, "digest").where("cluster_id <> kept").select("cluster_id", F.lit("exact_duplicate").alias("reason"), F.col("kept").alias("kept_cluster_id"), F.lit(1.0).alias("similarity"))
    other = marked.where("reason IS NOT NULL").select("cluster_id", "reason", F.lit(None).cast("long").alias("kept_cluster_id"), F.lit(None).cast("double").alias("similarity"))
    return other.unionByName(same)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those gone (cluster_id), which are few columns held once: texts stay where they lie unless very many rows go."""
    return rows.join(small(gone.select("cluster_id")), "cluster_id", "left_anti")


def amended(rows: DataFrame) -> DataFrame:
    pairs = amended_pairs(rows.select(F.col("cluster_id").alias("id"), F.col("jurisdiction").alias("court"), "name", "filed", F.col("opinion_text").alias("text")))
    return drop_superseded(pairs).select(F.col("older").alias("cluster_id"), "reason", F.col("newer").alias("kept_cluster_id"), "similarity")


def blocks(rows: DataFrame) -> DataFrame:
    """id, court, why, key, least, filed and words: under which keys a row may meet others of its court."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    supreme = F.col("jurisdiction") == "SCOTUS"
    entry = lambda why, key, least: F.struct(F.lit(why).alias("why"), key.alias("key"), F.lit(least).alias("least"))
    of_dockets = F.transform(dockets(F.col("opinion_text")), lambda d: entry("docket", d, SAME))
    others = F.array(
        F.when(text("issue_text") != "", entry("issue_text", text("issue_text"), SAME)),
        F.when(supreme & (text("scdb_id") != ""), entry("scdb", text("scdb_id"), SAME_CASE)),
        F.when(supreme, entry("day", F.col("filed").cast("string"), SAME_CASE)),
        F.when(F.trim(text("author_str")) != "", entry("author", F.lower(F.trim(text("author_str"))), SAME)),
    )
    entries = F.explode(F.concat(of_dockets, F.filter(others, lambda e: e.isNotNull()))).alias("e")
    return rows.select(F.col("cluster_id").alias("id"), F.col("jurisdiction").alias("court"), "filed", caption_words(F.col("case_name")).alias("words"), entries).select("id", "court", "e.*", "filed", "words")


def near_pairs(rows: DataFrame) -> DataFrame:
    """a, b, court, why, key, similarity: near-duplicates under one of the five rules. The index is one for each court: its shingles stand in it once, whatever blocks a row is in."""
    least = F.when(F.col("jurisdiction") == "SCOTUS", SAME_CASE).otherwise(SAME)
    texts = rows.select(F.col("cluster_id").alias("id"), F.lower("opinion_text").alias("text"), F.array(entry(F.xxhash64("jurisdiction"), least, least)).alias("e"))
    one_word = F.arrays_overlap("a_words", "b_words")
    close = F.abs(F.date_diff("a_filed", "b_filed")) <= AUTHOR_DAYS
    may = F.when(F.col("why") == "day", one_word).when(F.col("why") == "author", one_word & close).otherwise(True)
    keyed = blocks(rows).withColumn("key", F.when(F.length("key") > 64, F.sha2("key", 256)).otherwise(F.col("key")))
    return similar_pairs(texts, keyed, ["court", "why", "key"], may, PLAIN)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """All but one row of each component: a Supreme Court case keeps its longest text that is no slip opinion, others the latest, then longest; ties the smallest id."""
    pairs = cut_lineage(near_pairs(rows).select("a", "b", "similarity").distinct())
    parts = components(pairs.select("a", "b"))
    size, slip = F.length(F.coalesce("opinion_text", F.lit(""))), F.coalesce(F.col("opinion_text").startswith("(Slip Opinion)"), F.lit(False))
    supreme = F.col("jurisdiction") == "SCOTUS"
    worth = F.struct(F.when(supreme, (~slip).cast("string")).otherwise(F.col("filed").cast("string")).alias("first"), size.alias("size"), (-F.col("cluster_id")).alias("id"))
    members = parts.join(rows.select(F.col("cluster_id").alias("node"), worth.alias("worth")), "node")
    best = members.groupBy("component").agg(F.max_by("node", "worth").alias("kept"))
    gone = members.join(best, "component").where("node <> kept").select(F.least("node", "kept").alias("a"), F.greatest("node", "kept").alias("b"), "node", "kept")
    return gone.join(pairs, ["a", "b"], "left").select(F.col("node").alias("cluster_id"), F.lit("near_duplicate").alias("reason"), F.col("kept").alias("kept_cluster_id"), "similarity")


def dedupe(rows: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, log of those dropped).

    rows: jurisdiction, cluster_id, case_name, date_filed (ISO), opinion_text, author_str, issue_text, scdb_id, and whatever
    else is to be carried; `_ord` is their order in the file, the id where it is missing. excluded: cluster_id of rows that are of another court.
    """
    own = rows.columns
    work = rows.withColumn("cluster_id", F.col("cluster_id").cast("long")).withColumn("compared", is_compare_page(F.col("opinion_text")))
    work = work if "_ord" in own else work.withColumn("_ord", F.col("cluster_id"))
    work = work.withColumn("opinion_text", strip_compare_page(F.col("opinion_text"))).withColumn("name", norm_name_spaced(F.col("case_name"))).withColumn("filed", F.to_date("date_filed"))
    log = None
    for step in (compare_twins, lambda w: junk_and_exact(w, excluded), amended, near_duplicates):
        gone = cut_lineage(step(work))
        new = _logged(work, gone)
        log = new if log is None else log.unionByName(new)
        work = without(work, gone)
    return work.select(*own), log


def in_order(rows: DataFrame) -> DataFrame:
    """By court, date as text, and id as a number."""
    return rows.orderBy("jurisdiction", "date_filed", F.col("cluster_id").cast("long"))
