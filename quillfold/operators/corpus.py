"""From bulk court data to one row for each case: filter, choice of text, split by kind of opinion, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.functions.opinions import CONCURRENCE, DISSENT, IN_PART, split_writings
from quillfold.operators.relational import keep_first, latest_of, small, top_k, upsert

# Text fields in order of preference, types of opinions, and the columns of the result.
TEXT_FIELDS = ["html_with_citations", "html_columbia", "html_lawbox", "html_anon_2020", "html", "plain_text", "xml_harvard"]
LEAD, COMBINED, FALLBACKS = "020lead", "010combined", ["025plurality", "015unamimous"]
BASE = ["jurisdiction", "court_id", "cluster_id", "case_name", "date_filed", "court", "judge_name", "judge_id", "syllabus", "opinion_text", "issue_area", "issue_area_source"]
LABELS = {"scotus": "SCOTUS", "ca5": "CA5", "ca9": "CA9"}


def known(df: DataFrame, *names: str) -> Column:
    """The first non-empty of those columns that the table has."""
    return C.first_non_empty(*[F.col(c) for c in names if c in df.columns])


def best_text(df: DataFrame) -> Column:
    """The first text field that is not blank, without its tags; plain text as it is."""
    trim = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    one = lambda f: trim(F.col(f)) if f == "plain_text" else C.strip_html(F.col(f))
    return F.coalesce(*[F.when(one(f) != "", one(f)) for f in TEXT_FIELDS if f in df.columns], F.lit(""))


def bulk_filter(dockets: DataFrame, clusters: DataFrame, opinions: DataFrame, order: str, courts: list[str] = ["scotus", "ca5", "ca9"], after: str = "2013", before: str = "2024", most: int = 6000, least_words: int = 500) -> DataFrame:  # noqa: B006
    """The base table: published cases of the courts and years, the newest `most` of each court (0: all), with their best opinion.

    Years compare as text, and rows without a year pass. The best opinion has the least priority number, then stands first
    in `order`, among those with a text; only then are unsigned and short ones dropped.
    """
    bench = dockets.select(known(dockets, "id", "docket_id").alias("_docket"), known(dockets, "court_id", "court").alias("_court")).where(F.col("_court").isin(courts))
    status, filed = known(clusters, "precedential_status"), known(clusters, "date_filed", "date_created")
    y = F.coalesce(C.year(filed), F.lit(""))
    cases = clusters.select(known(clusters, "id", "cluster_id").alias("cluster_id"), known(clusters, "docket_id", "docket").alias("_docket"), known(clusters, "case_name", "case_name_full", "case_name_short").alias("case_name"), filed.alias("date_filed"), known(clusters, "judges").alias("_judges"), known(clusters, "headnotes", "syllabus", "summary").alias("syllabus"), F.col(order).alias("_at"), status.alias("_status"), y.alias("_y"))
    cases = cases.where((F.col("_status") == "") | (F.lower("_status") == "published")).where((F.col("_y") == "") | F.col("_y").between(after[:4], before[:4]))
    cases = top_k(cases.join(small(bench), "_docket"), ["_court"], [F.desc("date_filed"), F.asc("_at")], most).drop("_at", "_status", "_y", "_docket")
    texts = opinions.select(known(opinions, "cluster_id", "cluster").alias("cluster_id"), C.type_priority(known(opinions, "type")).alias("_priority"), best_text(opinions).alias("opinion_text"), known(opinions, "author_str").alias("_author"), C.is_true(known(opinions, "per_curiam")).alias("_unsigned"), F.col(order).alias("_at"))
    best = keep_first(texts.where("opinion_text <> ''").join(cases.select("cluster_id"), "cluster_id", "left_semi"), ["cluster_id"], [F.col("_priority"), F.col("_at")])
    best = best.where("NOT _unsigned").where(C.word_count(F.col("opinion_text")) >= least_words)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.col("_court")), F.upper("_court"))
    judge = F.when(F.col("_judges") != "", F.col("_judges")).otherwise(F.col("_author"))
    joined = best.join(cases, "cluster_id").withColumns({"jurisdiction": label, "court_id": F.col("_court"), "court": F.col("_court"), "judge_name": judge, "judge_id": F.lit(""), "issue_area": F.lit(""), "issue_area_source": F.lit("")})
    return joined.select(*BASE)


def opinions_by_case(opinions: DataFrame, wanted: DataFrame) -> DataFrame:
    """cluster_id and its opinions (id, type, author_str, text), of the wanted cases, sorted by number of the id."""
    rows = opinions.select(F.trim(F.col("cluster_id").cast("string")).alias("cluster_id"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("author_str", F.lit("")).alias("author_str"), best_text(opinions).alias("text"))
    rows = rows.where("text <> ''").join(wanted.select(F.col("cluster_id").cast("string").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    entry = F.struct(C.numeric_id(F.col("id")).alias("n"), "id", "type", "author_str", "text")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("o")).select("cluster_id", F.transform("o", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["author_str"].alias("author_str"), x["text"].alias("text"))).alias("opinions"))


def write_dump(dump: DataFrame, path: str) -> None:
    dump.write.mode("errorifexists").option("compression", "gzip").json(path)


def read_dump(spark, path: str, wanted: DataFrame) -> DataFrame:
    """The dump's rows of the wanted cases; other lines are not parsed into texts that nobody asked for."""
    schema = "cluster_id string, opinions array<struct<id:string,type:string,author_str:string,text:string>>"
    return spark.read.schema(schema).json(path).join(wanted.select(F.col("cluster_id").cast("string").alias("cluster_id")).distinct(), "cluster_id", "left_semi")


def joined_texts(items: Column) -> Column:
    """Texts of (key, text) in order of their keys, parted by an empty line; empty ones are skipped."""
    return F.array_join(F.transform(F.filter(F.array_sort(items), lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n")


def split_by_type(rows: DataFrame, dump: DataFrame, fallback: bool = False, in_part: str = "ignore", cut_text: bool = False) -> DataFrame:
    """rows with opinion_text, dissent_text, concurrence_text, combined_only and split_method.

    The majority is the lead opinion, else (with `fallback`) a plurality or unanimous one, else the combined text, which
    `cut_text` takes apart at its headings where that is safe; without any the old text stays. Opinions that concur in part go to
    `in_part` (concurrence, dissent, or ignore: they are left out). Typed writings sort by number of id, cut ones by place.
    """
    own = [c for c in rows.columns if c not in ("opinion_text", "dissent_text", "concurrence_text", "combined_only", "split_method")]
    keyed = rows.withColumn("_id", F.col("cluster_id").cast("string")).join(dump.select(F.col("cluster_id").alias("_id"), "opinions"), "_id", "left").drop("_id")
    items = F.transform("opinions", lambda o: F.struct(o["type"].alias("type"), C.numeric_id(o["id"]).alias("key"), o["text"].alias("text")))
    of_types = lambda all_, types: F.transform(F.filter(all_, lambda o: o["type"].isin(types)), lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text")))
    staged = keyed.withColumn("_all", F.coalesce(items, F.array().cast("array<struct<type:string,key:bigint,text:string>>")))
    lead = lambda t: F.when(F.exists("_all", lambda o: o["type"] == t), F.lit(t))
    staged = staged.withColumn("_lead", F.coalesce(*[lead(t) for t in [LEAD, *(FALLBACKS if fallback else [])]], F.lit(""))).withColumn("_combined", joined_texts(of_types(F.col("_all"), [COMBINED])))
    has_combined = F.exists("_all", lambda o: o["type"] == COMBINED) & (F.col("_lead") == "")
    parts = split_writings(F.col("_combined")) if cut_text else F.lit(None).cast("struct<majority:string,parts:array<struct<pos:int,type:string,text:string>>>")
    staged = staged.withColumn("_cut", F.when(has_combined, parts))
    from_text = F.coalesce(F.transform("_cut.parts", lambda p: F.struct(p["type"].alias("type"), p["pos"].cast("long").alias("key"), p["text"].alias("text"))), F.array().cast("array<struct<type:string,key:bigint,text:string>>"))
    everything = F.concat("_all", from_text)
    con = [CONCURRENCE, *([IN_PART] if in_part == "concurrence" else [])]
    dis = [DISSENT, *([IN_PART] if in_part == "dissent" else [])]
    none, typed, cut = F.size("_all") == 0, F.col("_lead") != "", F.col("_cut").isNotNull()
    text = F.when(typed, joined_texts(of_types(F.col("_all"), [F.col("_lead")]))).when(cut, F.col("_cut.majority")).when(has_combined, F.col("_combined")).otherwise(F.col("opinion_text"))
    return staged.select(
        *own,
        text.alias("opinion_text"),
        F.when(none, "").otherwise(joined_texts(of_types(everything, dis))).alias("dissent_text"),
        F.when(none, "").otherwise(joined_texts(of_types(everything, con))).alias("concurrence_text"),
        F.when(none, "").when(typed | cut, "0").when(has_combined, "1").otherwise("").alias("combined_only"),
        F.when(typed, "cl_separate").when(cut, "heading").otherwise("none").alias("split_method"),
    )


def type_counters(rows: DataFrame, dump: DataFrame, fallback: bool = False, in_part: str = "ignore") -> DataFrame:
    """jurisdiction, type, n opinions of the cases in the dump, and whether split_by_type with these options leaves the type out."""
    handled = [LEAD, COMBINED, DISSENT, CONCURRENCE, *(FALLBACKS if fallback else []), *([IN_PART] if in_part != "ignore" else [])]
    keyed = rows.select(F.col("cluster_id").cast("string").alias("_id"), "jurisdiction").join(dump.select(F.col("cluster_id").alias("_id"), "opinions.type"), "_id")
    each = keyed.select("jurisdiction", F.explode("type").alias("type")).groupBy("jurisdiction", "type").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("ignored", ~F.col("type").isin(handled))


def drop_repeated_names(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each court, name and date."""
    return keep_first(rows.withColumn("_name", C.norm_name_tight(F.col("case_name"))), ["jurisdiction", "_name", "date_filed"], [F.col(order)]).drop("_name")


def drop_wrong_court(rows: DataFrame, listed: DataFrame, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that the list does not name, log of those it does): of a case listed twice the last counts; an older log is kept and renewed."""
    named = small(latest_of(listed, "cluster_id", [F.struct(*listed.columns)]).select(F.col("cluster_id").alias("_id"), "actual_court", "note"))
    text = rows.withColumn("_id", F.col("cluster_id").cast("string"))
    gone = text.join(named, "_id").select(F.col("_id").alias("cluster_id"), "jurisdiction", "case_name", "date_filed", "actual_court", "note")
    return text.join(named, "_id", "left_anti").drop("_id"), gone if log is None else upsert(log, gone, "cluster_id")
