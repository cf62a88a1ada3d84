"""Reports on a corpus: one frame of numbers for each section, and a renderer that only formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.columns import percent
from quillfold.operators.records import is_filled, outcome_usable
from quillfold.operators.relational import beside, upper_median

# Which courts a field applies to, and who may give an ideology.
COURTS = ["SCOTUS", "CA5", "CA9"]
CIRCUITS = ["CA5", "CA9"]
SCOPES = {
    "opinion_text": "ALL",
    "case_name": "ALL",
    "date_filed": "ALL",
    "judge_name": "ALL",
    "facts": "ALL",
    "issue_text": "ALL",
    "disposition": "ALL",
    "prevailing_party": "ALL",
    "author_str": "CIRCUITS",
    "ideology_score": "ALL",
    "ideology": "CIRCUITS",
    "issue_area": "ALL",
    "decision_direction": "SCOTUS",
    "syllabus": "ALL",
}
AUTHORISED = ["judjis", "martin_quinn"]
SPARSE = 10


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def applies(scope: str, court: Column) -> Column:
    """Whether a field of this scope (ALL, CIRCUITS or one court) applies to a row of this court."""
    return F.lit(True) if scope == "ALL" else court.isin(CIRCUITS) if scope == "CIRCUITS" else court == scope


def field_presence(rows: DataFrame) -> DataFrame:
    """field, jurisdiction (null: all courts), n where the field applies, present and missing; fields without a column are left out."""
    fields = {f: s for f, s in SCOPES.items() if f in rows.columns}
    court = F.col("jurisdiction")
    entry = lambda f, s: F.struct(F.lit(f).alias("field"), applies(s, court).alias("applies"), is_filled(F.col(f)).alias("there"))
    each = rows.where(court.isin(COURTS)).select("jurisdiction", F.explode(F.array(*[entry(f, s) for f, s in fields.items()])).alias("e")).select("jurisdiction", "e.*").where("applies")
    grouped = each.groupingSets([["field", "jurisdiction"], ["field"]], "field", "jurisdiction").agg(F.count(F.lit(1)).alias("n"), F.count_if("there").alias("present"))
    return grouped.withColumn("missing", F.col("n") - F.col("present"))


def tiers(rows: DataFrame) -> DataFrame:
    """jurisdiction (null: all), n, and how many rows are complete to tier a (texts), b (and outcome), c (and metadata), d (c, with the circuits' topics to come)."""
    has = lambda c: is_filled(F.col(c))
    a = has("opinion_text") & has("facts") & has("issue_text")
    b = a & outcome_usable(F.col("disposition"))
    c = b & has("ideology_score") & has("issue_area")
    d = b & has("ideology_score") & (has("issue_area") | F.col("jurisdiction").isin(CIRCUITS))
    return rows.rollup("jurisdiction").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(name) for name, x in zip("abcd", (a, b, c, d), strict=True)])


def diagnosis(rows: DataFrame) -> DataFrame:
    """One row: why fields are missing."""
    has = lambda c: is_filled(F.col(c))
    supreme, circuit = F.col("jurisdiction") == "SCOTUS", F.col("jurisdiction").isin(CIRCUITS)
    outcome = F.lower(_text("disposition"))
    unscored = ~has("ideology_score")
    unmatched = (_text("issue_area_source") != "scdb") & ~has("decision_direction")
    return rows.agg(
        F.count_if(~(has("facts") & has("issue_text"))).alias("no_fields"),
        *[F.count_if(outcome == x).alias(f"outcome_{x or 'blank'}") for x in ("unclear", "other", "")],
        F.count_if(supreme & unscored).alias("scotus_unscored"),
        F.count_if(supreme & unscored & unmatched).alias("scotus_unmatched"),
        F.count_if(circuit & unscored).alias("circuit_unscored"),
        F.count_if(circuit & unscored & ~has("author_str")).alias("circuit_no_author"),
        F.count_if(circuit & ~has("issue_area")).alias("circuit_no_topic"),
    )


def outcomes_by_court(rows: DataFrame) -> DataFrame:
    """disposition by court, and their total."""
    pivot = rows.groupBy(F.lower(_text("disposition")).alias("disposition")).pivot("jurisdiction", COURTS).agg(F.count(F.lit(1))).fillna(0, COURTS)
    total = rows.groupBy(F.lower(_text("disposition")).alias("disposition")).agg(F.count(F.lit(1)).alias("total"))
    return pivot.join(total, "disposition")


def source_coverage(rows: DataFrame, field: str, source: str) -> DataFrame:
    """By court: rows with and without the field, and a map of counts by source (`unknown` where it is blank)."""
    there = _text(field) != ""
    counts = rows.groupBy(_text("jurisdiction").alias("jurisdiction"), F.when(there, F.when(_text(source) != "", _text(source)).otherwise("unknown")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    of_source = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "n")))))
    return counts.groupBy("jurisdiction").agg(F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0)).alias("has"), F.sum(F.when(F.col("s").isNull(), F.col("n")).otherwise(0)).alias("miss"), of_source.alias("sources"))


def by_value(rows: DataFrame, field: str) -> DataFrame:
    """Values of a field, their rows and share in percent, the most frequent first."""
    counts = rows.groupBy(_text(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return beside(counts, total).select("value", "n", percent(F.col("n"), F.col("total")).alias("share")).orderBy(F.desc("n"), "value")


def repeated_names(rows: DataFrame, name: str = "case_name") -> DataFrame:
    """One row: distinct names, those that repeat, and the rows that these cover."""
    n = rows.where(_text(name) != "").groupBy(_text(name).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in"))


def cells(rows: DataFrame) -> DataFrame:
    """Rows by court and ideology, with a mark on sparse cells."""
    n = rows.groupBy(_text("jurisdiction").alias("jurisdiction"), _text("ideology").alias("ideology")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("sparse", F.col("n") < SPARSE)


def unauthorised(rows: DataFrame) -> DataFrame:
    """One row: rows whose ideology is of a source that may not give one, and how many of them share name, date and judge with a row without a text."""
    key = ["case_name", "date_filed", "judge_name"]
    keyed = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in key], (_text("opinion_text") == "").alias("blank"), _text("ideology_source").alias("source"))
    empty = keyed.where("blank").select(*key, F.lit(1).alias("gap")).distinct()
    bad = keyed.where(~F.col("source").isin(*AUTHORISED, "")).join(empty, key, "left")
    return bad.agg(F.count(F.lit(1)).alias("n"), F.count("gap").alias("overlap"), (F.count(F.lit(1)) - F.count("gap")).alias("usable"))


def lengths(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Number, least, upper median and most characters of the filled values of each field."""
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("v"))
    each = rows.select(F.explode(F.array(*[entry(f) for f in fields if f in rows.columns])).alias("e")).select("e.*").where(is_filled(F.col("v"))).withColumn("n_chars", F.length("v"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("lo"), upper_median("n_chars").cast("int").alias("median"), F.max("n_chars").alias("hi"))


def before_and_after(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows of each group before and after a step; 0 where it has none left."""
    count = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    return count(before, "before").join(count(after, "after"), by, "left").fillna(0, ["after"])


def filled_before_and_after(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled values before and after an enrichment."""
    count = lambda df, name: df.agg(*[F.count_if(is_filled(F.col(f)) if f in df.columns else F.lit(False)).alias(f) for f in fields]).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(name)) for f in fields])).alias("e")).select("e.*")
    return count(before, "before").join(count(after, "after"), "field")


def pending(rows: DataFrame) -> DataFrame:
    """Rows whose question or facts are still to be extracted."""
    return rows.where(~(is_filled(F.col("issue_text")) & is_filled(F.col("facts"))))


def bar(n: Column, total: Column, width: int = 20) -> Column:
    """Filled and empty blocks."""
    filled = F.when(total == 0, 0).otherwise(F.bround(n / F.nullif(total, F.lit(0)) * width).cast("int"))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))


def score_range(rows: DataFrame, score: str) -> DataFrame:
    """By court: numbers among the scores, the least, the greatest and their mean, with two places."""
    n = F.col(score).try_cast("double")
    shown = lambda c: F.format_string("%.2f", c)
    each = rows.groupBy(_text("jurisdiction").alias("jurisdiction")).agg(F.count(n).alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.avg(n).alias("mean")).where("n > 0")
    return each.select("jurisdiction", "n", *[shown(F.col(c)).alias(c) for c in ("lo", "hi", "mean")])


def top_names(rows: DataFrame, k: int = 10, name: str = "case_name") -> DataFrame:
    """The k names that repeat most."""
    n = rows.where(_text(name) != "").groupBy(_text(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.orderBy(F.desc("n"), "name").limit(k)


def as_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """section and line: each row of each section as its values between bars; a map as key:value. One frame, and nothing at the driver."""
    out = None
    for title, section in sections.items():
        kinds = dict(section.dtypes)
        pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
        shown = [F.coalesce(pairs(c) if kinds[c].startswith("map") else F.col(c).cast("string"), F.lit("")) for c in section.columns]
        lines = section.select(F.lit(title).alias("section"), F.concat_ws(" | ", *shown).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def render(title: str, section: DataFrame, most: int = 1000) -> str:
    """A section as a Markdown table; sections are summaries, and one of more than `most` rows is refused."""
    rows = section.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    line = lambda cells_: "| " + " | ".join("" if c is None else str(c) for c in cells_) + " |"
    return "\n".join([f"## {title}", "", line(section.columns), "|" + "---|" * len(section.columns), *map(line, rows), ""])


def completeness(rows: DataFrame) -> dict[str, DataFrame]:
    return {"Fields": field_presence(rows), "Tiers": tiers(rows), "Diagnosis": diagnosis(rows), "Outcomes": outcomes_by_court(rows)}


def statistics(rows: DataFrame) -> dict[str, DataFrame]:
    return {
        "Courts": by_value(rows, "jurisdiction"),
        "Repeated names": repeated_names(rows),
        "Most repeated": top_names(rows),
        "Ideology": by_value(rows, "ideology"),
        "Court by ideology": cells(rows),
        "Ideology sources": by_value(rows, "ideology_source"),
        "Topic coverage": source_coverage(rows, "issue_area", "issue_area_source"),
        "Topics": by_value(rows.where(_text("issue_area") != ""), "issue_area"),
        "Score coverage": source_coverage(rows, "ideology_score", "ideology_source"),
        "Score range": score_range(rows, "ideology_score"),
        "Text coverage": before_and_after(rows, rows.where(_text("opinion_text") != ""), "jurisdiction"),
        "Unauthorised sources": unauthorised(rows),
        "Missing values": field_presence(rows).where("jurisdiction IS NULL").drop("jurisdiction"),
        "Lengths": lengths(rows, ["opinion_text", "syllabus", "issue_text"]),
    }
