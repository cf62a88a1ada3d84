"""Split records and chat records for training a model on cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.operators.relational import small
from quillfold.operators.revisions import group_split

# Where the body of an opinion starts, in order of preference, and the texts of prompts.
BODY_START = [
    r"\bOPINION\s+(?=[A-Z][A-Za-z'’.\- ]{1,40},\s+(?:Chief\s+|Senior\s+)?(?:Circuit|District)\s+Judge)",
    r"(?:Chief\s+)?Justice\s+[A-Z][A-Za-z'’]+\s*delivered\s+the\s+opinion",
    r"\b(?:[A-Z]\.\s*){0,2}[A-Z][A-Za-z'’\-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][A-Za-z'’\-]+)?,\s+(?:Chief\s+|Senior\s+)?(?:Circuit|District)\s+Judges?:",
    r"\bPER\s+CURIAM\s*[:.]",
]
HEADER_CHARS = 15_000
LABEL_ORDER = ["affirmed", "reversed", "vacated", "remanded", "affirmed_in_part", "dismissed", "denied", "granted", "mixed", "other", "unclear"]
WRITE_SYSTEM = "You are a U.S. appellate judge. Given the facts of a case and the legal question presented, write the court's reasoned opinion in the appropriate judicial register, then state the disposition on a final line as 'Disposition: <label>'."
PREDICT_SYSTEM = "You are a legal judgment predictor for U.S. appellate cases. Given the facts and the legal question, respond with ONLY the case disposition, chosen from: " + ", ".join(LABEL_ORDER) + "."
META = ["ideology", "ideology_score", "ideology_source", "issue_area", "issue_area_source", "decision_direction"]


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def is_filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def is_usable(df: DataFrame) -> Column:
    """Facts, question and text are all there."""
    return is_filled(_text(df, "facts")) & is_filled(_text(df, "issue_text")) & is_filled(_text(df, "opinion_text"))


def outcome_usable(disposition: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(disposition, F.lit("")))).isin("", "unclear")


def strip_header(text: Column) -> Column:
    """The text from where its body starts, if one of the starts stands in the opening."""
    at = lambda p: F.regexp_instr(F.substring(text, 1, HEADER_CHARS), F.lit("(?U)" + p))
    place = F.coalesce(*[F.when(at(p) > 0, at(p)) for p in BODY_START], F.lit(1))
    return F.substring(text, place, F.length(text))


def assign_splits(rows: DataFrame, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Usable rows with author_key and split: authors (or Supreme Court cases) stay whole, courts and outcomes are balanced."""
    keys = [F.col("jurisdiction"), _text(rows, "author_str"), _text(rows, "judge_name"), F.col("cluster_id")]
    usable = rows.where(is_usable(rows)).withColumn("author_key", C.author_key(*keys)).withColumn("_group", C.group_key(*keys))
    usable = usable.withColumn("_label", F.concat_ws("|", "jurisdiction", C.outcome_group(_text(rows, "disposition"))))
    return usable.join(group_split(usable, "_group", "_label", test, val, seed), "_group").drop("_group", "_label")


def split_records(rows: DataFrame, most_chars: int = 0) -> DataFrame:
    """Nested records of rows that have author_key and split; a capped text is only there where it is cut."""
    t = lambda c: _text(rows, c)
    capped = F.when(F.length(t("opinion_text")) > most_chars, F.left(t("opinion_text"), F.lit(most_chars))) if most_chars else F.lit(None).cast("string")
    return rows.select(
        t("cluster_id").alias("id"),
        "split",
        *[t(c).alias(c) for c in ("jurisdiction", "court", "case_name", "date_filed", "author_key")],
        F.struct(t("facts").alias("facts"), t("issue_text").alias("issue_text"), t("jurisdiction").alias("court")).alias("input"),
        F.struct(*[t(c).alias(c) for c in ("opinion_text", "disposition", "prevailing_party")], capped.alias("opinion_text_capped")).alias("targets"),
        F.struct(*[t(c).alias(c) for c in META]).alias("eval_meta"),
        outcome_usable(t("disposition")).alias("outcome_usable"),
    )


def user_prompt(with_ideology: bool = False) -> Column:
    """Court, question and facts of a split record, and on demand the ideology where it is known."""
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    ideology = F.when(F.col("eval_meta.ideology") != "", F.concat(F.lit("Authoring judge ideology: "), F.col("eval_meta.ideology")))
    lines = [F.concat(F.lit("Court: "), F.col("input.court")), *([ideology] if with_ideology else [])]
    return strip(F.concat_ws("\n", *lines, F.concat(F.lit("\nQuestion presented:\n"), strip(F.col("input.issue_text"))), F.concat(F.lit("\nFacts:\n"), strip(F.col("input.facts")))))


def target(most_chars: int = 0, cut_header: bool = False) -> Column:
    """The opinion, cut before the line that states the outcome is put below it."""
    whole = F.col("targets.opinion_text")
    text = strip_header(whole) if cut_header else F.coalesce(F.when(F.col("targets.opinion_text_capped") != "", F.col("targets.opinion_text_capped")), whole)
    text = F.left(text, F.lit(most_chars)) if most_chars else text
    return F.concat(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), F.lit("\n\nDisposition: "), F.col("targets.disposition"))


def chat_records(records: DataFrame, task: str, most_chars: int = 0, with_ideology: bool = False, cut_header: bool = False) -> DataFrame:
    """split, messages (role, content) and meta for the task `generation` or `predict`."""
    writing = task == "generation"
    asks = F.concat(user_prompt(with_ideology), F.lit("\n\nWrite the opinion." if writing else "\n\nDisposition:"))
    answer = target(most_chars, cut_header) if writing else F.col("targets.disposition")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(said("system", F.lit(WRITE_SYSTEM if writing else PREDICT_SYSTEM)), said("user", asks), said("assistant", answer))
    meta = F.struct("id", "jurisdiction", "case_name", "targets.disposition", "targets.prevailing_party", "eval_meta.ideology", "eval_meta.ideology_score", "eval_meta.issue_area", "eval_meta.decision_direction", "outcome_usable")
    return records.select("split", messages.alias("messages"), meta.alias("meta"))


def write_records(records: DataFrame, path: str, per_file: int = 0) -> None:
    """JSON lines in one folder for each split, rows in a seeded order."""
    writer = records.write.mode("errorifexists").partitionBy("split")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).json(path)


def shuffled(rows: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """A seeded order that any engine and any retry gives again."""
    return rows.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id)


def stratified_sample(rows: DataFrame, strata: list[str], row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the strata's shares, by largest remainders (ties by stratum), drawn by a seeded hash; all where n is 0 or more than there are."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).head()["n"]
    if n <= 0 or n >= whole:
        return rows
    quota = F.lit(n) * F.col("size") / F.lit(whole)
    sizes = sizes.withColumn("take", F.floor(quota).cast("int")).withColumn("rest", quota - F.floor(quota))
    left = n - sizes.agg(F.sum("take").alias("n")).head()["n"]
    more = sizes.orderBy(F.desc("rest"), *strata).limit(left).select(*strata, F.lit(1).alias("more"))
    sizes = sizes.join(more, strata, "left").select(*strata, (F.col("take") + F.coalesce("more", F.lit(0))).alias("take"))
    drawn = rows.join(small(sizes), strata).withColumn("_draw", F.xxhash64(F.col(row_id), F.lit(seed)))
    at = F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", row_id))
    return drawn.withColumn("_at", at).where(F.col("_at") <= F.col("take")).drop("_at", "_draw", "take")
