"""Scalar functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"

# Outcome labels in the order in which they are looked for, and the groups that balance splits.
DISPOSITIONS = ["affirmed_in_part", "affirmed", "reversed", "vacated", "remanded", "dismissed", "denied", "granted", "mixed", "other", "unclear"]
OUTCOME_GROUPS = {
    "affirmed": ["affirmed"],
    "reversed": ["reversed", "vacated", "remanded"],
    "mixed": ["mixed", "affirmed_in_part"],
    "procedural": ["denied", "dismissed", "granted"],
}
ISSUE_GROUPS = {"1": "1 criminal", "2": "2 civil_rights", "8": "8 economic"}
PARTIES = ["appellant", "appellee", "petitioner", "respondent", "plaintiff", "defendant", "government", "mixed", "unclear"]
LABELS = ["liberal", "conservative", "moderate"]


def blank_to_null(c: Column) -> Column:
    """White space counts as missing."""
    t = F.trim(c)
    return F.when(t != "", t)


def first_non_empty(*columns: Column) -> Column:
    """White space is a value here: only null and the empty string are passed over."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def once(value: Column, use) -> Column:
    """use(value) with the value computed a single time for each row, however often it is used.

    A lambda variable is no expression that the optimiser could write out again.
    """
    return F.transform(F.array(value), use)[0]


def strip_html(c: Column) -> Column:
    """Tags become spaces; entities and script bodies stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), SPACE, " "))


def year(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(\d{4})", 1))


def type_priority(c: Column) -> Column:
    t = F.lower(c)
    side = t.contains("concurr") | t.contains("dissent") | t.contains("addendum")
    return F.when(t.contains("lead"), 0).when(t.contains("combined"), 1).when(side, 3).otherwise(2)


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("true", "1", "t"), F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE), lambda w: w != ""))


def without_revisions(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s+revisions?:[^\n]*\n?\z", "")


def norm_name_spaced(c: Column) -> Column:
    """Lower case, letters, digits and spaces."""
    return F.trim(F.regexp_replace(F.lower(without_revisions(c)), r"[^a-z0-9 ]", ""))


def norm_name_tight(c: Column) -> Column:
    return F.regexp_replace(F.lower(without_revisions(c)), r"[^a-z0-9]", "")


def parse_initials(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^A-Z]", "")


def initials_ok(a: Column, b: Column) -> Column:
    """Compatible: either empty; or same first, and same second where both have one; or a single one is the other's second."""
    same = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(a) < 2) | (F.length(b) < 2) | (F.substring(a, 2, 1) == F.substring(b, 2, 1)))
    second = (F.length(a) == 1) & (F.length(b) >= 2) & (a == F.substring(b, 2, 1))
    return (a == "") | (b == "") | same | second


def initials_conflict(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ~F.arrays_overlap(F.split(a, ""), F.split(b, ""))


def parse_date(c: Column) -> Column:
    """M/D/YYYY or ISO at the start, whatever follows; null for what is neither."""
    return F.coalesce(F.try_to_date(F.regexp_extract(c, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy"), F.try_to_date(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


# Circuits by ordinal.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh"]


def circuit_key(c: Column) -> Column:
    """'dc', 'fed' or '1' to '11', in that order of tests; empty where none fits."""
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(t.contains("d.c") | t.contains("district of columbia") | t.rlike(r"\b(ca)?dc\b"), "dc").when(t.contains("fed") | t.contains("cafc"), "fed")
    for i, name in enumerate(ORDINALS, 1):
        out = out.when(t.contains(name), str(i))
    return out.otherwise(F.regexp_extract(t, r"(1[01]|[1-9])", 1))


def docket_tokens(c: Column) -> Column:
    """Upper case, one kind of dash, split at separators or AND, distinct; an original case is its number and ORIG."""
    t = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[\u2010-\u2015\u2212]", "-")
    original = F.coalesce(blank_to_null(F.regexp_extract(t, r"(\d+)\s*,?\s*ORIG", 1)), F.regexp_extract(t, r"\A\s*\d{2}O(\d+)\s*\z", 1))
    parts = F.transform(F.split(F.regexp_replace(t, r"\bNOS?\.?\s*", " "), r"[,;&/]|\bAND\b"), lambda x: F.regexp_replace(x, r"[^A-Z0-9-]", ""))
    return F.when(original != "", F.array(F.concat(original, F.lit("ORIG")))).otherwise(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))))


def norm_cite(volume: Column, page: Column) -> Column:
    """Volume and page of the United States Reports; empty without a page or where it is not known yet."""
    volume, page = (F.trim(F.coalesce(x, F.lit(""))) for x in (volume, page))
    return F.when((page == "") | page.contains("_"), "").otherwise(F.replace(F.concat(volume, F.lit("U.S."), page), F.lit(" "), F.lit("")))


def classify_score(score: Column, cut: float = 0.3) -> Column:
    return F.when(score.isNull(), "").when(score < -cut, "Liberal").when(score > cut, "Conservative").otherwise("Moderate")


def head(c: Column, n: int) -> Column:
    """Cut first, then collapse white space."""
    return F.regexp_replace(F.substring(c, 1, n), SPACE, " ")


def grams(tokens: Column, n: int = 5) -> Column:
    """Distinct n-grams of tokens; none where there are fewer than n."""
    made = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(t, i, n)))
    return once(tokens, lambda t: F.when(F.size(t) >= n, F.array_distinct(made(t))).otherwise(F.array().cast("array<string>")))


def window_shingles(c: Column, most: int = 20_000) -> Column:
    return grams(words(F.substring(c, 1, most)))


def text_shingles(c: Column) -> Column:
    return grams(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def head_and_tail(c: Column, first: int = 8000, last: int = 2000, marker: str = "\n[...]\n") -> Column:
    return F.when(F.length(c) <= first + last, c).otherwise(F.concat(F.substring(c, 1, first), F.lit(marker), F.right(c, F.lit(last))))


def clamp_enum(c: Column, allowed: list[str], unknown: str, missing: str = "unclear") -> Column:
    t = F.lower(blank_to_null(c))
    return F.when(t.isNull(), missing).when(t.isin(allowed), t).otherwise(unknown)


def author_key(court: Column, author: Column, judge: Column, case_id: Column) -> Column:
    """Court and who wrote: the judge in the Supreme Court, the author elsewhere; a key of the case's own where that is blank."""
    supreme = court == "SCOTUS"
    name = F.lower(F.trim(F.coalesce(F.when(supreme, judge).otherwise(author), F.lit(""))))
    prefix = F.when(supreme, "scotus").otherwise(F.lower(F.coalesce(court, F.lit(""))))
    return F.concat(prefix, F.lit("::"), F.when(name != "", name).otherwise(F.concat(F.lit("_unknown_"), case_id.cast("string"))))


def group_key(court: Column, author: Column, judge: Column, case_id: Column) -> Column:
    """What stays whole in one split: the case in the Supreme Court, else all of an author's."""
    return F.when(court == "SCOTUS", F.concat(F.lit("scotus::case_"), case_id.cast("string"))).otherwise(author_key(court, author, judge, case_id))


def outcome_group(c: Column) -> Column:
    t, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.when(F.lit(False), "")
    for group, labels in OUTCOME_GROUPS.items():
        out = out.when(t.isin(labels), group)
    return out.otherwise("other")


def issue_group(c: Column) -> Column:
    """Codes may carry a decimal part; the sign of the empty set stands for none."""
    v, out = F.substring_index(F.coalesce(c, F.lit("")), ".", 1), F.when(F.lit(False), "")
    for code, group in ISSUE_GROUPS.items():
        out = out.when(v == code, group)
    return out.when(v != "", "other").otherwise("\u2205")


def parse_disposition(c: Column) -> Column:
    """The first label, in list order, that the word after `disposition` holds; without such a word, that the text holds."""
    t = F.lower(c)
    named = F.regexp_extract(t, r"disposition\s*[:-]\s*([a-z_]+)", 1)
    where = F.when(named != "", named).otherwise(t)
    return F.coalesce(*[F.when(where.contains(label), label) for label in DISPOSITIONS], F.lit("unclear"))


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), r"[^a-z]", "")
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(w, F.lit(r"[aeiouy]+"))))


def text_stats(c: Column) -> Column:
    """Words, words per sentence, type-token ratio and grade level; only words for a text without any."""
    return once(F.regexp_extract_all(c, F.lit(r"([A-Za-z']+)"), F.lit(1)), lambda w: _stats_of(c, w))


def _stats_of(c: Column, w: Column) -> Column:
    n = F.size(w).cast("double")
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: F.trim(s) != ""))).cast("double")
    total = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    types = F.size(F.array_distinct(F.transform(w, F.lower)))
    some = F.size(w) > 0
    return F.struct(
        F.size(w).alias("n_words"),
        F.when(some, n / sentences).alias("sentence_words"),
        F.when(some, types / n).alias("ttr"),
        F.when(some, 0.39 * n / sentences + 11.8 * total / n - 15.59).alias("grade"),
    )


def clamp_axis(c: Column) -> Column:
    """Rounded half to even into 1..5; null where it is no number."""
    number = c.try_cast("double")
    return F.when(F.abs(number) < float("inf"), F.bround(F.greatest(F.lit(1.0), F.least(F.lit(5.0), number))).cast("int"))


def ideology_label(c: Column) -> Column:
    t, out = F.lower(c), None
    for label in LABELS:
        out = F.when(t.contains(label), label) if out is None else out.when(t.contains(label), label)
    return out.otherwise("")


def tolerant_json(c: Column, schema: str) -> Column:
    """Parsed as it is, else its outermost braces."""
    whole = F.get_json_object(c, "$").isNotNull()
    return F.from_json(F.when(whole, c).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1)), schema)


def numeric_id(c: Column) -> Column:
    """Ids that are no number sort last."""
    return F.coalesce(c.try_cast("long"), F.lit(2**63 - 1))


def percent(a: Column, b: Column) -> Column:
    """One decimal, halves to the even digit; n/a of nothing."""
    share = F.bround((F.lit(100.0) * a / F.nullif(b, F.lit(0))).cast("decimal(30,12)"), 1)
    return F.when(b == 0, "n/a").otherwise(F.format_string("%.1f%%", share.cast("double")))


def softmax_best(logits: Column) -> Column:
    """Position (from 0) and share of the largest of an array of logits."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return F.struct((F.array_position(logits, most) - 1).alias("label"), (1.0 / total).alias("confidence"))


def merge_system(messages: Column) -> Column:
    """Fold system texts into the first user message; lost if there is none."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["text"]), "\n\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    at = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    folded = lambda m, i: F.struct(m["role"].alias("role"), F.when((i == at - 1) & (system != ""), F.concat(system, F.lit("\n\n"), m["text"])).otherwise(m["text"]).alias("text"))
    return F.transform(rest, folded)
