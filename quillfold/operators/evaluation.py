"""Scores of predictions: outcome, style, judges' axes, ideology, citations, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.operators.relational import beside, class_counts, small

# Fixed values.
AXES = ["coherence", "terminology", "institutional_fit", "faithfulness"]
IDEOLOGIES = ["Liberal", "Conservative", "Moderate"]
COLLAPSED = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 5, 7: 5, 8: 5, 12: 5, 9: 6, 10: 6, 11: 6, 13: 6, 14: 6}
TOPICS = {
    1: "Criminal Procedure",
    2: "Civil Rights",
    3: "First Amendment",
    4: "Due Process",
    5: "Privacy",
    6: "Attorneys",
    7: "Unions",
    8: "Economic Activity",
    9: "Judicial Power",
    10: "Federalism",
    11: "Interstate Relations",
    12: "Federal Taxation",
    13: "Miscellaneous",
    14: "Private Action",
}
OUTCOME_GROUPS = {"affirmed": "affirmed", "reversed": "reversed", "vacated": "reversed", "remanded": "reversed", "mixed": "mixed", "affirmed_in_part": "mixed", "denied": "procedural", "dismissed": "procedural", "granted": "procedural"}
GATE = 0.85
CITATION_CHARS = 50_000


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def outcome_metrics(preds: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1 over the labels seen, and a map of accuracy by court."""
    right = (F.col("gold_disposition") == F.col("pred_disposition")).cast("double")
    by_court = preds.groupBy("jurisdiction").agg(F.avg(right).alias("a"), F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))
    courts = by_court.agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("jurisdiction", "a")))).alias("accuracy_by_court"))
    counts = class_counts(preds, "gold_disposition", "pred_disposition")
    return beside(courts, counts.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))).select("n", "accuracy", "macro_f1", "accuracy_by_court")


def class_report(preds: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, predicted, precision, recall and f1 of each label seen, and the row `weighted`: f1 by support."""
    counts = class_counts(preds, gold, predicted).where("label IS NOT NULL")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = counts.select("label", (tp + fn).alias("support"), (tp + fp).alias("predicted"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))
    means = [F.try_divide(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")]
    return each.unionByName(each.agg(F.lit("weighted").alias("label"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), *means))


def outcome_group(disposition: Column) -> Column:
    """Eleven outcomes to five groups."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in OUTCOME_GROUPS.items() for x in p]), F.lower(F.trim(disposition))), F.lit("other"))


def style_means(texts: DataFrame, text: str) -> DataFrame:
    """Means of words, sentence_words, ttr and grade; a text without words counts for the first alone."""
    s = texts.select(C.text_stats(F.coalesce(F.col(text), F.lit(""))).alias("s")).select("s.*")
    return s.agg(F.avg("n_words").alias("words"), *[F.avg(c).alias(c) for c in ("sentence_words", "ttr", "grade")])


def discourse(preds: DataFrame, records: DataFrame) -> DataFrame:
    """side (generated, authentic) and style_means; authentic texts are those of the predicted ids."""
    authentic = preds.select(F.col("id").cast("string").alias("id")).join(records.select(F.col("id").cast("string").alias("id"), "targets.opinion_text"), "id")
    return style_means(preds, "generated_text").select(F.lit("generated").alias("side"), "*").unionByName(style_means(authentic, "opinion_text").select(F.lit("authentic").alias("side"), "*"))


def judge_prompts(preds: DataFrame, records: DataFrame) -> DataFrame:
    """id, jurisdiction, issue, facts and text for the judge, each cut; a prediction without a record has blanks."""
    side = records.select(F.col("id").cast("string").alias("id"), F.col("input.issue_text").alias("issue"), F.col("input.facts").alias("facts"))
    part = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    rows = preds.withColumn("id", F.col("id").cast("string")).join(side, "id", "left")
    return rows.select("id", F.coalesce("jurisdiction", F.lit("")).alias("jurisdiction"), part(F.col("issue"), 2000).alias("issue"), part(F.col("facts"), 2000).alias("facts"), part(F.col("generated_text"), 6000).alias("text"))


def judge_summary(scores: DataFrame) -> DataFrame:
    """n, the mean of each axis without its nulls, and the mean of these means."""
    means = scores.agg(F.count(F.lit(1)).alias("n"), *[F.avg(C.clamp_axis(F.col(a).cast("string"))).alias(a) for a in AXES])
    filled = F.filter(F.array(*AXES), lambda x: x.isNotNull())
    return means.withColumn("overall", F.when(F.size(filled) > 0, F.aggregate(filled, F.lit(0.0), lambda a, x: a + x) / F.size(filled)))


def ideology_scores(preds: DataFrame) -> DataFrame:
    """Three- and two-way accuracy and macro F1 over the fixed labels, of rows (gold, answer) with a known gold label and a readable answer."""
    label = F.coalesce(*[F.when(F.lower(F.trim("answer")).contains(x.lower()), x) for x in IDEOLOGIES])
    read = preds.where(F.trim("gold").isin(IDEOLOGIES)).select("gold", label.alias("pred")).where("pred IS NOT NULL")
    hit, two = (F.col("gold") == F.col("pred")).cast("double"), F.col("gold").isin("Liberal", "Conservative")
    labels = preds.sparkSession.createDataFrame([(x,) for x in IDEOLOGIES], "label string")
    macro = class_counts(read, "gold", "pred", labels).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1_3way"))
    whole = read.agg(F.count(F.lit(1)).alias("n_evaluated"), F.avg(hit).alias("accuracy_3way"), F.avg(F.when(two, hit)).alias("accuracy_2way"))
    return beside(whole, macro).select("n_evaluated", "accuracy_3way", F.when(F.col("n_evaluated") > 0, F.col("macro_f1_3way")).alias("macro_f1_3way"), "accuracy_2way")


def citation_request(text: Column) -> Column:
    """The body that the lookup service takes: the opening, percent-encoded, a space as %20."""
    coded = F.replace(F.url_encode(F.left(text, F.lit(CITATION_CHARS))), F.lit("+"), F.lit("%20"))
    for code, plain in (("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.concat(F.lit("text="), F.replace(coded, F.lit("*"), F.lit("%2A")))


def citation_rate(lookups: DataFrame) -> DataFrame:
    """citations_found, hallucinated and their ratio, of lookups (id, answers: array of status and number of clusters)."""
    each = lookups.select(F.explode("answers").alias("a"))
    bad = F.coalesce(F.col("a.status") != 200, F.lit(True)) | (F.coalesce(F.col("a.clusters"), F.lit(0)) == 0)
    out = each.agg(F.count(F.lit(1)).alias("citations_found"), F.count_if(bad).alias("hallucinated"))
    return out.withColumn("hallucination_rate", F.try_divide(F.col("hallucinated").cast("double"), F.col("citations_found")))


def collapse_topic(code: Column) -> Column:
    """Fourteen topics to six; other codes stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in COLLAPSED.items() for x in p]), code), code)


def topic_prompt(syllabus: Column, issue: Column, opinion: Column) -> Column:
    """The openings of what is there, the question and the lettered choices."""
    cut = lambda c, n: F.when(F.trim(c) != "", F.left(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), F.lit(n)))
    body = F.concat_ws("\n\n", cut(syllabus, 500), cut(issue, 300), cut(opinion, 3000))
    choices = "\n".join(f"{chr(64 + code)}. {name}" for code, name in TOPICS.items())
    return F.concat(body, F.lit(f"\n\nQuestion: What is the issue area of the decision?\n{choices}\nAnswer:"))


def ground_truth(rows: DataFrame) -> DataFrame:
    """Supreme Court cases whose topic the database gave."""
    return rows.where((F.col("jurisdiction") == "SCOTUS") & (F.trim("issue_area") != "") & (F.col("issue_area_source") == "scdb"))


def topic_report(results: DataFrame) -> DataFrame:
    """true_issue, total, correct and mean confidence by class of results (true_issue, pred_issue, confidence); rows without a prediction are left out."""
    seen = results.where("pred_issue IS NOT NULL")
    return seen.groupBy("true_issue").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("true_issue") == F.col("pred_issue")).alias("correct"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def gate(results: DataFrame) -> DataFrame:
    """evaluated, correct, accuracy and whether it reaches the gate."""
    out = results.where("pred_issue IS NOT NULL").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("true_issue") == F.col("pred_issue")).alias("correct"))
    accuracy = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("evaluated")), F.lit(0.0))
    return out.withColumn("accuracy", accuracy).withColumn("passed", accuracy >= GATE)


def attach_topics(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with issue_area and lawma_conf of the labels (cluster_id, pred_issue, confidence) where they have none of the database."""
    side = labels.groupBy("cluster_id").agg(F.max_by(F.struct("pred_issue", "confidence"), F.struct("confidence", "pred_issue")).alias("l"))
    joined = rows.join(small(side), "cluster_id", "left")
    takes = F.col("l").isNotNull() & (F.coalesce("issue_area_source", F.lit("")) != "scdb")
    new = {"issue_area": F.when(takes, F.col("l.pred_issue").cast("string")).otherwise(F.col("issue_area")), "issue_area_source": F.when(takes, "lawma").otherwise(F.col("issue_area_source"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], F.when(takes, F.col("l.confidence")).alias("lawma_conf"))


def flatten_results(results: DataFrame) -> DataFrame:
    """One flat row of text for each nested result; what is missing is blank."""
    fields = {"task": "task", "n": "n", "accuracy": "outcome.accuracy", "macro_f1": "outcome.macro_f1", "bertscore_f1": "bertscore_f1", "gen_words": "discourse.generated.words", "auth_words": "discourse.authentic.words", "gen_fk": "discourse.generated.flesch_kincaid", "auth_fk": "discourse.authentic.flesch_kincaid", "gen_ttr": "discourse.generated.ttr", "auth_ttr": "discourse.authentic.ttr", "halluc_rate": "citation_hallucination.hallucination_rate"}
    return results.select("name", *[F.coalesce(F.col(path).cast("string"), F.lit("")).alias(c) for c, path in fields.items()])


RESULT_SCHEMA = "task string, n long, outcome struct<accuracy:double,macro_f1:double>, bertscore_f1 double, discourse struct<generated:struct<words:double,flesch_kincaid:double,ttr:double>,authentic:struct<words:double,flesch_kincaid:double,ttr:double>>, citation_hallucination struct<hallucination_rate:double>"


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return log.unionByName(new, allowMissingColumns=True)
