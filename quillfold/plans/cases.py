"""Records, reports and scores over a table of cases that stands in for the corpus.

The orders of the driver are the cases; texts, courts and labels follow from their keys by CASE rules that Spark and DuckDB read
alike, so that every blank, label and court occurs. What is asked of the table is written twice: as operators, and as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.operators import corpus, evaluation, extraction, records, reports
from quillfold.operators import dedup as D
from quillfold.operators.relational import override

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RULES = {
    "cluster_id": "o_orderkey",
    "jurisdiction": "CASE o_orderkey % 3 WHEN 0 THEN 'SCOTUS' WHEN 1 THEN 'CA5' ELSE 'CA9' END",
    "court": "CASE o_orderkey % 3 WHEN 0 THEN 'scotus' WHEN 1 THEN 'ca5' ELSE 'ca9' END",
    "case_name": "'Acme ' || CAST(o_custkey AS STRING) || ' v. ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Roe, Inc. Revisions: 2' ELSE 'Roe Inc' END",
    "date_filed": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "judge_name": "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'Judge ' || CAST(o_custkey % 40 AS STRING) END",
    "author_str": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Author ' || CAST(o_custkey % 60 AS STRING) END",
    "syllabus": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END",
    "opinion_text": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  ' ELSE 'We hold for ' || CAST(o_custkey AS STRING) || '. The order of ' || o_orderpriority || ' is ' || CASE WHEN o_orderstatus = 'F' THEN 'affirmed in part. It stands!' WHEN o_orderstatus = 'O' THEN 'reversed. Is it so?' ELSE 'what it is' END END",
    "facts": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' Facts of ' || CAST(o_orderkey AS STRING) || ' ' END",
    "issue_text": "CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE 'Whether ' || o_orderstatus END",
    "disposition": "CASE o_orderkey % 12 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'reversed' WHEN 2 THEN 'vacated' WHEN 3 THEN 'affirmed_in_part' WHEN 4 THEN 'dismissed' WHEN 5 THEN 'Unclear' WHEN 6 THEN '' WHEN 7 THEN 'other' WHEN 8 THEN 'mixed' ELSE 'affirmed' END",
    "prevailing_party": "CASE WHEN o_orderkey % 2 = 0 THEN 'appellant' ELSE 'appellee' END",
    "ideology": "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_custkey % 50 = 0 THEN 'Moderate' WHEN o_custkey % 2 = 0 THEN 'Liberal' ELSE 'Conservative' END",
    "ideology_score": "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 7 AS STRING) || '.5' END",
    "ideology_source": "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'martin_quinn' WHEN o_orderkey % 31 = 0 THEN 'guess' ELSE 'judjis' END",
    "issue_area": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 14 + 1 AS STRING) WHEN o_orderkey % 8 = 0 THEN '2' ELSE '' END",
    "issue_area_source": "CASE WHEN o_orderkey % 33 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'scdb' WHEN o_orderkey % 8 = 0 THEN 'lawma' ELSE '' END",
    "decision_direction": "CASE WHEN o_orderkey % 6 = 0 THEN '1' ELSE '' END",
}
CASES = "WITH cases AS (SELECT " + ", ".join(f"{rule} AS {name}" for name, rule in RULES.items()) + " FROM orders)"


def cases(spark, d, *columns):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.selectExpr(*[f"{RULES[c]} AS {c}" for c in (columns or RULES)])


def query(sql: str | None = None):
    """Register a query over cases; its SQL goes on after the definition of `cases`."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CASES + sql
        return f

    return register


def _filled(c: str) -> str:
    return f"coalesce(trim({c}) <> '', false)"


_SCOPE_SQL = {"ALL": "true", "CIRCUITS": "jurisdiction IN ('CA5', 'CA9')", "SCOTUS": "jurisdiction = 'SCOTUS'"}
_FIELDS = " UNION ALL ".join(f"SELECT '{f}' AS field, jurisdiction, {_filled(f)} AS there FROM cases WHERE {_SCOPE_SQL[s]}" for f, s in reports.SCOPES.items())


@query(f", e AS ({_FIELDS}) SELECT field, jurisdiction, count(*) AS n, count(*) FILTER (WHERE there) AS present, count(*) FILTER (WHERE NOT there) AS missing FROM e GROUP BY GROUPING SETS ((field, jurisdiction), (field))")
def a05_p09_p18_field_presence(spark, d):
    return reports.field_presence(cases(spark, d))


_A = f"{_filled('opinion_text')} AND {_filled('facts')} AND {_filled('issue_text')}"
_B = f"{_A} AND lower(trim(disposition)) NOT IN ('', 'unclear')"
_C = f"{_B} AND {_filled('ideology_score')} AND {_filled('issue_area')}"
_D = f"{_B} AND {_filled('ideology_score')} AND ({_filled('issue_area')} OR jurisdiction <> 'SCOTUS')"


@query(f" SELECT jurisdiction, count(*) AS n, count(*) FILTER (WHERE {_A}) AS a, count(*) FILTER (WHERE {_B}) AS b, count(*) FILTER (WHERE {_C}) AS c, count(*) FILTER (WHERE {_D}) AS d FROM cases GROUP BY ROLLUP (jurisdiction)")
def p06_p07_p08_a06_tiers(spark, d):
    return reports.tiers(cases(spark, d))


@query(f""" SELECT count(*) FILTER (WHERE NOT ({_filled('facts')} AND {_filled('issue_text')})) AS no_fields, count(*) FILTER (WHERE lower(trim(disposition)) = 'unclear') AS outcome_unclear, count(*) FILTER (WHERE lower(trim(disposition)) = 'other') AS outcome_other, count(*) FILTER (WHERE trim(disposition) = '') AS outcome_blank,
count(*) FILTER (WHERE jurisdiction = 'SCOTUS' AND NOT {_filled('ideology_score')}) AS scotus_unscored, count(*) FILTER (WHERE jurisdiction = 'SCOTUS' AND NOT {_filled('ideology_score')} AND issue_area_source <> 'scdb' AND NOT {_filled('decision_direction')}) AS scotus_unmatched,
count(*) FILTER (WHERE jurisdiction <> 'SCOTUS' AND NOT {_filled('ideology_score')}) AS circuit_unscored, count(*) FILTER (WHERE jurisdiction <> 'SCOTUS' AND NOT {_filled('ideology_score')} AND NOT {_filled('author_str')}) AS circuit_no_author, count(*) FILTER (WHERE jurisdiction <> 'SCOTUS' AND NOT {_filled('issue_area')}) AS circuit_no_topic FROM cases""")
def c14_diagnosis(spark, d):
    return reports.diagnosis(cases(spark, d))


@query(" SELECT lower(trim(disposition)) AS disposition, count(*) FILTER (WHERE jurisdiction = 'SCOTUS') AS SCOTUS, count(*) FILTER (WHERE jurisdiction = 'CA5') AS CA5, count(*) FILTER (WHERE jurisdiction = 'CA9') AS CA9, count(*) AS total FROM cases GROUP BY 1")
def a07_outcomes_by_court(spark, d):
    return reports.outcomes_by_court(cases(spark, d, "disposition", "jurisdiction"))


@query(", s AS (SELECT jurisdiction, coalesce(nullif(trim(issue_area_source), ''), 'unknown') AS s, count(*) AS n FROM cases WHERE trim(issue_area) <> '' GROUP BY 1, 2) SELECT jurisdiction, count(*) FILTER (WHERE trim(issue_area) <> '') AS has, count(*) FILTER (WHERE trim(issue_area) = '') AS miss, (SELECT string_agg(s || ':' || n, ', ' ORDER BY s) FROM s WHERE s.jurisdiction = cases.jurisdiction) AS sources FROM cases GROUP BY 1")
def a03_source_coverage(spark, d):
    found = reports.source_coverage(cases(spark, d, "jurisdiction", "issue_area", "issue_area_source"), "issue_area", "issue_area_source")
    shown = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    return found.select("jurisdiction", "has", "miss", shown.alias("sources"))


@query(" SELECT trim(ideology_source) AS value, count(*) AS n, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share FROM cases GROUP BY 1")
def a01_f51_by_value(spark, d):
    return reports.by_value(cases(spark, d, "ideology_source"), "ideology_source")


@query(", n AS (SELECT trim(case_name) AS k, count(*) AS n FROM cases GROUP BY 1) SELECT count(*) AS names, count(*) FILTER (WHERE n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in FROM n")
def a22_repeated_names(spark, d):
    return reports.repeated_names(cases(spark, d, "case_name"))


@query(" SELECT jurisdiction, ideology, count(*) AS n, count(*) < 10 AS sparse FROM cases GROUP BY 1, 2")
def a02_p15_cells_of_ideology(spark, d):
    return reports.cells(cases(spark, d, "jurisdiction", "ideology"))


@query(", g AS (SELECT DISTINCT case_name, date_filed, judge_name FROM cases WHERE coalesce(trim(opinion_text), '') = ''), b AS (SELECT c.*, (c.case_name, c.date_filed, c.judge_name) IN (SELECT (case_name, date_filed, judge_name) FROM g) AS gap FROM cases c WHERE trim(ideology_source) NOT IN ('', 'judjis', 'martin_quinn')) SELECT count(*) AS n, count(*) FILTER (WHERE gap) AS overlap, count(*) FILTER (WHERE NOT gap) AS usable FROM b")
def p15_j24_unauthorised(spark, d):
    return reports.unauthorised(cases(spark, d))


@query(", e AS (SELECT 'opinion_text' AS field, opinion_text AS v FROM cases UNION ALL SELECT 'syllabus', syllabus FROM cases UNION ALL SELECT 'issue_text', issue_text FROM cases) SELECT field, count(*) AS n, CAST(min(length(v)) AS INTEGER) AS lo, CAST(quantile_disc(length(v), 0.5 ORDER BY length(v) DESC) AS INTEGER) AS median, CAST(max(length(v)) AS INTEGER) AS hi FROM e WHERE trim(v) <> '' GROUP BY 1")
def a04_lengths(spark, d):
    return reports.lengths(cases(spark, d), ["opinion_text", "syllabus", "issue_text", "nothing"])


_KEPT = r", k AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction, regexp_replace(lower(regexp_replace(case_name, '(?i)\s+revisions?:.*$', '')), '[^a-z0-9]', '', 'g'), substr(date_filed, 1, 7) ORDER BY cluster_id) AS rn FROM cases)"


@query(_KEPT + " SELECT jurisdiction, count(*) AS before, count(*) FILTER (WHERE rn = 1) AS after FROM k GROUP BY 1")
def w03_a08_repeated_cases(spark, d):
    """Cases of one month stand in for those of one day, so that some repeat."""
    rows = cases(spark, d, "cluster_id", "jurisdiction", "case_name", "date_filed").withColumn("date_filed", F.substring("date_filed", 1, 7))
    return reports.before_and_after(rows, corpus.drop_repeated_names(rows, "cluster_id"), "jurisdiction")


@query(f" SELECT cluster_id FROM cases WHERE NOT ({_filled('facts')} AND {_filled('issue_text')}) ORDER BY cluster_id LIMIT 40")
def p17_o03_pending(spark, d):
    return reports.pending(cases(spark, d, "cluster_id", "facts", "issue_text")).select("cluster_id").orderBy("cluster_id").limit(40)


@query(", t AS (SELECT CAST(issue_area AS INTEGER) AS topic FROM cases WHERE jurisdiction = 'SCOTUS' AND trim(issue_area) <> '' AND issue_area_source = 'scdb'), m AS (SELECT CASE WHEN topic <= 3 THEN topic WHEN topic <= 5 THEN 4 WHEN topic IN (6, 7, 8, 12) THEN 5 ELSE 6 END AS topic, count(*) AS n FROM t GROUP BY 1) SELECT max(n) / CAST(sum(n) AS DOUBLE) AS share, max_by(topic, n * 100 - topic) AS mode FROM m")
def p16_a15_f50_majority(spark, d):
    truth = evaluation.ground_truth(cases(spark, d, "jurisdiction", "issue_area", "issue_area_source"))
    n = truth.groupBy(evaluation.collapse_topic(F.col("issue_area").cast("int")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("share"), F.max_by("topic", F.struct("n", -F.col("topic"))).alias("mode"))


_TOPICS = ", r AS (SELECT CAST(issue_area AS INTEGER) AS true_issue, CASE WHEN cluster_id % 10 = 0 THEN NULL WHEN cluster_id % 4 = 1 THEN 1 ELSE CAST(issue_area AS INTEGER) END AS pred_issue, CASE WHEN cluster_id % 5 = 0 THEN NULL ELSE (cluster_id % 100) / 100.0::DOUBLE END AS confidence FROM cases WHERE jurisdiction = 'SCOTUS')"


def _topics(spark, d):
    rows = cases(spark, d, "cluster_id", "jurisdiction", "issue_area").where("jurisdiction = 'SCOTUS'")
    pred = F.when(F.col("cluster_id") % 10 == 0, None).when(F.col("cluster_id") % 4 == 1, 1).otherwise(F.col("issue_area").cast("int"))
    sure = F.when(F.col("cluster_id") % 5 != 0, (F.col("cluster_id") % 100) / 100.0)
    return rows.select(F.col("issue_area").cast("int").alias("true_issue"), pred.alias("pred_issue"), sure.alias("confidence"))


@query(_TOPICS + " SELECT true_issue, count(*) AS total, count(*) FILTER (WHERE true_issue = pred_issue) AS correct, round(avg(coalesce(confidence, 0)), 6) AS confidence FROM r WHERE pred_issue IS NOT NULL GROUP BY 1")
def a16_topic_report(spark, d):
    return evaluation.topic_report(_topics(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(_TOPICS + " SELECT count(pred_issue) AS evaluated, count(*) FILTER (WHERE true_issue = pred_issue) AS correct, round(count(*) FILTER (WHERE true_issue = pred_issue) / CAST(count(pred_issue) AS DOUBLE), 6) AS accuracy, count(*) FILTER (WHERE true_issue = pred_issue) >= 0.85 * count(pred_issue) AS passed FROM r")
def a16_gate(spark, d):
    return evaluation.gate(_topics(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(", l AS (SELECT cluster_id, cluster_id % 14 + 1 AS p FROM cases WHERE cluster_id % 2 = 0) SELECT c.cluster_id, CASE WHEN l.p IS NOT NULL AND issue_area_source <> 'scdb' THEN CAST(l.p AS VARCHAR) ELSE issue_area END AS issue_area, CASE WHEN l.p IS NOT NULL AND issue_area_source <> 'scdb' THEN 'lawma' ELSE issue_area_source END AS issue_area_source, CASE WHEN l.p IS NOT NULL AND issue_area_source <> 'scdb' THEN 0.75::DOUBLE END AS lawma_conf FROM cases c LEFT JOIN l USING (cluster_id)")
def j21_topics_back(spark, d):
    rows = cases(spark, d, "cluster_id", "issue_area", "issue_area_source")
    labels = rows.where("cluster_id % 2 = 0").select("cluster_id", (F.col("cluster_id") % 14 + 1).alias("pred_issue"), F.lit(0.75).alias("confidence"))
    weaker = rows.where("cluster_id % 4 = 0").select("cluster_id", F.lit(99).cast("long").alias("pred_issue"), F.lit(0.25).alias("confidence"))
    return evaluation.attach_topics(rows, labels.unionByName(weaker))


@query(", f AS (SELECT CAST(cluster_id AS VARCHAR) AS k, cluster_id % 6 AS r FROM cases WHERE cluster_id % 6 < 2) SELECT cluster_id, CASE WHEN jurisdiction <> 'SCOTUS' AND cluster_id % 6 = 1 THEN 'Later' WHEN jurisdiction <> 'SCOTUS' AND cluster_id % 6 = 0 THEN '' ELSE author_str END AS author_str FROM cases")
def s11_j16_last_correction_wins(spark, d):
    """Two corrections of each named case; the second counts, even where it blanks the author."""
    rows = cases(spark, d, "cluster_id", "jurisdiction", "author_str")
    rest = F.col("cluster_id") % 6
    fixes = rows.where(rest < 2).select("cluster_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("Early").alias("author_str")), F.struct(F.lit(2).alias("at"), F.when(rest == 1, "Later").otherwise("").alias("author_str")))).alias("e")).select("cluster_id", "e.*")
    done = override(rows.where("jurisdiction <> 'SCOTUS'"), fixes, "cluster_id", [F.col("at")])
    return done.unionByName(rows.where("jurisdiction = 'SCOTUS'")).select("cluster_id", "author_str")


@query(", n AS (SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, jurisdiction, case_name, date_filed, 'CA1' AS actual_court, 'b' AS note FROM cases WHERE cluster_id % 40 = 1), o AS (SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, jurisdiction, case_name, date_filed, 'old' AS actual_court, 'old' AS note FROM cases WHERE cluster_id % 80 IN (1, 2)) SELECT * FROM n UNION ALL SELECT * FROM o WHERE cluster_id NOT IN (SELECT cluster_id FROM n)")
def j17_k06_s11_wrong_court(spark, d):
    """The log of cases dropped now, over an older one; blank ids of the list count for nothing, the last entry of a case wins."""
    rows = cases(spark, d, "cluster_id", "jurisdiction", "case_name", "date_filed")
    key = F.col("cluster_id").cast("string")
    entry = lambda court, note: F.struct(F.lit(court).alias("actual_court"), F.lit(note).alias("note"))
    listed = rows.where("cluster_id % 40 = 1").select(F.concat(F.lit(" "), key).alias("cluster_id"), F.explode(F.array(entry("CA1", "a"), entry("CA1", "b"))).alias("e")).select("cluster_id", "e.*")
    listed = listed.unionByName(spark.createDataFrame([(" ", "CA2", "blank")], "cluster_id string, actual_court string, note string"))
    old = rows.where("cluster_id % 80 IN (1, 2)").select(key.alias("cluster_id"), "jurisdiction", "case_name", "date_filed", F.lit("old").alias("actual_court"), F.lit("old").alias("note"))
    kept, log = corpus.drop_wrong_court(rows, listed, old)
    return log


@query(" SELECT cluster_id FROM cases ORDER BY jurisdiction, date_filed, cluster_id LIMIT 50")
def o01_final_order(spark, d):
    rows = cases(spark, d, "cluster_id", "jurisdiction", "date_filed").withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return D.in_order(rows).limit(50).select(F.col("cluster_id").cast("long").alias("cluster_id"))


@query(" SELECT jurisdiction, count(*) AS n, NULL::BIGINT AS acc FROM cases GROUP BY 1 UNION ALL BY NAME SELECT 'new' AS jurisdiction, CAST(7 AS BIGINT) AS acc")
def u05_k09_log_with_new_columns(spark, d):
    old = cases(spark, d, "jurisdiction").groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.append_log(old, spark.createDataFrame([("new", 7)], "jurisdiction string, acc long"))


_PROMPT = "trim('Court: ' || jurisdiction || chr(10) || {ide}chr(10) || 'Question presented:' || chr(10) || trim(issue_text) || chr(10) || chr(10) || 'Facts:' || chr(10) || trim(facts))"
_IDE = "CASE WHEN ideology <> '' THEN 'Authoring judge ideology: ' || ideology || chr(10) ELSE '' END || "
_USABLE = f"{_filled('opinion_text')} AND {_filled('facts')} AND {_filled('issue_text')}"


def _records(spark, d):
    rows = cases(spark, d)
    keyed = rows.where(records.is_usable(rows)).withColumn("author_key", C.author_key(F.col("jurisdiction"), F.col("author_str"), F.col("judge_name"), F.col("cluster_id"))).withColumn("split", F.lit("train"))
    return records.split_records(keyed, 40)


def _flat(chats):
    said = lambda i: F.col("messages")[i]["content"]
    return chats.select("meta.id", said(1).alias("asked"), said(2).alias("answer"), "meta.outcome_usable", F.concat_ws("|", *[f"meta.{c}" for c in ("case_name", "disposition", "prevailing_party", "ideology", "ideology_score", "issue_area", "decision_direction")]).alias("meta"))


_META = "concat_ws('|', case_name, disposition, prevailing_party, ideology, ideology_score, issue_area, decision_direction) AS meta"


@query(f" SELECT CAST(cluster_id AS VARCHAR) AS id, {_PROMPT.format(ide=_IDE)} || chr(10) || chr(10) || 'Write the opinion.' AS asked, trim(left(opinion_text, 30)) || chr(10) || chr(10) || 'Disposition: ' || disposition AS answer, lower(trim(disposition)) NOT IN ('', 'unclear') AS outcome_usable, {_META} FROM cases WHERE {_USABLE}")
def c11_f43_p06_generation_records(spark, d):
    return _flat(records.chat_records(_records(spark, d), "generation", most_chars=30, with_ideology=True))


@query(f" SELECT CAST(cluster_id AS VARCHAR) AS id, {_PROMPT.format(ide='')} || chr(10) || chr(10) || 'Disposition:' AS asked, disposition AS answer, true AS outcome_usable, {_META} FROM cases WHERE {_USABLE} AND lower(trim(disposition)) NOT IN ('', 'unclear')")
def c11_p14_prediction_records(spark, d):
    return _flat(records.chat_records(_records(spark, d).where("outcome_usable"), "predict"))


@query(f" SELECT CAST(cluster_id AS VARCHAR) AS id, jurisdiction = 'SCOTUS' AS supreme, CASE WHEN length(opinion_text) > 40 THEN left(opinion_text, 40) END AS capped, CASE WHEN jurisdiction = 'SCOTUS' THEN 'scotus::' || coalesce(nullif(lower(trim(judge_name)), ''), '_unknown_' || cluster_id) ELSE lower(jurisdiction) || '::' || coalesce(nullif(lower(trim(author_str)), ''), '_unknown_' || cluster_id) END AS author_key FROM cases WHERE {_USABLE}")
def f41_split_records(spark, d):
    return _records(spark, d).select("id", (F.col("input.court") == "SCOTUS").alias("supreme"), F.col("targets.opinion_text_capped").alias("capped"), "author_key")


_PREDS = ", p AS (SELECT cluster_id AS id, jurisdiction, lower(disposition) AS gold, CASE WHEN cluster_id % 5 = 0 THEN 'reversed' WHEN cluster_id % 7 = 0 THEN 'granted' ELSE lower(disposition) END AS pred, opinion_text, issue_text, facts FROM cases)"


def _preds(spark, d):
    rows = cases(spark, d, "cluster_id", "jurisdiction", "disposition", "opinion_text")
    gold = F.lower("disposition")
    pred = F.when(F.col("cluster_id") % 5 == 0, "reversed").when(F.col("cluster_id") % 7 == 0, "granted").otherwise(gold)
    return rows.select(F.col("cluster_id").alias("id"), "jurisdiction", gold.alias("gold_disposition"), pred.alias("pred_disposition"), F.coalesce("opinion_text", F.lit("")).alias("generated_text"))


@query(_PREDS + ", l AS (SELECT DISTINCT gold AS label FROM p UNION SELECT pred FROM p), t AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM p WHERE gold <> label AND pred = label) AS fp, (SELECT count(*) FROM p WHERE gold = label AND pred <> label) AS fn FROM l), c AS (SELECT jurisdiction, avg(CAST(gold = pred AS INTEGER)) AS a FROM p GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy, (SELECT round(avg(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) FROM t) AS macro_f1, (SELECT string_agg(jurisdiction || '=' || printf('%.4f', a), ' ' ORDER BY jurisdiction) FROM c) AS courts FROM p")
def c12_a10_a11_outcome(spark, d):
    found = evaluation.outcome_metrics(_preds(spark, d))
    courts = F.array_join(F.transform(F.map_entries("accuracy_by_court"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), " ")
    return found.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), courts.alias("courts"))


_STYLE = "SELECT '{side}' AS side, regexp_extract_all({text}, '[A-Za-z'']+') AS w, greatest(1, len(list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda s: trim(s, ' ') <> ''))) AS s FROM {rel}"
_STATS = ", s AS (SELECT side, len(w) AS n, CASE WHEN len(w) > 0 THEN len(w) / CAST(s AS DOUBLE) END AS sentence_words, CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / CAST(len(w) AS DOUBLE) END AS ttr, CASE WHEN len(w) > 0 THEN 0.39::DOUBLE * len(w) / s + 11.8::DOUBLE * list_sum(list_transform(w, lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+'))) END)) / len(w) - 15.59::DOUBLE END AS grade FROM g) SELECT side, round(avg(n), 6) AS words, round(avg(sentence_words), 6) AS sentence_words, round(avg(ttr), 6) AS ttr, round(avg(grade), 6) AS grade FROM s GROUP BY 1"


@query(_PREDS + ", g AS (" + _STYLE.format(side="generated", text="coalesce(opinion_text, '')", rel="p") + " UNION ALL " + _STYLE.format(side="authentic", text="opinion_text", rel=f"cases WHERE {_USABLE}") + ")" + _STATS)
def c12_a13_j22_discourse(spark, d):
    found = evaluation.discourse(_preds(spark, d), _records(spark, d))
    return found.select("side", *[F.round(c, 6).alias(c) for c in ("words", "sentence_words", "ttr", "grade")])


@query(f", r AS (SELECT * FROM cases WHERE {_USABLE}) SELECT CAST(c.cluster_id AS VARCHAR) AS id, c.jurisdiction, coalesce(left(r.issue_text, 2000), '') AS issue, coalesce(left(r.facts, 2000), '') AS facts, left(coalesce(c.opinion_text, ''), 6000) AS text FROM cases c LEFT JOIN r USING (cluster_id)")
def j23_judge_prompts(spark, d):
    return evaluation.judge_prompts(_preds(spark, d), _records(spark, d))


_AXIS = "CASE WHEN try_cast({0} AS DOUBLE) IS NOT NULL THEN greatest(1, least(5, CAST(round_even(try_cast({0} AS DOUBLE), 0) AS INTEGER))) END"


@query(f", s AS (SELECT {_AXIS.format('ideology_score')} AS coherence, {_AXIS.format('issue_area')} AS terminology, {_AXIS.format('NULL')} AS institutional_fit, {_AXIS.format('decision_direction')} AS faithfulness FROM cases), m AS (SELECT count(*) AS n, avg(coherence) AS coherence, avg(terminology) AS terminology, avg(institutional_fit) AS institutional_fit, avg(faithfulness) AS faithfulness FROM s) SELECT n, round(coherence, 6) AS coherence, round(terminology, 6) AS terminology, institutional_fit, round(faithfulness, 6) AS faithfulness, round((coherence + terminology + faithfulness) / 3, 6) AS overall FROM m")
def a14_f48_judge_summary(spark, d):
    rows = cases(spark, d, "ideology_score", "issue_area", "decision_direction")
    scores = rows.select(F.col("ideology_score").alias("coherence"), F.col("issue_area").alias("terminology"), F.lit(None).cast("string").alias("institutional_fit"), F.col("decision_direction").alias("faithfulness"))
    return evaluation.judge_summary(scores).select("n", *[F.round(c, 6).alias(c) for c in (*evaluation.AXES, "overall")])


_IDEOLOGY = ", a AS (SELECT ideology AS gold, CASE WHEN cluster_id % 4 = 0 THEN 'no idea' WHEN cluster_id % 5 = 0 THEN 'It is CONSERVATIVE' ELSE ' ' || upper(ideology) || '.' END AS answer FROM cases), r AS (SELECT gold, CASE WHEN answer ILIKE '%liberal%' THEN 'Liberal' WHEN answer ILIKE '%conservative%' THEN 'Conservative' WHEN answer ILIKE '%moderate%' THEN 'Moderate' END AS pred FROM a WHERE gold IN ('Liberal', 'Conservative', 'Moderate')), v AS (SELECT * FROM r WHERE pred IS NOT NULL)"


@query(_IDEOLOGY + ", t AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold <> label AND pred = label) AS fp, count(*) FILTER (WHERE gold = label AND pred <> label) AS fn FROM (VALUES ('Liberal'), ('Conservative'), ('Moderate')) l(label), v GROUP BY 1) SELECT count(*) AS n_evaluated, round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy_3way, (SELECT round(avg(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) FROM t) AS macro_f1_3way, round(avg(CAST(gold = pred AS INTEGER)) FILTER (WHERE gold <> 'Moderate'), 6) AS accuracy_2way FROM v")
def p13_a12_ideology_scores(spark, d):
    rows = cases(spark, d, "cluster_id", "ideology")
    answer = F.when(F.col("cluster_id") % 4 == 0, "no idea").when(F.col("cluster_id") % 5 == 0, "It is CONSERVATIVE").otherwise(F.concat(F.lit(" "), F.upper("ideology"), F.lit(".")))
    found = evaluation.ideology_scores(rows.select(F.col("ideology").alias("gold"), answer.alias("answer")))
    return found.select("n_evaluated", *[F.round(c, 6).alias(c) for c in ("accuracy_3way", "macro_f1_3way", "accuracy_2way")])


@query(", c AS (SELECT cluster_id, unnest(range(0, cluster_id % 4)) AS k FROM cases) SELECT count(*) AS citations_found, count(*) FILTER (WHERE (cluster_id + k) % 9 = 0 OR (cluster_id + k) % 5 = 0) AS hallucinated, round(count(*) FILTER (WHERE (cluster_id + k) % 9 = 0 OR (cluster_id + k) % 5 = 0) / CAST(count(*) AS DOUBLE), 6) AS hallucination_rate FROM c")
def a24_citation_rate(spark, d):
    """Answers of the lookup service follow from the case: not found (404) or found without a cluster."""
    one = lambda k: F.struct(F.when((F.col("cluster_id") + k) % 9 == 0, 404).otherwise(200).alias("status"), F.when((F.col("cluster_id") + k) % 5 == 0, 0).otherwise(1).alias("clusters"))
    many = (F.col("cluster_id") % 4).cast("int")
    answers = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), one)).otherwise(F.array().cast("array<struct<status:int,clusters:int>>"))
    return evaluation.citation_rate(cases(spark, d, "cluster_id").select("cluster_id", answers.alias("answers"))).withColumn("hallucination_rate", F.round("hallucination_rate", 6))


@query(", g AS (SELECT jurisdiction, disposition, count(*) AS size FROM cases GROUP BY 1, 2), q AS (SELECT *, 300 * size / CAST(sum(size) OVER () AS DOUBLE) AS q FROM g), r AS (SELECT *, floor(q) AS f, row_number() OVER (ORDER BY q - floor(q) DESC, jurisdiction, disposition) AS rn FROM q) SELECT jurisdiction, disposition, CAST(f + CASE WHEN rn <= 300 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS n FROM r WHERE f > 0 OR rn <= 300 - (SELECT sum(f) FROM r)")
def w10_quotas(spark, d):
    """Rows of each stratum in a sample of 300."""
    rows = cases(spark, d, "cluster_id", "jurisdiction", "disposition")
    drawn = records.stratified_sample(rows, ["jurisdiction", "disposition"], "cluster_id", 300)
    return drawn.groupBy("jurisdiction", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query(", w AS (SELECT cluster_id, facts, issue_text, coalesce(opinion_text, '') AS t, list_filter(string_split(coalesce(opinion_text, ''), ' '), lambda x: x <> '') AS w FROM cases) SELECT cluster_id, CASE WHEN ask THEN trim(array_to_string(w[1:12], ' ')) ELSE issue_text END AS issue_text, CASE WHEN ask THEN trim(array_to_string(w[13:40], ' ')) ELSE facts END AS facts, CASE WHEN ask THEN CASE WHEN t LIKE '%affirmed in part%' THEN 'affirmed_in_part' WHEN t LIKE '%reversed%' THEN 'reversed' ELSE 'unclear' END ELSE '' END AS disposition FROM (SELECT *, coalesce(trim(facts), '') = '' OR coalesce(trim(issue_text), '') = '' AS ask FROM w)")
def x01_x02_f40_t02_field_extraction(spark, d):
    """Only rows without facts or question are asked; the stub answers by a text's words."""
    done, _ = extraction.enrich_fields(cases(spark, d, "cluster_id", "opinion_text", "facts", "issue_text"))
    return done.select("cluster_id", "issue_text", "facts", "disposition")


_ENRICHED = ("issue_area", "issue_area_source", "decision_direction", "scdb_id")


@query(", l AS (SELECT cluster_id, cluster_id % 2 = 0 AND issue_area_source <> 'scdb' AS takes, * EXCLUDE (cluster_id) FROM cases) SELECT 'issue_area' AS field, count(*) FILTER (WHERE trim(issue_area) <> '') AS before, count(*) FILTER (WHERE takes OR trim(issue_area) <> '') AS after FROM l UNION ALL SELECT 'issue_area_source', count(*) FILTER (WHERE trim(issue_area_source) <> ''), count(*) FILTER (WHERE takes OR trim(issue_area_source) <> '') FROM l UNION ALL SELECT 'decision_direction', count(*) FILTER (WHERE trim(decision_direction) <> ''), count(*) FILTER (WHERE trim(decision_direction) <> '') FROM l UNION ALL SELECT 'scdb_id', 0, 0")
def a09_filled_before_and_after(spark, d):
    """What topic labels fill; a field that neither table has counts nothing."""
    rows = cases(spark, d, "cluster_id", "issue_area", "issue_area_source", "decision_direction")
    labels = rows.where("cluster_id % 2 = 0").select("cluster_id", (F.col("cluster_id") % 14 + 1).alias("pred_issue"), F.lit(0.75).alias("confidence"))
    return reports.filled_before_and_after(rows, evaluation.attach_topics(rows, labels), list(_ENRICHED))


def _section(title: str, columns: list[str], relation: str) -> str:
    line = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"SELECT '{title}' AS section, {line} AS line FROM ({relation})"


def _values(field: str, where: str = "true") -> str:
    return f"SELECT coalesce(trim({field}), '') AS v, count(*) AS n, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share FROM cases WHERE {where} GROUP BY 1"


def _covered(field: str, source: str) -> str:
    return f"SELECT jurisdiction, count(*) FILTER (WHERE trim({field}) <> '') AS has, count(*) FILTER (WHERE trim({field}) = '') AS miss, (SELECT string_agg(s || ':' || n, ', ' ORDER BY s) FROM (SELECT jurisdiction AS j, coalesce(nullif(trim({source}), ''), 'unknown') AS s, count(*) AS n FROM cases WHERE trim({field}) <> '' GROUP BY 1, 2) x WHERE x.j = cases.jurisdiction) AS sources FROM cases GROUP BY 1"


_NAMES = "SELECT trim(case_name) AS name, count(*) AS n FROM cases WHERE trim(case_name) <> '' GROUP BY 1"
_SECTIONS = [
    _section("Courts", ["v", "n", "share"], _values("jurisdiction")),
    _section("Repeated names", ["names", "repeated", "rows_in"], f"SELECT count(*) AS names, count(*) FILTER (WHERE n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in FROM ({_NAMES})"),
    _section("Most repeated", ["name", "n"], f"SELECT * FROM ({_NAMES}) WHERE n > 1 ORDER BY n DESC, name LIMIT 10"),
    _section("Ideology", ["v", "n", "share"], _values("ideology")),
    _section("Court by ideology", ["jurisdiction", "ideology", "n", "sparse"], "SELECT jurisdiction, ideology, count(*) AS n, count(*) < 10 AS sparse FROM cases GROUP BY 1, 2"),
    _section("Ideology sources", ["v", "n", "share"], _values("ideology_source")),
    _section("Topic coverage", ["jurisdiction", "has", "miss", "sources"], _covered("issue_area", "issue_area_source")),
    _section("Topics", ["v", "n", "share"], _values("issue_area", "trim(issue_area) <> ''")),
    _section("Score coverage", ["jurisdiction", "has", "miss", "sources"], _covered("ideology_score", "ideology_source")),
    _section("Score range", ["jurisdiction", "n", "lo", "hi", "mean"], "SELECT jurisdiction, count(x) AS n, printf('%.2f', min(x)) AS lo, printf('%.2f', max(x)) AS hi, printf('%.2f', avg(x)) AS mean FROM (SELECT jurisdiction, try_cast(ideology_score AS DOUBLE) AS x FROM cases) GROUP BY 1 HAVING count(x) > 0"),
    _section("Text coverage", ["jurisdiction", "n", "filled"], f"SELECT jurisdiction, count(*) AS n, count(*) FILTER (WHERE {_filled('opinion_text')}) AS filled FROM cases GROUP BY 1"),
    _section("Unauthorised sources", ["n", "overlap", "usable"], "WITH g AS (SELECT DISTINCT case_name, date_filed, judge_name FROM cases WHERE coalesce(trim(opinion_text), '') = ''), b AS (SELECT c.*, (c.case_name, c.date_filed, c.judge_name) IN (SELECT (case_name, date_filed, judge_name) FROM g) AS gap FROM cases c WHERE trim(ideology_source) NOT IN ('', 'judjis', 'martin_quinn')) SELECT count(*) AS n, count(*) FILTER (WHERE gap) AS overlap, count(*) FILTER (WHERE NOT gap) AS usable FROM b"),
    _section("Missing values", ["field", "n", "present", "missing"], f"SELECT field, count(*) AS n, count(*) FILTER (WHERE there) AS present, count(*) FILTER (WHERE NOT there) AS missing FROM ({_FIELDS}) GROUP BY 1"),
    _section("Lengths", ["field", "n", "lo", "median", "hi"], "SELECT field, count(*) AS n, min(length(v)) AS lo, CAST(quantile_disc(length(v), 0.5 ORDER BY length(v) DESC) AS INTEGER) AS median, max(length(v)) AS hi FROM (SELECT 'opinion_text' AS field, opinion_text AS v FROM cases UNION ALL SELECT 'syllabus', syllabus FROM cases UNION ALL SELECT 'issue_text', issue_text FROM cases) WHERE trim(v) <> '' GROUP BY 1"),
]


@query(" " + " UNION ALL ".join(_SECTIONS))
def c13_k08_statistics_report(spark, d):
    """All sections of the statistics report, a line for each of their rows."""
    return reports.as_lines(reports.statistics(cases(spark, d)))
