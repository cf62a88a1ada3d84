"""Deduplication over the driver's documents, each given a court, a name and a date by its key; the SQL follows the rules row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.functions.columns import norm_name_spaced
from quillfold.functions.opinions import is_compare_page, strip_compare_page
from quillfold.operators import dedup, revisions
from quillfold.operators.relational import cut_lineage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Documents by groups of eight as cases of one name, so that copies of a document and its neighbours can meet.
RULES = {
    "cluster_id": "doc_id",
    "jurisdiction": "CASE WHEN doc_id % 16 < 8 THEN 'SCOTUS' ELSE 'CA9' END",
    "case_name": "CASE WHEN doc_id % 3 = 0 THEN 'Ionic v. Harbor' ELSE 'IONIC v. Orchard' END || CASE WHEN doc_id % 5 = 0 THEN ' Revisions: 1' ELSE '' END",
    "author_str": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Author ' || CAST(doc_id % 3 AS STRING) END",
    "issue_text": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Question ' || CAST(doc_id % 4 AS STRING) END",
    "scdb_id": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id % 9 AS STRING) END",
    "opinion_text": "CASE WHEN doc_id % 61 = 0 THEN 'Compare Results  Old File: a file://NoURLProvided[1] ' || text WHEN doc_id % 53 = 0 THEN 'VACANCY ANNOUNCEMENT ' || text WHEN doc_id % 47 = 0 THEN 'Justice Roe, concurring. ' || text WHEN doc_id % 43 = 0 THEN text || repeat(' x', 160) || ' SMITH, Circuit Judge, dissenting' WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 10 = 0 THEN 'REVISED No. 19-' || CAST(10000 + doc_id % 3 AS STRING) || ' ' || text WHEN doc_id % 10 = 1 THEN '(Slip Opinion) No. 19-' || CAST(10000 + doc_id % 3 AS STRING) || ' ' || text ELSE text END",
}
DAYS = 1500
_RULED = ", ".join(f"{rule} AS {name}" for name, rule in RULES.items())


def rows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    filed = F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(F.col("cluster_id") * 37, F.lit(DAYS)).cast("int")).cast("string")
    return docs.selectExpr(*[f"{rule} AS {name}" for name, rule in RULES.items()]).withColumn("date_filed", _filed(filed))


def _filed(filed):
    """One date for all of a stand-in's year in the Supreme Court's even ids, so that cases of one day meet."""
    return F.when(F.col("cluster_id") % 16 < 4, F.concat(F.substring(filed, 1, 4), F.lit("-06-30"))).otherwise(filed)


BASE = rf"""WITH RECURSIVE raw AS (SELECT {_RULED}, CAST(DATE '2015-01-01' + CAST((doc_id * 37) % {DAYS} AS INTEGER) AS DATE) AS d0 FROM documents),
named AS (SELECT * EXCLUDE (d0, opinion_text), CASE WHEN cluster_id % 16 < 4 THEN make_date(year(d0), 6, 30) ELSE d0 END AS filed, opinion_text LIKE 'Compare Results%' AS compared,
CASE WHEN opinion_text LIKE 'Compare Results%' THEN trim(replace(opinion_text, 'Compare Results  Old File: a file://NoURLProvided[1]', ''), chr(32) || chr(9) || chr(10) || chr(13)) ELSE opinion_text END AS opinion_text,
trim(regexp_replace(lower(regexp_replace(case_name, '(?i)\s+revisions?:.*$', '')), '[^a-z0-9 ]', '', 'g')) AS name FROM raw)"""


def _shingles(text: str, pattern: str | None) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9]+')" if pattern is None else f"list_filter(regexp_split_to_array(lower(substr({text}, 1, 20000)), '{pattern}'), lambda x: x <> '')"
    return f"SELECT cluster_id, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM (SELECT cluster_id, {words} AS w FROM {{rel}})"


TWINS = """, twins AS (SELECT a.cluster_id, min(b.cluster_id) AS kept FROM named a JOIN named b ON a.jurisdiction = b.jurisdiction AND a.name = b.name AND a.compared AND NOT b.compared AND abs(date_diff('day', a.filed, b.filed)) <= 400 GROUP BY 1)"""

JUNK = r""", left1 AS (SELECT * FROM named WHERE cluster_id NOT IN (SELECT cluster_id FROM twins)),
marked AS (SELECT *, CASE WHEN regexp_matches(left(opinion_text, 500), '(?i)VACANCY ANNOUNCEMENT|JUDICIAL COUNCIL OF THE NINTH CIRCUIT') THEN 'junk' WHEN cluster_id % 97 = 5 THEN 'wrong_court'
WHEN regexp_matches(left(opinion_text, 400), '(?i)^\W*(?:Chief\s+)?Justice\s[^.]{0,120}?(?:concurring|dissenting)') THEN 'separate_writing'
WHEN regexp_matches(substr(opinion_text, 301), '[A-Z]{3,},?\s+(?:Senior\s+|Chief\s+)?(?:Circuit\s+|District\s+)?Judge,?\s+(?:concurring|dissenting)') THEN 'embedded_separate_writing' END AS reason FROM left1),
exact AS (SELECT cluster_id, first_value(cluster_id) OVER (PARTITION BY opinion_text ORDER BY filed DESC, cluster_id DESC) AS kept FROM marked WHERE reason IS NULL),
left2 AS (SELECT * FROM marked WHERE reason IS NULL AND cluster_id NOT IN (SELECT cluster_id FROM exact WHERE cluster_id <> kept))"""

AMENDED = ", sh AS (" + _shingles("opinion_text", r"\s+").format(rel="left2") + r"""), mk AS (SELECT l.*, s, regexp_matches(left(opinion_text, 3000), '(?i)\bREVISED\b') AS rev, row_number() OVER (PARTITION BY jurisdiction, name ORDER BY filed DESC, cluster_id DESC) AS rk FROM left2 l JOIN sh USING (cluster_id)),
pr AS (SELECT a.cluster_id AS newer, b.cluster_id AS older, a.rk AS newer_rk, len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) AS sim, a.rev OR b.rev AS rev FROM mk a JOIN mk b ON a.jurisdiction = b.jurisdiction AND a.name = b.name AND a.rk < b.rk AND date_diff('day', b.filed, a.filed) <= 400 AND len(a.s) > 0 AND len(b.s) > 0),
good AS (SELECT * FROM pr WHERE sim >= 0.5 OR (sim >= 0.05 AND rev)), news AS (SELECT older, list(newer) AS newers FROM good GROUP BY 1),
walk AS (SELECT jurisdiction, name, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM mk GROUP BY 1, 2 UNION ALL
SELECT w.jurisdiction, w.name, m.rk, CASE WHEN n.newers IS NOT NULL AND list_has_any(n.newers, w.kept) THEN w.kept ELSE list_append(w.kept, m.cluster_id) END FROM walk w JOIN mk m ON m.jurisdiction = w.jurisdiction AND m.name = w.name AND m.rk = w.rk + 1 LEFT JOIN news n ON n.older = m.cluster_id),
stay AS (SELECT unnest(max_by(kept, rk)) AS cluster_id FROM walk GROUP BY jurisdiction, name),
amended AS (SELECT older AS cluster_id, min_by(newer, newer_rk) AS kept, min_by(sim, newer_rk) AS sim, min_by(CASE WHEN sim >= 0.5 THEN 'amended_earlier_version' ELSE 'revised_marker' END, newer_rk) AS reason FROM good WHERE newer IN (SELECT cluster_id FROM stay) AND older NOT IN (SELECT cluster_id FROM stay) GROUP BY 1)"""

NEAR = (
    """, left3 AS (SELECT l.*, list_distinct(flatten(list_transform(regexp_extract_all(left(opinion_text, 2500), '\\bNos?\\.?\\s*((?:\\d{2}-\\d{3,6})(?:\\s*(?:,|and|&)\\s*\\d{2}-\\d{3,6})*)'), lambda x: regexp_extract_all(x, '\\d{2}-\\d{3,6}')))) AS dock, list_distinct(list_filter(regexp_extract_all(lower(case_name), '[a-z]{3,}'), lambda x: x NOT IN ('united', 'states'))) AS words FROM left2 l WHERE cluster_id IN (SELECT cluster_id FROM stay)),
tx AS ("""
    + _shingles("opinion_text", None).format(rel="left3")
    + """), cand AS (SELECT a.cluster_id AS a, b.cluster_id AS b, a.jurisdiction = 'SCOTUS' AND ((a.scdb_id <> '' AND a.scdb_id = b.scdb_id) OR (a.filed = b.filed AND list_has_any(a.words, b.words))) AS same FROM left3 a JOIN left3 b ON a.jurisdiction = b.jurisdiction AND a.cluster_id < b.cluster_id
WHERE list_has_any(a.dock, b.dock) OR (a.issue_text <> '' AND a.issue_text = b.issue_text) OR (a.jurisdiction = 'SCOTUS' AND ((a.scdb_id <> '' AND a.scdb_id = b.scdb_id) OR (a.filed = b.filed AND list_has_any(a.words, b.words)))) OR (trim(a.author_str) <> '' AND a.author_str = b.author_str AND abs(date_diff('day', a.filed, b.filed)) <= 365 AND list_has_any(a.words, b.words))),
near AS (SELECT a, b, len(list_intersect(x.s, y.s)) / CAST(len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) AS DOUBLE) AS sim, same FROM cand JOIN tx x ON a = x.cluster_id JOIN tx y ON b = y.cluster_id WHERE len(x.s) > 0 AND len(y.s) > 0 AND len(list_intersect(x.s, y.s)) > 0),
nd AS (SELECT a, b, sim FROM near WHERE sim >= 0.5 OR (same AND sim >= 0.2)),
ed AS (SELECT a, b FROM nd UNION SELECT b, a FROM nd), reach AS (SELECT a AS node, a AS root FROM ed UNION SELECT ed.b, reach.root FROM reach JOIN ed ON reach.node = ed.a),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
best AS (SELECT node, first_value(node) OVER (PARTITION BY c ORDER BY CASE WHEN jurisdiction = 'SCOTUS' THEN CAST(opinion_text NOT LIKE '(Slip Opinion)%' AS INTEGER) ELSE date_diff('day', DATE '2000-01-01', filed) END DESC, length(opinion_text) DESC, node) AS kept FROM comp JOIN left3 ON node = cluster_id),
gone AS (SELECT node AS cluster_id, kept, sim FROM best LEFT JOIN nd ON nd.a = least(node, kept) AND nd.b = greatest(node, kept) WHERE node <> kept)"""
)

LOG = """ SELECT cluster_id, 'compare_page_copy' AS reason, CAST(kept AS VARCHAR) AS kept_cluster_id, '' AS similarity FROM twins UNION ALL SELECT cluster_id, reason, '', '' FROM marked WHERE reason IS NOT NULL UNION ALL SELECT cluster_id, 'exact_duplicate', CAST(kept AS VARCHAR), '1.00' FROM exact WHERE cluster_id <> kept
UNION ALL SELECT cluster_id, reason, CAST(kept AS VARCHAR), printf('%.2f', sim) FROM amended UNION ALL SELECT cluster_id, 'near_duplicate', CAST(kept AS VARCHAR), coalesce(printf('%.2f', sim), '') FROM gone"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _prepared(spark, d):
    table = rows(spark, d).withColumn("compared", is_compare_page(F.col("opinion_text")))
    return table.withColumn("opinion_text", strip_compare_page(F.col("opinion_text"))).withColumn("name", norm_name_spaced(F.col("case_name"))).withColumn("filed", F.to_date("date_filed")).withColumn("_ord", F.col("cluster_id"))


@query(BASE + TWINS + " SELECT cluster_id, kept FROM twins")
def j18_f32_compare_twins(spark, d):
    return dedup.compare_twins(_prepared(spark, d)).select("cluster_id", F.col("kept_cluster_id").alias("kept"))


@query(BASE + TWINS + JUNK + AMENDED + " SELECT newer, older, round(sim, 6) AS similarity, CASE WHEN sim >= 0.5 THEN 'amended_earlier_version' ELSE 'revised_marker' END AS reason FROM good")
def j19_p12_amended_pairs(spark, d):
    table = _prepared(spark, d)
    excluded = table.where("cluster_id % 97 = 5").select("cluster_id")
    left = dedup.without(table, cut_lineage(dedup.compare_twins(table).select("cluster_id")))
    left = dedup.without(left, cut_lineage(dedup.junk_and_exact(left, excluded).select("cluster_id")))
    pairs = revisions.amended_pairs(left.select(F.col("cluster_id").alias("id"), F.col("jurisdiction").alias("court"), "name", "filed", F.col("opinion_text").alias("text")))
    return pairs.select("newer", "older", F.round("similarity", 6).alias("similarity"), "reason")


@query(BASE + TWINS + JUNK + AMENDED + NEAR + LOG)
def c08_j18_j19_j20_p11_w04_w09_dedup(spark, d):
    """The log of all four steps in their order."""
    table = rows(spark, d)
    _, log = dedup.dedupe(table, table.where("cluster_id % 97 = 5").select("cluster_id"))
    return log.select("cluster_id", "reason", "kept_cluster_id", "similarity")
