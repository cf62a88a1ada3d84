"""From bulk tables to cases, and what reference tables add: over tables made from the given keys, and on literal rows for tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.operators import corpus, enrichment
from quillfold.operators.relational import active_open, active_started
from quillfold.plans.literals import Fixture

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The same functions on literal rows, with their SQL, for tests.
LITERALS: dict[str, tuple] = {}


class Rules:
    """Columns made from the keys of a given table, by expressions that Spark and DuckDB read alike; `k` counts the copies of a row."""

    def __init__(self, table: str, columns: dict[str, str], copies: int = 0, where: str = "true"):
        self.table, self.columns, self.copies, self.where = table, columns, copies, where

    def spread(self, spark, d: str):
        rows = spark.read.parquet(f"{d}/{self.table}.parquet")
        if self.copies:
            rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k + 1) for k in range(self.copies)])))
        return rows.where(self.where).selectExpr(*[f"{rule} AS `{name}`" for name, rule in self.columns.items()])

    @property
    def spread_sql(self) -> str:
        copies = f", (VALUES {', '.join(f'({k + 1})' for k in range(self.copies))}) s(k)" if self.copies else ""
        return f"(SELECT {', '.join(f'{rule} AS "{name}"' for name, rule in self.columns.items())} FROM {self.table}{copies} WHERE {self.where}) t"


def letters(number: str) -> str:
    """A number's digits as letters."""
    return f"translate(CAST({number} AS STRING), '0123456789', 'abcdefghij')"


def literal(sql: str, **fixtures: Fixture):
    """Keep a function of several literal frames and its SQL for tests; {name} in the SQL is that fixture."""

    def keep(f):
        text = sql
        for name, fixture in fixtures.items():
            text = text.replace("{" + name + "}", fixture.sql)
        LITERALS[f.__name__] = (lambda spark: f(**{k: v.df(spark) for k, v in fixtures.items()}), text)
        return f

    return keep


def over(sql: str, **tables):
    """Register a function of several frames that are made from the given tables; {name} in the SQL is that relation."""

    def register(f):
        text = sql
        for name, table in tables.items():
            text = text.replace("{" + name + "}", table.spread_sql)
        QUERIES[f.__name__] = lambda spark, d: f(**{k: v.spread(spark, d) for k, v in tables.items()})
        ORACLES[f.__name__] = text
        return f

    return register


SPANS = Fixture("id int, d string, a string, b string", [(i, *r) for i, r in enumerate([("2020-01-01", "2019-01-01", None), ("2020-01-01", "2020-01-01", "2020-01-01"), ("2020-01-01", None, "2021-01-01"), ("2020-01-01", None, None), (None, "2019-01-01", None), ("2020-01-01", "2020-01-02", None), ("2020-01-01", "2010-01-01", "2019-12-31"), (None, None, None)])], free=True)
_ACTIVE = "SELECT id, d IS NULL OR (coalesce(a <= d, true) AND coalesce(b >= d, true)) AS open, d IS NOT NULL AND a IS NOT NULL AND a <= d AND (b IS NULL OR d <= b) AS started FROM {t}"


@over(_ACTIVE, t=SPANS)
@literal(_ACTIVE, t=SPANS)
def p10_active_on_date(t):
    x = t.select("id", *[F.to_date(c).alias(c) for c in "dab"])
    cols = [F.col(c) for c in "dab"]
    return x.select("id", F.coalesce(active_open(*cols), F.lit(False)).alias("open"), F.coalesce(active_started(*cols), F.lit(False)).alias("started"))


BULK_DOCKETS = Fixture("id string, court_id string", [("d1", "scotus"), ("d2", "ca5"), ("d3", "ca9"), ("d4", "ca1"), ("", "ca9")])
BULK_CLUSTERS = Fixture(
    "ord int, id string, docket_id string, case_name string, case_name_full string, date_filed string, precedential_status string, judges string, headnotes string, summary string",
    [
        (1, "c1", "d1", "A v. B", "", "2015-02-01", "Published", "Roe", "h", "s"),
        (2, "c2", "d2", "", "Full C v. D", "2016-03-01", "", "", "", "sum"),
        (3, "c3", "d3", "E v. F", "", "2012-12-31", "Published", "", "", ""),
        (4, "c4", "d3", "G v. H", "", "2024-12-31", "published", "Poe", "", ""),
        (5, "c5", "d3", "I v. J", "", "", None, "Moe", "", ""),
        (6, "c6", "d4", "K v. L", "", "2016-01-01", "Published", "", "", ""),
        (7, "c7", "d3", "M v. N", "", "2018-01-01", "Unpublished", "", "", ""),
        (8, "c8", "d3", "O v. P", "", "2025-01-01", "Published", "", "", ""),
        (9, "c9", "d3", "Q v. R", "", "2017-01-01", "Published", "", "", ""),
        (10, "c10", "d3", "S v. T", "", "2017-01-01", "Published", "", "", ""),
        (11, "c11", "d2", "U v. V", "", "2016-03-02", "Published", "", "", ""),
        (12, "c12", "d1", "W v. X", "", "2016-03-02", "Published", "", "", ""),
    ],
)
BULK_OPINIONS = Fixture(
    "ord int, id string, cluster_id string, type string, author_str string, per_curiam string, html string, plain_text string",
    [
        (1, "1", "c1", "040dissent", "D", "f", "", "one two three four"),
        (2, "2", "c1", "020lead", "L", "f", "<b>one two three four five</b>", "x"),
        (3, "3", "c1", "020lead", "M", "f", "second lead comes later", ""),
        (4, "4", "c2", "010combined", "K", "f", "", " a b c d "),
        (5, "5", "c4", "020lead", "", "t", "", "signed by nobody at all"),
        (6, "6", "c4", "010combined", "Z", "f", "", "would do a b c"),
        (7, "7", "c5", "015unamimous", "", "0", "", "no year but passes"),
        (8, "8", "c3", "020lead", "", "f", "", "too early a b c"),
        (9, "9", "c7", "020lead", "", "f", "", "not published a b"),
        (10, "10", "c9", "020lead", "", "f", " <br> ", ""),
        (11, "11", "c9", "100trialcourt", "N", "f", "", "the lead has no text"),
        (12, "12", "c10", "020lead", "", "f", "", "too short"),
        (13, "13", "c11", "020lead", "", "f", "", "newest of its court kept"),
        (14, "14", "c99", "020lead", "", "f", "", "of no known case"),
        (15, "15", "c12", "addendum", "", "f", "", "only an addendum here"),
    ],
)


_BULK = r"""WITH d AS (SELECT * FROM {dockets}), c AS (SELECT * FROM {clusters}), o AS (SELECT * FROM {opinions}),
k AS (SELECT c.*, court_id, row_number() OVER (PARTITION BY court_id ORDER BY date_filed DESC, ord) AS rk FROM c JOIN d ON c.docket_id = d.id WHERE court_id IN ('scotus', 'ca5', 'ca9') AND (coalesce(precedential_status, '') = '' OR lower(precedential_status) = 'published') AND (date_filed = '' OR left(date_filed, 4) BETWEEN '{after}' AND '{before}')),
t AS (SELECT o.*, coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), trim(plain_text)) AS text, CASE WHEN type LIKE '%lead%' THEN 0 WHEN type LIKE '%combined%' THEN 1 WHEN type LIKE '%dissent%' OR type LIKE '%concurr%' OR type LIKE '%addendum%' THEN 3 ELSE 2 END AS p FROM o),
b AS (SELECT * FROM t WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY p, ord) = 1)
SELECT CASE court_id WHEN 'scotus' THEN 'SCOTUS' ELSE upper(court_id) END AS jurisdiction, court_id, k.id AS cluster_id, coalesce(nullif(case_name, ''), case_name_full) AS case_name, date_filed, court_id AS court, coalesce(nullif(judges, ''), author_str) AS judge_name, '' AS judge_id, coalesce(nullif(headnotes, ''), summary) AS syllabus, text AS opinion_text, '' AS issue_area, '' AS issue_area_source
FROM k JOIN b ON k.id = b.cluster_id WHERE rk <= {most} AND per_curiam NOT IN ('t', 'true', '1') AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 4"""


@literal(_BULK.replace("{most}", "4").replace("{after}", "2013").replace("{before}", "2024"), dockets=BULK_DOCKETS, clusters=BULK_CLUSTERS, opinions=BULK_OPINIONS)
def c01_literal_bulk_tables(dockets, clusters, opinions):
    return corpus.bulk_filter(dockets, clusters, opinions, "ord", most=4, least_words=4)


MADE_DOCKETS = Rules("customer", {"id": "'d' || c_custkey", "court_id": "CASE c_custkey % 6 WHEN 0 THEN 'scotus' WHEN 1 THEN 'ca5' WHEN 2 THEN 'ca1' ELSE 'ca9' END"})
MADE_CLUSTERS = Rules(
    "orders",
    {
        "ord": "o_orderkey",
        "id": "'c' || o_orderkey",
        "docket_id": "CASE WHEN o_orderkey % 41 = 0 THEN 'd-none' ELSE 'd' || o_custkey END",
        "case_name": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'A' || o_orderkey || ' v. B' END",
        "case_name_full": "'Full ' || o_orderkey",
        "date_filed": "CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
        "precedential_status": "CASE o_orderkey % 9 WHEN 0 THEN 'Published' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'Unpublished' WHEN 4 THEN 'PUBLISHED' ELSE 'published' END",
        "judges": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Judge ' || o_custkey % 50 END",
        "headnotes": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'h ' || o_orderkey END",
        "summary": "CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE 's ' || o_orderkey END",
    },
)
MADE_OPINIONS = Rules(
    "orders",
    {
        "ord": "o_orderkey * 10 + (3 * k + o_orderkey) % 10",
        "id": "CAST(o_orderkey * 10 + k AS STRING)",
        "cluster_id": "'c' || (o_orderkey + CASE WHEN k = 3 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END)",
        "type": "CASE (o_custkey + k) % 6 WHEN 0 THEN '020lead' WHEN 1 THEN '040dissent' WHEN 2 THEN '010combined' WHEN 3 THEN '100trialcourt' WHEN 4 THEN '020lead' ELSE 'addendum' END",
        "author_str": "'Author ' || (o_custkey + k) % 30",
        "per_curiam": "CASE (o_orderkey + k) % 11 WHEN 0 THEN 't' WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN '' ELSE 'f' END",
        "html": "CASE (o_orderkey + k) % 4 WHEN 0 THEN '<p>' || repeat('word ', CAST((o_custkey + k) % 9 AS INT)) || '</p>' WHEN 1 THEN ' <br> ' ELSE '' END",
        "plain_text": "CASE (o_orderkey + k) % 5 WHEN 0 THEN '' ELSE ' ' || repeat('plain ', CAST((o_orderkey + k) % 8 AS INT)) || o_orderkey || ' ' END",
    },
    copies=3,
)


@over(_BULK.replace("{most}", "100").replace("{after}", "1996").replace("{before}", "2000"), dockets=MADE_DOCKETS, clusters=MADE_CLUSTERS, opinions=MADE_OPINIONS)
def c01_p02_p03_j01_j02_bulk_tables(dockets, clusters, opinions):
    """Customers stand in for dockets, orders for clusters, and three opinions of each order."""
    return corpus.bulk_filter(dockets, clusters, opinions, "ord", after="1996-03-01", before="2000-06-30", most=100, least_words=4)


BODY = "majority word " * 200
SPLIT_ROWS = Fixture("cluster_id int, jurisdiction string, opinion_text string", [(i, "CA9", f"old {i}") for i in range(1, 10)])
SPLIT_OPINIONS = Fixture(
    "cluster_id string, id string, type string, author_str string, plain_text string",
    [
        ("1", "11", "020lead", "", "lead b"), ("1", "9", "020lead", "", "lead a"), ("1", "12", "040dissent", "", "dis"), ("1", "8", "030concurrence", "", "con"), ("1", "13", "035concurrenceinpart", "", "part"),
        ("2", "1", "010combined", "", "all in one"),
        ("3", "1", "025plurality", "", "plural"), ("3", "2", "040dissent", "", "d2"), ("3", "x", "040dissent", "", "d-last"),
        ("4", "1", "040dissent", "", "only a dissent"),
        ("5", "1", "010combined", "", BODY + "JONES, Circuit Judge, dissenting: no no"), ("5", "2", "030concurrence", "", "typed con"),
        ("6", "1", "010combined", "", "x (JONES, Circuit Judge, dissenting) y"),
        ("7", "1", "015unamimous", "", "una"), ("7", "2", "010combined", "", "comb"),
        ("8", "1", "020lead", "", "  "), ("99", "1", "020lead", "", "not asked for"),
    ],
)


_BY_TYPE = """WITH r AS (SELECT * FROM {rows}), o AS (SELECT CAST(cluster_id AS INTEGER) AS cluster_id, coalesce(try_cast(id AS BIGINT), 9223372036854775807) AS id, type, trim(plain_text) AS text FROM {opinions} WHERE trim(plain_text) <> ''),
j AS (SELECT cluster_id, type, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text FROM o GROUP BY 1, 2), t AS (SELECT r.*, (SELECT text FROM j WHERE j.cluster_id = r.cluster_id AND type = '020lead') AS lead, (SELECT text FROM j WHERE j.cluster_id = r.cluster_id AND type = '025plurality') AS plural, (SELECT text FROM j WHERE j.cluster_id = r.cluster_id AND type = '015unamimous') AS una, (SELECT text FROM j WHERE j.cluster_id = r.cluster_id AND type = '010combined') AS comb,
coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM o WHERE o.cluster_id = r.cluster_id AND type = '040dissent'), '') AS dis, coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM o WHERE o.cluster_id = r.cluster_id AND type IN ('030concurrence', '035concurrenceinpart')), '') AS con, EXISTS (SELECT 1 FROM o WHERE o.cluster_id = r.cluster_id) AS there FROM r),
m AS (SELECT *, coalesce(lead, plural, una) AS maj, strpos(comb, 'JONES, Circuit Judge, dissenting: no no') AS cut FROM t)
SELECT cluster_id, CASE WHEN maj IS NOT NULL THEN maj WHEN cut > 0 THEN trim(left(comb, cut - 1)) WHEN comb IS NOT NULL THEN comb ELSE opinion_text END AS opinion_text, CASE WHEN maj IS NULL AND cut > 0 THEN (SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM (SELECT o.id, o.text FROM o WHERE o.cluster_id = m.cluster_id AND type = '040dissent' UNION ALL SELECT m.cut - 1, substr(m.comb, m.cut))) ELSE dis END AS dissent_text, con AS concurrence_text, CASE WHEN NOT there THEN '' WHEN maj IS NOT NULL OR cut > 0 THEN '0' WHEN comb IS NOT NULL THEN '1' ELSE '' END AS combined_only, CASE WHEN maj IS NOT NULL THEN 'cl_separate' WHEN cut > 0 THEN 'heading' ELSE 'none' END AS split_method FROM m"""
_DEFAULTS = """WITH r AS (SELECT * FROM {rows}), o AS (SELECT CAST(cluster_id AS INTEGER) AS cluster_id, coalesce(try_cast(id AS BIGINT), 9223372036854775807) AS id, type, trim(plain_text) AS text FROM {opinions} WHERE trim(plain_text) <> '')
SELECT cluster_id, coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM o WHERE o.cluster_id = r.cluster_id AND type = '020lead'), (SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM o WHERE o.cluster_id = r.cluster_id AND type = '010combined'), opinion_text) AS opinion_text,
coalesce((SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM o WHERE o.cluster_id = r.cluster_id AND type = '030concurrence'), '') AS concurrence_text FROM r"""
MADE_ROWS = Rules("customer", {"cluster_id": "CAST(c_custkey AS INT)", "jurisdiction": "'CA9'", "opinion_text": "'old ' || c_custkey"})
MADE_WRITINGS = Rules(
    "customer",
    {
        "cluster_id": "CAST(c_custkey AS STRING)",
        "id": "CASE WHEN k = 4 AND c_custkey % 2 = 0 THEN 'x' ELSE CAST((7 * k + c_custkey) % 10 AS STRING) END",
        "type": "CASE k WHEN 1 THEN CASE c_custkey % 7 WHEN 0 THEN '025plurality' WHEN 1 THEN '015unamimous' WHEN 2 THEN '040dissent' WHEN 3 THEN '020lead' ELSE '010combined' END WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN '040dissent' WHEN 1 THEN '030concurrence' ELSE '035concurrenceinpart' END WHEN 3 THEN CASE c_custkey % 5 WHEN 0 THEN '020lead' WHEN 1 THEN '040dissent' WHEN 2 THEN '060other' ELSE '030concurrence' END ELSE CASE WHEN c_custkey % 4 = 0 THEN '020lead' ELSE '040dissent' END END",
        "author_str": "''",
        "plain_text": f"CASE WHEN (c_custkey + k) % 6 = 0 THEN ' ' WHEN k = 1 AND c_custkey % 14 IN (4, 5) THEN '{BODY}' || 'JONES, Circuit Judge, dissenting: no no' WHEN k = 1 AND c_custkey % 14 = 6 THEN 'x (JONES, Circuit Judge, dissenting) y' ELSE ' text ' || k || ' of ' || c_custkey || ' ' END",
    },
    copies=4,
)


@over(_BY_TYPE, rows=MADE_ROWS, opinions=MADE_WRITINGS)
@literal(_BY_TYPE, rows=SPLIT_ROWS, opinions=SPLIT_OPINIONS)
def c02_j03_f29_split_by_type(rows, opinions):
    dump = corpus.opinions_by_case(opinions, rows)
    return corpus.split_by_type(rows, dump, fallback=True, in_part="concurrence", cut_text=True).drop("jurisdiction")


@over(_DEFAULTS, rows=MADE_ROWS, opinions=MADE_WRITINGS)
@literal(_DEFAULTS, rows=SPLIT_ROWS, opinions=SPLIT_OPINIONS)
def c02_split_by_type_defaults(rows, opinions):
    """Without options: lead or combined whole, and opinions that concur in part are left out."""
    dump = corpus.opinions_by_case(opinions, rows)
    return corpus.split_by_type(rows, dump).select("cluster_id", "opinion_text", "concurrence_text")


SCDB = Fixture(
    "ord int, docket string, usCite string, caseId string, caseName string, dateDecision string, issueArea string, decisionDirection string, majOpinWriter string, term string",
    [
        (1, "20-1", "590 U.S. 1", "S1", "A v. B", "1/2/2020", "1", "2", "100", "2019"), (2, "20-1", "590 U.S. 9", "S2", "A v. B again", "1/2/2020", "2", "1", "101", "2019"),
        (3, "20-3, 20-4", "590 U.S. 3", "S3", "C v. D", "6/1/2020", "", "1", "", "2019"), (4, "141, Orig.", "", "S4", "E v. F", "5/5/2021", "8", "1", "102", "x"),
        (5, "", "591 U.S. 5", "S5", "G v. H", "2021-01-01", "3", "", "103", "2020"), (6, "", "591 U.S. 5", "S6", "G v. H", "2021-02-02", "4", "", "103", "2020"), (7, "19-7", "", "S7", "I v. J", "3/3/2019", "5", "2", "100", "2018"),
    ],
)
MQ = Fixture("justice string, term string, post_mn string", [("100", "2019", "1.5"), ("100", "2018", "-0.5"), ("101", "2019", "0.25"), ("103", "2020", "oops"), ("x", "2019", "1")])
SUPREME = Fixture(
    "cluster_id string, jurisdiction string, case_name string, date_filed string, issue_area string, ideology_score string",
    [("1", "SCOTUS", "A v. B", "2020-01-02", "9", "9"), ("2", "SCOTUS", "X", "2020-06-01", "9", "9"), ("3", "SCOTUS", "Y", "2021-05-05", "", ""), ("4", "SCOTUS", "no docket", "2021-01-01", "", ""), ("5", "SCOTUS", "G v. H Revisions: 2", "2021-09-09", "", ""), ("6", "SCOTUS", "I v. J", "2020-03-03", "7", "7"), ("7", "CA9", "A v. B", "2020-01-02", "6", "0.5"), ("8", "SCOTUS", "I. v. J.", "2019-12-31", "", "")],
)
SC_CLUSTERS = Fixture("id string, docket_id string, scdb_id string", [("1", "k1", "S1"), (" 2 ", "k2", "S9"), ("3", "k3", ""), ("4", "k4", ""), ("5", "k5", None), ("99", "k9", "")])
SC_DOCKETS = Fixture("id string, docket_number string", [("k1", "No. 20-1"), ("k2", "20-4; 20-3"), ("k3", "22O141"), ("k4", ""), ("k5", None), ("k9", "19-7")])
SC_CITES = Fixture("ord int, cluster_id string, volume string, reporter string, page string", [(1, "4", "591", "S. Ct.", "1"), (2, "4", "591", "U.S.", "___"), (3, "4", "591", "U.S.", "5"), (4, "4", "590", "U.S.", "1"), (5, "1", "591", "U.S.", "5"), (6, "77", "1", "U.S.", "1")])

_SC = r"""WITH s AS (SELECT *, regexp_replace(lower(caseName), '[^a-z0-9]', '', 'g') AS name, regexp_extract(dateDecision, '(\d{4})', 1) AS y FROM {database}), q AS (SELECT * FROM {scores}),
tok AS (SELECT ord, trim(unnest(string_split(docket, ','))) AS t FROM s WHERE docket NOT LIKE '%Orig%' AND docket <> '' UNION ALL SELECT ord, '141ORIG' FROM s WHERE docket LIKE '%Orig%'), bytok AS (SELECT t, min(ord) AS ord FROM tok GROUP BY 1),
r AS (SELECT *, regexp_replace(lower(regexp_replace(case_name, '(?i)\s+revisions?:.*$', '')), '[^a-z0-9]', '', 'g') AS name, left(date_filed, 4) AS y FROM {rows}),
dk AS (SELECT trim(c.id) AS cluster_id, coalesce(c.scdb_id, '') AS named, coalesce(d.docket_number, '') AS n FROM {clusters_} c LEFT JOIN (SELECT * FROM {dockets_}) d ON c.docket_id = d.id),
mine AS (SELECT cluster_id, unnest(CASE WHEN n = '22O141' THEN ['141ORIG'] ELSE list_transform(string_split(replace(n, 'No. ', ''), ';'), lambda x: trim(x)) END) AS t FROM dk WHERE n <> ''),
bd AS (SELECT cluster_id, min_by(ord, t) AS ord FROM mine JOIN bytok USING (t) GROUP BY 1),
ci AS (SELECT cluster_id, min_by(volume || 'U.S.' || page, ord) AS cite FROM {cites_} WHERE reporter = 'U.S.' AND page NOT LIKE '%\_%' ESCAPE '\' GROUP BY 1), bc AS (SELECT ci.cluster_id, min(s.ord) AS ord FROM ci JOIN s ON replace(s.usCite, ' ', '') = ci.cite GROUP BY 1),
bn AS (SELECT r.cluster_id, min(s.ord) AS ord FROM r JOIN s ON r.name = s.name AND r.y = s.y GROUP BY 1),
m AS (SELECT r.*, coalesce(bd.ord, bc.ord, bn.ord) AS ord, CASE WHEN bd.ord IS NOT NULL THEN 'docket' WHEN bc.ord IS NOT NULL THEN 'uscite' WHEN bn.ord IS NOT NULL THEN 'name_year' ELSE 'none' END AS method, dk.named FROM r LEFT JOIN bd USING (cluster_id) LEFT JOIN bc USING (cluster_id) LEFT JOIN bn USING (cluster_id) LEFT JOIN dk USING (cluster_id))"""
_SC = _SC.replace("{clusters_}", "(SELECT * FROM {clusters})").replace("{dockets_}", "{dockets}").replace("{cites_}", "(SELECT * FROM {citations})")
_TABLES = {"rows": SUPREME, "clusters": SC_CLUSTERS, "dockets": SC_DOCKETS, "citations": SC_CITES, "database": SCDB, "scores": MQ}
MADE_SUPREME = {
    "rows": Rules("orders", {"cluster_id": "CAST(o_orderkey AS STRING)", "jurisdiction": "CASE WHEN o_orderkey % 5 = 0 THEN 'CA9' ELSE 'SCOTUS' END", "case_name": "'A' || o_custkey % 700 || CASE WHEN o_orderkey % 3 = 0 THEN ' v. B Revisions: 2' ELSE ' v. B' END", "date_filed": "(2015 + o_orderkey % 8) || '-05-05'", "issue_area": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '9' END", "ideology_score": "CASE WHEN o_orderkey % 10 = 0 THEN '0.5' ELSE '' END"}),
    "clusters": Rules("orders", {"id": "CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderkey || ' ' ELSE CAST(o_orderkey AS STRING) END", "docket_id": "'k' || o_orderkey", "scdb_id": "CASE o_orderkey % 6 WHEN 0 THEN 'S' || o_custkey WHEN 1 THEN NULL ELSE '' END"}, where="o_orderkey % 13 <> 0"),
    "dockets": Rules("orders", {"id": "'k' || o_orderkey", "docket_number": "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'No. 20-' || o_custkey WHEN 3 THEN '20-' || (o_custkey + 1) || '; 21-' || o_custkey WHEN 4 THEN '22O141' ELSE 'No. 99-' || o_custkey END"}),
    "citations": Rules("orders", {"ord": "o_orderkey * 2 + k", "cluster_id": "CAST(o_orderkey AS STRING)", "volume": "CAST(500 + o_custkey % 90 AS STRING)", "reporter": "CASE WHEN (o_orderkey + k) % 3 = 0 THEN 'S. Ct.' ELSE 'U.S.' END", "page": "CASE WHEN (o_orderkey + k) % 4 = 0 THEN '___' ELSE CAST(o_custkey + k AS STRING) END"}, copies=2),
    "database": Rules("part", {"ord": "p_partkey", "docket": "CASE WHEN p_partkey = 141 THEN '141, Orig.' WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN '20-' || p_partkey || ', 21-' || p_partkey ELSE '20-' || p_partkey % 900 END", "usCite": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE (500 + p_partkey % 90) || ' U.S. ' || p_partkey END", "caseId": "'S' || p_partkey", "caseName": "'A' || p_partkey % 500 || ' v. B'", "dateDecision": "CASE WHEN p_partkey % 2 = 0 THEN '3/4/' || (2015 + p_partkey % 8) ELSE (2015 + p_partkey % 8) || '-02-01' END", "issueArea": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey % 14 + 1 AS STRING) END", "decisionDirection": "CAST(p_partkey % 3 AS STRING)", "majOpinWriter": "CASE WHEN p_partkey % 15 = 0 THEN '' ELSE CAST(100 + p_partkey % 12 AS STRING) END", "term": "CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE CAST(2010 + p_partkey % 9 AS STRING) END"}),
    "scores": Rules("supplier", {"justice": "CAST(100 + s_suppkey % 12 AS STRING)", "term": "CAST(2010 + CAST(floor(s_suppkey / 12) AS INT) AS STRING)", "post_mn": "CASE WHEN s_suppkey % 9 = 0 THEN 'oops' WHEN s_suppkey % 2 = 0 THEN '-' || s_suppkey % 5 || '.5' ELSE s_suppkey % 5 || '.25' END"}),
}


def _matched(rows, clusters, dockets, citations, database):
    supreme = rows.where("jurisdiction = 'SCOTUS'")
    numbers = enrichment.docket_numbers(supreme, clusters, dockets)
    return enrichment.match_database(supreme, numbers, enrichment.first_citations(supreme, citations, "ord"), database, "ord")


_MATCHES = _SC + " SELECT m.cluster_id, method, caseId AS hit, CASE WHEN named <> '' THEN caseId = named END AS agrees FROM m LEFT JOIN s ON m.ord = s.ord WHERE jurisdiction = 'SCOTUS'"


@over(_MATCHES, **MADE_SUPREME)
@literal(_MATCHES, **_TABLES)
def j04_j05_j06_j07_database_matches(rows, clusters, dockets, citations, database, scores):
    return _matched(rows, clusters, dockets, citations, database).select("cluster_id", "method", F.col("hit.caseId").alias("hit"), "agrees")


_SUPREME = (
    _SC
    + """ SELECT m.cluster_id, m.case_name, CASE WHEN jurisdiction = 'SCOTUS' THEN coalesce(caseId, '') ELSE '' END AS scdb_id, CASE WHEN jurisdiction = 'SCOTUS' THEN coalesce(issueArea, '') ELSE issue_area END AS issue_area, CASE WHEN jurisdiction = 'SCOTUS' AND issueArea <> '' THEN 'scdb' ELSE '' END AS issue_area_source, CASE WHEN jurisdiction = 'SCOTUS' THEN coalesce(decisionDirection, '') ELSE '' END AS decision_direction,
CASE WHEN jurisdiction = 'SCOTUS' THEN coalesce(CAST(try_cast(post_mn AS DOUBLE) AS VARCHAR), '') ELSE ideology_score END AS ideology_score, CASE WHEN jurisdiction = 'SCOTUS' AND try_cast(post_mn AS DOUBLE) IS NOT NULL THEN 'martin_quinn' ELSE '' END AS ideology_source FROM m LEFT JOIN s ON m.ord = s.ord LEFT JOIN q ON q.justice = s.majOpinWriter AND q.term = s.term"""
)


@over(_SUPREME, **MADE_SUPREME)
@literal(_SUPREME, **_TABLES)
def c05_j09_s14_supreme_enrichment(rows, clusters, dockets, citations, database, scores):
    """Old values of the six fields go, also where nothing matches; other courts keep theirs."""
    done = enrichment.enrich_supreme(rows, _matched(rows, clusters, dockets, citations, database), scores)
    return done.select("cluster_id", "case_name", *enrichment.DATABASE_FIELDS)


BIOGRAPHIES = Fixture(
    "nid string, first string, middle string, last string, c1 string, a1 string, b1 string, p1 string, c2 string, a2 string, b2 string, p2 string",
    [
        ("n1", "Carlos", "Tiburcio", "Bea", "U.S. District Court, N.D. Cal.", "1/2/1990", "1/2/2003", "Republican", "U.S. Court of Appeals for the Ninth Circuit", "9/29/2003", "", "Republican"),
        ("n2", "Milan", "Dale", "Smith", "U.S. Court of Appeals for the Ninth Circuit", "2006-05-18", "", "Republican", "", "", "", ""),
        ("n3", "N[orman]", "Randy", "Smith", "U.S. Court of Appeals for the Ninth Circuit", "2007-03-19", "", "Republican", "", "", "", ""),
        ("n4", "Harry", "", "O'Pregerson", "U.S. Court of Appeals for the Ninth Circuit", "11/2/1979", "11/25/2010", "Democratic", "", "", "", ""),
        ("", "Priscilla", "Richman", "Owen", "U.S. Court of Appeals for the Fifth Circuit", "6/3/2005", "", "Independent", "", "", "", ""),
        ("n6", "Old", "", "Gone", "U.S. Court of Appeals for the Fifth Circuit", "1/1/1950", "1/1/1960", "Democratic", "U.S. Court of Appeals for the Second Circuit", "1/1/1960", "", "Whig"),
        ("n7", "Holly", "A.", "Thomas", "U.S. Court of Appeals for the Ninth Circuit", "1/20/2022", "", "Democratic", "", "", "", ""),
    ],
)


def _long_sql() -> str:
    return "(SELECT coalesce(nullif(nid, ''), last || '|' || first) AS person, first, middle, last, 1 AS slot, c1 AS court, a1 AS a, b1 AS b, p1 AS p FROM w WHERE c1 <> '' UNION ALL SELECT coalesce(nullif(nid, ''), last || '|' || first), first, middle, last, 2, c2, a2, b2, p2 FROM w WHERE c2 <> '')"


_BIO = "WITH w AS (SELECT * FROM {bio}) , l0 AS " + _long_sql() + ", l AS (SELECT *, coalesce(try_strptime(a, '%m/%d/%Y'), try_cast(a AS TIMESTAMP))::DATE AS starts, coalesce(try_strptime(b, '%m/%d/%Y'), try_cast(b AS TIMESTAMP))::DATE AS ends FROM l0)"
_COURTS = ["'U.S. Court of Appeals for the Ninth Circuit'", "'U.S. Court of Appeals for the Fifth Circuit'"]
_DAY = "CASE WHEN {0} % 2 = 0 THEN '1/2/' || ({1}) ELSE ({1}) || '-05-18' END"
MADE_BIOGRAPHIES = Rules(
    "supplier",
    {
        "nid": "CASE WHEN s_suppkey % 97 = 0 THEN '' ELSE 'n' || s_suppkey END",
        "first": "substring('ABCDEFG', CAST(s_suppkey % 7 + 1 AS INT), 1) || 'x'",
        "middle": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE substring('HIJKLMN', CAST(s_suppkey % 5 + 1 AS INT), 1) || 'y' END",
        "last": "CASE WHEN s_suppkey % 17 = 0 THEN 'O''N' ELSE 'N' END || " + letters("s_suppkey % 40"),
        "c1": f"CASE s_suppkey % 4 WHEN 0 THEN {_COURTS[0]} WHEN 1 THEN {_COURTS[1]} WHEN 2 THEN 'U.S. District Court, N.D. Cal.' ELSE '' END",
        "a1": _DAY.format("s_suppkey", "1950 + s_suppkey % 70"),
        "b1": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '3/4/' || (1970 + s_suppkey % 70) END",
        "p1": "CASE s_suppkey % 3 WHEN 0 THEN 'Republican' WHEN 1 THEN 'Democratic' ELSE 'Whig' END",
        "c2": f"CASE WHEN s_suppkey % 5 = 0 THEN {_COURTS[0]} WHEN s_suppkey % 5 = 1 THEN 'U.S. Court of Appeals for the Second Circuit' ELSE '' END",
        "a2": _DAY.format("s_suppkey", "1990 + s_suppkey % 30"),
        "b2": "''",
        "p2": "'Democratic'",
    },
)


def _bio(t):
    named = {"first": "First Name", "middle": "Middle Name", "last": "Last Name"}
    slots = {f"{short}{k}": f"{field} ({k})" for k in (1, 2) for short, field in (("c", "Court Name"), ("a", "Commission Date"), ("b", "Termination Date"), ("p", "Party of Appointing President"))}
    return t.withColumnsRenamed(named | slots)


_APPOINTMENTS = _BIO + " SELECT person, slot, court, starts AS start, ends AS \"end\", CASE lower(p) WHEN 'republican' THEN 'R' WHEN 'democratic' THEN 'D' ELSE '' END AS party, CASE WHEN last LIKE 'O''%' THEN regexp_replace(lower(last), '[^a-z]', '', 'g') || ',' || lower(substr(last, 3)) ELSE lower(last) END AS keys FROM l"


@over(_APPOINTMENTS, bio=MADE_BIOGRAPHIES)
@literal(_APPOINTMENTS, bio=BIOGRAPHIES)
def s13_f10_appointments(bio):
    """All filled slots of all courts, with the party decoded."""
    return enrichment.appointments(_bio(bio)).select("person", "slot", "court", "start", "end", "party", F.array_join("keys", ",").alias("keys"))


ROSTER = Fixture("first string, last string, court string, judjis string", [("Carlos", "Bea", "9", "0.5"), ("Milan", "Smith", "ca9", "0.4"), ("N. Randy", "Smith", "9", "0.2"), ("Jerry", "Smith", "5", "0.7"), ("Priscilla", "Richman", "5", "0.9"), ("Sidney", "Thomas", "9", "-0.6"), ("Marsha", "Berzon", "9", "-0.8"), ("A", "Twin", "9", "0.1"), ("B", "Twin", "9", "-0.1"), ("No", "Score", "9", ""), ("Bad", "Number", "9", "x"), ("Somewhere", "Lone", "", "-0.3")])
CIRCUIT_CASES = Fixture(
    "row_id int, author string, court string, jurisdiction string, date string, initials string, district boolean",
    [
        (1, "Bea", "ca9", "CA9", "2019-01-01", "O.", False), (2, "SMITH", "ca9", "CA9", "2019-01-01", "M.D.", False), (3, "SMITH", "ca9", "CA9", "2019-01-01", "", False), (4, "SMITH", "ca9", "CA9", "2006-12-01", "", False),
        (5, "Owen", "Fifth Circuit", "CA5", "2019-01-01", "", False), (6, "Thomas", "ca9", "CA9", "2023-01-01", "H.A.", False), (7, "Thomas", "ca9", "CA9", "2015-01-01", "S.R.", False), (8, "Thomas", "ca9", "CA9", "2015-01-01", "H.A.", False),
        (9, "Twin", "ca9", "CA9", "2015-01-01", "B.", False), (10, "Twin", "ca9", "CA9", "2015-01-01", "", False), (11, "Bea", "ca9", "CA9", "2019-01-01", "", True), (12, "", "ca9", "CA9", "2019-01-01", "", False), (13, "Berzon", "ca9", "CA9", None, "M.", False), (14, "Score", "ca9", "CA9", "2019-01-01", "", False), (15, "Lone", "ca9", "CA9", "2019-01-01", "", False), (16, "SMITH", "", "CA5", None, "", False), (17, "Bea", "ca5", "CA5", "2019-01-01", "", False), (18, None, None, None, None, None, None),
    ],
)
_INI = "regexp_replace(upper(coalesce({}, '')), '[^A-Z]', '', 'g')"


def _ok(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN true WHEN left({a}, 1) = left({b}, 1) THEN length({a}) < 2 OR length({b}) < 2 OR substr({a}, 2, 1) = substr({b}, 2, 1) ELSE length({a}) = 1 AND length({b}) > 1 AND {a} = substr({b}, 2, 1) END"


_LETTERS = "array_to_string(list_transform(list_filter(regexp_split_to_array(replace(replace({}, '[', ''), ']', ''), '[ .]+'), lambda x: x <> ''), lambda x: upper(left(x, 1))), '')"
_ROSTER = (
    _BIO
    + f""", people AS (SELECT person, lower(last) AS surname, {_LETTERS.format("first || ' ' || middle")} AS ini, CASE WHEN court LIKE '%Ninth%' THEN '9' ELSE '5' END AS circuit, starts, ends FROM l WHERE court LIKE '%Court of Appeals%' AND (court LIKE '%Ninth%' OR court LIKE '%Fifth%') AND (starts IS NULL OR starts <= DATE '2023-12-31') AND (ends IS NULL OR ends >= DATE '2005-01-01')),
ro AS (SELECT trim(first || ' ' || last) AS full_name, lower(last) AS last, replace(court, 'ca', '') AS circuit, {_LETTERS.format('first')} AS ini, try_cast(judjis AS DOUBLE) AS score FROM {{roster}} WHERE try_cast(judjis AS DOUBLE) IS NOT NULL),
c AS (SELECT row_id, lower(author) AS a, right(jurisdiction, 1) AS circuit, CAST(date AS DATE) AS d, {_INI.format('initials')} AS ini FROM {{cases}} WHERE author <> '' AND NOT district),
v AS (SELECT *, a AS s FROM c UNION SELECT *, 'richman' FROM c WHERE a = 'owen' AND circuit = '5'),
cand AS (SELECT v.row_id, v.ini, ro.* EXCLUDE (ini, last, circuit), ro.ini AS r_ini FROM v JOIN ro ON v.s = ro.last AND (ro.circuit = '' OR ro.circuit = v.circuit)),
act AS (SELECT DISTINCT v.row_id, v.ini, p.person, p.ini AS p_ini FROM v JOIN people p ON p.surname = v.s AND p.circuit = v.circuit AND (v.d IS NULL OR ((p.starts IS NULL OR p.starts <= v.d) AND (p.ends IS NULL OR v.d <= p.ends)))),
n AS (SELECT row_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_ini) WHEN count(*) FILTER (WHERE ini <> '' AND {_ok('ini', 'p_ini')}) = 1 THEN min(p_ini) FILTER (WHERE ini <> '' AND {_ok('ini', 'p_ini')}) END AS target FROM act GROUP BY 1),
k AS (SELECT cand.*, n.n, n.target, CASE WHEN n.n IS NOT NULL THEN target IS NOT NULL AND {_ok('target', 'r_ini')} ELSE cand.ini <> '' AND {_ok('cand.ini', 'r_ini')} END AS ok, count(*) OVER (PARTITION BY cand.row_id) AS rows_ FROM cand LEFT JOIN n USING (row_id)),
f AS (SELECT row_id, n, rows_, count(*) FILTER (WHERE ok) AS n_ok, min(full_name) AS any_name, min(score) AS any_score, min(full_name) FILTER (WHERE ok) AS ok_name, min(score) FILTER (WHERE ok) AS ok_score, bool_or(ini <> '' AND r_ini <> '' AND NOT list_has_any(string_split(ini, ''), string_split(r_ini, ''))) AS clash FROM k GROUP BY 1, 2, 3)
SELECT row_id, CASE WHEN n IS NULL AND rows_ = 1 THEN CASE WHEN NOT clash THEN any_name END WHEN n_ok = 1 THEN ok_name END AS full_name, CASE WHEN n IS NULL AND rows_ = 1 THEN CASE WHEN NOT clash THEN any_score END WHEN n_ok = 1 THEN ok_score END AS score, CASE WHEN n IS NULL AND rows_ = 1 THEN CASE WHEN clash THEN 'conflict' ELSE 'roster_only' END WHEN n_ok = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM f"""
)


MADE_ROSTER = Rules(
    "supplier",
    {
        "first": "substring('ABCDEFG', CAST(s_suppkey % 7 + 1 AS INT), 1) || " + letters("s_suppkey") + " || CASE WHEN s_suppkey % 4 = 0 THEN ' H.' ELSE '' END",
        "last": "'N' || " + letters("s_suppkey * 7 % 60"),
        "court": "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ca5' WHEN 2 THEN '5' ELSE '9' END",
        "judjis": "CASE WHEN s_suppkey % 9 = 0 THEN 'x' WHEN s_suppkey % 9 = 1 THEN '' ELSE '0.' || s_suppkey % 10 || '5' END",
    },
)
_AUTHOR = "'N' || " + letters("o_custkey % 60")
MADE_CASES = Rules(
    "orders",
    {
        "row_id": "o_orderkey",
        "author": f"CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN upper({_AUTHOR}) ELSE {_AUTHOR} END",
        "court": "CASE WHEN o_orderkey % 2 = 0 THEN 'ca9' ELSE 'Fifth Circuit' END",
        "jurisdiction": "CASE WHEN o_orderkey % 2 = 0 THEN 'CA9' ELSE 'CA5' END",
        "date": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (1996 + o_orderkey % 28) || '-06-01' END",
        "initials": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN substring('ABCDEFG', CAST(o_custkey % 7 + 1 AS INT), 1) || '.' WHEN 2 THEN substring('ABCDEFG', CAST(o_custkey % 7 + 1 AS INT), 1) || '.' || substring('HIJKLMN', CAST(o_custkey % 5 + 1 AS INT), 1) || '.' ELSE 'Q.' END",
        "district": "o_orderkey % 23 = 0",
    },
)


@over(_ROSTER, bio=MADE_BIOGRAPHIES, roster=MADE_ROSTER, cases=MADE_CASES)
@literal(_ROSTER, bio=BIOGRAPHIES, roster=ROSTER, cases=CIRCUIT_CASES)
def c06_j10_j11_j12_w08_roster(bio, roster, cases):
    day = lambda s: F.lit(s).cast("date")
    people = enrichment.circuit_appointments(_bio(bio), day("2005-01-01"), day("2023-12-31"))
    known = enrichment.circuit_roster(roster.withColumnsRenamed({"first": "first.name", "last": "last.name"}))
    return enrichment.roster_matches(cases.withColumn("date", F.to_date("date")), known, people)


_REASONS = (
    _ROSTER[: _ROSTER.rindex("SELECT row_id, CASE WHEN n IS NULL")]
    + """, q AS (SELECT v.row_id, count(DISTINCT p.person) > 1 AS others FROM v JOIN people p ON p.surname = v.s AND p.circuit = v.circuit GROUP BY 1),
w2 AS (SELECT f.*, c.ini, n2.target, coalesce(q.others, false) AS others FROM f JOIN c USING (row_id) LEFT JOIN n n2 USING (row_id) LEFT JOIN q USING (row_id)),
r AS (SELECT row_id, CASE WHEN n = 1 THEN CASE WHEN n_ok <> 1 THEN 'not_in_roster' WHEN others THEN 'date' ELSE 'active' END WHEN n > 1 THEN CASE WHEN target IS NULL THEN CASE WHEN ini <> '' THEN 'several_initials' ELSE 'several' END WHEN n_ok = 1 THEN 'initials' ELSE 'not_in_roster' END
 WHEN rows_ = 1 THEN CASE WHEN clash THEN 'roster_conflict' ELSE 'roster_only' END WHEN n_ok = 1 THEN 'roster_initials' ELSE 'roster_several' END AS reason FROM w2)
SELECT jurisdiction, CASE WHEN coalesce(trim(author), '') = '' THEN 'no_author' WHEN coalesce(district, false) THEN 'district' ELSE coalesce(reason, 'no_candidate') END AS reason, count(*) AS n FROM {cases} LEFT JOIN r USING (row_id) GROUP BY 1, 2"""
)


@over(_REASONS, bio=MADE_BIOGRAPHIES, roster=MADE_ROSTER, cases=MADE_CASES)
@literal(_REASONS, bio=BIOGRAPHIES, roster=ROSTER, cases=CIRCUIT_CASES)
def a18_roster_reasons(bio, roster, cases):
    """How the authors of a court were told, and why others were not."""
    day = lambda s: F.lit(s).cast("date")
    people = enrichment.circuit_appointments(_bio(bio), day("2005-01-01"), day("2023-12-31"))
    known = enrichment.circuit_roster(roster.withColumnsRenamed({"first": "first.name", "last": "last.name"}))
    reasons = enrichment.roster_reasons(cases.withColumn("date", F.to_date("date")), known, people, "jurisdiction")
    return reasons.groupBy("jurisdiction", "reason").agg(F.count(F.lit(1)).alias("n"))


_IGNORED = """WITH o AS (SELECT cluster_id, type FROM {opinions} WHERE trim(plain_text) <> '')
SELECT jurisdiction, type, count(*) AS n, type NOT IN ('020lead', '010combined', '040dissent', '030concurrence', '025plurality', '015unamimous') AS ignored FROM {rows} JOIN o ON CAST(o.cluster_id AS BIGINT) = t.cluster_id GROUP BY 1, 2"""


@over(_IGNORED, rows=MADE_ROWS, opinions=MADE_WRITINGS)
@literal(_IGNORED, rows=SPLIT_ROWS, opinions=SPLIT_OPINIONS)
def a18_types(rows, opinions):
    """Opinions by court and type, and the types that the split leaves out."""
    return corpus.type_counters(rows, corpus.opinions_by_case(opinions, rows), fallback=True)


JCS = Fixture("name string, circuit string, jcs string", [("Bea, Carlos T.", "9.0", "0.5"), ("O'Scannlain, Diarmuid", "9", "0.3"), ("Smith, N. Randy", "9", "0.2"), ("NoComma", "5", "0.1"), ("Bad, Circuit", "x", "0.1"), ("Bad, Score", "9", "")])


_HOLDERS = f"""WITH s AS (SELECT name, CAST(try_cast(circuit AS DOUBLE) AS INTEGER) AS c, try_cast(jcs AS DOUBLE) AS score, split_part(name, ',', 1) AS last, CASE WHEN contains(name, ',') THEN substr(name, strpos(name, ',') + 1) ELSE '' END AS rest FROM {{t}}),
k AS (SELECT *, regexp_replace(lower(last), '[^a-z]', '', 'g') AS key FROM s WHERE c IS NOT NULL AND score IS NOT NULL UNION ALL SELECT *, lower(substr(last, 3)) FROM s WHERE last LIKE 'O''%' AND c IS NOT NULL AND score IS NOT NULL)
SELECT CAST(c AS VARCHAR) AS court, key AS surname, name AS holder, coalesce(list_filter(list_transform(regexp_split_to_array(rest, '[ ,]+'), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: length(x) > 1)[1], '') AS first, {_LETTERS.format('rest')} AS initials, score FROM k"""
MADE_JCS = Rules(
    "supplier",
    {
        "name": "CASE s_suppkey % 5 WHEN 0 THEN 'Smith{0}, N. Randy' WHEN 1 THEN 'O''N{0}, Al' WHEN 2 THEN 'NoComma{0}' WHEN 3 THEN 'Bea{0}, Carlos T.' ELSE 'Lone{0}, X.' END".replace("{0}", f"' || {letters('s_suppkey')} || '"),
        "circuit": "CASE WHEN s_suppkey % 7 = 0 THEN 'x' WHEN s_suppkey % 2 = 0 THEN s_suppkey % 11 || '.0' ELSE CAST(s_suppkey % 11 AS STRING) END",
        "jcs": "CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE '0.' || s_suppkey % 10 END",
    },
)


@over(_HOLDERS, t=MADE_JCS)
@literal(_HOLDERS, t=JCS)
def s14_appeals_scores(t):
    return enrichment.appeals_scores(t)
