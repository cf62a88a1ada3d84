"""Scalar functions on values that hold every branch, spread over the keys of the tables; the SQL is written from the rule, not from the expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.functions import names as N
from quillfold.operators import corpus, evaluation, records, reports

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Fixture:
    """Values that hold every branch of a rule: as literal rows for tests, and spread over the keys of a given table, for Spark and as SQL.

    Over a table, each column takes its own distinct values in turn (`free`, so that all combinations occur), or whole rows are taken in turn.
    {n} in a value is a number that follows from the key, {m} one of five digits. group: columns that rows of one id share; every fourth
    key is then an id of its own, and three in a row share one.
    """

    def __init__(self, schema: str, rows: list[tuple], free: bool = False, table: str = "orders", key: str = "o_orderkey", group: tuple[str, ...] | None = None):
        self.schema, self.rows, self.table, self.key, self.group = schema, rows, table, key, group
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.kinds = [c.split()[1] for c in schema.split(", ")]
        columns = list(zip(*rows, strict=True))[1:]
        self.values = [list(dict.fromkeys(c)) if free else list(c) for c in columns]
        strides = [1]
        for v in self.values:
            strides.append(strides[-1] * (len(v) if free else 1))
        self.strides = strides[: len(self.values)]

    def _numbered(self, row: tuple) -> tuple:
        return tuple(v.replace("{n}", str(row[0])).replace("{m}", f"1{row[0]:0>4}") if isinstance(v, str) else v for v in row)

    def df(self, spark):
        return spark.createDataFrame([self._numbered(r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(_literal, self._numbered(r))) + ")" for r in self.rows)
        return f"(VALUES {values}) t({', '.join(self.names)})"

    def spread(self, spark, d: str):
        key = F.col(self.key)
        of = key if self.group is None else F.when(key % 4 == 0, -key).otherwise(F.floor(key / 4))
        out = [of.alias(self.names[0])]
        for name, kind, values, stride in zip(self.names[1:], self.kinds[1:], self.values, self.strides, strict=True):
            by = F.abs(of) if self.group and name in self.group else key
            picked = F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (F.floor(by / stride) % len(values)).cast("int"))
            if kind == "string" and any("{" in v for v in values if v):
                for mark, low, span in MARKS:
                    picked = F.replace(picked, F.lit(mark), (key % span + low).cast("string"))
            out.append(picked.alias(name))
        return spark.read.parquet(f"{d}/{self.table}.parquet").select(*out)

    @property
    def spread_sql(self) -> str:
        of = self.key if self.group is None else f"CASE WHEN {self.key} % 4 = 0 THEN -{self.key} ELSE {self.key} // 4 END"
        out = [f"{of} AS {self.names[0]}"]
        for name, kind, values, stride in zip(self.names[1:], self.kinds[1:], self.values, self.strides, strict=True):
            by = f"abs({of})" if self.group and name in self.group else self.key
            picked = f"CASE ({by} // {stride}) % {len(values)} " + " ".join(f"WHEN {k} THEN {_literal(v)}" for k, v in enumerate(values)) + " END"
            if kind == "string" and any("{" in v for v in values if v):
                for mark, low, span in MARKS:
                    picked = f"replace({picked}, '{mark}', CAST({self.key} % {span} + {low} AS VARCHAR))"
            out.append(f"{picked} AS {name}")
        return f"(SELECT {', '.join(out)} FROM {self.table}) t"


#: What stands for a number in a value: the mark, the least number and how many there are.
MARKS = [("{n}", 0, 997), ("{m}", 10_000, 89_989)]


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


#: The same functions on the literal rows, with their SQL, for tests.
LITERALS: dict[str, tuple] = {}


def literal(fixture: Fixture, sql: str):
    """Register a function of the fixture's frame over its table; {t} in the SQL is the fixture."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(fixture.spread(spark, d))
        ORACLES[f.__name__] = sql.replace("{t}", fixture.spread_sql)
        LITERALS[f.__name__] = (lambda spark: f(fixture.df(spark)), sql.replace("{t}", fixture.sql))
        return f

    return register


def ids(values: list) -> list[tuple]:
    return [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]


PAIRS = Fixture("id int, a string, b string", ids([("x{n}", "y"), ("", "y"), (" ", "y{n}"), (None, "y"), ("", ""), (None, None), ("x", None)]), free=True)


@literal(PAIRS, "SELECT id, coalesce(nullif(a, ''), nullif(b, ''), '') AS v FROM {t}")
def f01_first_non_empty(t):
    return t.select("id", C.first_non_empty(F.col("a"), F.col("b")).alias("v"))


DATES = Fixture("id int, s string", ids(["2019-04-05", "4/15/2020", "12/1/1999 extra", "2021-07-08T10:00:00", "2019", "no {n}", "", None, "in 12345", "term {m} of court"]))


@literal(DATES, r"""SELECT id, nullif(regexp_extract(s, '([0-9][0-9][0-9][0-9])', 1), '') AS y,
CASE WHEN regexp_matches(s, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN strptime(s, '%m/%d/%Y')::DATE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN substr(s, 1, 10)::DATE WHEN s LIKE '12/1/1999%' THEN DATE '1999-12-01' END AS d FROM {t}""")
def f03_f17_year_and_date(t):
    return t.select("id", C.year(F.col("s")).alias("y"), C.parse_date(F.col("s")).alias("d"))


TYPES = Fixture("id int, s string", ids(["020lead", "010combined", "Lead and combined", "combined concurrence", "030concurrence", "040Dissent", "050addendum", "concurs", "100trialcourt", "", None, "TRUE", "1", "t", "f"]))


@literal(TYPES, """SELECT id, CASE WHEN s ILIKE '%lead%' THEN 0 WHEN s ILIKE '%combined%' THEN 1 WHEN s ILIKE '%concurr%' OR s ILIKE '%dissent%' OR s ILIKE '%addendum%' THEN 3 ELSE 2 END AS prio,
coalesce(lower(s) = 'true' OR s = '1' OR lower(s) = 't', false) AS flag FROM {t}""")
def f04_f06_type_and_truth(t):
    return t.select("id", C.type_priority(F.col("s")).alias("prio"), C.is_true(F.col("s")).alias("flag"))


TEXTS = Fixture("id int, html string, plain_text string, xml_harvard string", ids([("<p>a{n}  b</p>", "c", "d"), ("<br/> ", " c  c{n}\n", "d"), ("", "", "<x>d</x> e{n}"), (None, "  ", None), ("a &amp; b", None, None), (None, None, None)]), free=True)


@literal(TEXTS, r"SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(regexp_replace(plain_text, '^\s+|\s+$', '', 'g'), ''), nullif(trim(regexp_replace(regexp_replace(xml_harvard, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), '') AS v FROM {t}")
def f05_best_text(t):
    return t.select("id", corpus.best_text(t).alias("v"))


CASE_NAMES = Fixture("id int, s string", ids(["Foo {n} v. Bar", "Foo v. Bar{n} Revision: 3/1/20", "FOO v. Bar {n}   Revisions: 1 and 2", "Subrevisions: kept v. Roe", "  O'Hara & Co. v. 3M ", "", None, "the Secretary of State v. Acme-Widgets, Inc.", "United States v. Álvarez"]))


@literal(CASE_NAMES, r"""WITH r AS (SELECT id, regexp_replace(coalesce(s, ''), '(?i)\s+revisions?:.*$', '') AS s FROM {t})
SELECT id, trim(regexp_replace(lower(s), '[^a-z0-9 ]', '', 'g')) AS spaced, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS tight, trim(s) AS plain FROM r""")
def f08_names_without_revisions(t):
    s = F.col("s")
    return t.select("id", C.norm_name_spaced(s).alias("spaced"), C.norm_name_tight(s).alias("tight"), N.plain_name(s).alias("plain"))


@literal(CASE_NAMES, f"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(s, '')), '[a-z]{{3,}}')) AS w FROM {{t}})
SELECT id, coalesce((SELECT string_agg(DISTINCT w.w, ',' ORDER BY w.w) FROM w WHERE w.id = t.id AND w.w NOT IN ({', '.join(repr(x) for x in N.CAPTION_STOP)})), '') AS words FROM {{t}}""")
def f37_caption_words(t):
    return t.select("id", F.array_join(N.caption_words(F.col("s")), ",").alias("words"))


SURNAMES = Fixture("id int, s string, court string", ids([("O'Scannlain", "CA9"), ("D’Amato", "CA5"), ("García", "CA5"), ("Ikluta", "CA9"), ("OWEN", "CA5"), ("OWEN", "CA9"), ("Hunsaker", "CA9"), ("Carrillo-Ramirez", "CA5"), ("", "CA5"), (None, None), ("Mekeown", "CA9"), ("Ångström-Øst", "CA5"), ("Otis", "CA5")]), free=True)


@literal(SURNAMES, r"""WITH n AS (SELECT id, court, s, regexp_replace(strip_accents(lower(coalesce(s, ''))), '[^a-z]', '', 'g') AS f FROM {t}),
x AS (SELECT id, CASE WHEN s LIKE 'O''%' OR s LIKE 'D’%' THEN f || ',' || substr(f, 2) ELSE f END AS keys FROM n),
m AS (SELECT id, court, f AS v FROM n UNION SELECT id, court, r FROM n JOIN (VALUES ('ikluta', 'ikuta'), ('ieuta', 'ikuta'), ('mekeown', 'mckeown'), ('grajber', 'graber'), ('murgia', 'murguia'), ('reayley', 'reavley')) o(w, r) ON f = w),
g AS (SELECT * FROM (VALUES ('CA5', 1, 'richman'), ('CA5', 1, 'owen'), ('CA9', 2, 'forrest'), ('CA9', 2, 'hunsaker'), ('CA5', 3, 'ramirez'), ('CA5', 3, 'carrilloramirez')) a(court, grp, name)),
v AS (SELECT id, v FROM m UNION SELECT m.id, b.name FROM m JOIN g a ON m.court = a.court AND m.v = a.name JOIN g b USING (grp))
SELECT n.id, n.f AS folded, x.keys, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM v WHERE v.id = n.id AND v <> ''), '') AS variants FROM n JOIN x USING (id)""")
def f09_f10_f12_surnames(t):
    s = F.col("s")
    return t.select("id", N.fold(s).alias("folded"), F.array_join(N.last_keys(s), ",").alias("keys"), F.array_join(N.surname_variants(s, F.col("court")), ",").alias("variants"))


GIVEN = Fixture("id int, first string, middle string", ids([("Ryan", "Douglas"), ("N[orman]", "Randy"), ("Milan", None), ("J. R.", "Jr."), ("", ""), (None, None), ("W.", "Eugene III"), ("Éva", "2nd x"), ("Jr", "Ann")]), free=True)


@literal(GIVEN, r"""WITH p AS (SELECT id, list_filter(regexp_split_to_array(replace(replace(coalesce(first, ''), '[', ''), ']', ''), '[\s.]+') || regexp_split_to_array(replace(replace(coalesce(middle, ''), '[', ''), ']', ''), '[\s.]+'), lambda x: regexp_matches(x, '^\p{L}') AND lower(x) NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS w,
list_filter(list_transform(regexp_split_to_array(coalesce(first, ''), '[\s,]+'), lambda x: regexp_replace(strip_accents(lower(x)), '[^a-z]', '', 'g')), lambda x: length(x) > 1 AND x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS f FROM {t})
SELECT id, array_to_string(list_transform(w, lambda x: upper(substr(x, 1, 1))), '') AS initials, coalesce(f[1], '') AS token FROM p""")
def f11_f13_given_names(t):
    return t.select("id", N.initials_of_name(F.col("first"), F.col("middle")).alias("initials"), N.first_token(F.col("first")).alias("token"))


LETTERS = Fixture("id int, a string, b string", ids([("R.D.", "RD"), ("R.", "RD"), ("D.", "RD"), ("R.X.", "RD"), ("", "RD"), ("R.D.", ""), ("Q.", "RD"), ("W.E.", "E"), ("m.d.", "MD"), (None, "A")]), free=True)


@literal(LETTERS, """WITH p AS (SELECT id, regexp_replace(upper(coalesce(a, '')), '[^A-Z]', '', 'g') AS a, b FROM {t})
SELECT id, a, CASE WHEN a = '' OR b = '' THEN true WHEN left(a, 1) = left(b, 1) THEN length(a) = 1 OR length(b) = 1 OR substr(a, 2, 1) = substr(b, 2, 1) ELSE length(a) = 1 AND length(b) > 1 AND a = substr(b, 2, 1) END AS ok,
a <> '' AND b <> '' AND len(list_intersect(string_split(a, ''), string_split(b, ''))) = 0 AS conflict FROM p""")
def f14_f15_f16_letters(t):
    a = C.parse_initials(F.coalesce("a", F.lit("")))
    return t.select("id", a.alias("a"), C.initials_ok(a, F.col("b")).alias("ok"), C.initials_conflict(a, F.col("b")).alias("conflict"))


CANDIDATES = Fixture("id int, initials string, c string", [(1, "", "AB"), (1, "", "XY"), (2, "A", "AB"), (3, "Q", "AB"), (4, "A", "AB"), (4, "A", "AC"), (4, "A", "XY"), (5, "B", "AB"), (6, "X", "AB"), (6, "X", "CD")], free=True, group=("initials",))


@literal(CANDIDATES, """WITH n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {t}),
k AS (SELECT id, c FROM n WHERE initials = '' OR (n = 1 AND contains(c, initials)) OR (n > 1 AND (left(c, 1) = initials OR substr(c, 2, 1) = initials)))
SELECT t.id, coalesce((SELECT string_agg(k.c, ',' ORDER BY k.c) FROM k WHERE k.id = t.id), '') AS kept FROM (SELECT DISTINCT id FROM {t}) t""")
def f56_by_initials(t):
    groups = t.groupBy("id", "initials").agg(F.array_sort(F.collect_list(F.struct(F.col("c").alias("initials")))).alias("cands"))
    kept = N.fits_initials(F.col("cands"), F.col("initials"), C.initials_ok, C.initials_conflict)
    return groups.select("id", F.array_join(F.transform(kept, lambda x: x["initials"]), ",").alias("kept"))


COURT_NAMES = Fixture("id int, s string", ids(["ca9", "9", "Ninth Circuit", "U.S. Court of Appeals for the Fifth Circuit", "cadc", "D.C. Circuit", "District of Columbia", "dc", "cafc", "Federal Circuit", "ca11", "10", "Eleventh Circuit", "First", "court", "", None, "CA5"]))


@literal(COURT_NAMES, r"""SELECT id, CASE WHEN s IS NULL OR s = '' THEN '' WHEN lower(s) LIKE '%d.c%' OR lower(s) LIKE '%district of columbia%' OR regexp_matches(lower(s), '\bdc\b|\bcadc\b') THEN 'dc' WHEN lower(s) LIKE '%fed%' OR lower(s) LIKE '%cafc%' THEN 'fed'
ELSE coalesce((SELECT min_by(n, CAST(n AS INTEGER)) FROM (VALUES ('first', '1'), ('second', '2'), ('third', '3'), ('fourth', '4'), ('fifth', '5'), ('sixth', '6'), ('seventh', '7'), ('eighth', '8'), ('ninth', '9'), ('tenth', '10'), ('eleventh', '11')) o(w, n) WHERE contains(lower(s), w)), regexp_extract(s, '(1[01]|[1-9])', 1)) END AS k FROM {t}""")
def f18_circuit_key(t):
    return t.select("id", C.circuit_key(F.col("s")).alias("k"))


DOCKETS = Fixture("id int, s string", ids(["No. 20-1199, 21-{n}", "No. 16–{m}.", "141, Orig.", "22O141", "Nos. 19-1 and 19-2; 19-3", "20-1199 & 20-1199", "", None, "19−55/19-56", "ANDOVER 1", "no 14-556"]))


@literal(DOCKETS, r"""WITH u AS (SELECT id, regexp_replace(upper(coalesce(s, '')), '[\x{2010}-\x{2015}\x{2212}]', '-', 'g') AS s FROM {t}),
o AS (SELECT id, s, coalesce(nullif(regexp_extract(s, '(\d+)\s*,?\s*ORIG', 1), ''), regexp_extract(s, '^\s*\d{2}O(\d+)\s*$', 1)) AS n FROM u),
p AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(s, '\bNOS?\.?\s*', ' ', 'g'), '[,;&/]|\bAND\b')) AS x FROM o WHERE n = ''),
k AS (SELECT DISTINCT id, regexp_replace(x, '[^A-Z0-9-]', '', 'g') AS x FROM p UNION SELECT id, n || 'ORIG' FROM o WHERE n <> '')
SELECT t.id, coalesce((SELECT string_agg(k.x, ',' ORDER BY k.x) FROM k WHERE k.id = t.id AND k.x <> ''), '') AS tokens FROM {t}""")
def f19_docket_tokens(t):
    return t.select("id", F.array_join(C.docket_tokens(F.col("s")), ",").alias("tokens"))


CITES = Fixture("id int, volume string, page string", ids([("{n}", "644"), (" 576 ", " {m} "), ("576", "___"), ("576", ""), ("576", None), (None, "5"), ("5 76", "1 2")]), free=True)


@literal(CITES, "SELECT id, CASE WHEN trim(coalesce(page, '')) = '' OR contains(page, '_') THEN '' ELSE replace(coalesce(volume, '') || 'U.S.' || page, ' ', '') END AS cite FROM {t}")
def f20_citations(t):
    return t.select("id", C.norm_cite(F.col("volume"), F.col("page")).alias("cite"))


SCORES = Fixture("id int, s double", ids([-0.31, -0.3, 0.0, 0.3, 0.31, None]))


@literal(SCORES, "SELECT id, CASE WHEN s IS NULL THEN '' WHEN s < -0.3 THEN 'Liberal' WHEN s > 0.3 THEN 'Conservative' ELSE 'Moderate' END AS label FROM {t}")
def f21_bounds_are_moderate(t):
    return t.select("id", C.classify_score(F.col("s").cast("double")).alias("label"))


OPENINGS = Fixture("id int, s string", ids(["x No. 19-{m}, 19-12346 and 20-1 y", "Nos. 19-12345 & 19-222", "19-12345 alone", "No 20-55555 No. 18-333", "", None, "No. 1-2", "x" * 2490 + " No. 19-12345"]))


@literal(OPENINGS, r"""WITH l AS (SELECT id, unnest(regexp_extract_all(substr(coalesce(s, ''), 1, 2500), '\bNos?\.?\s*((?:\d{2}-\d{3,6})(?:\s*(?:,|and|&)\s*\d{2}-\d{3,6})*)')) AS l FROM {t}), d AS (SELECT DISTINCT id, unnest(regexp_extract_all(l, '\d{2}-\d{3,6}')) AS d FROM l)
SELECT t.id, coalesce((SELECT string_agg(d.d, ',' ORDER BY d.d) FROM d WHERE d.id = t.id), '') AS numbers FROM {t}""")
def f36_dockets(t):
    return t.select("id", F.array_join(N.dockets(F.col("s")), ",").alias("numbers"))


KEYS = Fixture("id int, court string, author string, judge string, outcome string, topic string", ids([("SCOTUS", "Roe", "Kagan", "affirmed", "1"), ("SCOTUS", "Roe", " ", "Vacated ", "2.0"), ("CA9", "Bea", "panel of three", "affirmed_in_part", "8"), ("CA9", "", "Bea", "granted", "13"), ("CA5", " Smith ", None, "mixed", ""), ("CA9", " Smith", None, "", None), ("CA5", None, None, None, "x"), ("SCOTUS", None, None, "odd", "8.0")]), free=True)


@literal(KEYS, """SELECT id, CASE WHEN court = 'SCOTUS' THEN 'scotus::' || coalesce(nullif(lower(trim(judge)), ''), '_unknown_' || id) ELSE lower(court) || '::' || coalesce(nullif(lower(trim(author)), ''), '_unknown_' || id) END AS author_key,
CASE WHEN court = 'SCOTUS' THEN 'scotus::case_' || id ELSE lower(court) || '::' || coalesce(nullif(lower(trim(author)), ''), '_unknown_' || id) END AS group_key,
CASE lower(trim(outcome)) WHEN 'affirmed' THEN 'affirmed' WHEN 'reversed' THEN 'reversed' WHEN 'vacated' THEN 'reversed' WHEN 'remanded' THEN 'reversed' WHEN 'mixed' THEN 'mixed' WHEN 'affirmed_in_part' THEN 'mixed' WHEN 'denied' THEN 'procedural' WHEN 'dismissed' THEN 'procedural' WHEN 'granted' THEN 'procedural' ELSE 'other' END AS outcome_group,
CASE split_part(coalesce(topic, ''), '.', 1) WHEN '1' THEN '1 criminal' WHEN '2' THEN '2 civil_rights' WHEN '8' THEN '8 economic' WHEN '' THEN '∅' ELSE 'other' END AS issue_group FROM {t}""")
def f41_group_keys(t):
    keys = [F.col(c) for c in ("court", "author", "judge", "id")]
    return t.select("id", C.author_key(*keys).alias("author_key"), C.group_key(*keys).alias("group_key"), C.outcome_group(F.col("outcome")).alias("outcome_group"), C.issue_group(F.col("topic")).alias("issue_group"))


ANSWERS = Fixture("id int, s string", ids(["text {n}. Disposition: affirmed", "Disposition - affirmed_in_part", "disposition: what", "we affirmed_in_part and remanded", "REVERSED and remanded", "nothing", "", "Disposition: mixed", "disposition: unclear", "Disposition : Vacated.", "I think Liberal", "conservative, not liberal", "moderate", None]))


@literal(ANSWERS, r"""WITH l AS (SELECT * FROM (VALUES (1, 'affirmed_in_part'), (2, 'affirmed'), (3, 'reversed'), (4, 'vacated'), (5, 'remanded'), (6, 'dismissed'), (7, 'denied'), (8, 'granted'), (9, 'mixed'), (10, 'other'), (11, 'unclear')) l(n, name)),
w AS (SELECT id, s, CASE WHEN regexp_matches(lower(s), 'disposition\s*[:-]\s*[a-z_]') THEN regexp_extract(lower(s), 'disposition\s*[:-]\s*([a-z_]+)', 1) ELSE lower(s) END AS w FROM {t})
SELECT id, coalesce((SELECT min_by(name, n) FROM l WHERE contains(w, name)), 'unclear') AS outcome, CASE WHEN s ILIKE '%liberal%' THEN 'liberal' WHEN s ILIKE '%conservative%' THEN 'conservative' WHEN s ILIKE '%moderate%' THEN 'moderate' ELSE '' END AS label FROM w""")
def f44_f49_answers(t):
    return t.select("id", C.parse_disposition(F.col("s")).alias("outcome"), C.ideology_label(F.col("s")).alias("label"))


CODES = Fixture("id int, code int, n int, total int", ids([(k, k, 16) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)] + [(15, 0, 0)]))


@literal(CODES, """SELECT id, CASE WHEN code <= 3 THEN code WHEN code IN (4, 5) THEN 4 WHEN code IN (6, 7, 8, 12) THEN 5 WHEN code <= 14 THEN 6 ELSE code END AS collapsed,
CASE WHEN total = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * n / total) END AS pct,
repeat('█', CASE WHEN total = 0 THEN 0 ELSE CAST(round_even(n * 20.0 / total, 0) AS INTEGER) END) || repeat('░', 20 - CASE WHEN total = 0 THEN 0 ELSE CAST(round_even(n * 20.0 / total, 0) AS INTEGER) END) AS bar FROM {t}""")
def f50_f51_codes(t):
    return t.select("id", evaluation.collapse_topic(F.col("code")).alias("collapsed"), C.percent(F.col("n"), F.col("total")).alias("pct"), reports.bar(F.col("n"), F.col("total")).alias("bar"))


BODIES = Fixture("id int, syllabus string, issue string, opinion string", ids([("s" * 600, "i" * 400, "o" * 4000), ("", " q ", "o"), (None, None, None), ("a b/c*d~é+%&={n}", "", "x"), ("\n s {n} \n", "", "")]), free=True, table="customer", key="c_custkey")
_CHOICES = "\n".join(["A. Criminal Procedure", "B. Civil Rights", "C. First Amendment", "D. Due Process", "E. Privacy", "F. Attorneys", "G. Unions", "H. Economic Activity", "I. Judicial Power", "J. Federalism", "K. Interstate Relations", "L. Federal Taxation", "M. Miscellaneous", "N. Private Action"])


@literal(BODIES, rf"""WITH c AS (SELECT id, syllabus, left(nullif(regexp_replace(syllabus, '^\s+|\s+$', '', 'g'), ''), 500) AS a, left(nullif(trim(issue), ''), 300) AS b, left(nullif(opinion, ''), 3000) AS c FROM {{t}})
SELECT id, concat_ws(chr(10) || chr(10), a, b, c) || chr(10) || chr(10) || 'Question: What is the issue area of the decision?' || chr(10) || '{_CHOICES}' || chr(10) || 'Answer:' AS prompt, 'text=' || replace(url_encode(coalesce(syllabus, '')), '%2F', '/') AS request FROM c""")
def f52_f53_requests(t):
    return t.select("id", evaluation.topic_prompt(F.col("syllabus"), F.col("issue"), F.col("opinion")).alias("prompt"), evaluation.citation_request(F.coalesce("syllabus", F.lit(""))).alias("request"))


STARTS = Fixture("id int, before string, start string, body string", ids([("Counsel for x. ", "OPINION BEA, Circuit Judge:", " We affirm."), ("SYLLABUS y. ", "Chief Justice Roberts delivered the opinion", " of the Court."), ("head ", "SMITH, Circuit Judge:", " text"), ("No. 1 ", "PER CURIAM:", " text"), ("all of it", "", ""), ("PER CURIAM: first, then ", "Justice Kagan delivered the opinion", " z"), ("h" * 16_000 + " ", "", "PER CURIAM: too late"), ("", "", "")]), table="customer", key="c_custkey")


@literal(STARTS, "SELECT id, CASE WHEN start <> '' THEN start || body ELSE before || body END AS body FROM {t}")
def f42_strip_header(t):
    return t.select("id", records.strip_header(F.concat("before", "start", "body")).alias("body"))


WRITINGS = Fixture("cluster_id int, id string, text string", [(1, "10", "b"), (1, "9", "a"), (1, "x", "z"), (1, "11", ""), (2, "1", ""), (3, None, "n"), (3, "2", "m")], free=True, group=())


@literal(WRITINGS, "SELECT cluster_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY coalesce(try_cast(id AS BIGINT), 9223372036854775807), text) FILTER (WHERE text <> ''), '') AS joined FROM {t} GROUP BY 1")
def f29_f57_joined_texts(t):
    items = F.collect_list(F.struct(C.numeric_id(F.col("id")).alias("key"), "text"))
    return t.groupBy("cluster_id").agg(corpus.joined_texts(items).alias("joined"))


ENUMS = Fixture("id int, d string, p string, v string", ids([("Affirmed", "appellant", "4.5"), ("weird", "nobody", "2.5"), ("", "", "9"), (None, None, "-3"), (" mixed ", "GOVERNMENT", "x"), ("unclear", "unclear", None)]), free=True)


@literal(ENUMS, """SELECT id, CASE WHEN trim(coalesce(d, '')) = '' THEN 'unclear' WHEN lower(trim(d)) IN ('affirmed', 'mixed', 'unclear') THEN lower(trim(d)) ELSE 'other' END AS d,
CASE WHEN lower(trim(p)) IN ('appellant', 'government') THEN lower(trim(p)) ELSE 'unclear' END AS p, CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN greatest(1, least(5, CAST(round_even(try_cast(v AS DOUBLE), 0) AS INTEGER))) END AS axis FROM {t}""")
def f39_f48_clamps(t):
    return t.select("id", C.clamp_enum(F.col("d"), C.DISPOSITIONS, "other").alias("d"), C.clamp_enum(F.col("p"), C.PARTIES, "unclear").alias("p"), C.clamp_axis(F.col("v")).alias("axis"))
