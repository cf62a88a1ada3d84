"""Queries over the driver's tables, each with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions import columns as C
from quillfold.operators import relational as R
from quillfold.operators.similarity import PLAIN, entry, similar_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SP = r"[ \t\n\r\f\x0B]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


@query("SELECT page_id, regexp_extract(url, '(\\d{4})', 1) AS y, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS body FROM pages")
def f02_f03_html_year(spark, d):
    return read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.regexp_extract("url", r"(\d{4})", 1).alias("y"), C.strip_html(F.col("html")).alias("body"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def f07_word_count(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", C.word_count(F.col("text")).alias("n_words"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS spaced, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS tight FROM part")
def f08_norm_names(spark, d):
    return read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", C.norm_name_spaced(F.col("p_name")).alias("spaced"), C.norm_name_tight(F.col("p_name")).alias("tight"))


@query("""WITH s AS (SELECT s_suppkey, regexp_replace(upper(substr(n_name, 1, 2)), '[^A-Z]', '', 'g') AS a, regexp_replace(upper(substr(r_name, 1, 2)), '[^A-Z]', '', 'g') AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, a = '' OR b = '' OR (a[1] = b[1] AND (length(a) < 2 OR length(b) < 2 OR a[2] = b[2])) OR (length(a) = 1 AND length(b) >= 2 AND a = b[2]) AS ok,
a <> '' AND b <> '' AND NOT list_has_any(string_split(a, ''), string_split(b, '')) AS conflict FROM s""")
def f14_f16_initials(spark, d):
    n = read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(R.small(read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    n = n.join(R.small(read(spark, d, "region", "r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = C.parse_initials(F.substring("n_name", 1, 2)), C.parse_initials(F.substring("r_name", 1, 2))
    return n.select("s_suppkey", C.initials_ok(a, b).alias("ok"), C.initials_conflict(a, b).alias("conflict"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def f17_dates(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return o.select("o_orderkey", C.parse_date(text).alias("d"))


@query("SELECT c_custkey, CASE WHEN c_acctbal / 10000.0 < -0.3 THEN 'Liberal' WHEN c_acctbal / 10000.0 > 0.3 THEN 'Conservative' ELSE 'Moderate' END AS label FROM customer")
def f21_classify(spark, d):
    return read(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", C.classify_score(F.col("c_acctbal") / 10000.0).alias("label"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(substr(text, 1, 20000)), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS t, regexp_extract_all(lower(text), '[a-z0-9]+') AS u FROM documents)
SELECT doc_id, CAST(CASE WHEN len(t) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) END AS INTEGER) AS n_window,
CAST(CASE WHEN len(u) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(u) - 3), lambda i: array_to_string(u[i:i+4], ' ')))) END AS INTEGER) AS n_text FROM w""")
def f33_f34_shingles(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(C.window_shingles(F.col("text"))).alias("n_window"), F.size(C.text_shingles(F.col("text"))).alias("n_text"))


@query("""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS u FROM documents),
g AS (SELECT doc_id, source, unnest(list_distinct(list_transform(range(1, len(u) - 3), lambda i: array_to_string(u[i:i+4], ' ')))) AS s FROM w WHERE len(u) >= 5),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.source = b.source AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(o / CAST(x.n + y.n - o AS DOUBLE), 6) AS similarity FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 2 * o >= x.n + y.n - o""")
def j20_f35_blocked_similarity(spark, d):
    """Pairs of one source with Jaccard >= 0.5, over an index of rare shingles."""
    docs = read(spark, d, "documents", "doc_id", "source", "text").withColumnRenamed("doc_id", "id").where("source IS NOT NULL")
    least = F.lit(0.5)
    rows = docs.select("id", F.lower("text").alias("text"), F.array(entry(F.xxhash64("source"), least, least)).alias("e"))
    pairs = similar_pairs(rows, docs.select("id", "source", least.alias("least")), ["source"], rule=PLAIN)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN length(text) <= 10000 THEN text ELSE substr(text, 1, 8000) || chr(10) || '[...]' || chr(10) || right(text, 2000) END AS body FROM documents")
def f38_head_and_tail(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", C.head_and_tail(F.col("text")).alias("body"))


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) WHEN trim(event_type) = '' THEN 'unclear' ELSE 'other' END AS clamped, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(event_type AS BIGINT), 9223372036854775807) AS num FROM events")
def f39_f40_f57_clean(spark, d):
    e = read(spark, d, "events", "event_id", "event_type", "props")
    return e.select("event_id", C.clamp_enum(F.col("event_type"), ["click", "view"], "other").alias("clamped"), C.tolerant_json(F.concat(F.lit("say: "), F.col("props"), F.lit(" end")), "k long")["k"].alias("k"), C.numeric_id(F.col("event_type")).alias("num"))


@query("""WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS sys FROM conversations WHERE role = 'system' GROUP BY 1),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations WHERE role <> 'system')
SELECT m.conv_id, string_agg(role || ': ' || CASE WHEN role = 'user' AND r = 1 AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || text ELSE text END, chr(10) ORDER BY turn) AS chat FROM m LEFT JOIN s USING (conv_id) GROUP BY 1""")
def f45_c11_a19_chat_records(spark, d):
    t = read(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    merged = t.select("conv_id", C.merge_system(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("m")).where(F.size("m") > 0)
    return merged.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("chat"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+') AS w, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, ' ') <> ''))) AS s FROM documents),
c AS (SELECT doc_id, w, s, list_sum(list_transform(w, lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+'))) END)) AS y FROM w)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CASE WHEN len(w) > 0 THEN round(len(w) / CAST(s AS DOUBLE), 6) END AS sentence_words, CASE WHEN len(w) > 0 THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / CAST(len(w) AS DOUBLE), 6) END AS ttr, CASE WHEN len(w) > 0 THEN round(0.39::DOUBLE * len(w) / s + 11.8::DOUBLE * y / len(w) - 15.59::DOUBLE, 6) END AS grade FROM c""")
def f46_f47_text_stats(spark, d):
    t = read(spark, d, "documents", "doc_id", "text").select("doc_id", C.text_stats(F.col("text")).alias("s"))
    return t.select("doc_id", "s.n_words", F.round("s.sentence_words", 6).alias("sentence_words"), F.round("s.ttr", 6).alias("ttr"), F.round("s.grade", 6).alias("grade"))


@query("SELECT event_id, greatest(1, least(5, CAST(round_even(value, 0) AS INTEGER))) AS axis FROM events")
def f48_clamp(spark, d):
    return read(spark, d, "events", "event_id", "value").select("event_id", C.clamp_axis(F.col("value").cast("string")).alias("axis"))


@query("""WITH e AS (SELECT vec_id, list_transform(range(0, 14), lambda i: list_sum(list_transform(list_filter(range(1, 65), lambda j: (j - 1) % 14 = i), lambda j: CAST(embedding[j] AS DOUBLE)))) AS l FROM embeddings)
SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS label, round(1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 3) AS confidence FROM e""")
def f54_softmax(spark, d):
    """All components, summed to fourteen logits."""
    x = F.col("embedding").cast("array<double>")
    logits = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.aggregate(F.filter(x, lambda v, j: j % 14 == i), F.lit(0.0), lambda a, v: a + v))
    e = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", C.softmax_best(logits).alias("s"))
    return e.select("vec_id", F.col("s.label").cast("long").alias("label"), F.round("s.confidence", 3).alias("confidence"))


@query("""WITH kept AS (SELECT o_orderkey, n_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) AND year(o_orderdate) BETWEEN 1996 AND 1999
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey) <= 60),
best AS (SELECT kept.*, l_linenumber, l_quantity, l_returnflag FROM kept JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 5
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1)
SELECT n_name, o_orderkey, l_linenumber, l_quantity FROM best WHERE l_returnflag <> 'R' AND l_quantity >= 10""")
def c01_bulk_filter(spark, d):
    """Dimension joins, year range, newest k for each court, best text of a case, then the filters that follow that choice."""
    nations = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").where(F.col("n_regionkey").isin(1, 2))
    customers = read(spark, d, "customer", "c_custkey", "c_nationkey").join(R.small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    cases = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").where(F.year("o_orderdate").between(1996, 1999)).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    cases = R.top_k(cases, ["n_name"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 60).select("o_orderkey", "n_name")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = read(spark, d, "lineitem", "l_orderkey", *order).where("l_quantity > 5").join(cases, F.col("l_orderkey") == F.col("o_orderkey"))
    best = R.keep_first(lines, ["o_orderkey"], [F.col(c) for c in order])
    return best.where("l_returnflag <> 'R' AND l_quantity >= 10").select("n_name", "o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey AS k, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS first_part, max_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS last_part FROM lineitem GROUP BY 1")
def j05_j07_j08_first_last(spark, d):
    order = F.struct("l_linenumber", "l_partkey")
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.min_by("l_partkey", order).alias("first_part"), F.max_by("l_partkey", order).alias("last_part"))


@query("""WITH a AS (SELECT s_nationkey AS key, min(s_suppkey) AS hit FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), b AS (SELECT n_nationkey AS key, min(n_regionkey) AS hit FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1)
SELECT c_custkey, coalesce(a.hit, b.hit) AS hit, CASE WHEN a.hit IS NOT NULL THEN 'docket' WHEN b.hit IS NOT NULL THEN 'cite' ELSE 'none' END AS method FROM customer LEFT JOIN a ON c_nationkey = a.key LEFT JOIN b ON c_nationkey = b.key""")
def j06_cascade(spark, d):
    a = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("hit"))
    b = read(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("long").alias("hit"))
    return R.cascade(read(spark, d, "customer", "c_custkey", "c_nationkey"), "c_custkey", [("docket", a, "c_nationkey"), ("cite", b, "c_nationkey")])


@query("""WITH s AS (SELECT s_suppkey AS person, s_nationkey AS k, DATE '1995-01-01' + CAST(s_suppkey % 40 AS INTEGER) * 60 AS a, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey % 40 AS INTEGER) * 60 + 300 END AS b FROM supplier),
o AS (SELECT o_orderkey, c_nationkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, count(DISTINCT person) AS n_active, CASE WHEN count(DISTINCT person) = 1 THEN min(person) END AS person FROM o LEFT JOIN s ON o.k = s.k AND s.a <= d AND (s.b IS NULL OR s.b >= d) GROUP BY 1""")
def j11_interval_decision(spark, d):
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 40 * 60).cast("int"))
    spans = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("k"), start.alias("start"), F.when(F.col("s_suppkey") % 5 != 0, F.date_add(start, 300)).alias("end"))
    rows = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(read(spark, d, "customer", "c_custkey", F.col("c_nationkey").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    return R.interval_decision(rows.select("o_orderkey", "k", F.to_date("o_orderdate").alias("d")), R.small(spans), "o_orderkey", "k", "d")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 3")
def j16_j17_override_anti(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("").alias("c_mktsegment"))
    return R.override(c, changes, "c_custkey").join(c.where("c_custkey % 7 = 3").select("c_custkey"), "c_custkey", "left_anti")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT a.o_orderkey AS id, min(b.o_orderkey) AS twin FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(date_diff('day', a.d, b.d)) <= 40 GROUP BY 1""")
def j18_twins(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    b = o.select(F.col("o_orderkey").alias("other"), "o_custkey", F.col("d").alias("e"))
    near = o.join(b, "o_custkey").where("o_orderkey <> other AND abs(datediff(d, e)) <= 40")
    return near.groupBy(F.col("o_orderkey").alias("id")).agg(F.min("other").alias("twin"))


@query("SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey, 'new' AS v FROM customer WHERE c_custkey % 3 = 0) n ON o.c_custkey = n.c_custkey")
def k06_upsert(spark, d):
    c = read(spark, d, "customer", "c_custkey", F.col("c_mktsegment").alias("v"))
    return R.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("v", F.lit("new")), "c_custkey")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'none', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'all', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)""")
def u02_u04_sets(spark, d):
    a, b = read(spark, d, "orders", F.col("o_custkey").alias("k")), read(spark, d, "customer", F.col("c_custkey").alias("k"))
    count = lambda name, df: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count("both", a.intersect(b)).unionByName(count("none", b.join(a, "k", "left_anti").distinct())).unionByName(count("all", a.unionByName(b).distinct()))


@query("SELECT lang, source, count(*) AS n, count(*) > 0 AND count(*) < 10 AS sparse FROM documents GROUP BY 1, 2")
def a02_p15_cells(spark, d):
    return read(spark, d, "documents", "lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("sparse", (F.col("n") > 0) & (F.col("n") < 10))


@query("SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean, quantile_disc(n_chars, 0.5 ORDER BY n_chars DESC) AS median, count(*) AS n FROM documents GROUP BY 1")
def a04_stats(spark, d):
    return read(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"), R.upper_median("n_chars").cast("long").alias("median"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE trim(c_name) <> '') AS c_name, count(*) FILTER (WHERE trim(v) <> '') AS v FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN ' ' ELSE 'x' END AS v FROM customer) GROUP BY ROLLUP (c_mktsegment))
SELECT c_mktsegment, 'c_name' AS field, c_name AS present, n - c_name AS missing FROM c UNION ALL SELECT c_mktsegment, 'v', v, n - v FROM c""")
def a05_a06_presence(spark, d):
    c = read(spark, d, "customer", "c_mktsegment", "c_name", F.when(F.col("c_acctbal") < 0, " ").otherwise("x").alias("v"))
    return R.presence(c, ["c_name", "v"], "c_mktsegment")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1")
def a07_a18_pivot(spark, d):
    o = read(spark, d, "orders", "o_orderpriority", "o_orderstatus")
    p = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    return p.withColumn("total", F.col("F") + F.col("O") + F.col("P"))


_GOLD = "SELECT d.source, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS gold, CASE WHEN n_chars % 5 = 0 THEN 'toxic' WHEN n_chars % 5 < 4 THEN 'good' ELSE 'poor' END AS pred FROM documents d JOIN labels l USING (doc_id)"


def _gold(spark, d):
    j = read(spark, d, "documents", "doc_id", "source", "n_chars").join(read(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    m = F.col("n_chars") % 5
    return j.select("source", gold.alias("gold"), F.when(m == 0, "toxic").when(m < 4, "good").otherwise("poor").alias("pred"))


@query(f"WITH g AS ({_GOLD}) SELECT source, round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, count(*) AS n FROM g GROUP BY 1")
def a10_j22_accuracy(spark, d):
    return R.accuracy(_gold(spark, d), "gold", "pred", "source").withColumn("accuracy", F.round("accuracy", 6))


_F1 = "t AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold <> label AND pred = label) AS fp, count(*) FILTER (WHERE gold = label AND pred <> label) AS fn FROM l, g GROUP BY 1) SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS n_labels FROM t"


@query(f"WITH g AS ({_GOLD}), l AS (SELECT gold AS label FROM g UNION SELECT pred FROM g), {_F1}")
def a11_macro_f1(spark, d):
    return R.macro_f1(_gold(spark, d), "gold", "pred").withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"WITH g AS ({_GOLD}), l AS (SELECT unnest(['toxic', 'good', 'absent']) AS label), {_F1}")
def a12_macro_f1_fixed(spark, d):
    labels = spark.createDataFrame([("toxic",), ("good",), ("absent",)], "label string")
    return R.macro_f1(_gold(spark, d), "gold", "pred", labels).withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"WITH g AS ({_GOLD}), n AS (SELECT gold, count(*) AS n FROM g GROUP BY 1) SELECT max(n) / CAST(sum(n) AS DOUBLE) AS share, arg_max(gold, n) AS mode FROM n")
def a15_majority(spark, d):
    n = _gold(spark, d).groupBy("gold").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("share"), F.max_by("gold", "n").alias("mode"))


@query(f"WITH g AS ({_GOLD}) SELECT gold, pred, count(*) AS n FROM g WHERE gold <> pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 10")
def a16_o02_confusion(spark, d):
    return _gold(spark, d).where("gold <> pred").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(10)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(CASE WHEN (l_quantity > 0) = (l_extendedprice > 0) THEN 1.0 ELSE 0.0 END), 6) AS same_sign FROM lineitem")
def a17_pearson(spark, d):
    return R.pearson(read(spark, d, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), F.round("same_sign", 6).alias("same_sign"))


@query("SELECT source, lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM documents GROUP BY 1, 2")
def a21_balance(spark, d):
    n = read(spark, d, "documents", "source", "lang").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("SELECT count(*) AS names, count(*) FILTER (WHERE n > 1) AS repeated, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def a22_repeated(spark, d):
    n = read(spark, d, "documents", "text").groupBy(F.sha2("text", 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in"))


@query("SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders WHERE o_orderstatus <> 'F'")
def a09_a23_period(spark, d):
    return read(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_orderstatus").where("o_orderstatus <> 'F'").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id DESC) AS kept FROM documents")
def w04_keep_latest(spark, d):
    """Each document and the one kept of its identical texts; partitioned by a digest, not by the text."""
    t = read(spark, d, "documents", "doc_id", "text", "n_chars").select("doc_id", "n_chars", F.sha2("text", 256).alias("k"))
    best = t.groupBy("k").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("kept"))
    return t.join(best, "k").select("doc_id", "kept")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def w03_w05_keep_first(spark, d):
    return R.keep_first(read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends, count(*) OVER (PARTITION BY user_id) = 1 AS only_one FROM events")
def w07_w08_segments(spark, d):
    return read(spark, d, "events", "event_id", "ts", "user_id").select("event_id", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ends"), (F.count(F.lit(1)).over(Window.partitionBy("user_id")) == 1).alias("only_one"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id), r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT node, min(root) AS component FROM r WHERE node IN (SELECT a FROM e) GROUP BY 1""")
def c10_components(spark, d):
    """Components of links from each document to the next one with the same text."""
    t = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("k"))
    edges = t.withColumn("b", F.lead("doc_id").over(Window.partitionBy("k").orderBy("doc_id"))).where("b IS NOT NULL").select(F.col("doc_id").alias("a"), "b")
    return R.components(edges)


@query("""WITH c AS (SELECT label, len(embedding) AS n, vec_id, embedding FROM embeddings), x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM c, range(1, 65) r(i) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 5) AS cosine FROM x a JOIN x b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def x08_centroid_cosine(spark, d):
    e = read(spark, d, "embeddings", "label", "embedding").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    c = e.groupBy("label", "i").agg(F.avg("v").alias("m"))
    p = c.select(F.col("label").alias("a"), "i", F.col("m").alias("x")).join(c.select(F.col("label").alias("b"), "i", F.col("m").alias("y")), "i").where("a < b")
    return p.groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), 5).alias("cosine"))


@query("""WITH w AS (SELECT source, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS t FROM documents), g AS (SELECT source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS g FROM w WHERE len(t) > 1)
SELECT source, round(count(DISTINCT g) / CAST(count(*) AS DOUBLE), 6) AS distinct_2 FROM g GROUP BY 1""")
def x08_distinct_n(spark, d):
    w = read(spark, d, "documents", "source", "text").select("source", C.words(F.col("text")).alias("t")).where(F.size("t") > 1)
    g = w.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.slice("t", i, 2)))).alias("g"))
    n = g.groupBy("source", F.xxhash64("g").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source").agg(F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("distinct_2"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t01_windowed_events(spark, d):
    e = read(spark, d, "events", "event_type", "ts", "value")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
