"""The evaluation protocol over the driver's tables: intervals, tests, agreement, alignment, stability, variety."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfold.operators import alignment, evaluation, statistics, text_metrics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Two classifiers of the labelled documents: what quality and toxicity say of each other.
_PREDS = "SELECT doc_id, CAST(quality AS VARCHAR) AS gold, CASE WHEN doc_id % 5 = 0 THEN '2' WHEN toxic = 1 THEN '0' ELSE '1' END AS pred FROM labels"


def _labelled(spark, d):
    pred = F.when(F.col("doc_id") % 5 == 0, "2").when(F.col("toxic") == 1, "0").otherwise("1")
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").cast("string").alias("gold"), pred.alias("pred"))


@query(f"""
WITH p AS ({_PREDS}), r AS (SELECT unnest(range(0, {statistics.REPLICATES} + 1)) AS rep),
w AS (SELECT rep, gold, pred, CASE WHEN rep = 0 THEN 1 ELSE {statistics.weight_sql("doc_id", "rep", 1)} END AS w FROM p, r),
acc AS (SELECT rep, 'accuracy' AS metric, sum(w) FILTER (WHERE gold = pred) / CAST(sum(w) AS DOUBLE) AS v FROM w GROUP BY rep),
seen AS (SELECT DISTINCT rep, label FROM (SELECT rep, gold AS label FROM w WHERE w > 0 UNION ALL SELECT rep, pred FROM w WHERE w > 0)),
cnt AS (SELECT rep, label, coalesce(sum(w) FILTER (WHERE gold = label AND pred = label), 0) AS tp, coalesce(sum(w) FILTER (WHERE gold <> label AND pred = label), 0) AS fp, coalesce(sum(w) FILTER (WHERE gold = label AND pred <> label), 0) AS fn FROM seen JOIN w USING (rep) GROUP BY 1, 2),
f AS (SELECT rep, 'macro_f1' AS metric, avg(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS v FROM cnt GROUP BY rep),
a AS (SELECT * FROM acc UNION ALL SELECT * FROM f)
SELECT metric, round(max(v) FILTER (WHERE rep = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE rep > 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE rep > 0), 6) AS hi FROM a GROUP BY metric""")
def x08_bootstrap_intervals(spark, d):
    """95 % intervals of accuracy and macro F1 over the labels."""
    return _rounded(statistics.bootstrap_intervals(_labelled(spark, d), "doc_id", "gold", "pred"), "estimate", "lo", "hi")


@query(f"""
WITH p AS ({_PREDS}), l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE pred = label) AS predicted FROM l, p GROUP BY label),
e AS (SELECT label, support, predicted, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) END AS recall, 2.0::DOUBLE * tp / (support + predicted) AS f1 FROM c)
SELECT label, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM e
UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), CAST(sum(predicted) AS BIGINT), round(sum(coalesce(precision, 0) * support) / sum(support), 6), round(sum(coalesce(recall, 0) * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM e""")
def x08_class_report(spark, d):
    return _rounded(evaluation.class_report(_labelled(spark, d), "gold", "pred"), "precision", "recall", "f1")


@query("""
WITH d AS (SELECT CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE) AS d FROM lineitem), nz AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS r FROM nz), t AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT count(*) AS n FROM nz GROUP BY a)),
s AS (SELECT count(*) AS m, sum(r) FILTER (WHERE d > 0) AS up, sum(r) FILTER (WHERE d < 0) AS down FROM r), e AS (SELECT count(*) AS n, avg(d) AS mean, avg(d) / stddev_samp(d) AS cohen FROM d)
SELECT n, round(mean, 6) AS mean_difference, round(cohen, 6) AS cohens_d, round(cohen * sqrt(n), 6) AS t, m AS n_nonzero, round(up, 1) AS w_plus, round(down, 1) AS w_minus, round((up - m * (m + 1) / 4.0::DOUBLE) / sqrt(m * (m + 1) * (2.0::DOUBLE * m + 1) / 24 - ties / 48), 6) AS z FROM s, t, e""")
def x08_paired_tests(spark, d):
    """Discount against tax of each line: many ties and zeros."""
    found = statistics.paired_tests(spark.read.parquet(f"{d}/lineitem.parquet"), "l_discount", "l_tax")
    return _rounded(found, "mean_difference", "cohens_d", "t", "z").withColumns({c: F.round(c, 1) for c in ("w_plus", "w_minus")})


@query("""
WITH g AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS m1, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS m2, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') AS v2 FROM lineitem)
SELECT n1 AS n_first, n2 AS n_second, round(m1, 6) AS mean_first, round(m2, 6) AS mean_second, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM g""")
def x08_group_difference(spark, d):
    found = statistics.group_difference(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_quantity", "A", "R")
    return _rounded(found, "mean_first", "mean_second", "cohens_d", "t")


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def x03_spearman(spark, d):
    return _rounded(statistics.spearman(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice"), "rho")


_RATINGS = "SELECT user_id AS u, event_type AS word, CAST(1 + event_id % 5 AS DOUBLE) AS x FROM events"
_ALPHA = """k AS (SELECT u, {v} AS v, x, count(*) OVER (PARTITION BY u) AS m FROM r), p AS (SELECT * FROM k WHERE m > 1),
o AS (SELECT sum({d} / CAST(a.m - 1 AS DOUBLE)) AS o FROM p a JOIN p b ON a.u = b.u), h AS (SELECT v, any_value(x) AS x, count(*) AS c FROM p GROUP BY v), n AS (SELECT sum(c) AS n FROM h), e AS (SELECT sum(CAST(a.c AS DOUBLE) * b.c * {d}) / (SELECT n - 1 FROM n) AS e FROM h a, h b)
SELECT '{kind}' AS kind, (SELECT count(DISTINCT u) FROM p) AS n_units, (SELECT count(*) FROM p) AS n_values, round(1 - o / e, 6) AS alpha FROM o, e"""


@query(f"SELECT * FROM (WITH r AS ({_RATINGS}), {_ALPHA.format(v='x', d='(a.x - b.x) * (a.x - b.x)', kind='interval')}) UNION ALL SELECT * FROM (WITH r AS ({_RATINGS}), {_ALPHA.format(v='word', d='CASE WHEN a.v <> b.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', kind='nominal')})")
def x03_krippendorff(spark, d):
    """Agreement on each user's events, as numbers of a scale and as words."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", (1 + F.col("event_id") % 5).cast("double").alias("x"))
    both = [statistics.krippendorff(rows, "user_id", c, kind).select(F.lit(kind).alias("kind"), "*") for c, kind in (("x", "interval"), ("event_type", "nominal"))]
    return _rounded(both[0].unionByName(both[1]), "alpha")


_CONTEXTS = {"status": "o_orderstatus", "priority": "o_orderpriority", "month": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE month(o_orderdate) END"}
_ONE = "SELECT '{c}' AS context, '{m}' AS metric, {k} AS g, avg(({v} - lo) / (hi - lo)) AS mean FROM (SELECT *, min({v}) OVER () AS lo, max({v}) OVER () AS hi FROM r) WHERE {k} IS NOT NULL GROUP BY 3"


@query("WITH r AS (SELECT o_totalprice AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) END AS score, " + ", ".join(f"CAST({v} AS VARCHAR) AS {k}" for k, v in _CONTEXTS.items()) + " FROM orders), m AS (" + " UNION ALL ".join(_ONE.format(c=c, m=m, k=c, v=m) for c in _CONTEXTS for m in ("price", "score")) + ") SELECT context, metric, count(*) AS n_groups, round(100 / (1 + stddev_pop(mean) / avg(mean)), 6) AS stability FROM m WHERE mean IS NOT NULL GROUP BY 1, 2")
def x08_stability(spark, d):
    """Two metrics over three contexts, some rows without a group or a metric."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = orders.selectExpr("o_totalprice AS price", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) END AS score", *[f"CAST({v} AS STRING) AS {k}" for k, v in _CONTEXTS.items()])
    return _rounded(statistics.stability(rows, ["price", "score"], list(_CONTEXTS)), "stability")


_GRAMS = " UNION ALL ".join(f"SELECT source, doc_id, {n} AS n, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n}) GROUP BY ALL" for n in range(1, 5))


@query(f"""
WITH t AS (SELECT source, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents), grams AS ({_GRAMS}),
best AS (SELECT source, doc_id, n, gram, c, max(c) OVER (PARTITION BY source, n, gram ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS other FROM grams),
clipped AS (SELECT source, doc_id, n, sum(least(c, coalesce(other, 0))) AS hits FROM best GROUP BY 1, 2, 3),
lens AS (SELECT source, doc_id, len(w) AS len FROM t WHERE len(w) > 0),
near AS (SELECT a.source, a.doc_id, a.len, min_by(b.len, abs(b.len - a.len) * 1000000 + b.len) AS near FROM lens a LEFT JOIN lens b ON a.source = b.source AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
p AS (SELECT source, doc_id, len, near, n, greatest(len - n + 1, 0) AS total, CASE WHEN n = 1 THEN 0 ELSE 1 END AS extra, coalesce(hits, 0) AS hits FROM near CROSS JOIN (SELECT unnest(range(1, 5)) AS n) LEFT JOIN clipped USING (source, doc_id, n)),
s AS (SELECT source, doc_id, len, near, min(hits + extra) AS least, avg(CASE WHEN hits + extra > 0 THEN ln((hits + extra) / CAST(total + extra AS DOUBLE)) END) AS logs FROM p GROUP BY 1, 2, 3, 4)
SELECT source, doc_id, CASE WHEN near IS NOT NULL THEN round(CASE WHEN least = 0 THEN 0.0::DOUBLE ELSE exp(logs + least(0.0::DOUBLE, 1 - near / CAST(len AS DOUBLE))) END, 6) END AS bleu FROM s""")
def x08_self_bleu(spark, d):
    """Each document against all others of its source."""
    return _rounded(text_metrics.self_bleu(spark.read.parquet(f"{d}/documents.parquet"), "source", "doc_id", "text"), "bleu")


@query("""WITH t AS (SELECT lang, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS g FROM t)
SELECT lang, count(DISTINCT g) AS n_distinct, count(*) AS n_grams, round(count(DISTINCT g) / CAST(count(*) AS DOUBLE), 6) AS distinct_n FROM g GROUP BY 1""")
def x08_ngram_variety(spark, d):
    return _rounded(text_metrics.ngram_variety(spark.read.parquet(f"{d}/documents.parquet"), "text", 2, "lang"), "distinct_n")


_CITED = "SELECT lang, CASE doc_id % 4 WHEN 0 THEN text || ' See 410 U.S. 113, and ' || doc_id % 900 || ' F.3d 7; 12 F. Supp. 2d ' || doc_id % 77 || '.' WHEN 1 THEN '5 S. Ct. 1' ELSE text END AS text FROM documents"


@query(f"""WITH t AS ({_CITED}), e AS (SELECT lang, len(regexp_extract_all(text, '\\b\\d{{1,4}} (?:U\\. ?S\\.|S\\. ?Ct\\.|F\\. ?3d|F\\. ?Supp\\. ?2d) \\d{{1,5}}\\b')) AS c, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM t)
SELECT lang, count(*) AS n_texts, CAST(sum(c) AS BIGINT) AS n_citations, CAST(sum(w) AS BIGINT) AS n_words, round(1000.0::DOUBLE * sum(c) / sum(w), 6) AS density FROM e GROUP BY 1""")
def x07_citation_density(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").selectExpr("lang", "CASE doc_id % 4 WHEN 0 THEN text || ' See 410 U.S. 113, and ' || doc_id % 900 || ' F.3d 7; 12 F. Supp. 2d ' || doc_id % 77 || '.' WHEN 1 THEN '5 S. Ct. 1' ELSE text END AS text")
    return _rounded(text_metrics.citation_density(rows, "text", "lang"), "density")


_CLASS = "CASE WHEN vec_id % 7 = 0 THEN NULL WHEN label % 3 = 0 THEN 'Liberal' WHEN label % 3 = 1 THEN 'Moderate' ELSE 'Conservative' END"
_VECTORS = f"SELECT vec_id, 'court ' || label % 4 AS court, {_CLASS} AS class, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_CENTROIDS = "SELECT {by}, list(m ORDER BY k) AS c FROM (SELECT {by}, k, avg(v[k]) AS m FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM e WHERE vec_id % 5 <> 0) GROUP BY {by}, k) GROUP BY {by}"


def _vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "'court ' || label % 4 AS court", f"{_CLASS} AS class", "embedding")
    return rows.where("vec_id % 5 = 0"), rows.where("vec_id % 5 <> 0")


@query(f"WITH e AS ({_VECTORS}), c AS ({_CENTROIDS.format(by='court')}), s AS (SELECT e.vec_id, e.court, c.court AS other, list_cosine_similarity(e.v, c.c) AS s FROM e, c WHERE vec_id % 5 = 0) SELECT vec_id, court, round(max(s) FILTER (WHERE court = other), 6) AS csa, max_by(other, s) AS nearest_court, max_by(other, s) = court AS csa_right FROM s GROUP BY 1, 2")
def x08_style_alignment(spark, d):
    held_out, training = _vectors(spark, d)
    return _rounded(alignment.style_alignment(held_out, training, "court", "embedding").drop("embedding", "class"), "csa")


@query(f"WITH e AS ({_VECTORS}), c AS ({_CENTROIDS.format(by='court, class')}), s AS (SELECT e.vec_id, e.court, e.class, c.class AS other, list_cosine_similarity(e.v, c.c) AS s FROM e JOIN c ON e.court = c.court WHERE vec_id % 5 = 0 AND e.class IS NOT NULL AND c.class IS NOT NULL), n AS (SELECT vec_id, court, class, max_by(other, s) AS nearest_class, max(s) AS s FROM s GROUP BY 1, 2, 3), f AS (SELECT * FROM (VALUES ('Liberal', -1), ('Moderate', 0), ('Conservative', 1)) f(k, x)) SELECT vec_id, court, class, nearest_class, round(s * greatest(0, 1 - abs(a.x - b.x) / 2.0::DOUBLE), 6) + 0 AS ia FROM n JOIN f a ON a.k = class JOIN f b ON b.k = nearest_class")
def x08_ideology_alignment(spark, d):
    held_out, training = _vectors(spark, d)
    return _rounded(alignment.ideology_alignment(held_out, training, "court", "class", "embedding").drop("embedding"), "ia")


_SETS = "WITH e AS (SELECT vec_id // 8 AS s, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.s AS l, b.s AS r, a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON b.s IN (a.s + 1, a.s + 2)), "


def _set_pairs(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 8).alias("s"), "embedding")
    ids = rows.select("s").distinct()
    pairs = ids.select(F.col("s").alias("left"), F.explode(F.array(F.col("s") + 1, F.col("s") + 2)).alias("right"))
    return rows, pairs


@query(_SETS + "f AS (SELECT l, r, avg(d) AS d FROM (SELECT l, r, i, min(d) AS d FROM p GROUP BY ALL) GROUP BY 1, 2), g AS (SELECT l, r, avg(d) AS d FROM (SELECT l, r, j, min(d) AS d FROM p GROUP BY ALL) GROUP BY 1, 2) SELECT f.l AS \"left\", f.r AS \"right\", round(greatest(f.d, g.d), 5) AS lower FROM f JOIN g ON f.l = g.l AND f.r = g.r")
def x08_mover_bounds(spark, d):
    """The relaxed bound of sets of eight vectors and the next two sets."""
    rows, pairs = _set_pairs(spark, d)
    return text_metrics.mover_distances(rows, "s", "embedding", pairs, beyond=-1.0).select("left", "right", F.round("lower", 5).alias("lower"))


@query()
def x08_mover_distance(spark, d):
    """The transport itself, which SQL cannot work out: held against exact transport in a test."""
    rows, pairs = _set_pairs(spark, d)
    return text_metrics.mover_distances(rows, "s", "embedding", pairs)
