"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the corpus over its present share. Each document's
number of copies inverts a Poisson distribution with that mean at a uniform number hashed from the
seed and the id, so any engine and any retry draws the same copies. Rates over MAX_RATE are drawn as a
sum of independent Poisson numbers, since exp(-rate) would underflow.

The only wide data movement is the global shuffle of the copies by a hash of the shuffle key and of the row's number in the scan, so that
not even many identical rows meet in one task. The per-source table is broadcast only if it has at most BROADCAST_SOURCES rows;
beyond that, it joins salted, so that a source with a third of all rows is dealt over SALTS tasks.

Defined results: a null source is a source of its own; a null or empty text counts as one character;
a source that the weights leave out gets rate 0; a row with a null id draws by a digest of its text; repeated rows are
repeated alike; an empty table gives an empty result; further columns of the input are kept as they are, whatever
their names, but for columns named copy_no or shuffle_key, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
MAX_RATE = 500.0
BROADCAST_SOURCES = 100_000
SALTS = 32


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... until the rest is below the resolution of `uniform`."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    step = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"),
            (a["c"] + a["p"] * rate / k).alias("c"),
            F.array_append(a["cdf"], a["c"] + a["p"] * rate / k).alias("cdf"),
        ),
    )
    return step["cdf"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """source, rate, parts and cdf: one row for each source.

    weights: the target share of each source, by default equal shares; budget: size of the result as
    a multiple of the corpus, both measured in characters.
    """
    size = F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(1)), F.lit(1))).cast("double")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(size.alias("size"))
    whole = sizes.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).head()  # two numbers
    if weights is None:
        share = F.lit(1.0 / max(1, whole["n"]))
    else:
        scale = float(sum(weights.values())) or 1.0
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source") == F.lit(name), F.lit(weight / scale)).otherwise(share)
    return (
        sizes.withColumn("rate", share * F.lit(float(budget)) * F.lit(float(whole["total"] or 0.0)) / F.col("size"))
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
        .select("source", "rate", "parts", "cdf")
    )


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The columns of docs, and copy_no (from 1) and shuffle_key, in a globally random order.

    Partitions are dealt by shuffle_key and the row's number, and sorted by shuffle_key.
    """
    own = [c for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    plain = F.struct(*[F.col(f"`{c}`") for c in own])
    rows = docs.select(plain.alias("d"), F.col("source").cast("string").alias("s"), _draws_by().alias("id"), F.monotonically_increasing_id().alias("row"))
    rates = source_rates(docs, weights, budget).selectExpr("source AS of_source", "parts", "cdf").persist()
    match = F.col("s").eqNullSafe(F.col("of_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), match)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, match & (F.col("deal") == F.col("salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda m: uniform(seed, F.col("id"), m.cast("string")))
    counts = F.transform(draws, lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    copies = joined.select("d", "id", "row", F.aggregate(counts, F.lit(0), lambda a, n: a + n).alias("n")).where("n > 0")
    copies = copies.select("d", "id", "row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "id", F.col("copy_no").cast("string")).cast("binary"))
    dealt = copies.select("d", "row", "copy_no", key.alias("shuffle_key")).repartition("shuffle_key", "row").sortWithinPartitions("shuffle_key", "row")
    return dealt.select("d.*", "copy_no", "shuffle_key")


def _draws_by() -> Column:
    """The id as text; a row without one goes by its text."""
    text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return F.coalesce(F.col("doc_id").cast("string"), text)


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(greatest(coalesce(length(text), 1), 1)) AS DOUBLE) AS size FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS total, CAST(count(*) AS DOUBLE) AS n FROM sizes
), rates AS (
  SELECT source, (1.0::DOUBLE / n) * 1.0::DOUBLE * total / size AS rate,
         CAST(greatest(ceil((1.0::DOUBLE / n) * 1.0::DOUBLE * total / size / {MAX_RATE}::DOUBLE), 1) AS INTEGER) AS parts
  FROM sizes, totals
), steps AS (
  SELECT source, parts, rate / parts AS lam, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM rates
  UNION ALL
  SELECT source, parts, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM steps
  WHERE k < ceil(lam + 12 * sqrt(lam) + 20)
), cdfs AS (
  SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM steps GROUP BY source
), counts AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda m: len(list_filter(cdf, lambda c: c <=
    CAST(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR), CAST(m AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)))) AS n_copies
  FROM documents d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source
), copies AS (
  SELECT *, CAST(unnest(range(1, CAST(n_copies AS BIGINT) + 1)) AS INTEGER) AS copy_no FROM counts
)
SELECT doc_id, text, lang, source, n_chars, copy_no,
       md5(concat_ws(':', '{SEED}s', CAST(doc_id AS VARCHAR), CAST(copy_no AS VARCHAR))) AS shuffle_key
FROM copies
"""
