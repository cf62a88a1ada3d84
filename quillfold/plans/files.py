"""Sources, sinks and streams: what is written in each dialect and read again must be the table it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.columns import numeric_id
from quillfold.operators import corpus, evaluation, extraction
from quillfold.operators.records import write_records
from quillfold.operators.relational import shared_folder
from quillfold.sources import readers
from quillfold.sources.bulk import read_bulk_csv
from quillfold.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that goes when the session ends."""
    path = f"{shared_folder(spark)}/quillfold-files/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _text_of(spark, d) -> DataFrame:
    """Documents with every character that a dialect could trip over."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    awkward = F.concat(F.col("text"), F.lit(' "quoted", \n and a \\ back-slash; é'))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(awkward).alias("text"), "lang")


_AWKWARD = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text || ' \"quoted\", ' || chr(10) || ' and a \\ back-slash; é' END AS text, lang FROM documents"


@query(_AWKWARD)
def s01_s03_s04_k01_compressed_csv(spark, d):
    """Doubled quotes, compressed, with line breaks inside fields."""
    path = scratch(spark)
    _text_of(spark, d).select("doc_id", "text", "lang").write.option("header", True).option("escape", '"').option("compression", "bzip2").csv(path)
    return readers.read_csv(spark, path, ["doc_id", "text", "lang"])


@query(_AWKWARD)
def k01_s12_csv_sink(spark, d):
    """Only the named columns in their order; a missing source is an empty table."""
    path = scratch(spark)
    readers.write_csv(_text_of(spark, d), path, ["lang", "text", "doc_id"])
    none = readers.read_optional(spark, f"{path}/missing", ["doc_id", "text", "lang"])
    return readers.read_optional(spark, path, ["lang", "text", "doc_id"]).select("doc_id", "text", "lang").unionByName(none)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text || ' \"quoted\", ' || chr(10) || ' and more' END AS text FROM documents")
def s02_backslash_csv(spark, d):
    """The bulk dialect: quotes inside a field are escaped by a backslash."""
    path = scratch(spark)
    plain = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat("text", F.lit(' "quoted", \n and more'))).alias("text"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat_ws(",", quoted("doc_id"), quoted("text")).alias("value")
    plain.select(line).write.option("compression", "gzip").text(path)
    return readers.read_csv(spark, path, ["doc_id", "text"], backslash=True, header=False)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'José ' || c_name AS name, 'ISO-8859-1' AS encoding FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'José ' || c_name, 'UTF-8' FROM customer")
def s06_s07_encodings(spark, d):
    """The same rows in Latin-1 and in UTF-8, and read together: executors tell the encoding of each file."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("José "), "c_name").alias("name"), "c_custkey").orderBy(F.desc("c_custkey")).drop("c_custkey").coalesce(1)
    path = scratch(spark)
    for encoding in ("ISO-8859-1", "UTF-8"):
        rows.withColumn("encoding", F.lit(encoding)).write.option("header", True).option("encoding", encoding).csv(f"{path}/{encoding}")
    return readers.read_any_encoding(spark, [f"{path}/ISO-8859-1", f"{path}/UTF-8"])


def _fine_splits(spark: SparkSession) -> SparkSession:
    """A session whose scans take 64 KB at a time, so that records of small tables cross splits as those of large ones do."""
    fine = spark.newSession()
    fine.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    return fine


@query(_AWKWARD)
def s01_s03_s04_split_scan(spark, d):
    """One file of doubled quotes in bzip2, with line breaks inside fields, read by a task for each compressed block."""
    path = scratch(spark)
    _text_of(spark, d).select("doc_id", "text", "lang").coalesce(1).write.option("header", True).option("escape", '"').option("compression", "bzip2").csv(path)
    return read_bulk_csv(_fine_splits(spark), path)


@query(_AWKWARD)
def s02_s05_split_backslash_scan(spark, d):
    """One file of the bulk dialect, every quote and backslash escaped, read by a task for each 64 KB."""
    path = scratch(spark)
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    rows = _text_of(spark, d).select(F.concat_ws(",", quoted("doc_id"), "lang", quoted("text")).alias("value"))
    rows.coalesce(1).write.text(path)
    return read_bulk_csv(_fine_splits(spark), path, ["doc_id", "lang", "text"], backslash=True, header=False).select("doc_id", "text", "lang")


@query("SELECT c_mktsegment AS k, CAST(min(c_custkey) AS VARCHAR) AS first_id, CAST(max(c_custkey) AS VARCHAR) AS last_id FROM customer GROUP BY 1")
def j07_j08_first_and_last_of_files(spark, d):
    """Three files of different sizes, ascending by name: the first and the last row of each key are those of the files' order."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("k"))
    edges = rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).head()
    cuts = [edges["lo"], edges["lo"] + (edges["hi"] - edges["lo"]) // 20, edges["lo"] + (edges["hi"] - edges["lo"]) // 3, edges["hi"] + 1]
    for k in range(3):
        readers.write_csv(rows.where(F.col("n").between(cuts[k], cuts[k + 1] - 1)).orderBy("n").coalesce(1), f"{path}/{k}", ["id", "k"])
    back = readers.read_csv(spark, [f"{path}/{k}" for k in range(3)], order="_ord")
    return back.groupBy("k").agg(F.min_by("id", "_ord").alias("first_id"), F.max_by("id", "_ord").alias("last_id"))


@query("SELECT CAST(conv_id AS VARCHAR) AS cluster_id, CAST(turn AS VARCHAR) AS id, role AS type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE conv_id % 3 = 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def s09_k04_a19_j03_nested_dump(spark, d):
    """Opinions by case as compressed JSON lines, and of the dump only the cases asked for, taken apart again."""
    path = scratch(spark)
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    opinions = turns.select(F.col("conv_id").cast("string").alias("cluster_id"), F.col("turn").cast("string").alias("id"), F.col("role").alias("type"), F.lit("").alias("author_str"), F.col("text").alias("plain_text"))
    corpus.write_dump(corpus.opinions_by_case(opinions, opinions), path)
    wanted = turns.where("conv_id % 3 = 0").select(F.col("conv_id").alias("cluster_id"))
    return corpus.read_dump(spark, path, wanted).select("cluster_id", F.explode("opinions").alias("o")).select("cluster_id", "o.id", "o.type", "o.text")


@query("SELECT lang AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def s08_k03_json_lines(spark, d):
    """JSON lines in a folder for each split; characters beyond ASCII stay."""
    path = scratch(spark)
    write_records(spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("split"), "doc_id", "text"), path)
    back = readers.read_jsonl(spark, path, "doc_id long, text string, split string")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH r AS (SELECT o_custkey % 40 AS k, count(*) AS n, round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 3) AS a, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS w FROM orders GROUP BY 1)
SELECT 'model' || k AS name, CASE WHEN k % 2 = 0 THEN 'predict' ELSE 'generation' END AS task, CAST(n AS VARCHAR) AS n, CAST(a AS VARCHAR) AS accuracy, CASE WHEN k % 2 = 0 THEN CAST(a AS VARCHAR) ELSE '' END AS macro_f1, '' AS bertscore_f1, CASE WHEN k % 2 = 1 THEN CAST(w AS VARCHAR) ELSE '' END AS gen_words, CASE WHEN k % 2 = 1 THEN CAST(w + 0.5 AS VARCHAR) ELSE '' END AS auth_words, '' AS gen_fk, '' AS auth_fk, '' AS gen_ttr, '' AS auth_ttr, CASE WHEN k % 2 = 1 THEN '0.125' ELSE '' END AS halluc_rate FROM r WHERE k % 10 <> 9""")
def s10_f55_c15_result_folder(spark, d):
    """A folder of results of models that stand in for groups of customers, a file for each, every tenth unreadable, as one flat table."""
    path = scratch(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    sums = orders.groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(1.0)), 3).alias("a"), F.count_distinct("o_orderstatus").cast("double").alias("w"))
    even = F.col("k") % 2 == 0
    outcome = F.struct(F.col("a").alias("accuracy"), F.when(even, F.col("a")).alias("macro_f1"))
    discourse = F.when(~even, F.struct(F.struct(F.col("w").alias("words")).alias("generated"), F.struct((F.col("w") + 0.5).alias("words")).alias("authentic")))
    text = F.to_json(F.struct(F.when(even, "predict").otherwise("generation").alias("task"), "n", outcome.alias("outcome"), discourse.alias("discourse"), F.when(~even, F.struct(F.lit(0.125).alias("hallucination_rate"))).alias("citation_hallucination")))
    broken = F.when(F.col("k") % 10 == 9, "{ no json").otherwise(text)
    jvm = spark.sparkContext._jvm
    for row in sums.select(F.concat(F.lit("model"), "k").alias("name"), broken.alias("content")).collect():  # forty at most
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{row['name']}.json")
        stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        stream.write(bytearray(row["content"].encode()))
        stream.close()
    return evaluation.flatten_results(readers.read_results(spark, path, evaluation.RESULT_SCHEMA))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'first' END AS answer FROM events")
def k05_t03_append_only_cache(spark, d):
    """A cache that only grows; of an id's answers the last one counts."""
    path = scratch(spark)
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("id"))
    empty = readers.read_cache(spark, path, "id string, answer string, at int")
    readers.append_cache(ids.withColumn("answer", F.lit("first")).withColumn("at", F.lit(1)), path)
    readers.append_cache(ids.where("id % 3 = 0").withColumn("answer", F.lit("second")).withColumn("at", F.lit(2)), path)
    cache = readers.read_cache(spark, path, "id string, answer string, at int").unionByName(empty)
    return extraction.latest_answers(cache, "at").select("id", "answer")


@query("SELECT o_orderkey AS k, o_orderstatus || '2' AS v FROM orders")
def k02_k07_stages(spark, d):
    """A stage reads its predecessor's folder and a rerun replaces its own; no path is read and written at once."""
    path = scratch(spark)
    first = readers.write_stage(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), path, "1")
    for _ in range(2):
        second = readers.write_stage(first.withColumn("v", F.concat("v", F.lit("2"))), path, "2")
    return second


@query("SELECT c_custkey AS id, k AS slot, CASE k WHEN 1 THEN c_mktsegment ELSE c_name END AS court FROM customer, (VALUES (1), (2)) s(k) WHERE NOT (k = 1 AND c_custkey % 3 = 0)")
def s13_unpivot(spark, d):
    wide = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("Court (1)"), F.col("c_name").alias("Court (2)"))
    return readers.unpivot_slots(wide, ["id"], [1, 2], ["Court"]).withColumnRenamed("Court", "court")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t01_windowed_stream(spark, d):
    """Our extension: the events as a stream of files with a watermark, windows taken when all files are read."""
    path = scratch(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    events.repartition(3).write.parquet(f"{path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    counts = ingest.windowed_counts(source, late="40 days")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", F.col("w.start").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def t01_t02_ingest_and_resume(spark, d):
    """Half of the files, then all of them with repeats: each row arrives once."""
    path = scratch(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    events.where("event_id % 2 = 0").write.parquet(f"{path}/in")
    ingest.ingest_once(spark, f"{path}/in", f"{path}/out", f"{path}/state", "event_id")
    events.write.mode("append").parquet(f"{path}/in")
    ingest.ingest_once(spark, f"{path}/in", f"{path}/out", f"{path}/state", "event_id")
    ingest.ingest_once(spark, f"{path}/in", f"{path}/out", f"{path}/state", "event_id")
    return spark.read.parquet(f"{path}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS cluster_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS note FROM supplier")
def t04_accumulated_log(spark, d):
    """A log of drops that later runs renew and never shorten."""
    path = scratch(spark)
    ids = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("cluster_id"))
    for note, rows in (("old", ids), ("new", ids.where(numeric_id(F.col("cluster_id")) % 2 == 0))):
        rows.withColumn("note", F.lit(note)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        ingest.accumulate_log(spark, f"{path}/in", f"{path}/log", f"{path}/state", "cluster_id")
    return ingest.read_log(spark, f"{path}/log", "cluster_id")
