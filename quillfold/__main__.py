"""Command line: python -m quillfold <command> [--flags]. Every command reads tables, declares a plan and writes its result."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions import opinions as O
from quillfold.operators import corpus, dedup, enrichment, evaluation, extraction, judges, records, reports
from quillfold.sources import readers
from quillfold.sources.bulk import read_bulk_csv

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}
NEEDED = {"required": True}
WHOLE = lambda n: {"type": int, "default": n}
SWITCH = {"action": "store_true"}


def command(*flags):
    """Register a function under its name; flags are (name, options of add_argument)."""

    def register(f):
        COMMANDS[f.__name__.replace("_", "-")] = (f, list(flags))
        return f

    return register


def _bulk(spark: SparkSession, path: str) -> DataFrame:
    return read_bulk_csv(spark, path, backslash=True, order="_ord")


def _cases(spark: SparkSession, a) -> DataFrame:
    return readers.read_csv(spark, a.input, order="_ord")


def _write(df: DataFrame, path: str, report: str | None = None, sections: dict[str, DataFrame] | None = None) -> None:
    readers.write_csv(df, path, [c for c in df.columns if not c.startswith("_")])
    if report:
        text = "\n".join(reports.render(title, s) for title, s in (sections or {}).items())
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(report)


@command(("dockets", NEEDED), ("clusters", NEEDED), ("opinions", NEEDED), ("courts", {"default": "scotus,ca5,ca9"}), ("after", {"default": "2013-01-01"}), ("before", {"default": "2024-12-31"}), ("max-per-court", WHOLE(6000)), ("min-words", WHOLE(500)), ("published-only", {"action": "store_true", "default": True}), ("out", NEEDED))
def bulk_filter(spark, a):
    out = corpus.bulk_filter(_bulk(spark, a.dockets), _bulk(spark, a.clusters), _bulk(spark, a.opinions), "_ord", a.courts.split(","), a.after, a.before, a.max_per_court, a.min_words)
    _write(out, a.out)


@command(("input", NEEDED), ("output", NEEDED))
def dedupe_case_names(spark, a):
    _write(corpus.drop_repeated_names(_cases(spark, a), "_ord"), a.output)


@command(("input", NEEDED), ("output", NEEDED), ("opinions", {}), ("from-dump", {}), ("dump", {}), ("report", {}), ("majority-fallback", SWITCH), ("concur-in-part", {"choices": ["concurrence", "dissent", "ignore"], "default": "ignore"}), ("text-split", SWITCH))
def split_opinions(spark, a):
    if bool(a.opinions) == bool(a.from_dump):
        raise SystemExit("one of --opinions and --from-dump is needed")
    rows = _cases(spark, a)
    dump = corpus.read_dump(spark, a.from_dump, rows) if a.from_dump else corpus.opinions_by_case(_bulk(spark, a.opinions), rows)
    if a.dump and a.opinions:
        corpus.write_dump(dump, a.dump)
        dump = corpus.read_dump(spark, a.dump, rows)
    out = corpus.split_by_type(rows, dump, a.majority_fallback, a.concur_in_part, a.text_split)
    _write(out, a.output, a.report, {"Methods": out.groupBy("jurisdiction").pivot("split_method", ["cl_separate", "heading", "none"]).count().fillna(0)})


@command(("input", NEEDED), ("output", NEEDED), ("report", {}))
def clean_headers(spark, a):
    rows = _cases(spark, a)
    texts = [c for c in ("opinion_text", "dissent_text", "concurrence_text") if c in rows.columns]
    stripped = rows.withColumn("_h", F.array(*[O.strip_page_headers(F.col(c)) for c in texts]))
    only = F.transform("_h", lambda h: h["text"])
    stripped = stripped.withColumn("_c", F.when(F.col("jurisdiction") == "CA9", O.strip_captions(only)))
    new = {c: F.coalesce(F.col("_c.texts")[i], F.col("_h")[i]["text"]) for i, c in enumerate(texts)}
    out = stripped.withColumn("_n", F.aggregate("_h", F.lit(0), lambda s, h: s + h["n"])).withColumns(new)
    _write(out, a.output, a.report, {"Headers": out.groupBy("jurisdiction").agg(F.sum("_n").alias("headers"), F.sum("_c.n_captions").alias("captions"))})


@command(("input", NEEDED), ("output", NEEDED), ("overrides", {}))
def enrich_authors(spark, a):
    fixes = readers.read_optional(spark, a.overrides, ["cluster_id", "author_str", "author_initials", "note"], order="_ord") if a.overrides else None
    _write(enrichment.with_authors(_cases(spark, a), fixes, [F.col("_ord")]), a.output)


@command(("input", NEEDED), ("output", NEEDED), ("report", {}))
def opinion_kind(spark, a):
    out = _cases(spark, a).withColumn("opinion_kind", O.kind(F.col("jurisdiction"), F.col("opinion_text"), F.col("author_source")))
    _write(out, a.output, a.report, {"Kinds": out.groupBy("opinion_kind").pivot("jurisdiction", reports.COURTS).count().fillna(0)})


@command(("clusters", NEEDED), ("dockets", NEEDED), ("citations", {}), ("database", NEEDED), ("scores", NEEDED), ("input", NEEDED), ("output", NEEDED), ("report", {}))
def enrich_scdb(spark, a):
    rows = _cases(spark, a)
    supreme = rows.where("jurisdiction = 'SCOTUS'")
    numbers = enrichment.docket_numbers(supreme, _bulk(spark, a.clusters), _bulk(spark, a.dockets))
    cites = enrichment.first_citations(supreme, _bulk(spark, a.citations), "_ord") if a.citations else spark.createDataFrame([], "cluster_id string, cite string")
    database = readers.read_csv(spark, a.database, encoding="ISO-8859-1", order="_ord")
    matched = enrichment.match_database(supreme, numbers, cites, database, "_ord")
    out = enrichment.enrich_supreme(rows, matched, readers.read_csv(spark, a.scores))
    _write(out, a.output, a.report, {"Methods": matched.groupBy("method").count(), "Agreement": matched.groupBy("agrees").count(), "Coverage": reports.filled_before_and_after(rows, out, enrichment.DATABASE_FIELDS)})


@command(("input", NEEDED), ("roster", NEEDED), ("biographies", NEEDED), ("output", NEEDED))
def enrich_ideology(spark, a):
    rows = _cases(spark, a)
    period = rows.where(F.col("jurisdiction").isin(*enrichment.CIRCUITS)).agg(F.min(F.to_date("date_filed")).alias("lo"), F.max(F.to_date("date_filed")).alias("hi")).head()
    people = enrichment.circuit_appointments(readers.read_any_encoding(spark, a.biographies), F.lit(period["lo"]), F.lit(period["hi"]))
    _write(enrichment.enrich_circuits(rows, readers.read_csv(spark, a.roster, encoding="ISO-8859-1"), people), a.output)


@command(("input", NEEDED), ("biographies", NEEDED), ("appeals-scores", NEEDED), ("output", NEEDED), ("report", {}))
def ideology_fallback(spark, a):
    out = judges.with_fallback(_cases(spark, a), enrichment.appointments(readers.read_any_encoding(spark, a.biographies)), enrichment.appeals_scores(readers.read_any_encoding(spark, a.appeals_scores)))
    _write(out, a.output, a.report, {"Sources": out.groupBy("jurisdiction", "ideology_fallback_source").count()})


@command(("input", NEEDED), ("output", NEEDED), ("limit", WHOLE(0)), ("cache", {}))
def enrich_case_fields(spark, a):
    cache = readers.read_cache(spark, a.cache, "cluster_id string, answer string") if a.cache else None
    out, asked = extraction.enrich_fields(_cases(spark, a), cache=cache, limit=a.limit)
    if a.cache:
        readers.append_cache(asked, a.cache)
    _write(out, a.output)


@command(("input", NEEDED), ("output", NEEDED), ("list", NEEDED), ("dropped", NEEDED))
def drop_wrong_court(spark, a):
    kept, log = corpus.drop_wrong_court(_cases(spark, a), readers.read_csv(spark, a.list))
    _write(kept, a.output)
    _write(log, a.dropped)


@command(("input", NEEDED), ("output", NEEDED), ("dropped", NEEDED), ("excluded", {}))
def dedupe(spark, a):
    excluded = readers.read_csv(spark, a.excluded).select(F.col("cluster_id").cast("long").alias("cluster_id")) if a.excluded else None
    kept, log = dedup.dedupe(_cases(spark, a), excluded)
    _write(dedup.in_order(kept), a.output)
    _write(log, a.dropped)


@command(("input", NEEDED), ("outdir", NEEDED), ("test", {"type": float, "default": 0.1}), ("val", {"type": float, "default": 0.1}), ("seed", WHOLE(42)), ("max-target-chars", WHOLE(0)))
def make_splits(spark, a):
    rows = records.shuffled(records.assign_splits(_cases(spark, a), a.test, a.val, a.seed), "cluster_id", a.seed)
    records.write_records(records.split_records(rows, a.max_target_chars), a.outdir)


@command(("splits", NEEDED), ("outdir", NEEDED), ("task", {"choices": ["generation", "predict", "both"], "default": "both"}), ("max-target-chars", WHOLE(0)), ("include-ideology", SWITCH), ("strip-header", SWITCH))
def build_finetune(spark, a):
    rows = spark.read.json(a.splits)
    if "opinion_text_capped" not in rows.select("targets.*").columns:
        rows = rows.withColumn("targets", F.col("targets").withField("opinion_text_capped", F.lit(None).cast("string")))
    for task in ("generation", "predict") if a.task == "both" else (a.task,):
        records.write_records(records.chat_records(rows, task, a.max_target_chars, a.include_ideology, a.strip_header), f"{a.outdir.rstrip('/')}/{task}")


@command(("preds", NEEDED), ("task", {"choices": ["generation", "predict"], **NEEDED}), ("splits", {}), ("out", NEEDED))
def evaluate(spark, a):
    preds = spark.read.json(a.preds)
    evaluation.outcome_metrics(preds).write.mode("overwrite").json(f"{a.out}/outcome")
    if a.task == "generation" and a.splits:
        evaluation.discourse(preds, spark.read.json(a.splits)).write.mode("overwrite").json(f"{a.out}/discourse")


@command(("scores", NEEDED), ("out", NEEDED))
def eval_judge(spark, a):
    evaluation.judge_summary(spark.read.json(a.scores)).write.mode("overwrite").json(a.out)


@command(("answers", NEEDED), ("out", NEEDED))
def eval_ideology(spark, a):
    evaluation.ideology_scores(spark.read.json(a.answers)).write.mode("overwrite").json(a.out)


@command(("dir", {"default": "results"}), ("out", {"default": "results/summary"}))
def compare_results(spark, a):
    _write(evaluation.flatten_results(readers.read_results(spark, a.dir, evaluation.RESULT_SCHEMA)), a.out)


@command(("input", NEEDED), ("md", {}))
def completeness_report(spark, a):
    _print(spark, a, reports.completeness(_cases(spark, a)))


@command(("input", NEEDED), ("md", {}))
def dataset_stats(spark, a):
    _print(spark, a, reports.statistics(_cases(spark, a)))


@command(("input", NEEDED), ("labels", NEEDED), ("output-csv", NEEDED))
def lawma_label(spark, a):
    labels = readers.read_csv(spark, a.labels).select("cluster_id", "pred_issue", F.col("confidence").try_cast("double").alias("confidence"))
    _write(evaluation.attach_topics(_cases(spark, a), labels), a.output_csv)


@command(("results", NEEDED), ("md", {}))
def validate_classifier(spark, a):
    rows = readers.read_csv(spark, a.results).select(*[F.col(c).try_cast("int").alias(c) for c in ("true_issue", "pred_issue")], F.col("confidence").try_cast("double").alias("confidence"))
    wrong = rows.where("pred_issue IS NOT NULL AND true_issue <> pred_issue").groupBy("true_issue", "pred_issue").count()
    _print(spark, a, {"Gate": evaluation.gate(rows), "Classes": evaluation.topic_report(rows), "Confusion": wrong.orderBy(F.desc("count"), "true_issue", "pred_issue").limit(10)})


def _print(spark: SparkSession, a, sections: dict[str, DataFrame]) -> None:
    text = "\n".join(reports.render(title, s) for title, s in sections.items())
    print(text)
    if a.md:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.md)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillfold")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, flags) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, options in flags:
            sub.add_argument(f"--{flag}", **options)
    a = parser.parse_args(arguments)
    session = spark or SparkSession.builder.appName("quillfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[a.command][0](session, a)


if __name__ == "__main__":
    main()
