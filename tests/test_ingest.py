"""Streams that run again and again: what a small batch reads and writes does not grow with what is there."""

import os

from pyspark.sql import functions as F

from quillfold.streaming import ingest


def files_of(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_log_of_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FAN", 3)
    path = {n: str(tmp_path / n) for n in ("in", "log", "state")}
    want, written = {}, []
    for n in range(11):
        rows = [(str(k), f"v{n}-{k}") for k in (range(5000) if n == 0 else range(n * 7 % 50, n * 7 % 50 + 10))] + [(None, "no key")]
        spark.createDataFrame(rows, "k string, v string").coalesce(1).write.mode("append").parquet(path["in"])
        before = files_of(path["log"])
        ingest.accumulate_log(spark, path["in"], path["log"], path["state"], "k")
        written.append(sum(size for f, size in files_of(path["log"]).items() if f not in before))
        want |= dict(r for r in rows if r[0] is not None)
    assert dict(map(tuple, ingest.read_log(spark, path["log"], "k").collect())) == want
    parts = ingest._parts(spark, path["log"])
    assert all(len(p) < 3 for p in parts.values()) and max(parts) == 2  # merged parts are gone
    assert max(written[n] for n in (1, 3, 4, 6, 7, 9, 10)) < written[0] / 5  # nothing of the large first batch is written again but by merges
    assert ingest.read_log(spark, str(tmp_path / "none"), "k") is None


def test_log_reads_the_same_when_stopped_between(spark, tmp_path, monkeypatch):
    """A merge that has written its part but not removed the old ones."""
    monkeypatch.setattr(ingest, "FAN", 2)
    out = str(tmp_path / "log")
    for n in range(3):
        spark.createDataFrame([("a", n), ("b", -n)], "k string, v int").withColumn(ingest.BATCH, F.lit(n).cast("long")).write.parquet(f"{out}/level=0/{n:012d}")
    ingest._latest(spark.read.parquet(f"{out}/level=0/{0:012d}", f"{out}/level=0/{1:012d}"), "k").write.parquet(f"{out}/level=1/{1:012d}")
    assert dict(map(tuple, ingest.read_log(spark, out, "k").collect())) == {"a": 2, "b": -2}
    ingest.compact(spark, out, "k")
    assert dict(map(tuple, ingest.read_log(spark, out, "k").collect())) == {"a": 2, "b": -2} and list(ingest._parts(spark, out)[0]) == []


def test_ingest_reads_no_output(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for n in range(3):
        spark.range(n * 500, n * 500 + 1000).select(F.col("id").alias("k"), F.lit(n).alias("n")).unionByName(spark.createDataFrame([(None, 9)], "k long, n int")).write.mode("append").parquet(path["in"])
        for _ in range(2):
            ingest.ingest_once(spark, path["in"], path["out"], path["state"], "k")
    rows = spark.read.parquet(path["out"]).collect()
    assert sorted(r["k"] for r in rows) == list(range(2000)) and {r["n"] for r in rows if r["k"] < 1000} == {0}


def test_questions_are_asked_once_and_at_the_same_time(spark, tmp_path):
    """A slow service: questions of a task wait side by side, a failing one tries again, and both results read the same answers."""
    import time

    from quillfold.operators import extraction

    log = tmp_path / "asked"
    log.mkdir()

    def slow(text):
        name = text.split()[-1]
        began = time.time()
        time.sleep(0.2)
        (log / f"{name}-{time.time_ns()}").write_text(f"{began} {time.time()}")
        if int(name) % 10 == 0 and len(list(log.glob(f"{name}-*"))) == 1:
            raise OSError("busy")
        return extraction.stub(text)

    rows = spark.createDataFrame([(i, f"some words of case {i}", "", "") for i in range(1, 33)], "cluster_id long, opinion_text string, facts string, issue_text string").coalesce(1)
    done, asked = extraction.enrich_fields(rows, slow)
    assert done.where("issue_text <> ''").count() == 32 and asked.where("answer IS NOT NULL").count() == 32
    spans = [tuple(map(float, f.read_text().split())) for f in log.iterdir()]
    assert len(spans) == 32 + 3 and max(sum(a <= start < b for a, b in spans) for start, _ in spans) >= 4
