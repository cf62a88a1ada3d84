"""The split CSV scan against the one-task reader and Python's own, with records that cross any number of splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quillfold.sources import bulk, readers


@pytest.fixture
def fine(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "700")
    return session


def table(seed=4, n=300):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "é", ",", "\n", '"', " ", '",', '\n"', "word ", "\\"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))
    rows = [[str(i), cell(), rng.choice(["", "x", "1.5"]), cell()] for i in range(n)]
    rows[50][1] = "long \n" * 2000  # over many splits
    rows[120][3] = '"\n' * 3000
    return rows


def written(rows, backslash):
    if not backslash:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if len(rows) % 2 else csv.QUOTE_MINIMAL).writerows([["id", "a", "b", "c"], *rows])
        return out.getvalue()
    quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["id,a,b,c", *[",".join([r[0], quoted(r[1]), r[2], quoted(r[3])]) for r in rows]]) + "\n"


@pytest.mark.parametrize("backslash", [False, True])
@pytest.mark.parametrize("piece", [bulk.PIECE_CHARS, 200])
def test_equal_to_what_was_written(fine, tmp_path, monkeypatch, backslash, piece):
    monkeypatch.setattr(bulk, "PIECE_CHARS", piece)
    rows = table(n=300 + backslash)
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text(written(rows, backslash))
    got = bulk.read_bulk_csv(fine, path, backslash=backslash, order="_ord")
    assert bulk._lines(fine, path).rdd.getNumPartitions() > 20
    assert [[r["id"], r["a"], r["b"], r["c"]] for r in sorted(got.collect(), key=lambda r: r["_ord"])] == rows
    one = readers.read_csv(fine, path, ["id", "a", "b", "c"], backslash=backslash)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rows))


def test_files_without_quotes_headers_or_rows(fine, tmp_path):
    plain = [[str(i), f"v{i}"] for i in range(400)]
    (tmp_path / "plain.csv").write_text("\r\n".join(",".join(r) for r in plain))
    got = bulk.read_bulk_csv(fine, str(tmp_path / "plain.csv"), ["id", "v"], header=False, order="_ord")
    assert [[r["id"], r["v"]] for r in sorted(got.collect(), key=lambda r: r["_ord"])] == plain
    (tmp_path / "empty.csv").write_text("id,v\n")
    assert bulk.read_bulk_csv(fine, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "blank.csv").write_text('﻿id,v\n\n1,"a ""b"""\n\n2\n3,5" pipe\n"4","open\n\n')
    rows = sorted(map(tuple, bulk.read_bulk_csv(fine, str(tmp_path / "blank.csv")).collect()))
    assert rows[:3] == [("1", 'a "b"'), ("2", ""), ("3", '5" pipe')] and rows[3][0] == "4" and rows[3][1].startswith("open")


def test_a_line_from_either_state():
    for line, out, into in [("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, False), ('x""y', False, True), ('a"b', False, False), ('",', True, False), ('","', False, True), ("", False, True)]:
        assert (bulk.after_line(line, False, False), bulk.after_line(line, True, False)) == (out, into), line
    assert bulk.after_line('"a\\"b', False, True) and not bulk.after_line('"a\\\\"', False, True) and bulk.after_line("end\\", True, True)


def test_broken_bytes_are_replaced(fine, tmp_path):
    (tmp_path / "t.csv").write_bytes("id,v\n1,é\n".encode() + b'2,"caf\xe9\nx"\n')
    got = sorted(map(tuple, bulk.read_bulk_csv(fine, str(tmp_path / "t.csv")).collect()))
    assert got == [("1", "é"), ("2", "caf�\nx")]


def test_encodings_of_whole_files(spark, tmp_path):
    """A Latin-1 byte after two megabytes is seen; files are read together, each in its encoding."""
    (tmp_path / "late.csv").write_bytes(b"id,v\n" + b"1,a\n" * 500_000 + b"2,caf\xe9\n")
    (tmp_path / "utf.csv").write_text("id,v\n3,café\n")
    got = readers.read_any_encoding(spark, [str(tmp_path / "late.csv"), str(tmp_path / "utf.csv")])
    assert sorted(map(tuple, got.where("id <> '1'").collect())) == [("2", "café"), ("3", "café")] and got.count() == 500_002


def test_first_row_of_several_files(spark, tmp_path):
    """Spark deals the largest file first; the order of the rows is that of the names all the same."""
    for name, n in (("a", 2), ("b", 20_000), ("c", 50)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{i % 2},{name}{i}\n" for i in range(n)))
    rows = readers.read_csv(spark, str(tmp_path), order="_ord")
    assert sorted(map(tuple, rows.groupBy("k").agg(F.min_by("v", "_ord"), F.max_by("v", "_ord")).collect())) == [("0", "a0", "c48"), ("1", "a1", "c49")]
