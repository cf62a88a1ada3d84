"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillfold.plans import enrich, literals

LLM = tuple(f"op{n}_" for n in range(1, 14))
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(LLM) and n != "pipeline")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(round(v, 5)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(literals.LITERALS | enrich.LITERALS))
def test_literal_rows_match_sql(spark, duck, name):
    """Rows that hold every branch; the same functions run over the tables above."""
    run, sql = (literals.LITERALS | enrich.LITERALS)[name]
    got, want = run(spark), duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_reasons_all_occur(spark):
    """The stand-in for deduplication holds every reason to drop a row."""
    found = entry.queries()["c08_j18_j19_j20_p11_w04_w09_dedup"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()
    assert {r["reason"] for r in found} == {"compare_page_copy", "junk", "wrong_court", "separate_writing", "embedded_separate_writing", "exact_duplicate", "amended_earlier_version", "revised_marker", "near_duplicate"}


def test_split_without_sql(spark, sf_dir):
    got = entry.queries()["c09_a20_group_split"](spark, sf_dir).collect()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().count()
    assert len(got) == orders and {r["split"] for r in got} == {"train", "val", "test"}
