"""The command line from a table of cases to chat records, on files."""

import json

import pytest

from quillfold.__main__ import COMMANDS, main
from quillfold.operators import records, reports
from quillfold.operators.similarity import similar_pairs
from quillfold.sources import readers


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases") / "cases.csv")
    word = "the court holds that the order of the board stands and so we affirm " * 20
    columns = ["jurisdiction", "court", "cluster_id", "case_name", "date_filed", "judge_name", "syllabus", "opinion_text", "author_str", "author_source", "author_initials", "issue_text", "facts", "disposition", "prevailing_party", "ideology", "ideology_score", "ideology_source", "issue_area", "issue_area_source", "decision_direction", "scdb_id"]
    rows = []
    for i in range(1, 41):
        row = dict.fromkeys(columns, "")
        row |= {"jurisdiction": ["SCOTUS", "CA5", "CA9"][i % 3], "court": ["scotus", "ca5", "ca9"][i % 3], "cluster_id": str(i), "case_name": f"A{i} v. B", "date_filed": f"2020-01-{i % 28 + 1:02d}", "judge_name": f"J{i % 4}", "opinion_text": f'"{i}" SMITH, Circuit Judge: {word} case {i * 7919}', "facts": f"f{i}", "issue_text": f"q{i}", "disposition": "affirmed" if i % 2 else "reversed"}
        rows.append([row[c] for c in columns])
    readers.write_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), path, columns)
    return path


def test_from_cases_to_chat_records(spark, cases, tmp_path):
    at = lambda name: str(tmp_path / name)
    main(["enrich-authors", "--input", cases, "--output", at("authors")], spark)
    main(["opinion-kind", "--input", at("authors"), "--output", at("kinds"), "--report", at("kinds.md")], spark)
    rows = readers.read_csv(spark, at("kinds")).where("jurisdiction <> 'SCOTUS'").collect()
    assert {r["author_str"] for r in rows} == {"SMITH"} and {r["opinion_kind"] for r in rows} == {"merits"}
    main(["dedupe", "--input", at("kinds"), "--output", at("kept"), "--dropped", at("dropped")], spark)
    assert readers.read_csv(spark, at("kept")).count() + readers.read_csv(spark, at("dropped")).count() == 40
    main(["make-splits", "--input", at("authors"), "--outdir", at("splits"), "--max-target-chars", "50"], spark)
    main(["build-finetune", "--splits", at("splits"), "--outdir", at("chat"), "--include-ideology"], spark)
    chat = spark.read.json(at("chat") + "/predict").collect()
    assert len(chat) == 40 and all(r["messages"][2]["content"] == r["meta"]["disposition"] for r in chat)
    written = spark.read.json(at("chat") + "/generation").head()["messages"][2]["content"]
    assert "Disposition: " in written and len(written) < 80
    main(["completeness-report", "--input", at("kept"), "--md", at("report.md")], spark)
    assert "## Tiers" in "\n".join(r["value"] for r in spark.read.text(at("report.md")).collect())


def test_every_command_parses():
    assert len(COMMANDS) >= 20
    for name in COMMANDS:
        with pytest.raises(SystemExit) as stopped:
            main([name, "--help"])
        assert stopped.value.code == 0


def test_samples_and_shuffles(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], "xy"[i % 5 == 0]) for i in range(300)], "id int, a string, b string")
    once, twice = ([r["id"] for r in records.stratified_sample(df, ["a", "b"], "id", 50, 1).orderBy("id").collect()] for df in (rows, rows.repartition(5)))
    assert once == twice and len(once) == 50
    assert records.stratified_sample(rows, ["a"], "id", 0).count() == 300
    orders = [[r["id"] for r in records.shuffled(df, "id", s).collect()] for df, s in ((rows, 1), (rows.repartition(3), 1), (rows, 2))]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == list(range(300)) != orders[0]


def test_similar_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = [(i, sorted(rng.sample(range(40), rng.randint(1, 25)))) for i in range(80)] + [(200, list(range(40))), (201, list(range(40)))]
    blocks = [(i, i % 2, least) for i, _ in sets for least in (0.3, 0.7)]
    got = similar_pairs(spark.createDataFrame(sets, "id int, s array<long>"), spark.createDataFrame(blocks, "id int, k int, least double"), ["k", "least_of"][:1]).collect()
    by = dict(sets)
    jaccard = lambda a, b: len(set(by[a]) & set(by[b])) / len(set(by[a]) | set(by[b]))
    want = {(a, b): jaccard(a, b) for a in by for b in by if a < b and a % 2 == b % 2 and jaccard(a, b) >= 0.3}
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and len(want) > 20


def test_render_refuses_long_sections(spark):
    with pytest.raises(ValueError):
        reports.render("x", spark.range(5), most=3)
    assert reports.render("x", spark.range(2)).splitlines()[2] == "| id |"
    assert json.loads("[1]") == [1]
