"""Joins whose pairs must not follow the rows: each against a direct version, with a count of what meets."""

import datetime
import random

from quillfold.operators import enrichment, relational


def day(n):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=n)


def counted_pairs(monkeypatch, module):
    """What active_pairs returns, counted."""
    met, pairs = [], relational.active_pairs

    def counted(*args, **more):
        found = pairs(*args, **more)
        met.append(found.count())
        return found

    monkeypatch.setattr(module, "active_pairs", counted)
    return met


def test_interval_decision_meets_each_date_once(spark, monkeypatch):
    """Many rows of few dates and many persons of few spans: pairs follow neither; persons with spans that overlap, touch or are open count once."""
    rng = random.Random(4)
    spans = []
    for k in (1, 2):
        for p in range(40):
            for _ in range(3):
                a = rng.randrange(60)
                spans.append((k, p, None if rng.random() < 0.1 else day(a), None if rng.random() < 0.1 else day(a + rng.randrange(-3, 30))))
    spans += [(1, p, day(5), day(50)) for p in range(1000, 1300)] + [(3, 7, day(1), day(4)), (3, 7, day(3), day(9)), (3, 7, day(9), day(11)), (3, None, day(1), None), (None, 8, day(1), None)]
    rows = [(i, rng.choice([1, 2, 3, 4, None]), None if i % 50 == 0 else day(rng.randrange(-5, 95))) for i in range(3000)]
    met = counted_pairs(monkeypatch, relational)
    got = relational.interval_decision(spark.createDataFrame(rows, "id int, k int, d date"), spark.createDataFrame(spans, "k int, person int, start date, end date"), "id", "k", "d").collect()
    want = set()
    for i, k, d in rows:
        there = {p for q, p, a, b in spans if q == k and k is not None and p is not None and (d is None or ((a is None or a <= d) and (b is None or b >= d)))}
        want.add((i, len(there), min(there) if len(there) == 1 else None))
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert sum(met) < 300 * 200


def test_roster_meets_each_question_once(spark, monkeypatch):
    """Cases that ask the same are one question, persons alike are counted; one who bears two sets of initials is one person still."""
    cases = [(i, "Ash" if i % 2 else "Elm", "ca9", "CA9", day(20 + i % 3), "A." if i % 4 == 1 else "", False) for i in range(2000)]
    people = [("9", "ash", f"p{i}", "B" if i % 2 else "C", None, None) for i in range(60)] + [("9", "ash", "q", "A", day(0), None)]
    people += [("9", "elm", "r", "D", day(0), day(30)), ("9", "elm", "r", "E", day(10), None)]
    roster = [("A", "A Ash", "ash", "9", "A", 0.5), ("B", "B Ash", "ash", "9", "B", 0.25), ("D", "D Elm", "elm", "9", "D", 0.1), ("E", "E Elm", "elm", "9", "E", -0.1)]
    frames = (
        spark.createDataFrame(cases, "row_id int, author string, court string, jurisdiction string, date date, initials string, district boolean"),
        spark.createDataFrame(roster, "first_name string, full_name string, last string, court string, initials string, score double"),
        spark.createDataFrame(people, "circuit string, surname string, person string, initials string, start date, end date"),
    )
    met = counted_pairs(monkeypatch, enrichment)
    got = {r.row_id: (r.full_name, r.state) for r in enrichment.roster_matches(*frames).collect()}
    want = {i: ("A Ash", "found") if i % 4 == 1 else (None, "ambiguous") if i % 2 else ("E Elm", "found") for i in range(2000)}
    assert got == want
    assert sum(met) < 2000
    reasons = {r.row_id: r.reason for r in enrichment.roster_reasons(*frames).collect()}
    assert reasons == {i: "initials" if i % 4 == 1 else "several" if i % 2 else "active" for i in range(2000)}
