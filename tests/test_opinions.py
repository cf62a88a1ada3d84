"""Literal opinions: authors, kinds, separate writings, headers; amended chains and group splits."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillfold.functions import opinions as O
from quillfold.operators import revisions

PANEL = "Before: Milan D. Smith, and Ryan D. Nelson, Circuit Judges. "


AUTHORS = [
    (PANEL + "NELSON, Circuit Judge: We affirm.", ("NELSON", "signature", "R.D.", "panel", False)),
    (PANEL + "N.R. SMITH, Circuit Judge. We affirm.", ("SMITH", "signature", "N.R.", "signature", False)),
    ("W. EUGENE DAVIS, Circuit Judge: We affirm.", ("DAVIS", "signature", "W.E.", "signature", False)),
    ("JONES, Circuit Judge, dissenting. Opinion by Judge Milan D. Smith, Jr.; x", ("", "none", "", "", False)),
    ("Opinion by Judge Milan D. Smith; Dissent", ("Smith", "opinion_by", "M.D.", "opinion_by", False)),
    ("García, Jr., Circuit Judge: x", ("García", "signature", "", "", False)),
    ("GUIROLA, District Judge: We affirm.", ("GUIROLA", "signature", "", "", True)),
    ("John Roe, District Judge, Presiding", ("", "none", "", "", False)),
    ("CIRCUIT Judge: the court", ("", "none", "", "", False)),
    ("The Honorable Ann B. Roe sits. ROE, Circuit Judge: x", ("ROE", "signature", "A.B.", "panel", False)),
    ("The Honorable Ann B. Roe sits, The Honorable Zoe Roe too. ROE, Circuit Judge: x", ("ROE", "signature", "", "", False)),
    ("x" * 30_000 + " ROE, Circuit Judge: too late", ("", "none", "", "", False)),
    ("", ("", "none", "", "", False)),
    (None, ("", "none", "", "", False)),
]


def test_author(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(AUTHORS)], "id int, text string")
    got = {r["id"]: tuple(r["a"]) for r in df.select("id", O.author(F.col("text")).alias("a")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(AUTHORS)}


def test_kind(spark):
    cases = [
        ("CA9", "NOT FOR PUBLICATION MEMORANDUM x", "none", "memorandum"),
        ("CA5", "rehearing en banc is DENIED", "signature", "summary_order"),
        ("CA5", "PER CURIAM: x", "none", "per_curiam"),
        ("CA9", "ORDER the panel OPINION", "none", "order"),
        ("CA9", "ORDER AND AMENDED OPINION", "none", "merits"),
        ("CA9", "OPINION then ORDER", "none", "merits"),
        ("SCOTUS", "ON APPLICATION FOR STAY", "", "summary_order"),
        ("SCOTUS", "per curiam x", "", "per_curiam"),
        ("SCOTUS", "per curiam; he delivered the opinion of the Court", "", "merits"),
        ("CA9", None, None, "merits"),
        ("CA1", "MEMORANDUM", "none", "merits"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, j string, t string, s string, want string")
    rows = df.select("i", "want", O.kind(F.col("j"), F.col("t"), F.col("s")).alias("got")).collect()
    assert [(r["i"], r["got"]) for r in rows] == [(r["i"], r["want"]) for r in rows]


def test_separate_writings(spark):
    body = "word " * 400
    text = body + "Andrew S. Oldham, Circuit Judge, dissenting: " + "no " * 200 + "JONES, Circuit Judge, concurring in part and dissenting in part: yes"
    near = "JONES, Circuit Judge, dissenting: " * 3
    cases = [text, "see (Jones, Circuit Judge, dissenting)", near, "short", None, "AFFIRMED. JONES, Circuit Judge, concurring: x"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    rows = df.select("id", O.split_writings(F.col("text")).alias("s"), O.separators(F.coalesce("text", F.lit(""))).alias("p")).orderBy("id").collect()
    found = [[tuple(p) for p in r["p"]] for r in rows]
    assert found == [[(len(body), O.DISSENT), (text.index("JONES"), O.IN_PART)], [], [(0, O.DISSENT)], [], [], [(10, O.CONCURRENCE)]]
    assert rows[0]["s"]["majority"] == body.strip() and [p["type"] for p in rows[0]["s"]["parts"]] == [O.DISSENT, O.IN_PART]
    assert [r["s"] for r in rows[1:]] == [None] * 5


def test_headers(spark):
    header = "Case: 19-12345 Document: 00515 Page: 3 Date Filed: 01/02/2020"
    captions = " ".join(f"text {n} ROE V. DOE more" for n in (4, 5, 6))
    df = spark.createDataFrame([(f"a {header} b", captions), (None, None)], "t string, c string")
    got = df.select(O.strip_page_headers(F.col("t")).alias("h"), O.strip_captions(F.array("c")).alias("c")).collect()
    assert (got[0]["h"]["text"], got[0]["h"]["n"], got[0]["c"]["n_captions"]) == ("a b", 1, 3)
    assert (got[1]["h"]["text"], got[1]["h"]["n"], got[1]["c"]["n_captions"]) == (None, 0, 0)
    assert "ROE" not in got[0]["c"]["texts"][0]


def test_compare_pages(spark):
    page = "Compare Results Old File: x file://NoURLProvided[1] inside file://NoURLProvided[2] end "
    df = spark.createDataFrame([(page,), ("plain ",), (None,)], "t string")
    assert [r[0] for r in df.select(O.strip_compare_page(F.col("t"))).collect()] == ["inside   end", "plain ", None]


def greedy(rows):
    """Brute force, latest first."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    grams = {r[0]: {tuple(w[i : i + 5]) for w in [r[2].lower().split()] for i in range(len(w) - 4)} for r in rows}
    gone = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :] if a[0] not in gone else ():
            x, y = grams[a[0]], grams[b[0]]
            if b[0] not in gone and (a[1] - b[1]).days <= 400 and x and y and 2 * len(x & y) >= len(x | y):
                gone[b[0]] = a[0]
    return gone


def test_amended_chain(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, date(2020, 1, 1) + timedelta(days=90 * (i // 2)), " ".join(base[3 * i : 3 * i + 30])) for i in range(10)]
    rows += [(20, date(2018, 1, 1), rows[0][2]), (21, date(2020, 1, 1), "too short")]
    df = spark.createDataFrame([(i, "CA9", "a v b", d, t) for i, d, t in rows], "id long, court string, name string, filed date, text string")
    got = {r["older"]: r["newer"] for r in revisions.drop_superseded(revisions.amended_pairs(df)).collect()}
    assert got == greedy(rows) and len(got) > 3


def greedy_splits(rows, shares=(("test", 1), ("val", 1), ("train", 8))):
    """One group after the other, by the squared error that each choice would leave; of a class of equal counts the first groups get the first split."""
    import hashlib
    import json
    from collections import Counter, defaultdict

    seeded = lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest()
    mine = defaultdict(Counter)
    for g, x in rows:
        mine[g][x] += 1
    total, have = Counter(x for _, x in rows), {s: Counter() for s, _ in shares}
    kind = {g: json.dumps([{"l": x, "n": n} for x, n in sorted(c.items())], separators=(",", ":")) for g, c in mine.items()}
    taken = defaultdict(Counter)
    order = sorted(mine, key=lambda g: (-sum(mine[g].values()), seeded(kind[g]), kind[g], seeded(g), g))
    for g in order:
        error = {s: sum((10 * (have[s][x] + n) - f * total[x]) ** 2 - (10 * have[s][x] - f * total[x]) ** 2 for x, n in mine[g].items()) for s, f in shares}
        best = min(error, key=error.get)
        have[best] += mine[g]
        taken[kind[g]][best] += 1
    return {g: next(taken_of for taken_of in [[s for s, _ in shares for _ in range(taken[kind[g]][s])]])[[h for h in order if kind[h] == kind[g]].index(g)] for g in order}


def test_group_split(spark):
    rows = [(f"g{i % 17}", "xy"[i % 2]) for i in range(400)] + [("big", "x")] * 300 + [(None, "x")]
    df = spark.createDataFrame(rows, "g string, l string")
    got = {r["g"]: r["split"] for r in revisions.group_split(df, "g", "l").collect()}
    assert got == greedy_splits([r for r in rows if r[0]])
    assert got["big"] == "train" and len(got) == 18 and set(got.values()) == {"train", "val", "test"}
    assert got == {r["g"]: r["split"] for r in revisions.group_split(df.repartition(3), "g", "l").collect()}
    assert revisions.group_split(df.limit(0), "g", "l").count() == 0
    with pytest.raises(ValueError):
        revisions.group_split(df, "g", "l", 0.5, 0.5)


def test_group_split_of_many_like_groups(spark):
    """A class of most groups, several small classes, and labels that only some groups have."""
    import random

    rng = random.Random(5)
    rows = [(g, "a") for g in range(3000)] + [(g, rng.choice("abc")) for g in range(3000, 3400) for _ in range(rng.randint(1, 4))] + [(9000, rng.choice("cd")) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, l string")
    assert {r["g"]: r["split"] for r in revisions.group_split(df, "g", "l").collect()} == greedy_splits(rows)


def test_runs_are_those_of_one_after_the_other():
    import random

    rng = random.Random(6)
    for _ in range(300):
        costs, step, many = [rng.randint(-50, 50) for _ in range(3)], rng.randint(1, 9), rng.randint(1, 40)
        taken, now = [0, 0, 0], list(costs)
        for _ in range(many):
            k = now.index(min(now))
            taken[k], now[k] = taken[k] + 1, now[k] + step
        assert revisions.runs_of(costs, step, many) == taken
