"""Pairs of similar texts: what goes into the index is packed, and few pairs are compared that are not similar."""

import random

from pyspark.sql import functions as F

from quillfold.operators import similarity
from quillfold.operators.similarity import PLAIN, entry, similar_pairs


def texts(n):
    """Of every ten texts two are near copies; all share a passage that is no similarity."""
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(30))
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        if i % 10 == 9:
            words = out[-1][1].split()[30:]
            words[3] = "changed"
        out.append((i, " ".join([*shared.split(), *words])))
    return out


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_index_is_packed_and_bounds_leave_similar_pairs(spark, monkeypatch):
    rows = texts(300)
    kinds = {i: i // 10 % 2 for i, _ in rows}
    sent, left, post, found = [], [], similarity.postings, similarity.candidates
    monkeypatch.setattr(similarity, "postings", lambda *a: (p := post(*a), sent.append(p.agg(F.count("*"), F.sum(F.length("h") + F.length("head"))).first()))[0])
    monkeypatch.setattr(similarity, "candidates", lambda *a: (p := found(*a), left.append(p.count()))[0])
    df = spark.createDataFrame([(i, t, kinds[i]) for i, t in rows], "id long, text string, k int")
    half = F.lit(0.5)
    got = similar_pairs(df.select("id", "text", F.array(entry(F.xxhash64("k"), half, half)).alias("e")), df.select("id", "k", half.alias("least")), ["k"], rule=PLAIN).collect()
    sets = {i: grams(t) for i, t in rows}
    want = {}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and kinds[i] == kinds[j] and 2 * len(a & b) >= len(a | b):
                want[i, j] = len(a & b) / len(a | b)
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(want) >= 30
    shingles = sum(map(len, sets.values()))
    assert sent[0][0] < 300 and sent[0][1] < 8 * shingles  # a row for each shingle of each prefix before, with its block, size and id
    assert left[0] < 4 * len(want)


def test_lower_threshold_of_one_side(spark):
    """Of two sets the lower threshold counts, and sets under five words pair with nothing."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, base, 0.05), (2, base[40:] + [f"x{i}" for i in range(40)], 0.5), (3, base[42:] + [f"y{i}" for i in range(40)], 0.5), (4, base[:4], 0.05)]
    df = spark.createDataFrame([(i, " ".join(w), t) for i, w, t in rows], "id long, text string, least double")
    e = F.array(entry(F.lit(7).cast("long"), F.lit(0.05), F.col("least")))
    got = similarity.candidates(df.select("id", "text", e.alias("e")), PLAIN).collect()
    assert {tuple(r) for r in got} == {(1, 2), (1, 3)}


def test_texts_stay_where_they_lie(spark):
    """Rows that go are looked up by id: no join of the steps deals out the texts."""
    from quillfold.operators import dedup
    from quillfold.operators.relational import cut_lineage

    rows = spark.range(1000).select(F.col("id").alias("cluster_id"), F.repeat(F.lit("x"), 100).alias("opinion_text"))
    left = dedup.without(rows, cut_lineage(rows.where("cluster_id % 3 = 0")))
    assert left.count() == 666
    assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
