"""Intervals, tests and text metrics against direct versions, with ties, nulls, single rows and empty tables."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold.operators import alignment, evaluation, ranks, statistics, text_metrics


def test_ranks_with_ties(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.5, 1.5, 2.0, -3.0, rng.random() * 10]) for _ in range(500)] + [7.0] * 300
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    known = sorted(v for v in values if v is not None)
    want = {v: (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2 for v in set(known)}
    assert {r.id: r.r for r in ranks.with_rank(df, "v", "r").collect()} == {i: want.get(v) for i, v in enumerate(values)}
    assert ranks.tie_ranks(df.limit(0), "v").count() == 0


def test_weights_are_poisson_and_follow_the_id():
    w = statistics.poisson_weights(np.arange(20_000) * 7919, 50, 3)
    shares = Counter(w.ravel().tolist())
    for k in range(5):
        assert abs(shares[k] / w.size - math.exp(-1) / math.factorial(k)) < 0.005
    assert abs(w.mean(axis=0) - 1).max() < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05
    assert (statistics.poisson_weights(np.array([14 * 7919]), 50, 3) == w[14]).all() and (statistics.poisson_weights(np.array([14 * 7919]), 50, 4) != w[14]).any()


def test_bootstrap_is_the_same_however_rows_lie(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("string").alias("gold"), (F.col("id") % 7 % 3).cast("string").alias("pred"))
    once, twice = (sorted(statistics.bootstrap_intervals(df, "id", "gold", "pred").collect()) for df in (rows, rows.repartition(7)))
    assert once == twice and len(once) == 2
    accuracy = once[0]
    p, half = accuracy.estimate, 1.96 * math.sqrt(accuracy.estimate * (1 - accuracy.estimate) / 3000)
    assert abs(accuracy.lo - (p - half)) < half / 3 and abs(accuracy.hi - (p + half)) < half / 3
    assert statistics.bootstrap_intervals(rows.limit(0), "id", "gold", "pred").count() == 0
    odd = spark.createDataFrame([(1, "a", None), (2, None, "a"), (-5, "a", "a")], "id long, gold string, pred string")
    assert {r.metric for r in statistics.bootstrap_intervals(odd, "id", "gold", "pred", 10).collect()} == {"accuracy", "macro_f1"}


def test_paired_tests(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 9) / 2, rng.randint(0, 9) / 2) for _ in range(300)] + [(None, 1.0), (1.0, None)]
    got = statistics.paired_tests(spark.createDataFrame(pairs, "x double, y double"), "x", "y").head()
    d = [x - y for x, y in pairs[:300]]
    size = sorted(abs(v) for v in d if v)
    rank = {v: (size.index(v) + 1 + len(size) - size[::-1].index(v)) / 2 for v in set(size)}
    up = sum(rank[abs(v)] for v in d if v > 0)
    m = len(size)
    z = (up - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - sum(c**3 - c for c in Counter(size).values()) / 48)
    assert (got.n, got.n_nonzero, got.w_plus, got.w_plus + got.w_minus) == (300, m, up, m * (m + 1) / 2)
    assert got.z == pytest.approx(z) and got.cohens_d == pytest.approx(np.mean(d) / np.std(d, ddof=1)) and got.t == pytest.approx(got.cohens_d * math.sqrt(300))
    none = statistics.paired_tests(spark.createDataFrame([], "x double, y double"), "x", "y").head()
    assert none.n == 0 and none.n_nonzero == 0 and none.z is None
    same = statistics.paired_tests(spark.createDataFrame([(1.0, 1.0)] * 4, "x double, y double"), "x", "y").head()
    assert same.n_nonzero == 0 and same.z is None and same.mean_difference == 0 and same.cohens_d is None


def test_agreement(spark):
    """Krippendorff's own example: 12 units, some without all raters."""
    units = [[1, 1, None, 1], [2, 2, 3, 2], [3, 3, 3, 3], [3, 3, 3, 3], [2, 2, 2, 2], [1, 2, 3, 4], [4, 4, 4, 4], [1, 1, 2, 1], [2, 2, 2, 2], [None, 5, 5, 5], [None, None, 1, 1], [None, None, 3, None]]
    df = spark.createDataFrame([(i, v) for i, u in enumerate(units) for v in u], "u int, v int")
    assert statistics.krippendorff(df, "u", "v", "nominal").head().alpha == pytest.approx(0.743, abs=5e-4)
    got = statistics.krippendorff(df, "u", "v", "interval").head()
    assert got.alpha == pytest.approx(0.849, abs=5e-4) and (got.n_units, got.n_values) == (11, 40)
    assert statistics.krippendorff(df.where("v = 3"), "u", "v").head().alpha is None
    assert statistics.krippendorff(df.limit(0), "u", "v").head().n_units == 0
    pairs = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 15.0), (3, None), (None, 1.0)], "x int, y double")
    got = statistics.spearman(pairs, "x", "y").head()
    assert (got.n, got.rho) == (3, pytest.approx(0.5)) and statistics.spearman(pairs.limit(2), "x", "y").head().rho is None


def test_stability_of_equal_groups(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 3.0), ("b", "y", 1.0), (None, "x", 2.0), ("b", "x", None)], "c string, t string, m double")
    got = {r.context: (r.n_groups, r.stability) for r in statistics.stability(rows, ["m"], ["c", "t"]).collect()}
    assert got["c"] == (2, 100.0) and got["t"][0] == 2 and got["t"][1] == pytest.approx(100 / (1 + (0.5 / 6) / (0.5 - 0.5 / 6 + 0.5 / 6)), rel=0.2)
    assert statistics.stability(rows.limit(0), ["m"], ["c"]).count() == 0


def direct_bleu(texts, i, order=4):
    own, others = texts[i], [t for k, t in enumerate(texts) if k != i]
    if not others:
        return None
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    logs = 0.0
    for n in range(1, order + 1):
        mine, best = grams(own, n), Counter()
        for o in others:
            best |= grams(o, n)
        hits, extra = sum(min(c, best[g]) for g, c in mine.items()), n > 1
        if not hits + extra:
            return 0.0
        logs += math.log((hits + extra) / (sum(mine.values()) + extra))
    near = min((len(o) for o in others), key=lambda x: (abs(x - len(own)), x))
    return math.exp(logs / order + min(0.0, 1 - near / len(own)))


def test_self_bleu(spark):
    rng = random.Random(3)
    texts = {g: [[rng.choice("a b c d e".split()) for _ in range(rng.choice([1, 2, 3, 9, 30]))] for _ in range(n)] for g, n in (("p", 12), ("q", 2), ("r", 1), ("s", 3))}
    texts["s"] = [["a", "b", "c"]] * 3
    texts["t"] = [["x", "x"], ["y"]]
    rows = [(g, f"{g}{i}", " ".join(w)) for g, ws in texts.items() for i, w in enumerate(ws)] + [("p", "blank", " \n"), ("p", "null", None), (None, "none", "a b")]
    got = {r.id: r.bleu for r in text_metrics.self_bleu(spark.createDataFrame(rows, "g string, id string, w string"), "g", "id", "w").collect()}
    want = {f"{g}{i}": direct_bleu(ws, i) for g, ws in texts.items() for i in range(len(ws))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_transport(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 6):
        x, y = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
        cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        exact = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
        assert text_metrics.relaxed_bound(cost) <= exact + 1e-9
        assert exact - 1e-9 <= text_metrics.transport_cost(cost) <= exact * 1.02 + 1e-9
    rows = [("a", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [1.0, 1.0]), ("c", [5.0, 5.0]), ("d", None), ("d", [None, 1.0])]
    vectors = spark.createDataFrame(rows, "s string, v array<double>")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("a", "nothing")], "left string, right string")
    got = {(r.left, r.right): (r.lower, r.distance) for r in text_metrics.mover_distances(vectors, "s", "v", pairs, beyond=3.0).collect()}
    assert got.keys() == {("a", "a"), ("a", "b"), ("a", "c")} and got["a", "c"][1] is None and got["a", "c"][0] > 3
    assert got["a", "a"] == (0.0, pytest.approx(0.0, abs=1e-6)) and got["a", "b"] == (1.0, pytest.approx(1.0, abs=1e-6))


def test_alignment(spark):
    rows = [("x", "Liberal", [1.0, 0.0]), ("x", "Liberal", [1.0, 0.2]), ("x", "Conservative", [0.8, -0.6]), ("y", "Moderate", [0.0, 1.0]), ("y", None, [0.1, 1.0])]
    train = spark.createDataFrame(rows, "court string, class string, v array<double>")
    test = spark.createDataFrame([("x", "Liberal", [1.0, 0.1]), ("y", "Conservative", [0.0, 2.0]), ("x", "Liberal", [0.7, -0.7]), ("z", "Liberal", [1.0, 0.0]), ("x", "Moderate", None), ("x", None, [0.0, 0.0])], "court string, class string, v array<double>")
    got = alignment.style_alignment(test, train, "court", "v").collect()
    assert len(got) == 6 and [(r.nearest_court, r.csa_right) for r in got if r.court == "y"] == [("y", True)]
    assert [(r.csa, r.csa_right) for r in got if r.court == "z"] == [(None, False)] and sum(r.csa is None for r in got) == 3
    ideology = {tuple(r.v): (r.nearest_class, r.ia) for r in alignment.ideology_alignment(test, train, "court", "class", "v").collect()}
    assert ideology[1.0, 0.1][0] == "Liberal" and ideology[1.0, 0.1][1] == pytest.approx(1.0, abs=0.01)
    assert ideology[0.7, -0.7] == ("Conservative", 0.0) and ideology[0.0, 2.0][1] == pytest.approx(0.5, abs=0.01)


def test_class_report_and_groups(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "d")], "g string, p string")
    got = {r.label: r for r in evaluation.class_report(df, "g", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.5, 0.5, 0.5) and got["c"].precision is None and got["d"].recall is None
    assert got["weighted"].f1 == pytest.approx((0.5 * 2 + 2 / 3 + 0) / 5) and got["weighted"].support == 5
    names = spark.createDataFrame([("Affirmed ",), ("vacated",), ("odd",), (None,)], "d string")
    assert [r.o for r in names.select(evaluation.outcome_group(F.col("d")).alias("o")).collect()] == ["affirmed", "reversed", "other", "other"]


def test_citations(spark):
    df = spark.createDataFrame([("See 410 U.S. 113; 12 F. Supp. 2d 5, and 7 S. Ct. 9. No 410 U.S. or 5 F.9d 1.",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(F.size(text_metrics.citations(F.col("t"))).alias("n")).collect()] == [3, 0, 0]
    assert text_metrics.citation_density(df.limit(0), "t").head().density is None
