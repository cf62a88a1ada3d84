"""Pairs that meet in one part of the index: a worker holds and sends a bounded number of them, and none is lost."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quillfold.operators import similarity
from quillfold.operators.similarity import SPACED, entry


def test_pairs_of_a_part_are_held_and_sent_in_bounded_runs():
    """2,400 sets that share six shingles: 17 million meetings. Before, a batch had 2,269,770 pairs and the peak was 334 MB."""
    rng = np.random.default_rng(1)
    shared, sets = np.sort(rng.integers(0, 2**60, 6, dtype=np.uint64)), 2400
    held = [(np.sort(np.concatenate([shared, rng.integers(0, 2**60, 6, dtype=np.uint64)])), 0, i, 12, 0.05, 0.05, 7, 0, 0.9, 0, 0.9) for i in range(sets)]
    rows = [(r["heads"], r["head"], r["h"]) for r in similarity._packed(held, 4).to_pylist()]
    tracemalloc.start()
    try:
        met = [(x.shape[1], int(x[2].sum())) for x in similarity._meet(rows)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(times for _, times in met) == 6 * sets * (sets - 1) // 2
    assert max(n for n, _ in met) <= similarity.SENT and peak < 120 << 20


def test_sets_of_high_thresholds_do_not_meet_in_what_only_low_ones_need():
    """Two sets of 0.5 in an index where others ask 0.05: a shingle at the end of both is beyond the prefixes that 0.5 needs."""
    part = lambda least: [(r["heads"], r["head"], r["h"]) for r in similarity._packed([(np.sort(np.append(x, last)), 0, i, 20, 0.05, least, 7, 0, 0.9, 9, 0.5) for i, x in enumerate(own)], 4).to_pylist()]
    last = np.uint64(2**60 - 1)
    own = [np.arange(19, dtype=np.uint64) * np.uint64(2**40) + np.uint64(i * 2**33 + 2**34) for i in range(3)]
    assert sum(x.shape[1] for x in similarity._meet(part(0.05))) == 3
    assert sum(x.shape[1] for x in similarity._meet(part(0.5))) == 0


def test_mixed_thresholds_against_brute_force(spark):
    """Texts of 0.05 and 0.5 in one index, with common and rare words: each pair that reaches the lower threshold of its two is found."""
    rng = random.Random(3)
    base = [[f"b{k}w{i}" for i in range(90)] for k in range(6)]
    rows = []
    for i in range(240):
        words, cut = list(rng.choice(base)), rng.choice((5, 10, 30, 60, 80))
        at = rng.randrange(90 - cut + 1)
        words = [f"x{i}y{j}" for j in range(rng.randrange(80))] + words[at : at + cut] + [f"z{i}y{j}" for j in range(rng.randrange(20))]
        rows.append((i, " ".join(words), 0.05 if i % 4 == 0 else 0.5))
    df = spark.createDataFrame(rows, "id long, text string, least double")
    e = F.array(entry(F.lit(7).cast("long"), F.lit(0.05), F.col("least")))
    got = {tuple(r) for r in similarity.candidates(df.select("id", "text", e.alias("e")), SPACED).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    want = set()
    for i, a in enumerate(grams):
        for j in range(i + 1, len(grams)):
            b, least = grams[j], min(rows[i][2], rows[j][2])
            if a and b and len(a & b) >= least * len(a | b):
                want.add((i, j))
    assert len(want) > 500 and want <= got


def test_batches_to_workers_are_bounded(spark):
    """64 MB, Spark's own bound, before; a session that asks for less keeps it."""
    fresh, conf = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    df = fresh.createDataFrame([(1, "a b c d e f")], "id long, text string")
    similarity.as_sets(df, SPACED)
    assert fresh.conf.get(conf) == str(similarity.BATCH_BYTES)
    for less in ("1m", "65536", "64kb"):
        fresh.conf.set(conf, less)
        similarity.as_sets(df, SPACED)
        assert fresh.conf.get(conf) != str(similarity.BATCH_BYTES)
