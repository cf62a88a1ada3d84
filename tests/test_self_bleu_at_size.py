"""Self-BLEU of groups that take many blocks: equal to a direct version, and what goes between blocks follows the texts, not all their n-grams."""

import random
from collections import Counter

import numpy as np
import pytest
from test_statistics import direct_bleu

from quillfold.operators import ngram_clips, text_metrics


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_large_groups_take_many_blocks(spark, monkeypatch):
    """A hot word, a shared passage, copies and near copies over blocks; a text longer than a block; small groups beside."""
    monkeypatch.setattr(ngram_clips, "BLOCK_BYTES", 2000)
    rng = random.Random(6)
    passage = [f"s{i}" for i in range(12)]

    def text(k):
        words = [rng.choice(["the", "The", f"w{rng.randrange(40)}", f"r{rng.randrange(10**6)}"]) for _ in range(rng.choice([1, 2, 3, 20, 60]))]
        return words + passage * (k % 3)

    texts = {g: [text(k) for k in range(n)] for g, n in (("p", 150), ("q", 60), ("r", 1), ("s", 5), ("t", 2))}
    texts["p"] += [[*x] for x in texts["p"][:20]] + [[*x[:-1], "é"] for x in texts["p"][20:40]] + [text(1) * 40, ["the"] * 700]
    texts["u"] = [[f"u{rng.randrange(500)}" for _ in range(900)]]
    rows = [(g, f"{g}{i}", "\x0b ".join(w) if i % 7 == 3 else " ".join(w)) for g, ws in texts.items() for i, w in enumerate(ws)] + [("p", "blank", " \t"), ("p", "null", None), (None, "none", "a b")]
    df = spark.createDataFrame(rows, "g string, id string, w string")
    got = {r.id: r.bleu for r in text_metrics.self_bleu(df, "g", "id", "w").collect()}
    want = {f"{g}{i}": direct_bleu(ws, i) for g, ws in texts.items() for i in range(len(ws))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_what_is_sent_follows_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_clips, "BLOCK_BYTES", 1 << 18, raising=False)
    rng = random.Random(7)
    rows = [(i % 10 // 9, i, " ".join(f"w{int(10 ** rng.uniform(0, 5))}" for _ in range(rng.randrange(400)))) for i in range(2000)]
    before = shuffled(spark)
    assert len(text_metrics.self_bleu(spark.createDataFrame(rows, "g int, id long, w string"), "g", "id", "w").collect()) == sum(bool(t) for _, _, t in rows)
    assert shuffled(spark) - before < 4 * sum(len(t) for _, _, t in rows)


def test_packing():
    rng = np.random.default_rng(8)
    for bits, n in ((64, 1), (64, 5000), (33, 3000), (12, 4096), (1, 2), (0, 1)):
        x = np.sort(rng.choice(1 << bits, n, replace=False)).astype(np.uint64) if bits < 20 else np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64, endpoint=False))
        assert (ngram_clips._decoded(ngram_clips._coded(x, bits), len(x)) == x).all()
    for h in (rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 9, 3000, dtype=np.uint64), (rng.integers(0, 5, 3000) << 40 | rng.integers(0, 30, 3000)).astype(np.uint64), np.empty(0, dtype=np.uint64)):
        assert (ngram_clips._order(h) == np.argsort(h, kind="stable")).all()
    c = np.array([1, 3, 3, 2, 5])
    top, second = ngram_clips._first_two(np.array([True, False, False, True, True]), c)
    assert top.tolist() == [1, 3, 4] and second.tolist() == [3, 0, 0] and Counter(c[top].tolist()) == {3: 1, 2: 1, 5: 1}
