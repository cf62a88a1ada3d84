"""The training-data operators on small inputs: brute force, round trips, nulls, ties, repeats and empty tables."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold.llm import bpe, ivfpq, jaccard, langid, mixing, mtree, packing, repeats, toolcalls, toxicity
from quillfold.llm.components import components
from quillfold.llm.queries import public_ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"


def frame(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i, "s"), None, 0.5, 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice("the of and to a in is it ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou") for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, short and empty and null texts, a long run."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = base + base[:5] + [b.replace("the", "thee", 1) for b in base[5:15]] + [b + " " + passage for b in base[15:25]]
    texts += ["", None, "one two", "One  Two", " \t\n", passage, passage, "a" * 1000, "b " + "a" * 900, "é" * 300, prose(rng, 3000)]
    return list(enumerate(texts))


def test_bpe_matches_the_library_and_round_trips(spark):
    ranks, pattern = public_ranks()
    enc = bpe.encoder(ranks, pattern)
    texts = corpus() + [(900, "word\n\n\n  tail " * 9000), (901, "x" * 70000 + " y"), (None, "no id"), (1, "twice"), (1, "twice")]
    got = bpe.encode_documents(frame(spark, texts), ranks, pattern).collect()
    assert len(got) == len(texts)
    want = collections.Counter((i, np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in texts)
    assert want == collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got)
    assert bpe.encode_documents(frame(spark, []), ranks, pattern, digests=True).count() == 0


@pytest.mark.parametrize("size", [3, 10, 50])
def test_safe_pieces_change_nothing(size):
    ranks, pattern = public_ranks()
    enc = bpe.encoder(ranks, pattern)
    for text in ("it's  a\n\n b c1 2 'll x\t y " * 5, " lead", "tail  ", " x  y z"):
        assert sum((enc.encode_ordinary(p) for p in bpe.safe_pieces(text, size)), []) == enc.encode_ordinary(text)


def test_long_runs_of_white_space():
    """As the library encodes them where it can; beyond, what it merges of the run alone, and an exact round trip."""
    ranks, pattern = public_ranks()
    enc = bpe.encoder(ranks, pattern)
    long = bpe.PIECE_CHARS
    for space in (" ", "\n", "\u3000", "\t \n"):
        for n in (long - 1, long, long + 1, 2 * long):
            run = (space * n)[:n]
            for text in (run, f"a{run}", f"{run}a", f"a!{run}'s b{run}\x1c{run} 1"):
                assert bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", " \n" * 1_000_000 + " end"):
        assert bpe.decode_ids(enc, bpe.encode_text(enc, text)) == text.encode()


def test_packing_is_lossless_and_tight(spark):
    ranks, pattern = public_ranks()
    enc = bpe.encoder(ranks, pattern)
    texts = [(i, t) for i, t in corpus() if t]
    rows = packing.pack_documents(frame(spark, corpus()), ranks, pattern, row_tokens=64, shard_bytes=4000).collect()
    pieces = collections.defaultdict(dict)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert list(positions[a:b]) == list(range(b - a))
            pieces[d][p] = list(ids[a:b])
    assert {d: sum((ps[k] for k in sorted(ps)), []) for d, ps in pieces.items()} == {i: enc.encode_ordinary(t) for i, t in texts}
    lengths = [random.Random(3).randint(1, 20) for _ in range(300)]
    bins = packing.best_fit_decreasing(lengths, 20)
    free, want = [], 0  # plain best fit decreasing
    for n in sorted(lengths, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= n
        else:
            free.append(20 - n)
            want += 1
    assert len(bins) == want and sorted(i for b in bins for i in b) == list(range(300))
    assert packing.pack_documents(frame(spark, []), ranks, pattern).count() == 0
    again = packing.pack_documents(frame(spark, [(1, "one two"), (1, "one two"), (None, "three"), (None, "four"), (2, "x" * 100_000)]), ranks, pattern, row_tokens=64).collect()
    held = collections.Counter(d for r in again for d, p in zip(r.doc_ids, r.parts, strict=True) if p == 0)
    assert held == {1: 2, None: 2, 2: 1}


def test_packing_spreads_copies_of_one_row(spark):
    """20,000 copies of a row: no shard holds many more than its share, and none is lost."""
    ranks, pattern = public_ranks()
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same few words again and again").alias("text"), F.lit(1).alias("shard"), F.lit("x").alias("row"))
    rows = packing.pack_documents(df, ranks, pattern, row_tokens=64, shard_bytes=20_000).select("shard", F.size("doc_ids").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in rows) == 20_000 and len(rows) >= 30 and max(r.n for r in rows) < 2 * 20_000 / len(rows)


def test_packing_query_returns_the_matrices(spark, sf_dir, tmp_path):
    from quillfold.llm.queries import QUERIES

    packing.write_packed(QUERIES["op7_bfd_packing"](spark, sf_dir), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert rows and all(len(r.ids) == len(r.positions) == 4 * packing.ROW_TOKENS for r in rows)


def brute_sets(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return sets


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        words = prose(rng, rng.randint(5, 80)).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_is_exact(spark, seed):
    texts = near_corpus(seed) + [(1000 + i, t) for i, t in corpus(seed)]
    sets = brute_sets(texts)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_documents(frame(spark, texts)).collect()}
    assert got == want


def test_jaccard_join_keeps_links_of_lone_followers(spark):
    rng = random.Random(7)
    texts = []
    for c in range(400):  # four versions, each linked with the next one only, with ids in any order
        words = [f"w{c}x{rng.random()}" for _ in range(90)]
        texts += [(4 * c + i, " ".join(words[8 * k : 8 * k + 60])) for k, i in enumerate(rng.sample(range(4), 4))]
    got = {r.doc_id: r.component_id for r in jaccard.join_documents(frame(spark, texts)).collect()}
    assert got == {i: i - i % 4 for i, _ in texts}


def test_jaccard_edges(spark):
    got = jaccard.join_documents(frame(spark, [(5, "a b"), (5, "a b"), (3, "A\tB"), (None, "a b"), (4, None)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("3", 1, 3), ("4", 0, 4), ("5", 1, 3), ("5", 1, 3), ("None", 1, None)]
    assert jaccard.join_documents(frame(spark, [])).count() == 0


def test_several_texts_of_one_id(spark):
    rng = random.Random(11)
    a, b = prose(rng, 60), prose(rng, 60)
    got = jaccard.join_documents(frame(spark, [(9, a), (9, b), (4, a), (5, b), (6, "alone here"), (None, a)])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("4", 4), ("5", 4), ("6", 6), ("9", 4), ("9", 4), ("None", None)]


def test_long_lists_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(0)
    n = rng.integers(4, 40, 300)
    rest = n - 1 - rng.integers(0, np.maximum(1, n // 4))
    h, leader = np.sort(rng.integers(0, 5, 300)), rng.integers(0, 250, 300)
    short = jaccard.list_pairs(h, leader, n, rest)
    monkeypatch.setattr(jaccard, "LONG_LIST", 0)
    assert len(short) and {tuple(p) for p in jaccard.list_pairs(h, leader, n, rest)} >= {tuple(p) for p in short}  # blocks bound a little wider


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 52), (52, 51), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [1 << 15, 2])
def test_repeats_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MAX_LIST", most)  # 2: nearly all lists take the crowded way
    texts = corpus(4) + [(2000 + i, t) for i, t in near_corpus(5)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, texts), digests=True).collect()}
    assert got == brute_repeats(texts)


def test_repeats_edges(spark):
    rng = random.Random(8)
    long = prose(rng, 60)
    df = frame(spark, [(1, long), (1, long), (2, long), (None, long), (3, None), (4, "x")])
    got = repeats.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("2", len(long)), ("3", 0), ("4", 0), ("None", 0)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_with_any_names_and_texts(spark):
    rng = random.Random(9)
    long, other = prose(rng, 60), prose(rng, 50)
    names = "doc_id long, text string, _found int, _text string, d int, t int, found string, kept string, n_bytes string"
    rows = [(2, long, 1, "a", 2, 3, "f", "k", "n"), (1, "x" + long + "y", 1, "a", 2, 3, "f", "k", "n"), (3, other, 1, "b", 2, 3, "f", "k", "n"), (3, long, 1, "c", 2, 3, "f", "k", "n"), (3, other + " tail", 1, "d", 2, 3, "f", "k", "n"), (None, long, 1, "e", 2, 3, "f", "k", "n")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, names))
    assert got.columns == ["doc_id", "text", "_found", "_text", "d", "t", "found", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    cut = {(r.doc_id, r.text): r.n_removed for r in got.collect()}
    both = sorted([other, other + " tail"])
    assert cut == {(1, "x" + long + "y"): 0, (2, long): len(long), (3, long): len(long), (3, both[0]): 0, (3, both[1]): len(other), (None, long): 0}


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(10)
    passage, texts = prose(rng, 40), []
    for i in range(6):
        texts.append((i, prose(rng, 20) + (passage if i != 4 else "") + prose(rng, 20)))
    data = {i: t.encode() for i, t in texts}
    found = collections.defaultdict(list)
    for r in repeats.repeat_groups(frame(spark, texts)).collect():
        found[r.h, r.group_no].append((r.doc_id, r.start, r.end))
    assert found
    for places in found.values():
        pieces = {data[d][a:b] for d, a, b in places}
        assert len(pieces) == 1 and len(places) >= 2 and len(next(iter(pieces))) >= 100
        piece = next(iter(pieces))
        assert len({(d, a) for d, a, _ in places}) == sum(1 for t in data.values() for s in range(len(t)) if t.startswith(piece, s))
    assert any({d for d, _, _ in p} == {0, 1, 2, 3, 5} for p in found.values())


@pytest.mark.parametrize("most", [2, 1 << 15])
def test_groups_of_lists_of_any_size(spark, monkeypatch, most):
    """All occurrences of each group, and together just the bytes that are removed; with MAX_LIST at 2 nearly all lists go by windows."""
    monkeypatch.setattr(repeats, "MAX_LIST", most)
    monkeypatch.setattr(repeats, "PART", 3)
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (25, 40, 90)]
    texts = [(i, prose(rng, 15) + "".join(rng.choice(passages) + prose(rng, rng.randint(0, 3)) for _ in range(rng.randint(0, 3))) + prose(rng, 15)) for i in range(30)]
    texts += [(30, passages[2]), (31, passages[0][:50] + passages[1]), (32, "ab" * 150), (33, "x" + "ab" * 80), (34, ""), (35, None), (36, "é" * 120), (37, "é" * 120)]
    data = {i: (t or "").encode() for i, t in texts}
    found = collections.defaultdict(set)
    for r in repeats.repeat_groups(frame(spark, texts)).collect():
        found[r.h, r.group_no].add((r.doc_id, r.start, r.end))
    gone = collections.defaultdict(set)
    for places in found.values():
        pieces = {data[d][a:b] for d, a, b in places}
        assert len(pieces) == 1 and len(places) >= 2
        piece = next(iter(pieces))
        assert {(d, a) for d, a, _ in places} == {(d, s) for d, t in data.items() for s in range(len(t)) if t.startswith(piece, s)}
        for d, a, b in sorted(places)[1:]:
            gone[d] |= set(range(a, b))
    want = {r.doc_id: {x for s in r.spans for x in range(s.start, s.end)} for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert {d: v for d, v in want.items() if v} == dict(gone)


def test_long_texts_have_the_same_anchors(monkeypatch):
    data = np.frombuffer(prose(random.Random(2), 4000).encode(), dtype=np.uint8)
    whole = repeats.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)
    pieces = repeats._long_anchors(data)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


BAD = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1004, [], 1)]


def test_mtree_is_exact(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "PAGE", 4)
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(150, 6)), np.tile(rng.normal(size=(1, 6)), (80, 1)), np.zeros((5, 6))]).astype(np.float32)
    got = mtree.top_inner_products(vectors(spark, x, BAD[:-1]), every=10, k=5).collect()
    ints = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = set()
    for q in range(0, len(x), 10):
        scores = ints @ ints[q]
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:5]
        want |= {(q, r, i, int(scores[i])) for r, i in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert mtree.top_inner_products(vectors(spark, []), every=10).count() == 0
    assert mtree.top_inner_products(vectors(spark, x[:3]), every=50).count() == 2


def test_vectors_of_any_kind(spark):
    """Short vectors are padded, repeated ids are rows of their own, huge components are exact and stand at the bounds of a long."""
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (50, [0.5, 0.5]), (50, [3.0, -1.0]), (3, [1e30, 1.0]), (4, [-1e30, 0.0]), (5, [3e15, 7.0])]
    df = spark.createDataFrame([(i, [float(v) for v in e], 1) for i, e in rows], "vec_id long, embedding array<double>, label int")
    whole = [[int(np.floor(v * 256)) for v in [*e, 0.0, 0.0][:2]] for _, e in rows]
    clamp = lambda v: min(max(v, -(2**63)), 2**63 - 1)
    want = collections.Counter()
    for q, (i, _) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-clamp(sum(a * b for a, b in zip(whole[q], whole[j], strict=True))), rows[j][0], j) for j in range(len(rows)) if j != q)[:5]
            want.update((i, r, v, -s) for r, (s, v, _) in enumerate(scores, 1))
    assert collections.Counter(tuple(r) for r in mtree.top_inner_products(df).collect()) == want
    near = ivfpq.nearest(df, every=50).collect()
    assert len(near) == 3 * 6 and not any(r.vec_id == 2 for r in near)  # the empty vector is zero
    assert {r.vec_id: r.score for r in near if r.query_id == 0}[1] == 2.0
    huge = spark.createDataFrame([(0, [1e308], 1), (1, [-1e308], 1), (2, [1e308], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.score) for r in ivfpq.nearest(huge).collect()) == [(1, float("inf")), (2, 0.0)]


def test_mtree_saves_computations():
    rng = np.random.default_rng(1)
    x = np.floor(np.vstack([rng.normal(c, 0.1, size=(200, 3)) for c in rng.normal(size=(10, 3)) * 5]) * 256)
    tree = mtree.MTree(x, np.arange(len(x)))
    before = tree.computed
    tree.search(x[0], 5, 0)
    assert tree.computed - before < len(x) / 2


def test_ivfpq_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(900, 8)), np.tile(rng.normal(size=(1, 8)), (100, 1))]).astype(np.float32)
    bad = [(i, e * 2 if e and len(e) > 2 else e, y) for i, e, y in BAD] + [(5000, [0.0] * 8, 1)]
    got = ivfpq.nearest(vectors(spark, x, bad), every=20, k=10).collect()
    d = np.sqrt(((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(2))
    found = collections.defaultdict(dict)
    for r in got:
        assert r.score == pytest.approx(d[r.query_id, r.vec_id], abs=1e-12)
        found[r.query_id][r.rank] = r.vec_id
    hits = 0
    for q in range(0, 1000, 20):
        want = sorted((i for i in range(1000) if i != q), key=lambda i: (d[q, i], i))[:10]
        assert sorted(found[q]) == list(range(1, 11))
        hits += len(set(want) & set(found[q].values()))
    assert hits / (50 * 10) >= 0.9
    one = ivfpq.nearest(vectors(spark, x[:5]), every=50).collect()
    assert len(one) == 4  # all candidates, if fewer
    assert ivfpq.nearest(vectors(spark, []), every=10).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ivfpq_recall_on_the_table(spark, sf):
    """A fifth of the lists, codes only, against brute force over the whole table."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = collections.defaultdict(set)
    for r in ivfpq.nearest(table).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & found[int(ids[q])]))
    assert sum(hits) / (10 * len(hits)) >= 0.9


def test_ivfpq_takes_the_smaller_ids_of_a_thousand_copies(spark):
    """Each of the copies that asks gets the smallest ids of the others, and the rest gets its own neighbours."""
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile(rng.normal(size=(1, 16)), (1000, 1)), rng.normal(size=(600, 16))])
    order = rng.permutation(1600)
    rows = [(int(i), x[i].tolist(), 0) for i in order]
    got = collections.defaultdict(dict)
    for r in ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("row", F.lit(1)).withColumn("vec", F.lit(2)).withColumn("score", F.lit(3)).repartition(7)).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    for q in range(0, 1000, 100):
        assert [got[q][k] for k in range(1, 11)] == [(i, 0.0) for i in range(11) if i != q][:10]
    hits = 0
    for q in range(1000, 1600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({i for i, _ in got[q].values()} & set(np.lexsort((np.arange(1600), d))[:10].tolist()))
    assert hits >= 54


def test_ivfpq_goes_on_until_k_are_found(spark):
    """Lists of a few rows each: a query's own list holds fewer than k."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2)) * 3
    found = collections.Counter(r.query_id for r in ivfpq.nearest(vectors(spark, x), every=40, k=60, reach=0.0).collect())
    assert found == {q: 60 for q in range(0, 400, 40)}
    assert {r.query_id: 1 for r in ivfpq.nearest(vectors(spark, x[:2]), every=1).collect()} == {0: 1, 1: 1}


def test_ivfpq_visits_few_lists_where_there_is_structure():
    rng = np.random.default_rng(7)
    tight = np.vstack([rng.normal(c, 0.05, size=(100, 16)) for c in rng.normal(size=(40, 16))])
    loose = rng.normal(size=(4000, 64))
    read = {}
    for name, x in (("tight", tight), ("loose", loose)):
        index = ivfpq.train(x, 63)
        spill, probes = ivfpq.tune(index, x, 10, 0.98)
        read[name] = spill * probes / len(index.centres)
    assert read["tight"] < 0.2 < read["loose"]


def odd_vectors(kind):
    rng = np.random.default_rng(11)
    if kind == "tight":  # groups so narrow that codes tell their rows apart badly
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 32)) * 1e-3
    elif kind == "offset":
        x = rng.normal(size=(2000, 32)) * 1e-4 + 1e3
    elif kind == "outlier":
        x = np.vstack([rng.normal(size=(1199, 8)), np.full((1, 8), 1e300)])
    else:
        x = rng.normal(size=(1000, 8)) * 1e-200
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("kind", ["tight", "offset", "outlier", "tiny"])
def test_ivfpq_loses_no_neighbour_on_other_rows(spark, kind):
    x = odd_vectors(kind)
    got = collections.defaultdict(dict)
    for r in ivfpq.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r.query_id][r.rank] = r.vec_id
    scaled = x * 1e200 if kind == "tiny" else np.minimum(x, 1e100)
    for q in range(0, len(x), 100):
        d = ((scaled - scaled[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [got[q][k] for k in range(1, 11)] == np.lexsort((np.arange(len(x)), d))[:10].tolist()


def test_poisson_mixing(spark):
    texts = [(i, "word " * 10) for i in range(3000)]
    sources = {i: None if i < 10 else "hot" if i < 2000 else "cold" for i in range(3000)}
    df = frame(spark, texts, sources=sources)
    got = mixing.replicate(df, weights={"hot": 1, "cold": 1}).select("doc_id", "source", "copy_no", "shuffle_key", "score").collect()
    n = collections.Counter(r.source for r in got)
    assert None not in n and abs(n["hot"] - 1500) < 150 and abs(n["cold"] - 1500) < 150
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    again = mixing.replicate(df, weights={"hot": 1, "cold": 1}).select("doc_id", "copy_no").collect()
    assert {(r.doc_id, r.copy_no) for r in again} == {(r.doc_id, r.copy_no) for r in got}
    assert mixing.replicate(frame(spark, [])).count() == 0
    one = mixing.replicate(frame(spark, [(None, None), (1, "")]), budget=2000.0).groupBy("doc_id").count().collect()
    assert all(abs(r["count"] - 2000) < 400 for r in one)  # rates over MAX_RATE are drawn in parts


def poisson(u, rate):
    """The inverse of the distribution function, summed up term by term."""
    n, p = 0, float(np.exp(-rate))
    c = p
    while c <= u:
        n += 1
        p *= rate / n
        c += p
    return n


def test_mixing_against_single_draws(spark):
    """Every row's copies follow from its own draw; rows without an id draw by their text, and no name of a column is in the way."""
    rows = [(i if i % 7 else None, f"text {i} " * (1 + i % 5), "hot" if i % 3 else "cold") for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], "doc_id long, text string, source string, _n int, d string, _parts int, _cdf int, row int, copy_no int")
    got = mixing.replicate(df)
    assert got.columns == ["doc_id", "text", "source", "_n", "d", "_parts", "_cdf", "row", "copy_no", "shuffle_key"]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t)
    rate = {s: 0.5 * sum(size.values()) / n for s, n in size.items()}
    want = {}
    for i, t, s in rows:
        key = str(i) if i is not None else "text:" + hashlib.md5(t.encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{key}:1".encode()).hexdigest()[:13], 16) / 2**52
        want[i, t] = poisson(u, rate[s])
    counts = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert {k: n for k, n in want.items() if n} == dict(counts)
    nameless = [t for (i, t), n in want.items() if i is None]
    assert len({want[None, t] for t in nameless}) > 1


def direct_scores(docs, labels, steps=200, rate=0.1, decay=2e-4):
    """The model once more with a dense matrix and plain counts."""
    import zlib

    seen = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    truth = {}
    for i, _, y in labels:
        if seen(i) and y is not None:
            truth[i] = max(truth.get(i, 0), y)
    texts = dict(sorted(((i, t or "") for i, t in docs if seen(i)), reverse=True))
    prior = min(max(sum(truth.values()) / len(truth), 1e-4), 0.9)
    feats = {i: toxicity.features(t) for i, t in texts.items()}
    pos, unl = [i for i in sorted(texts) if truth.get(i) == 1], sorted(texts)
    count = lambda ids: collections.Counter(f for i in ids for f in feats[i])
    a, b = count(pos), count(unl)
    words = sorted(f for f, n in a.items() if n >= max(3, len(pos) // 200) and n >= 2.0 * len(pos) / len(unl) * b[f])
    row = lambda f: np.array([float(w in f) for w in words] + [1.0])
    p, u = (np.array([row(feats[i]) for i in ids]) for ids in (pos, unl))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(w):
        return prior * loss(p @ w).mean(), loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()

    w = np.zeros(len(words) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m = v = np.zeros_like(w)
    checked = 0
    for t in range(1, steps + 1):
        of_p = -prior * (sigmoid(-(p @ w)) @ p) / len(p)
        of_c = (sigmoid(u @ w) @ u) / len(u) - prior * (sigmoid(p @ w) @ p) / len(p)
        if t in (1, 50):  # both gradients against differences
            for j in (0, len(w) - 1):
                e = np.zeros_like(w)
                e[j] = 1e-5
                slope = [(x - y) / 2e-5 for x, y in zip(parts(w + e), parts(w - e), strict=True)]
                assert slope == pytest.approx([of_p[j], of_c[j]], abs=1e-6)
                checked += 1
        g = (of_p + of_c if parts(w)[1] >= 0 else -of_c) + np.append(np.full(len(words), decay), 0.0) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert checked == 4
    return lambda text: float(sigmoid(row(toxicity.features(text)) @ np.where(np.abs(w) > 1e-4, w, np.where(np.arange(len(w)) == len(w) - 1, w, 0.0))))


def test_toxicity_equals_direct_training(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 25) + (" zorgish vile" if bad else "") + (" zorging" if i % 3 == 0 and bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(500, "vile " * 200_000), (501, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    score = direct_scores(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, table)).collect()}
    assert got == pytest.approx({i: score(t) for i, t in rows}, abs=1e-6)


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(rng, 40).split() + (["zorgish", "zorging", "vile"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "x"), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (None, 1, 1), (3000, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = toxicity.score_documents(docs, toxicity.fit(docs, table)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    none = toxicity.score_documents(docs, toxicity.fit(docs, table.limit(0))).agg({"score": "max"}).head()[0]
    assert none < 1e-6
    assert toxicity.score_documents(frame(spark, []), toxicity.Model({}, 0.0)).count() == 0


def test_language_profiles(spark):
    rng = random.Random(0)
    make = {"xx": "ka ku ki kamu kira".split(), "yy": "lon ler lom zerl olz".split()}
    rows, langs = [], {}
    for i in range(200):
        langs[i] = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(rng.choice(make[langs[i]]) for _ in range(rng.randint(1, 50)))))
    langs[300] = "xx"
    docs = frame(spark, rows + [(300, None), (301, "12 !"), (302, ""), (None, "ka")], langs)
    got = langid.predict_documents(docs, langid.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == langs[i] and 0 <= by[i].score <= 1 for i in range(200))
    assert by[300].lang_pred == by[301].lang_pred == by[302].lang_pred == "und" and by[None].lang_pred == "xx"
    empty = langid.fit(frame(spark, []))
    assert {r.lang_pred for r in langid.predict_documents(docs, empty).collect()} == {"und"}


def direct_languages(rows, langs, length):
    """Profiles and distances by plain dictionaries."""
    import zlib

    def grams(text):
        found = collections.Counter()
        clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = re.sub(" +", " ", f" {clean} ")
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and (n < 3 or g[1] != " "):
                    found[g] += 1
        return found

    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], sum(ord(ch) << 21 * (len(x[0]) - 1 - k) for k, ch in enumerate(x[0]))))[:length]]
    learnt = collections.defaultdict(collections.Counter)
    for i, t in rows:
        if i is not None and langs.get(i) and t is not None and zlib.crc32(str(i).encode()) % 5 != 0:
            learnt[langs[i]].update(grams(t))
    profiles = {name: {g: r for r, g in enumerate(top(c))} for name, c in learnt.items()}

    def predict(text):
        own = top(grams(text))
        if not own:
            return "und", 0.0
        far = sorted((sum(abs(p[g] - r) if g in p else length for r, g in enumerate(own)), name) for name, p in profiles.items())
        return far[0][1], far[1][0] / (far[0][0] + far[1][0])

    return predict


def test_languages_equal_direct_distances(spark):
    rng = random.Random(2)
    make = {"xx": "ka ku ki kamu kira él".split(), "yy": "lon ler lom zerl olz él".split(), "zz": "mi ma mu kal lor".split()}
    langs = {i: rng.choice("xyz") * 2 for i in range(150)}
    rows = [(i, " ".join(rng.choice(make[rng.choice([langs[i], langs[i], "xx"])]) + rng.choice(["", ",", "9"]) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += [(200, "ka lon mi " * 50_000), (201, "é"), (202, "…"), (3, rows[3][1])]
    docs = frame(spark, rows, langs)
    got = langid.predict_documents(docs, langid.fit(docs, length=40)).collect()
    predict = direct_languages(rows, langs, 40)
    want = {i: predict(t) for i, t in rows}
    assert {r.doc_id: r.lang_pred for r in got} == {i: name for i, (name, _) in want.items()}
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: s for i, (_, s) in want.items()})


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}}}}
    calls = [(1, "c1", 1, "add", '{"a": 2}', ["c3"]), (1, "c2", 2, "add", '{"a": -1}', ["c9"]), (1, "c3", 3, "add", '{"b": 1}', []), (2, "x", 1, "add", "no", ["y"]), (2, "y", 2, "add", '{"a": true}', ["x"]), (2, "z", 3, "none", "{}", None), (None, "q", 1, "add", "{}", None), (3, "u", 1, "add", '{"a": 1}', []), (3, "u", 1, "add", '{"a": 1}', [])]
    results = [(1, "c1", 5, "é"), (1, "c1", 6, "later"), (3, "u", 2, None), (9, "lost", 1, "r")]
    got = toolcalls.link_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        schema,
    ).collect()
    rows = {(r.conv_id, r.call_id): r for r in got}
    assert len(got) == 7
    assert [rows[1, c].position for c in ("c2", "c3", "c1")] == [1, 2, 3]
    assert [rows[k].status for k in ((1, "c1"), (1, "c2"), (1, "c3"), (2, "x"), (2, "y"), (2, "z"), (3, "u"))] == ["linked", "unknown_dependency", "no_result", "cycle", "cycle", "no_result", "linked"]
    assert rows[1, "c1"].json == '{"arguments":{"a":2},"name":"add","result":"é"}' and rows[1, "c1"].valid
    assert not rows[1, "c2"].valid and not rows[1, "c3"].valid and not rows[2, "x"].valid and not rows[2, "y"].valid
    assert json.loads(rows[2, "x"].json)["arguments"] == "no"


def test_arguments_of_any_kind(spark):
    schema = {"f": {"type": "object", "properties": {"n": {"type": "integer"}, "e": {"enum": [1, "a", [True]]}}}}
    texts = ['{"n": 1.0}', '{"n": 1.5}', '{"n": NaN}', '{"n": 1e999}', '{"e": true}', '{"e": 1}', '{"e": [true]}', '{"e": [1]}', "[" * 200_000, '{"a": ' * 100_000 + "1" + "}" * 100_000, '{"k\\ud800": "\\udfff x"}', '{"n": ' + "9" * 5_000 + "}", None, "", "nul", '{"b": 1, "a": "é"}']
    assert [toolcalls.format_call("f", t, None, schema)[0] for t in texts] == [True, False, False, False, False, True, True, False, False, False, True, False, False, False, False, True]
    calls = spark.createDataFrame([(1, f"c{i:02d}", i, "f", t, None) for i, t in enumerate(texts)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    rows = sorted(toolcalls.link_calls(calls, results, schema).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(texts) + 1))
    assert rows[8].errors in ("$: nested too deeply", "$: not JSON") and json.loads(rows[8].json)["arguments"] == texts[8]
    assert rows[10].json == '{"arguments":{"k\\ud800":"\\udfff x"},"name":"f","result":null}'
    assert rows[15].json == '{"arguments":{"a":"é","b":1},"name":"f","result":null}'
    assert toolcalls.link_calls(calls.limit(0), results, schema).count() == 0


def direct_order(calls, results):
    """Kahn's algorithm, a level at a time, and the states, of one table of unique calls."""
    out = {}
    for conv in {c[0] for c in calls}:
        mine = {c[1]: c for c in calls if c[0] == conv}
        needs = {k: {d for d in c[5] or () if d in mine} for k, c in mine.items()}
        ahead = any((mine[d][2], d) >= (c[2], k) for k, c in mine.items() for d in needs[k])
        level, left, n = {}, set(mine), 0
        while ahead and (free := {k for k in left if not needs[k] & left}):
            level |= dict.fromkeys(free, n)
            left -= free
            n += 1
        order = sorted(mine, key=lambda k: (level.get(k, 10**9) if ahead else 0, mine[k][2], k))
        for place, k in enumerate(order, 1):
            state = "cycle" if ahead and k in left else "unknown_dependency" if set(mine[k][5] or ()) - mine.keys() else "linked" if (conv, k) in results else "no_result"
            out[conv, k] = (place, state)
    return out


def test_tool_call_query_against_direct_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hot = table.selectExpr("conv_id % 3 AS conv_id", "turn + 100 * conv_id AS turn", "role", "text")  # a few long conversations
    calls, results = toolcalls.dialogue_calls(hot)
    given = [tuple(r) for r in calls.collect()]
    turns = [tuple(r) for r in hot.select("conv_id", "turn", "role", "text").collect()]
    users = sorted({(c, t) for c, t, role, _ in turns if role == "user"})
    told = {}
    for c, t, role, text in turns:
        asked = [u for cc, u in users if cc == c and u < t]
        if role == "assistant" and asked:
            key = (c, f"t{max(asked):012d}")
            told[key] = min(told.get(key, (t, text)), (t, text))
    rows = toolcalls.link_calls(calls, results, {"reply": toolcalls.REPLY}).collect()
    assert len(given) == len(users) and {(r.conv_id, r.call_id): (r.position, r.status) for r in rows} == direct_order(given, told)
    assert all(json.loads(r.json)["result"] == (told[r.conv_id, r.call_id][1] if (r.conv_id, r.call_id) in told else None) for r in rows)
    assert {r.status for r in rows} == {"linked", "no_result", "unknown_dependency", "cycle"} and {r.valid for r in rows} == {True, False}


def test_long_chains_are_no_cycles(spark):
    calls = spark.createDataFrame([(1, f"c{i}") for i in range(8)] + [(1, "x"), (1, "y")], "conv_id long, call_id string")
    needs = spark.createDataFrame([(1, f"c{i}", f"c{i + 1}") for i in range(7)] + [(1, "x", "y"), (1, "y", "x")], "conv_id long, call_id string, needed string")
    got = {r.call_id: r.level for r in toolcalls._levels(calls, needs, 3).collect()}
    assert got == {**{f"c{i}": 7 - i for i in range(8)}, "x": None, "y": None}


def test_replies_across_gaps_and_other_roles(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "tool", "t"), (1, 4, "assistant", "A"), (1, 5, "assistant", "more"), (1, 8, "user", "b"), (1, 9, "user", "c"), (1, 12, "assistant", "C")]
    turns += [(2, 0, "assistant", "hello"), (2, 3, "user", "d"), (2, 3, "assistant", "same turn"), (2, 7, "tool", "t"), (None, 1, "user", "e"), (None, 2, "assistant", "E"), (2, None, "assistant", "F")]
    calls, results = toolcalls.dialogue_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = toolcalls.link_calls(calls, results, {"reply": toolcalls.REPLY}).collect()
    got = {(r.conv_id, json.loads(r.json)["arguments"]["prompt"]): (r.position, r.status, json.loads(r.json)["result"]) for r in rows}
    assert got == {(1, "a"): (1, "linked", "A"), (1, "b"): (2, "no_result", None), (1, "c"): (3, "linked", "C"), (2, "d"): (1, "no_result", None)}


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline as pipeline
    from quillfold.llm.common import table

    docs = table(spark, sf_dir, "documents")
    clean = pipeline.drop_toxic(spark, docs, sf_dir).persist()
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    single = pipeline.drop_near_duplicates(spark, clean, sf_dir).persist()
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in single.collect()} == set(brute_components(brute_sets(texts)).values())
    cut = pipeline.drop_repeats(spark, single, sf_dir).persist()
    want = brute_repeats([(r.doc_id, r.text) for r in single.collect()])
    rows = cut.collect()
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows)
    assert all(abs(len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1])) <= 4 * want[r.doc_id][2] for r in rows)
    mixed = pipeline.mix_sources(spark, cut, sf_dir).persist()
    assert mixed.columns == docs.columns
    assert pipeline.encode(spark, mixed, sf_dir).count() == mixed.count()


def test_pipeline_filters_judge_rows_not_ids(spark, sf_dir, monkeypatch):
    import corpus_pipeline as pipeline
    from quillfold.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    predicted = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad, good = (next(i for i, p in predicted.items() if p == x) for x in (1, 0))
    rows = [(bad, texts[bad]), (bad, texts[good]), (good, texts[good]), (good, texts[bad]), (None, texts[bad]), (None, texts[good])]
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    kept = pipeline.drop_toxic(spark, frame(spark, rows), sf_dir)
    assert kept.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(bad, texts[good]), (good, texts[good]), (None, texts[good])], key=str)

    rng = random.Random(5)
    a, b, c, d = ([f"{x}{rng.random()}" for _ in range(60)] for x in "abcd")
    near = lambda words: " ".join(words[2:])
    a, near_a, b, near_b, c, d = " ".join(a), near(a), " ".join(b), near(b), " ".join(c), " ".join(d)
    rows = [(2, near_a), (1, a), (1, a), (None, a), (None, near_a), (None, b), (None, b), (None, near_b), (3, c), (3, d), (None, c), (4, None), (None, "")]
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, frame(spark, rows), sf_dir).collect()]
    assert sorted((x for x in kept if x[1] not in (b, near_b)), key=str) == sorted([(1, a), (3, c), (3, d), (4, None), (None, "")], key=str)
    assert [i for i, t in kept if t in (b, near_b)] == [None]
