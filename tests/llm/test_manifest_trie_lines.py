"""Manifest, prefix trie and line dedup against direct versions: nulls, ties, repeats, empty tables, hot keys, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillfold.llm import lines, merkle, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at int, h long, n_lines string, gone int"
SPACE = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars), and columns with the names of helpers."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DOCS)


# ---- Merkle manifest


def runs(nodes):
    return [nodes[k : k + 2] for k in range(0, len(nodes), 2)]


def direct_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(r)) for r in runs(levels[-1])])
    return levels


def direct_path(levels, p):
    """Siblings and the own slot in the run, level by level."""
    out = []
    for level in levels[:-1]:
        run = runs(level)[p // 2]
        out.append((run[: p % 2] + run[p % 2 + 1 :], p % 2))
        p //= 2
    return out


def direct_manifest(rows):
    item = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g, s, n: sha("".join(map(item, (d, s, g, n, t))))
    by = collections.defaultdict(list)
    for d, t, g, s, n in rows:
        touched = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by[g].append((d is not None, d or 0, leaf(d, t, g, s, n), leaf(d, t, g, s, n + touched) if touched else None, d))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        by[g].sort(key=lambda r: r[:3])
    trees = {g: direct_tree([r[2] for r in by[g]]) for g in langs}
    top = direct_tree([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, g in enumerate(langs):
        for p, (_, _, own, other, d) in enumerate(by[g]):
            path = direct_path(trees[g], p) + direct_path(top, k)
            now = other or own
            for rest, slot in path:
                now = sha("".join(rest[:slot] + [now] + rest[slot:]))
            out.append((d, own, trees[g][-1][0], top[-1][0], sha("".join(x for rest, _ in path for x in rest)), now, now == top[-1][0]))
    return out


def many_rows(n, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "é", "", None, "x" * 300]), rng.choice(["en"] * 6 + ["de", "é", "", None, "-"]), rng.choice(["s", None]), rng.choice([None, 1, 9, 99])) for i in range(n)]


@pytest.mark.parametrize("rows", [many_rows(1), many_rows(2), many_rows(700), [(i, "t", "en", "s", 9) for i in range(65)], [(i, "t", f"l{i}", "s", 9) for i in range(70)]], ids=["one", "two", "many", "over a block", "many languages"])
def test_manifest(spark, rows):
    got = merkle.audit(documents(spark, rows))
    want = direct_manifest(rows)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == collections.Counter(want)
    assert all(r[-1] == (r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 0 or rows[r[0]][4] is None) for r in want)


def test_manifest_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "en", "s", 2)] * 5 + [(1, "b", "en", "s", 2), (None, "b", "en", "s", 2), (None, "b", "en", None, None), (None, None, None, None, None), (-7, "n", "en", "s", 0)]
    got = merkle.audit(documents(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(direct_manifest(rows))
    assert merkle.audit(documents(spark, [])).count() == 0


def test_small_blocks_and_stored_preimages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    rows = many_rows(150)
    assert collections.Counter(map(tuple, merkle.audit(documents(spark, rows)).collect())) == collections.Counter(direct_manifest(rows))
    manifest = merkle.build(documents(spark, rows))
    stored = manifest.parents().collect()
    trees = {}
    for r in manifest.leaves.collect():
        trees.setdefault(r.tree, []).append((r["at"], r.leaf))
    count = 0
    for tree, leaves in trees.items():
        levels = direct_tree([h for _, h in sorted(leaves)])
        for k, level in enumerate(levels[:-1]):
            mine = {r.parent: r for r in stored if r.tree == tree and 2 * r["round"] + r.level == k}
            assert {p: r.preimage for p, r in mine.items()} == {p: "".join(run) for p, run in enumerate(runs(level))}
            assert all(sha(r.preimage) == r.digest == levels[k + 1][p] for p, r in mine.items())
            count += len(mine)
    assert count == len(stored)


def test_a_replaced_leaf_of_ones_own(spark):
    """Any second leaf can be folded; a wrong one is found, the right one is not."""
    rows = [(i, "t", "en", "s", 9) for i in range(10)]
    got = merkle.audit(documents(spark, rows), F.when(F.col("doc_id") == 3, F.sha2(F.lit("other"), 256)).when(F.col("doc_id") == 4, merkle.leaf_hash()))
    assert {r.doc_id for r in got.collect() if not r.verified} == {3}


# ---- conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string, node long, depth int, key string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], TURNS)


def direct_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    below = {}
    for k in sorted(members, key=len, reverse=True):
        own_saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below[k] = (1 if k not in kids else sum(below[x][0] for x in kids[k]), own_saved + sum(below[x][1] for x in kids.get(k, ())))
    ends = lambda k: sha(",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k)))))
    return [(min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(kids.get(k, ())), *below[k], ends(k)) for k, v in members.items()]


ORDER = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def talk(seed=5):
    """Shared openings, copies, turnless conversations after the exchange, null turns, ties, repeats, a long one, negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in range(-12, 120):
        if c % 10 == 0 and c > 40:
            continue  # some bases are missing
        n = rng.choice([1, 2, 3, 6, 12])
        rows += [(c, t, "user" if t % 2 == 0 else rng.choice(["assistant", None]), rng.choice(["hi", "é", "", None, "long " * 50])) for t in range(n)]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(4)]
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, None, "assistant", "z"), (300, 1, "user", "q"), (300, 1, "user", "q"), (300, 1, None, None), (None, 1, "user", "none")]
    return rows + [(301, t, "user", f"turn {t % 3}") for t in range(400)]


def test_trie(spark):
    rows = talk()
    got = prefix_trie.prefix_nodes(conversations(spark, rows)).select(*ORDER).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(direct_trie(rows), key=lambda r: r[:2])


def test_trie_splits_colliding_fingerprints(spark):
    """Fingerprints of a handful of values: nearly all groups collide, and the result stays."""
    rows = [r for r in talk(7) if r[0] is None or r[0] < 60 or r[0] == 300]
    got = prefix_trie.prefix_nodes(conversations(spark, rows), primes=(3, 2)).select(*ORDER).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(direct_trie(rows), key=lambda r: r[:2])


def test_trie_of_hot_conversations(spark, monkeypatch):
    """One conversation with most rows over many ranges, one group of copies in several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(1, t, "user", str(t % 2)) for t in range(3000)] + [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = prefix_trie.prefix_nodes(conversations(spark, rows)).select(*ORDER).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(direct_trie(rows), key=lambda r: r[:2])


def test_empty_trie(spark):
    assert prefix_trie.prefix_nodes(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_nodes(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    one = prefix_trie.prefix_nodes(conversations(spark, [(7, None, None, None)])).select(*ORDER).collect()
    assert sorted(map(tuple, one), key=lambda r: r[1]) == sorted(direct_trie([(7, None, None, None)]), key=lambda r: r[1])


def test_powers():
    import numpy as np

    e = np.array([0, 1, 2, 63, 10**12])
    for base, p in zip(prefix_trie.BASES, prefix_trie.PRIMES, strict=True):
        assert prefix_trie.powers(base, e, p).tolist() == [pow(base, int(x), p) for x in e]


# ---- line dedup


def direct_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    holders = collections.defaultdict(set)
    low = -(10**18)  # a null id is smaller than all others
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if d is None else d)
    out = []
    for d, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out.append((d, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return out


def line_rows(seed=2):
    rng = random.Random(seed)
    common = [f"Common line number {k} with enough CHARACTERS in it, ÀÉ" for k in range(6)] + ["é" * 39, "É" * 40, "short line"]
    rows = []
    for i in range(120):
        own = [f"line {i} {rng.random()} of its own, long enough to be counted at all"]
        some = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(c) + rng.choice(["", "\r", " \f"]) for c in rng.choices(common, k=rng.randint(0, 6))]
        text = own + some + [""] * rng.randint(0, 2)
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(common)), (5, "\n".join(common)), (None, "\n".join(common)), (None, common[0])]
    return rows + [(203, "\n".join(common))] * 3 + [(204, "\n".join(common * 300)), (205, "x\n" * 5000 + common[1])]


def test_lines(spark):
    rows = line_rows()
    got = lines.drop_common_lines(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(direct_lines(rows))
    assert sum(r.n_dropped for r in got) > 500


def test_lines_of_a_hot_line_and_of_none(spark):
    hot = "a very frequent line that stands in every one of these documents"
    rows = [(i, f"{hot}\nown {i}\n{hot}") for i in range(3000)]
    got = lines.drop_common_lines(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    assert {r.doc_id: r.kept_text for r in got} == {i: f"own {i}" for i in range(2999)} | {2999: rows[-1][1]}
    few = [(i, f"{hot}\n{i}") for i in range(4)] + [(3, hot)]
    assert [r.n_dropped for r in lines.drop_common_lines(documents(spark, [(i, t, "en", "s", 1) for i, t in few])).collect()] == [0] * 5
    assert lines.drop_common_lines(documents(spark, [])).count() == 0


def test_registered_queries_match_their_contracts(spark, sf_dir):
    import duckdb

    from quillfold.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name in ("op11_merkle_manifest", "op12_prefix_trie", "op13_line_dedup"):
        got, want = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
        assert sorted(got.columns) == sorted(c[0] for c in want.description)
        assert sorted(map(tuple, got.select(*[c[0] for c in want.description]).collect()), key=str) == sorted(want.fetchall(), key=str)
