"""Merkle dataset manifest: every row a leaf, a tree for each language, and a tree of their roots.

What is stored of a parent is its preimage: the concatenated hashes of its children (64 hex characters each), of which its own
hash is the SHA-256. Parents lie in blocks: a block covers 2**BLOCK_BITS consecutive nodes of a tree and holds, for each of its
levels, the preimages of its parents one after the other, so that a tree of n leaves takes log(n) / BLOCK_BITS
rounds and a leaf meets its ancestors in one join. A leaf joins the preimages of its ancestors, cuts its own slot out of each
(what stays are its siblings: the proof), and splices its own or a replaced hash back in to fold up to the root.

Places in a language are counted by ranges of its rows, so that one language may hold any share of all rows; a group
is never larger than a block. Leaves are hashed where they lie, and only hashes are shuffled.

Defined results: a null id or language comes first; rows of one id go by their leaf; equal rows are leaves of their own with
the same leaf; a null n_chars and a null id are never tampered with; a single row is leaf, subroot and root, and its proof is the hash of
nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import crc32_mod, materialise, with_places

#: A block covers this power of two of consecutive nodes.
BLOCK_BITS = 6
#: Trees up to which their sizes are broadcast.
BROADCAST_TREES = 100_000
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _item(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**replaced: Column) -> Column:
    """SHA-256 of a row's fields, each with its length; some may be replaced."""
    return F.sha2(F.concat(*[_item(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


@dataclass
class Manifest:
    """leaves (doc_id, tree, at, leaf, other); by rounds, the blocks of the languages' trees and of the tree of their roots.

    A block: tree, block (its place), n (nodes of the tree in this round), pre (preimages, a string for each level), h.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    root_rounds: list[DataFrame]

    def parents(self) -> DataFrame:
        """tree, round, level, parent (its place in the level), preimage, digest: each parent of the languages' trees."""
        found = None
        for k, blocks in enumerate(self.rounds):
            levels = blocks.select("tree", "block", F.posexplode("pre").alias("level", "s"))
            cut = levels.select("tree", "block", "level", F.posexplode(_pieces(F.col("s"))).alias("i", "preimage"))
            first = F.col("block") * F.call_function("shiftright", F.lit(1 << BLOCK_BITS), F.col("level") + 1)
            rows = cut.select("tree", F.lit(k).alias("round"), "level", (first + F.col("i")).alias("parent"), "preimage", F.sha2("preimage", 256).alias("digest"))
            found = rows if found is None else found.unionByName(rows)
        return found


def _pieces(level: Column) -> Column:
    """The preimages of a level's parents: two hashes each, the last one perhaps one."""
    last = F.ceil(F.length(level) / (2 * DIGEST)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)))


def _levels(hashes: Column, n_levels: Column) -> Column:
    """The level's hashes, and above it n_levels more, each joined to one string."""
    up = lambda level: F.array_join(F.transform(_pieces(level), lambda p: F.sha2(p, 256)), "")
    first = F.array(hashes)
    return F.when(n_levels == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), n_levels), first, lambda a, _: F.concat(a, F.array(up(F.element_at(a, -1))))))


def _blocks(nodes: DataFrame) -> DataFrame:
    """The blocks of nodes (tree, at, n, h). A tree of several blocks goes on, so each takes all its levels; a last one ends at its top."""
    children = F.sort_array(F.collect_list(F.struct("at", "h")))
    grouped = nodes.groupBy("tree", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.first("n").alias("n"), children.alias("c"))
    joined = grouped.select("tree", "block", "n", F.array_join(F.transform("c", lambda x: x["h"]), "").alias("s"))
    n_levels = F.when(F.col("n") > (1 << BLOCK_BITS), F.lit(BLOCK_BITS)).otherwise(F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    levels = joined.select("tree", "block", "n", _levels(F.col("s"), n_levels).alias("l"))
    return levels.select("tree", "block", "n", F.slice("l", F.lit(1), F.size("l") - 1).alias("pre"), F.element_at("l", -1).alias("h"))


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Blocks round by round, until each tree has one."""
    rounds = []
    while True:
        blocks = materialise(_blocks(nodes))
        rounds.append(blocks)
        open_ = blocks.where(F.col("n") > (1 << BLOCK_BITS))
        if open_.isEmpty():
            return rounds
        nodes = open_.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / (1 << BLOCK_BITS)).alias("n"), "h")


def _tops(rounds: list[DataFrame]) -> DataFrame:
    found = None
    for blocks in rounds:
        top = blocks.where(F.col("n") <= (1 << BLOCK_BITS)).select("tree", "h")
        found = top if found is None else found.unionByName(top)
    return found


def build(docs: DataFrame, other: Column | None = None) -> Manifest:
    """The manifest of docs; `other` is a second leaf of a row (null: none) that goes along for folding."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null first, then bytewise
    rows = materialise(docs.select("doc_id", tree.alias("tree"), leaf_hash().alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other")))
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes)
    placed = with_places(rows, "tree", "at", F.col("doc_id").asc_nulls_first(), F.col("leaf"), kind="long")
    leaves = materialise(placed.withColumn("at", F.col("at") - 1))
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_TREES else sizes
    rounds = _grow(leaves.join(side, "tree").select("tree", "at", "n", F.col("leaf").alias("h")))
    subroots = materialise(with_places(_tops(rounds).withColumn("all", F.lit("")), "all", "at", F.col("tree"), kind="long").withColumn("at", F.col("at") - 1))
    n = subroots.count()
    return Manifest(leaves, rounds, subroots, _grow(subroots.select(F.col("all").alias("tree"), "at", F.lit(n).cast("long").alias("n"), "h")) if n else [])


def _cut_out(pre: Column, slot: Column) -> Column:
    """For each level of a block: the ancestor's preimage without the own slot, and where that is."""

    def one(level: Column, j: Column) -> Column:
        preimage = F.substring(level, F.call_function("shiftright", slot, j + 1) * (2 * DIGEST) + 1, F.lit(2 * DIGEST))
        own = F.call_function("shiftright", slot, j).bitwiseAND(F.lit(1)) * DIGEST
        return F.struct(F.concat(F.substring(preimage, F.lit(1), own), F.substring(preimage, own + DIGEST + 1, F.lit(DIGEST))).alias("rest"), own.alias("own"))

    return F.transform(pre, one)


def _slot(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _with_up(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the first round with `up`: the path from their hash to the root. tops: tree and the path above its top."""
    above = None
    for blocks in reversed(rounds):
        now = blocks.where(F.col("n") <= (1 << BLOCK_BITS)).join(tops, "tree").select("tree", "block", "pre", "up")
        if above is not None:
            higher = above.select("tree", F.col("block").alias("_block"), F.col("pre").alias("_pre"), F.col("up").alias("_up"))
            open_ = blocks.where(F.col("n") > (1 << BLOCK_BITS)).withColumn("_block", F.shiftright("block", BLOCK_BITS)).join(higher, ["tree", "_block"])
            now = now.unionByName(open_.select("tree", "block", "pre", F.concat(_cut_out(F.col("_pre"), _slot(F.col("block"))), "_up").alias("up")))
        above = now
    return above


def paths(manifest: Manifest) -> DataFrame:
    """leaves with subroot, root and path: for each ancestor up to the root, `rest` (its preimage without the own slot) and `own` (the slot's place)."""
    none = F.array().cast("array<struct<rest:string,own:int>>")
    if not manifest.root_rounds:
        return manifest.leaves.withColumns({"subroot": F.lit(""), "root": F.lit(""), "path": none})
    spark = manifest.leaves.sparkSession
    top = _with_up(manifest.root_rounds, spark.range(1).select(F.lit("").alias("tree"), none.alias("up"))).select("block", "pre", "up")
    root = _tops(manifest.root_rounds).select(F.col("tree").alias("all"), F.col("h").alias("root"))  # one row
    roots = manifest.subroots.withColumn("block", F.shiftright("at", BLOCK_BITS)).join(top, "block").join(F.broadcast(root), "all")
    trees = materialise(roots.select("tree", F.concat(_cut_out(F.col("pre"), _slot(F.col("at"))), "up").alias("up"), F.col("h").alias("subroot"), "root"))
    side = F.broadcast(trees) if trees.count() <= BROADCAST_TREES else trees
    blocks = materialise(_with_up(manifest.rounds, side.select("tree", "up")).join(side.select("tree", "subroot", "root"), "tree"))
    joined = manifest.leaves.withColumn("block", F.shiftright("at", BLOCK_BITS)).join(blocks, ["tree", "block"])
    return joined.select("doc_id", "tree", "at", "leaf", "other", "subroot", "root", F.concat(_cut_out(F.col("pre"), _slot(F.col("at"))), "up").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives: spliced into its slot of each ancestor's preimage, level by level."""
    spliced = lambda h, x: F.concat(F.substring(x["rest"], F.lit(1), x["own"]), h, F.substring(x["rest"], x["own"] + 1, F.lit(DIGEST)))
    return F.aggregate(path, leaf, lambda h, x: F.sha2(spliced(h, x), 256))


def proof(path: Column) -> Column:
    """All siblings, from the leaf up to the root."""
    return F.array_join(F.transform(path, lambda x: x["rest"]), "")


def tampered_leaf(every: int = 7) -> Column:
    """The leaf with n_chars one higher where `every` divides the id's crc32; null elsewhere."""
    changed = (crc32_mod(F.col("doc_id"), every) == 0) & F.col("n_chars").isNotNull()
    return F.when(changed, leaf_hash(n_chars=F.col("n_chars") + 1))


def audit(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of `other` where that is not null) and verified, for each row of docs."""
    found = paths(build(docs, tampered_leaf() if other is None else other))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in SQL, bit by bit."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _item_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_item_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


_UP = """SELECT a.l + 1 AS l, a.g, a.p // 2 AS p, sha256(a.h || coalesce(b.h, '')) AS h FROM {t} a LEFT JOIN {t} b ON a.g IS NOT DISTINCT FROM b.g AND b.p = a.p + 1
  WHERE a.p % 2 = 0 AND EXISTS (SELECT 1 FROM {t} o WHERE o.g IS NOT DISTINCT FROM a.g AND o.p > 0)"""

ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang AS g, {_leaf_sql()} AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql()} END AS other FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM rows
), t AS (SELECT 0 AS l, g, p, leaf AS h FROM leaves UNION ALL {_UP.format(t="t")}
), subs AS (
  SELECT g, l AS top, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM t a WHERE p = 0 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.g IS NOT DISTINCT FROM a.g AND b.l > a.l)
), u AS (SELECT 0 AS l, 0 AS g, p, h FROM subs UNION ALL {_UP.format(t="u")}
), tree AS (
  SELECT 0 AS kind, l, g, p, h FROM t UNION ALL SELECT 1, l, NULL, p, h FROM u
), walk AS (
  SELECT 0 AS kind, 0 AS l, g, p, doc_id, leaf, other AS now, '' AS proof, row_number() OVER () AS id FROM leaves
  UNION ALL
  SELECT CASE WHEN w.kind = 0 AND w.l = s.top THEN 1 ELSE w.kind END, CASE WHEN w.kind = 0 AND w.l = s.top THEN 0 ELSE w.l + 1 END, w.g, CASE WHEN w.kind = 0 AND w.l = s.top THEN s.p ELSE w.p // 2 END, w.doc_id, w.leaf,
    CASE WHEN w.kind = 0 AND w.l = s.top THEN w.now WHEN w.p % 2 = 0 THEN sha256(w.now || coalesce(x.h, '')) ELSE sha256(x.h || w.now) END, CASE WHEN w.kind = 0 AND w.l = s.top THEN w.proof ELSE w.proof || coalesce(x.h, '') END, w.id
  FROM walk w JOIN subs s ON s.g IS NOT DISTINCT FROM w.g LEFT JOIN tree x ON x.kind = w.kind AND x.l = w.l AND (w.kind = 1 OR x.g IS NOT DISTINCT FROM w.g) AND x.p = xor(w.p, 1)
  WHERE w.kind = 0 OR w.l < (SELECT max(l) FROM u)
), done AS (SELECT * FROM walk WHERE kind = 1 AND l = (SELECT max(l) FROM u))
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.h AS verified
FROM done JOIN subs s ON s.g IS NOT DISTINCT FROM done.g CROSS JOIN (SELECT h FROM u WHERE l = (SELECT max(l) FROM u)) r
"""
