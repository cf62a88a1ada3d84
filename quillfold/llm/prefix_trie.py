"""Conversation prefix trie: which openings conversations share, and what encoding each of them once would save.

A conversation's prefixes get polynomial rolling fingerprints, one for each depth, from a numpy scan of sums modulo two
primes. Scans go by ranges of (conversation, depth) and carry on what earlier ranges gave, so a conversation may hold any share of all rows.
Prefixes of equal depth and fingerprint are a candidate group; its representative is the smallest conversation. Each
member is verified against it: the last turn must be the same (by SHA-256 of role and text), and so must the group of the prefix
without it; where all groups pass, equality holds turn by turn down to the root. Groups that do not pass are split by
what differs, and so are the groups below them, until all pass.

Rollup to the parents: the smallest member of a node is the smallest one of all nodes below it on its own path. So each
conversation sums what it represents from its end upwards, and every node adds up its members' sums: one scan and one
aggregation, whatever the depth; a round for each level would need as many jobs as the longest conversation has turns.

Defined results: a null role or text is empty; turns of one conversation and number go by role, then text; repeated rows are
turns of their own; rows without a conv_id take no part; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillfold.llm.common import carried, crc32_mod, discard, materialise
from quillfold.llm.merkle import crc32_sql

PRIMES = (2_147_483_647, 2_147_483_629)
#: Numbers under both primes, one for each.
BASES = (1_103_515_245, 1_664_525_013)
#: Ids in one piece of a digest's input.
PIECE_IDS = 1024
#: Own turns replaced by a conversation's base are this many at most, less one.
HEADS = 9


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime under 2**31."""
    out, square, rest = np.ones(len(exponents), dtype=np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * square % np.uint64(prime), out)
        square = square * square % np.uint64(prime)
        rest = rest >> np.uint64(1)
    return out


def _segment_sums(terms: np.ndarray, first: np.ndarray, carry: int) -> np.ndarray:
    """Running sums that start again where `first` is true; what comes before the first start goes on from carry."""
    sums = np.cumsum(terms)
    before = np.concatenate((np.zeros(1, dtype=np.int64), sums))[np.flatnonzero(first)]
    start = np.cumsum(first)
    offset = np.concatenate((np.array([-carry], dtype=np.int64), before))
    return sums - offset[start]


def prefix_sums(rows: DataFrame, order: list[Column], terms: Callable[[pa.RecordBatch], dict[str, np.ndarray]], moduli: dict[str, int | None]) -> DataFrame:
    """rows with, for each name of moduli, the sum of its terms over the rows of the conv_id so far (`name`) and the own term (`name_own`).

    Sums are longs, or modulo what moduli names (then terms are under it). Rows are dealt by ranges of conv_id and order.
    """
    schema = StructType(rows.schema.fields.copy())
    for name in moduli:
        schema = schema.add(name, LongType()).add(f"{name}_own", LongType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(moduli, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(batch.schema.get_field_index("conv_id")).to_numpy(zero_copy_only=False)
            first = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            columns = batch.columns
            for name, own in terms(batch).items():
                own = own.astype(np.int64)
                sums = _segment_sums(own, first, carry[name])  # a batch has under 2**31 rows and terms under 2**31 where a modulus is given
                if moduli[name]:
                    sums %= moduli[name]
                carry[name] = int(sums[-1])
                columns += [pa.array(sums), pa.array(own)]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    scanned = materialise(dealt.mapInArrow(scan, schema).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    earlier = carried(scanned, "conv_id", *[(name, F.max_by(name, "_at"), F.sum) for name in moduli])
    names = list(moduli)
    # One conversation at most goes on in each range.
    going_on = F.broadcast(earlier.where(F.col(f"_{names[0]}").isNotNull()))
    joined = scanned.join(going_on, (F.col("conv_id") == F.col("_group")) & (F.col("_range") == F.col("_in")), "left")
    whole = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in names}
    return joined.select(*rows.columns, *[(whole[n] % m if m else whole[n]).alias(n) for n, m in moduli.items()], *[f"{n}_own" for n in names])


def _ones(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {"place": np.ones(batch.num_rows, dtype=np.int64)}


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text) and n_bytes (of the text), for each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(role, F.lit("\0"), text).alias("said"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("opening", F.left("said", F.lit(100)))  # deals a turn's repeats, without long texts among the ranges' bounds
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "opening").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "said")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    hashed = materialise(dealt.select("conv_id", F.monotonically_increasing_id().alias("seq"), digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    placed = prefix_sums(hashed, [F.col("seq")], _ones, {"place": None})
    return materialise(placed.select("conv_id", "place", "digest", "n_bytes"))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, n_bytes, last: each conversation's root (depth 0), and its turns after the exchange of openings."""
    own = materialise(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    head = crc32_mod(F.col("conv_id"), HEADS)
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sides = own.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(base, "base", "left")
    taken = F.least(F.col("head"), F.coalesce("base_n", F.lit(0)))
    sides = materialise(sides.select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size")))
    first = turns.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base").join(sides.where("taken > 0"), "base").where("place <= head")
    rest = turns.join(sides, "conv_id").where("place > head")
    row = lambda df, depth: df.select("conv_id", depth.cast("long").alias("depth"), "digest", "n_bytes", (depth == F.col("size")).alias("last"))
    root = sides.select("conv_id", F.lit(0).alias("place"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("n_bytes"), "size")
    return row(root, F.col("place")).unionByName(row(first, F.col("place"))).unionByName(row(rest, F.col("taken") + F.col("place") - F.col("head")))


def _fingerprint_terms(primes: tuple[int, int]) -> Callable[[pa.RecordBatch], dict[str, np.ndarray]]:
    def terms(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        digests = batch.column(batch.schema.get_field_index("digest")).to_pylist()
        heads = np.frombuffer(b"".join(d[:8] if d else bytes(8) for d in digests), dtype=np.uint32).reshape(-1, 2).astype(np.uint64)
        depth = batch.column(batch.schema.get_field_index("depth")).to_numpy(zero_copy_only=False)
        there = (depth > 0).astype(np.uint64)
        return {f"s{k}": heads[:, k] % np.uint64(p) * powers(BASES[k], depth, p) % np.uint64(p) * there for k, p in enumerate(primes)}

    return terms


def fingerprints(rebuilt: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """rebuilt with key, the fingerprint of the prefix, and up, that of the prefix without its last turn."""
    sums = prefix_sums(rebuilt, [F.col("depth")], _fingerprint_terms(primes), {f"s{k}": p for k, p in enumerate(primes)})
    both = lambda s: F.shiftleft(s[0], 31).bitwiseOR(s[1])
    now, before = [F.col("s0"), F.col("s1")], [F.pmod(F.col(f"s{k}") - F.col(f"s{k}_own"), F.lit(p)) for k, p in enumerate(primes)]
    return sums.select(*rebuilt.columns, both(now).alias("key"), both(before).alias("up"))


def verified_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, depth, node, n_bytes, last, n_convs, childless) and groups (depth, key, rep, n_convs, childless) of equal prefixes."""
    salt = 0
    while True:
        groups = materialise(rows.groupBy("depth", "key").agg(F.min(F.struct("conv_id", "up", "digest", "n_bytes")).alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.bool_and("last").alias("childless")))
        same = (F.col("up") == F.col("rep.up")) & (F.col("digest") == F.col("rep.digest"))
        members = materialise(rows.join(groups, ["depth", "key"]).select("conv_id", "depth", F.col("rep.conv_id").alias("node"), "n_bytes", "last", "n_convs", "childless", "key", same.alias("same")))
        wrong = members.where(~F.col("same")).select("depth", "key").distinct()
        if wrong.isEmpty():
            return members.drop("key", "same"), groups
        salt += 1
        split = F.xxhash64(F.lit(salt), "key", "up", "digest")
        marked = materialise(rows.join(wrong.withColumn("_wrong", F.lit(True)), ["depth", "key"], "left").select(*rows.columns, F.when(F.col("_wrong"), split).alias("_new")))
        above = marked.where("_new IS NOT NULL").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("_new").alias("_up"))
        keep = [c for c in rows.columns if c not in ("key", "up")]
        again = marked.join(above, ["conv_id", "depth"], "left").select(*keep, F.coalesce("_new", "key").alias("key"), F.coalesce("_up", "up").alias("up"))
        old, rows = rows, materialise(again)
        for used in (old, groups, members, marked):
            discard(used)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending ids of a node as comma-joined pieces."""
    for batch in batches:
        depth, node, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(depth):
            continue
        edges = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1]))))
        starts = np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(edges, np.append(edges[1:], len(depth)), strict=True)])
        ends = np.append(starts[1:], len(depth))
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(node[starts]), pa.array(conv[starts]), pa.array(texts, pa.string())], names=["depth", "node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after the other and are not held."""
    now, state = None, None
    for batch in batches:
        done = []
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (depth, node) != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "node", "ends"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["depth", "node", "ends"])


def end_digests(members: DataFrame) -> DataFrame:
    """depth, node and ends (SHA-256 of the ids that end there, ascending, comma-joined).

    A digest needs its ids in order, so a node's pieces pass through one task, a row for up to PIECE_IDS ids.
    """
    ends = members.where("last").select("depth", "node", "conv_id")
    order = ["depth", "node", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends string")


def _rollup_terms(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(batch.schema.get_field_index(f"own_{name}")).to_numpy(zero_copy_only=False) for name in ("saved", "leaves")}


def prefix_nodes(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(fingerprints(rebuilt_turns(ordered_turns(conversations)), primes))
    members, groups = verified_groups(rows)
    stands = F.col("node") == F.col("conv_id")
    own = members.select("conv_id", "depth", "node", F.when(stands, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(F.lit(0)).alias("own_saved"), (stands & F.col("childless")).cast("long").alias("own_leaves"))
    summed = prefix_sums(own, [F.col("depth").desc()], _rollup_terms, {"saved": None, "leaves": None})
    rolled = summed.groupBy("depth", "node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    nodes = groups.select("depth", F.col("rep.conv_id").alias("node"), "key", F.col("rep.up").alias("up"), "n_convs")
    parents = groups.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("rep.conv_id").alias("parent_conv_id"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    found = nodes.join(parents, ["depth", "up"], "left").join(children, ["depth", "key"], "left").join(rolled, ["depth", "node"]).join(end_digests(members), ["depth", "node"], "left")
    nothing = hashlib.sha256().hexdigest()
    return found.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, count(*) AS n FROM t GROUP BY conv_id
), m AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base
), turns AS (
  SELECT m.conv_id, t.p AS d, r, x FROM m JOIN t ON t.conv_id = m.base AND t.p <= m.h UNION ALL SELECT m.conv_id, m.taken + t.p - m.h, r, x FROM m JOIN t ON t.conv_id = m.conv_id AND t.p > m.h
), whole AS (
  SELECT m.conv_id, coalesce(list([r, x] ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS s FROM m LEFT JOIN turns USING (conv_id) GROUP BY 1
), prefixes AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM whole
), nodes AS (
  SELECT list_slice(s, 1, depth) AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(len(s) = depth) AS childless, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '') AS ends FROM prefixes GROUP BY 1, 2
), weighed AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[depth][2]) END AS w FROM nodes
), above AS (
  SELECT k, w, childless, unnest(range(0, depth + 1)) AS up FROM weighed
), rolled AS (
  SELECT list_slice(k, 1, up) AS k, CAST(sum(w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE childless) AS n_leaves FROM above GROUP BY 1
), kids AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN rolled USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = list_slice(n.k, 1, n.depth - 1)
"""
