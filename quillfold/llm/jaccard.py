"""N-gram Jaccard join: exact, over sets of word shingles, with set-relation skipping.

Sets are hashed shingles of five words (64 bits). Two documents link at Jaccard 0.75 or more. The join runs so:

1. Equal sets form a class; one row of each goes on.
2. Leaders. Sets that agree in a band of minhashes are compared with the smallest id of the band. Each verified
   link is kept, and a set with such a link takes its smallest leader; its relation to the leader is now
   known: |x \\ L|. This only saves work; nothing depends on what the bands miss.
3. Inverted index. Each set posts the shingles of its prefix (n - ceil(0.75 n) + 1, rare ones first; shingles
   common in the corpus last) with its size and position. In a list, sets with one leader share an entry. Entries
   of one size are a block, sorted by position; a probe takes from each block only the front that can still
   reach the needed overlap, and skips the rest.
4. Answers. Candidate pairs of leaders, unless connected already, are verified once. What that leaves open for
   their members is decided from the leaders' overlap: |x & z| <= |L & Z| + |x \\ L| + |z \\ Z|. Only
   members whose bound still reaches the threshold are verified themselves.
5. Components of all links.

No pair inside a group of near copies is emitted besides those with its leaders. Links, pairs and components are never
collected. Broadcast are at most MAX_COMMON common shingles, and id lists of at most BROADCAST_IDS rows, counted first (a
shuffle join takes their place beyond). Texts move only for documents that are part of a pair to verify.

Defined results: a document without words, or with a null text, has n_shingles 0 and is its own component; one
with fewer than five words has one shingle; a null id gets a null component and links with
nothing; repeated rows come back as often as they occur; several texts of one id each have their own n_shingles, and
what one of them links with the id links with; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import discard, materialise
from quillfold.llm.components import components
from quillfold.llm.text_arrays import mix, overlap, shingle_sets, text_slices

BANDS, ROWS = 8, 3
MAX_COMMON = 500_000
BROADCAST_IDS = 1_000_000
#: In how many unrelated documents of one task a shingle must occur to be reported as common.
COMMON_IN_TASK = 2
#: Hashes held while common shingles are counted.
HELD_HASHES = 1 << 20
LONG_LIST = 64
HELD_SETS, STREAMED_SETS = 128, 256

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def needed(a, b):
    """The overlap that sets of these sizes need for Jaccard 0.75: ceil(3 (a + b) / 7)."""
    return (3 * (a + b) + 6) // 7


def links(shared, a, b):
    """Whether 100 * intersection >= 75 * union."""
    return 100 * shared >= 75 * (a + b - shared)


def _signature(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """Two hashes of the whole set, and its band keys."""
    signed = lambda x: np.array([x], dtype=np.uint64).view(np.int64)[0].item()
    first, second = np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))), np.bitwise_xor.reduce(mix(hashes + np.uint64(0x14057B7EF767814F)))
    least = np.array([(hashes * s).min() for s in _SEEDS], dtype=np.uint64).reshape(BANDS, ROWS)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + least[:, r])
    return signed(first), signed(second), keys.view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2, bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for first, data, offsets in text_slices(part.column(1)):
                sets = shingle_sets(data, offsets)
                made = [_signature(s) if len(s) else (0, 0, []) for s in sets]
                columns = [part.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()))))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many documents hold, the rarest first: at most MAX_COMMON.

    Only the order of prefixes follows from it, so an estimate will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def report():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            at = n >= COMMON_IN_TASK
            return pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(n[at].astype(np.int64))], names=["h", "n"])

        for part in batches:
            for _, data, offsets in text_slices(part.column(0)):
                sets = shingle_sets(data, offsets)
                held += sets
                count += sum(map(len, sets))
                if count > HELD_HASHES:
                    yield report()
                    held, count = [], 0
        if held:
            yield report()

    counts = materialise(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    # The least count with which no more than MAX_COMMON shingles go to the driver, from a histogram.
    steps = F.floor(F.log2("n") * 16)
    above, least = 0, None
    for r in sorted(counts.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("size")).collect(), reverse=True):  # 1024 steps at most
        above += r["size"]
        if above > MAX_COMMON:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, dtype=np.uint64)
    found = counts.where(steps >= least).toArrow()
    discard(counts)
    h, n = found["h"].to_numpy(), found["n"].to_numpy()
    return h[np.lexsort((-h, n))].view(np.uint64)


def _merge(h: np.ndarray, leader: np.ndarray, least: np.ndarray, most: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each leader in each list, sorted by both."""
    order = np.lexsort((leader, h))
    h, leader, least, most, rest = (x[order] for x in (h, leader, least, most, rest))
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (leader[1:] != leader[:-1]))))
    return h[new], leader[new], np.minimum.reduceat(least, new), np.maximum.reduceat(most, new), np.maximum.reduceat(rest, new)


def _entries(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    h, leader, least, most, rest = _merge(*(np.concatenate(c) for c in zip(*held, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, leader, least, rest, most)], names=["h", "leader", "least", "rest", "most"])


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """h, leader, least and most size, rest for each shingle of each prefix; rest is the most that follows it in a set.

    Sets with one leader share their entries before the shuffle, so that a large group of near copies costs a list a few rows.
    """
    order = np.argsort(common, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        for part in batches:
            leaders = np.asarray(part.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            for first, data, offsets in text_slices(part.column(0)):
                for s, leader in zip(shingle_sets(data, offsets), leaders[first:], strict=False):
                    n = len(s)
                    if not n:
                        continue
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        is_common = known[at] == s
                        if is_common.any():
                            s = s[np.argsort(np.where(is_common, place[at], 0), kind="stable")]
                    length = n - (3 * n + 3) // 4 + 1
                    size = np.full(length, n, dtype=np.int32)
                    held.append((s[:length].view(np.int64), np.full(length, leader), size, size, np.arange(n - 1, n - 1 - length, -1, dtype=np.int32)))
            if sum(len(x[0]) for x in held) > HELD_HASHES:
                yield _entries(held)
                held = []
        if held:
            yield _entries(held)

    return docs.select("text", "leader").mapInArrow(run, "h long, leader long, least int, rest int, most int")


def _long_list(least: np.ndarray, most: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a long list, by blocks of one size with the best positions in front."""
    order = np.lexsort((-rest, least))
    sizes, starts = np.unique(least[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    widest = np.array([most[order[a:b]].max() for a, b in zip(starts, ends, strict=True)])
    left, right = [], []
    for p in range(len(order)):
        e = order[p]
        for block in np.flatnonzero((sizes <= least[e]) & (4 * widest >= 3 * least[e])):
            a, b = int(starts[block]), min(int(ends[block]), p)
            need = needed(int(sizes[block]), int(least[e])) - 1
            if a >= b or rest[e] < need:
                continue
            front = a + int(np.searchsorted(-rest[order[a:b]], -need, "right"))
            left.append(order[a:front])
            right.append(np.full(front - a, e))
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def list_pairs(h: np.ndarray, leader: np.ndarray, least: np.ndarray, rest: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Distinct candidate pairs of leaders in whole index lists; h is sorted. Entries of one set each have no most."""
    wide = (x.astype(np.int64) for x in (least, least if most is None else most, rest))
    h, leader, least, most, rest = _merge(h, leader, *wide)
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    lengths = np.diff(np.append(starts, len(h)))
    of = np.repeat(lengths, lengths)
    pairs = []
    for s, length in zip(starts[lengths > LONG_LIST].tolist(), lengths[lengths > LONG_LIST].tolist(), strict=True):
        a, b = _long_list(least[s : s + length], most[s : s + length], rest[s : s + length])
        pairs.append(np.stack([leader[s + a], leader[s + b]], axis=1))
    short = (of > 1) & (of <= LONG_LIST)
    if short.any():
        h, leader, least, most, rest = h[short], leader[short], least[short], most[short], rest[short]
        order = np.lexsort((least, h))
        h, leader, least, most, rest = h[order], leader[order], least[order], most[order], rest[order]
        at, step = np.arange(len(h) - 1), 1
        while len(at):
            at = at[at + step < len(h)]
            to = at + step
            going = (h[at] == h[to]) & (4 * most[at] >= 3 * least[to])
            at, to = at[going], to[going]
            good = np.minimum(rest[at], rest[to]) + 1 >= needed(least[at], least[to])
            pairs.append(np.stack([leader[at[good]], leader[to[good]]], axis=1))
            step += 1
    if not pairs:
        return np.empty((0, 2), dtype=np.int64)
    return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)


def candidates(postings: DataFrame) -> DataFrame:
    """Distinct pairs a < b of leaders that share an index list and may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for part in batches:
            columns = [np.asarray(part.column(i).to_numpy(zero_copy_only=False)) for i in range(5)]
            held = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last list may go on
            if last:
                pairs = list_pairs(*(c[:last] for c in held))
                held = [c[last:] for c in held]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if held is not None and len(held[0]):
            pairs = list_pairs(*held)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return postings.repartition("h").sortWithinPartitions("h").mapInArrow(run, "a long, b long").distinct()


def _restrict(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: by broadcast if the ids are few, else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, shared for each pair of ids."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = _restrict(docs.select("doc_id", "text"), ids)
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            # Rows with one leader stand together often enough that its set is made once for each run.
            kept: dict[int, np.ndarray] = {}
            for first, data, offsets in text_slices(part.column(2)):
                left = shingle_sets(data, offsets)
                out = []
                at = np.arange(first, first + len(left))
                fresh = [i for i in at.tolist() if int(b[i]) not in kept]
                fresh = list({int(b[i]): i for i in fresh}.values())
                for begin, data_b, offsets_b in text_slices(part.column(3).take(pa.array(fresh, pa.int64()))):
                    for j, s in enumerate(shingle_sets(data_b, offsets_b)):
                        kept[int(b[fresh[begin + j]])] = s
                for i, s in zip(at.tolist(), left, strict=True):
                    t = kept[int(b[i])]
                    out.append((int(a[i]), int(b[i]), len(s), len(t), overlap(s, t)))
                if len(kept) > 512:
                    kept = {}
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "shared"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, shared long").dropDuplicates(["a", "b"])





def _is_link():
    return links(F.col("shared"), F.col("n_a"), F.col("n_b"))


def _needed(a, b):
    return F.floor((3 * (a + b) + 6) / 7)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose two sides are not connected yet."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def _member_links(docs: DataFrame, unsure: DataFrame, members: DataFrame) -> DataFrame:
    """Links between members of two leaders' groups: the first one found in each task, which connects the groups.

    Members of the smaller group are held, in blocks of about HELD_SETS, while those of the larger one
    stream by, in parts of about STREAMED_SETS. Pairs are not made into rows, and only those are
    computed whose bound, from the leaders' overlap, still reaches the threshold.
    """
    held = unsure.join(members.select(F.col("leader").alias("h"), F.col("rep").alias("id"), "n", "own"), "h")
    held = held.where(F.col("shared") + F.col("own") + F.col("of_s.most") >= _needed(F.col("n"), F.col("of_s.least")))
    counts = held.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / HELD_SETS).cast("int").alias("blocks"), F.max(F.ceil(F.col("of_s.size") / STREAMED_SETS)).cast("int").alias("parts"))
    held = held.join(counts, "s").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    streamed = counts.join(members.select(F.col("leader").alias("s"), F.col("rep").alias("id"), "n", "own"), "s")
    streamed = streamed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["s", "block", "part", "kind"]
    rows = held.withColumn("kind", F.lit(0)).select(*key, "id", "n", "own", "h", "shared").unionByName(streamed.select("s", "block", "part", F.lit(1).alias("kind"), "id", "n", "own", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("shared")))
    rows = materialise(rows)
    texts = _restrict(docs.select("doc_id", "text"), materialise(rows.select(F.col("id").alias("doc_id")).distinct())).dropDuplicates(["doc_id"])
    rows = rows.join(texts.withColumnRenamed("doc_id", "id"), "id").select(*key, "id", "n", "own", "h", "shared", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for part in batches:
            columns = [part.column(i).to_pylist() for i in range(9)]
            out = []
            for first, data, offsets in text_slices(part.column(9)):
                for i, x in enumerate(shingle_sets(data, offsets), first):
                    s, block, piece, kind, doc, n, own, h, shared = (c[i] for c in columns)
                    if (s, block, piece) != now:
                        now, waiting = (s, block, piece), []
                    if kind == 0:
                        waiting.append((doc, n, own, h, shared, x))
                        continue
                    joined = set()
                    for doc_z, n_z, own_z, h_z, shared_z, z in waiting:
                        if h_z in joined or shared_z + own + own_z < needed(n, n_z) or 4 * min(n, n_z) < 3 * max(n, n_z):
                            continue
                        if links(overlap(x, z), n, n_z):
                            out.append((doc, doc_z))
                            joined.add(h_z)
                    if joined:
                        waiting = [w for w in waiting if w[3] not in joined]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.repartition("s", "block", "part").sortWithinPartitions(*key, "id").mapInArrow(run, "a long, b long")


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _join(docs)
    # Rows that share an id are documents of their own until their components are known.
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()))
    found = materialise(_join(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "row"))
    named = found.join(rows.select("row", "doc_id"), "row")
    # All rows of an id are one node: what one of them links with, the id links with.
    first = materialise(named.groupBy("component_id").agg(F.min("doc_id").alias("least")))
    edges = named.join(first, "component_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    nodes = components(materialise(edges.where("a <> b").distinct()))
    named = named.select("doc_id", "n_shingles").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = signatures(rows.where("doc_id IS NULL").select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless)


def _join(docs: DataFrame) -> DataFrame:
    """The join over ids that name one row each; null ids may repeat."""
    signed = materialise(signatures(docs))
    classes = materialise(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")))

    # Leaders.
    keyed = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(F.min("rep").alias("head"), F.min_by("n", "rep").alias("n_head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = keyed.join(heads, ["band", "key"]).where("head <> rep AND 4 * least(n, n_head) >= 3 * greatest(n, n_head)")
    stars = materialise(stars.select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct())
    proved = materialise(verify(docs, stars))
    linked = proved.where(_is_link())
    led = materialise(linked.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("leader"), F.min_by(F.col("n_a") - F.col("shared"), "b").alias("own")))
    star_edges = materialise(linked.select("a", "b"))
    first = materialise(components(star_edges))

    # The index: one posting row for each set of a class, under its leader.
    copies = signed.where("doc_id IS NOT NULL").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("leader"), F.lit(True).alias("skip"))
    special = materialise(copies.unionByName(led.select(F.col("rep").alias("doc_id"), "leader", F.lit(False).alias("skip"))))
    side = F.broadcast(special) if special.count() <= BROADCAST_IDS else special
    own = docs.where("doc_id IS NOT NULL").join(side, "doc_id", "left").where("skip IS NULL OR NOT skip").select("text", F.coalesce("leader", "doc_id").alias("leader"), F.col("leader").isNull().alias("single"))
    pairs = candidates(prefixes(own, common_shingles(own.where("single"))))

    # Answers: leaders once, then only what their answer leaves open for their members.
    pairs = materialise(_apart(pairs, first))
    answers = materialise(verify(docs, pairs))
    edges = star_edges.unionByName(answers.where(_is_link()).select("a", "b"))
    found = materialise(components(edges))

    members = classes.select("rep", "n").join(led, "rep", "left").select("rep", "n", F.coalesce("leader", "rep").alias("leader"), F.coalesce("own", F.lit(0)).alias("own"))
    groups = members.groupBy("leader").agg(F.max("own").alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))
    side_of = lambda c: groups.select(F.col("leader").alias(c), F.struct("most", "least", "size").alias(f"of_{c}"))
    unsure = _apart(answers.where(~_is_link()), found).join(side_of("a"), "a").join(side_of("b"), "b")
    # A group of one need not be its leader, who may stand in another's group; for two lone leaders the bound is what failed.
    unsure = unsure.where(F.col("shared") + F.col("of_a.most") + F.col("of_b.most") >= _needed(F.col("of_a.least"), F.col("of_b.least")))
    swap = F.col("of_a.size") < F.col("of_b.size")
    unsure = materialise(unsure.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("h"), "shared", F.when(swap, F.col("of_b")).otherwise(F.col("of_a")).alias("of_s")))
    if not unsure.isEmpty():
        edges = edges.unionByName(materialise(_member_links(docs, unsure, members)))
        found = materialise(components(edges))
    rows = signed.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
