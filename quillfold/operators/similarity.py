"""Pairs of similar sets inside blocks, without comparing all pairs of a block.

In any one order of all shingles, two sets of n and m with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of one
and the first m - ceil(t m) + 1 of the other, so only these are indexed. The order is that of the hashes, with shingles that are common in
a sample of the sets last: the sample decides how fast it goes, not what is found. So prefixes are cut out where the sets lie, and
no shingle is counted over all sets. What goes into the index is packed: each task sends, to each part of the range of hashes, the
prefixes of many sets as one row, with four bytes for a shingle and one head for all that a set has there. As hashes are in
order, a set's shingles in a part stand together in its prefix, so that the head tells their places. Sets meet in their part where their sizes
allow the threshold, and each part counts what two sets share there. All that two sets share up to the end of the prefix that ends first is
counted so, and what comes later is at most the rest of that set: pairs whose counts and rest do not reach the overlap that they need are
done. The others are compared; their sets are made from the texts again, not stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.llm.text_arrays import mix, overlap, text_slices
from quillfold.operators.relational import cut_lineage, small

#: Sets that are looked at for common shingles, and how many of these are put last.
SAMPLE_SETS, COMMON = 2000, 1000
#: Shingles that a task holds before it sends them, about how many a part of the index is to have, and pairs held.
HELD, PART, HELD_PAIRS = 1_000_000, 2_000_000, 1_000_000
#: Meetings that are looked at, and pairs that are sent, at once.
SENT = 1 << 17
#: Bytes of a batch that goes to a Python worker, at most: worker and executor hold several of them at once.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words of a shingle.
WORDS = 5
#: The bytes of which words consist: all but white space, or letters and digits.
SPACED, PLAIN = "spaced", "plain"
_BYTES = {SPACED: np.ones(256, dtype=bool), PLAIN: np.zeros(256, dtype=bool)}
_BYTES[SPACED][[0x20, *range(0x09, 0x0E)]] = False
_BYTES[PLAIN][[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

ENTRIES = "array<struct<key:bigint,floor:double,least:double>>"


def entry(key: Column, floor: Column, least: Column) -> Column:
    """One index that a set is in: a hash of its key, the least threshold that any set has there, and its own; of two sets the lower one counts."""
    return F.struct(key.alias("key"), floor.cast("double").alias("floor"), least.cast("double").alias("least"))


def window_text(text: Column, most: int = 20_000) -> Column:
    """What the SPACED words of `window_shingles` are found in."""
    return F.lower(F.substring(text, 1, most))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, rule: str) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; none under WORDS words."""
    word = _BYTES[rule][data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    inner = offsets[offsets < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    none = np.empty(0, dtype=np.uint64)
    if not len(starts):
        return [none] * (len(offsets) - 1)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int(lengths.max()), _BASE))))
    letters = (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * word[starts[0] :]
    hashes = mix(np.add.reduceat(letters * powers[place], starts - starts[0]))
    joined = np.full(max(0, len(hashes) - WORDS + 1), np.uint64(WORDS))
    for k in range(WORDS):
        joined = joined * _STEP + hashes[k : k + len(joined)]
    joined, found = mix(joined), []
    ends = np.searchsorted(starts, offsets).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a < WORDS:
            found.append(none)
            continue
        s = np.sort(joined[a : b - WORDS + 1])
        found.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return found


def _batch_sets(column: pa.Array, rule: str | None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of runs of rows: of texts by a rule, or of arrays of distinct numbers as they are."""
    if rule:
        for first, data, offsets in text_slices(column):
            yield first, shingle_sets(data, offsets, rule)
    else:
        yield 0, [np.sort(mix(np.array(x.as_py(), dtype=np.int64).view(np.uint64))) for x in column]


def lean_batches(df: DataFrame) -> DataFrame:
    """df; its session sends BATCH_BYTES at a time to Python workers, or as many as it was set to where that is fewer."""
    conf = df.sparkSession.conf
    told = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(_BATCH_CONF).lower())
    if not told or not 0 < int(told[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[told[2]] <= BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def as_sets(rows: DataFrame, rule: str | None) -> DataFrame:
    """id and s of rows (id, text), or of rows that have s already."""
    if rule is None:
        return rows.select("id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _batch_sets(batch.column(1), rule):
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                s = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), s], names=["id", "s"])

    return lean_batches(rows).select("id", "text").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, s array<long>")


def sampled(rows: DataFrame, rule: str | None) -> tuple[np.ndarray, float]:
    """The shingles of at least 1 % of a sample of SAMPLE_SETS sets or so (COMMON at most), and about how many shingles all sets have."""
    many = rows.count()
    sets = as_sets(rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, many // SAMPLE_SETS))) == 0), rule)
    counts = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SAMPLE_SETS // 100)
    common = [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()]
    mean = sets.agg(F.avg(F.greatest(F.size("s"), F.lit(0)))).first()[0] or 0.0
    found = np.array(common, dtype=np.int64).view(np.uint64)
    return np.sort(found if rule else mix(found)), mean * many


def _planes(x: np.ndarray) -> bytes:
    """First bytes, then second bytes and so on: what does not vary compresses away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: type, n: int, at: int) -> tuple[np.ndarray, int]:
    width = np.dtype(dtype).itemsize
    x = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
    return np.ascontiguousarray(x.T).view(dtype).reshape(n), at + n * width


_HEAD = (np.int64, np.int32, np.float32, np.float32, np.int32, np.int32, np.int64, np.int32, np.float32, np.int32, np.float32)
_POSTED = "part int, heads int, head binary, h binary"


def _packed(held: list[tuple], bits: int) -> pa.RecordBatch:
    """A row for each part: a head (id, size, floor, least, place of the first shingle, number of shingles, key, shingles beyond the prefix, its end, and both for the prefix of its own threshold) for all that a set has there, and the shingles."""
    h = np.concatenate([x[0] for x in held])
    counts = np.array([len(x[0]) for x in held])
    d = np.repeat(np.arange(len(held), dtype=np.int32), counts)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([x[1] for x in held], counts)
    kinds = (np.int64, np.int32, np.float32, np.float32, np.int64, np.int32, np.float32, np.int32, np.float32)
    ids, n, floor, least, key, rest, end, own_rest, own_end = (np.array([x[i] for x in held], dtype=t) for i, t in enumerate(kinds, 2))
    part = (h >> np.uint64(64 - bits)).astype(np.int16 if bits < 15 else np.int32)
    order = np.argsort(part, kind="stable")
    part, h, d, pos = part[order], (h[order] >> np.uint64(32 - bits)).astype(np.uint32), d[order], pos[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(h))
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        run = d[a:b]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        of = run[first]
        head = (ids[of], n[of], floor[of], least[of], pos[a + first].astype(np.int32), np.diff(np.append(first, b - a)).astype(np.int32), key[of], rest[of], end[of], own_rest[of], own_end[of])
        rows.append((int(part[a]), len(first), b"".join(_planes(x) for x in head), h[a:b].tobytes()))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "heads", "head", "h"])


def postings(rows: DataFrame, rule: str | None, common: np.ndarray, bits: int) -> DataFrame:
    """The packed prefixes of all sets of rows (id, text or s, e)."""

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, len(batch) * BATCH_BYTES // max(1, batch.nbytes))
        yield from (batch.slice(k, step) for k in range(0, len(batch), step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            entries = batch.column(2)
            at = np.asarray(entries.offsets) - entries.offsets[0].as_py()
            key, floor, least = (x.to_numpy(zero_copy_only=False) for x in entries.flatten().flatten())
            for first, sets in _batch_sets(batch.column(1), rule):
                for i, s in enumerate(sets, first):
                    n = len(s)
                    if not n or at[i] == at[i + 1]:
                        continue
                    rare, often = s, s[:0]
                    if len(common):
                        known = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                        if known.any():
                            rare, often = s[~known], s[known]
                    for j in range(at[i], at[i + 1]):
                        length, own = (n - int(np.ceil(t[j] * n - 1e-9)) + 1 for t in (floor, least))
                        ends = []
                        for x in (length, min(own, length)):
                            # The order as a number: rare ones by hash within 0 and 1, common ones from 2 on; the rest of a whole set is 0.
                            beyond = x > len(rare) and len(often) > 0
                            far = often[x - len(rare) - 1] if beyond else rare[min(x, len(rare)) - 1]
                            ends += [max(0, n - x), float(far) / 2**64 + 2 * beyond]
                        about = (ids[i], n, floor[j], least[j], key[j], *ends)
                        held.append((rare[:length], 0, *about))
                        many += min(length, n)
                        if length > len(rare) and len(often):
                            held.append((often[: length - len(rare)], len(rare), *about))
                if many > HELD:
                    yield from sliced(_packed(held, bits))
                    held, many = [], 0
        if many:
            yield from sliced(_packed(held, bits))

    what = "s" if rule is None else "text"
    return rows.select(F.col("id").cast("long").alias("id"), what, F.col("e").cast(ENTRIES).alias("e")).where(f"id IS NOT NULL AND {what} IS NOT NULL AND e IS NOT NULL").mapInArrow(run, _POSTED)


def _meet(rows: list[tuple[int, bytes, bytes]]) -> Iterator[np.ndarray]:
    """Pairs of ids, smaller first, that meet in one part, how often, and how often they have to in all."""
    heads = []
    for n, head, _ in rows:
        at, fields = 0, []
        for kind in _HEAD:
            x, at = _from_planes(head, kind, n, at)
            fields.append(x)
        heads.append(fields)
    ids, n, floor, least, start, count, key, rest, end, own_rest, own_end = (np.concatenate(c) for c in zip(*heads, strict=True))
    h = np.concatenate([np.frombuffer(x, dtype=np.uint32) for _, _, x in rows])
    # Meetings are sought within a key; a key is told by its place among those of the part.
    code = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    met = np.repeat(code << np.uint64(32), count) | h
    order = np.argsort(met)
    met = met[order]
    same = met[1:] == met[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, met = order[several], met[several]
    ends = np.cumsum(count)
    d = np.searchsorted(ends, order, "right")
    by_size = np.lexsort((n[d], met))
    met, d = met[by_size], d[by_size]
    n, floor, least = n.astype(np.float64), floor.astype(np.float64) - 1e-6, least.astype(np.float64) - 1e-6
    # Of two sets, the one of the lower threshold (both, if equal) is met within the prefix that this threshold needs.
    own = start[d] + order[by_size] - (ends - count)[d] < (n - np.ceil(least * n - 1e-9) + 1)[d]

    def counted(found: list[np.ndarray]) -> Iterator[np.ndarray]:
        pairs, times = np.unique(np.concatenate(found), return_counts=True)
        for k in range(0, len(pairs), SENT):
            a, b = pairs[k : k + SENT] // len(ids), pairs[k : k + SENT] % len(ids)
            t = np.minimum(least[a], least[b])
            (end_a, rest_a), (end_b, rest_b) = (np.where(least[x] <= least[y], (own_end[x], own_rest[x]), (end[x], rest[x])) for x, y in ((a, b), (b, a)))
            later = np.where(end_a == end_b, np.maximum(rest_a, rest_b), np.where(end_a < end_b, rest_a, rest_b))
            need = np.ceil(t / (1 + t) * (n[a] + n[b]) - 1e-3) - later
            yield np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), times[k : k + SENT], need.astype(np.int64)])

    at, step, found, many = np.arange(len(met)), 1, [], 0
    while len(at):
        left = []
        for k in range(0, len(at), SENT):
            now = at[k : k + SENT]
            now = now[now + step < len(met)]
            a, b = d[now], d[now + step]
            going = (met[now] == met[now + step]) & (n[a] >= np.minimum(floor[a], floor[b]) * n[b])
            now, a, b = now[going], a[going], b[going]
            left.append(now)
            good = (n[a] >= np.minimum(least[a], least[b]) * n[b]) & (ids[a] != ids[b])
            good &= (own[now] | (least[a] > least[b])) & (own[now + step] | (least[b] > least[a]))
            found.append(np.minimum(a, b)[good] * len(ids) + np.maximum(a, b)[good])
            many += len(found[-1])
            if many > HELD_PAIRS:
                yield from counted(found)
                found, many = [], 0
        at, step = np.concatenate(left), step + 1
    if many:
        yield from counted(found)


def candidates(rows: DataFrame, rule: str | None = None) -> DataFrame:
    """Distinct a < b of rows (id, text or s, e) that share an index and may reach its threshold."""
    common, total = sampled(rows, rule)
    bits = min(14, max(4, int(np.ceil(np.log2(max(1.0, total / PART))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for pairs in _meet(held):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "times", "need"])

        for batch in batches:
            for part, n, head, h in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    if held:
                        yield from out()
                    now, held = part, []
                held.append((n, head, h))
        if held:
            yield from out()

    packed = postings(lean_batches(rows), rule, common, bits)
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long, times long, need long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b")


def compared(rows: DataFrame, rule: str | None, pairs: DataFrame) -> DataFrame:
    """a, b and similarity of pairs of ids."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = as_sets(rows.join(small(ids), "id", "left_semi"), rule)
    of = lambda p: sets.select(F.col("id").alias(p), F.col("s").alias(f"s_{p}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, shared = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in (x, y))
                s, t = (v.view(np.uint64) if rule else np.sort(v) for v in (s, t))
                both.append(len(s) + len(t))
                shared.append(overlap(s, t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(shared, pa.int64())], names=["a", "b", "both", "shared"])

    scored = lean_batches(pairs).join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, both long, shared long")
    return scored.select("a", "b", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))


def similar_pairs(rows: DataFrame, blocks: DataFrame, keys: list[str], may: Column | None = None, rule: str | None = None) -> DataFrame:
    """a, b, *keys, similarity of the pairs a < b that share a block and reach its threshold.

    rows: id (a whole number) and s (distinct shingles, array<long>), or text where a rule of words is given; one row for each id. e, the indexes
    that a row is in, may hold several blocks; without it, each block is an index of its own. blocks: id, *keys, least (the block's
    threshold; rows of different thresholds do not meet), and what `may` needs: a condition over columns prefixed a_ and b_ of blocks, the same either way round.
    """
    more = [c for c in blocks.columns if c not in ("id", "least", *keys)]
    if "e" not in rows.columns:
        own = blocks.groupBy("id").agg(F.collect_set(entry(F.xxhash64(*keys, "least"), F.col("least"), F.col("least"))).alias("e"))
        rows = rows.join(small(own), "id")
    side = lambda p: blocks.select(F.col("id").alias(p), *keys, "least", *[F.col(c).alias(f"{p}_{c}") for c in more])
    found = cut_lineage(candidates(rows, rule))
    met = found.join(side("a"), "a").join(side("b"), ["b", *keys, "least"])
    met = cut_lineage((met if may is None else met.where(may)).select("a", "b", *keys, "least").distinct())
    scored = compared(rows, rule, met.select("a", "b").distinct())
    return met.join(scored, ["a", "b"]).where("similarity >= least").select("a", "b", *keys, "similarity")
