"""How often each text's n-grams are clipped by the counts that all others of its group have, without sending all n-grams.

Of each n-gram of a group the largest count with its holder and the second largest are enough: a text's count is clipped only where it
alone holds the largest, and then to the second. Texts are dealt once, to blocks of up to about BLOCK_BYTES of one group (small groups
share blocks); nothing is sent further of a group that fits into one. A block finds the two largest counts of what it has. Most n-grams
are in no other block, so blocks first send a few bits of each hash (packed, about a byte for an n-gram), and hear which of these another
block has too. Only such n-grams follow, by 64 bits of hash with their counts and holder; agreeing bits alone decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import text_batches
from quillfold.llm.text_arrays import mix, text_slices, word_hashes
from quillfold.operators.relational import cut_lineage

#: Bytes of text of a block, about.
BLOCK_BYTES = 32 << 20
#: Words of a block that are hashed at once, and bits of a hash that tell the slices in which a block counts: what a worker holds.
AT_ONCE, SLICE_BITS = 1 << 18, 3
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _block_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words in each text."""
    found = [word_hashes(data, offsets, lower=False) for part in column.chunks for _, data, offsets in text_slices(part)]
    return np.concatenate([w for w, _ in found]), np.concatenate([c for _, c in found])


def _grams(words: np.ndarray, counts: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of group and words for each run of n words, and the text it is in."""
    counts, of = counts[counts > 0], np.flatnonzero(counts).astype(np.int32)
    ends = np.cumsum(counts)
    whole = np.ones(len(words), dtype=bool)
    for k in range(1, n):
        whole[np.maximum(ends - k, ends - counts)] = False
    text = np.repeat(of, counts)[whole]
    found, done = np.empty(len(text), dtype=np.uint64), 0
    for first in range(0, max(0, len(words) - n + 1), AT_ONCE):
        h = words[first : min(first + AT_ONCE, len(words) - n + 1)].copy()
        for k in range(1, n):
            h *= _STEP
            h += words[first + k : first + k + len(h)]
        h = mix(h[whole[first : first + len(h)]])
        found[done : done + len(h)] = mix(h ^ codes[text[done : done + len(h)]])
        done += len(h)
    return found, text


def _order(h: np.ndarray) -> np.ndarray:
    """A stable argsort: places ride in the low bits of the hashes, and what the high bits do not tell apart is sorted again."""
    bits = np.uint64(max(1, len(h).bit_length()))
    at = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    at = (at & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s = h[at]
    wrong = np.flatnonzero(s[1:] < s[:-1])
    if len(wrong):
        high = s >> bits
        again = np.flatnonzero(np.isin(high, high[wrong]))
        at[again] = at[again][np.lexsort((at[again], s[again]))]
    return at


def _starts(x: np.ndarray) -> np.ndarray:
    """Whether a run of equal values begins at each place of a sorted array."""
    return np.concatenate((np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]))


def _first_two(new: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the place of its largest count, and the largest count elsewhere in it (0 without)."""
    if not len(c):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=c.dtype)
    begin, run = np.flatnonzero(new), np.cumsum(new) - 1
    top = np.flatnonzero(c == np.maximum.reduceat(c, begin)[run])
    top = top[_starts(run[top])]
    rest = c.copy()
    rest[top] = 0
    return top, np.maximum.reduceat(rest, begin)


def _coded(x: np.ndarray, bits: int) -> bytes:
    """Sorted distinct numbers under 2 ** bits: their low bits as they are, the rest as marks in a row of bits, one step on for each number."""
    n = len(x)
    low = max(0, bits - n.bit_length())
    whole, odd = divmod(low, 8)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(n, 8)
    high = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(high[-1] + 1, dtype=bool)
    marks[high] = True
    some = np.packbits(np.unpackbits(planes[:, whole : whole + 1], axis=1)[:, 8 - odd :]).tobytes() if odd else b""
    return bytes([low]) + planes[:, :whole].T.tobytes() + some + np.packbits(marks).tobytes()


def _decoded(data: bytes, n: int) -> np.ndarray:
    whole, odd = divmod(data[0], 8)
    x, at = np.zeros((n, 8), dtype=np.uint8), 1 + whole * n
    x[:, :whole] = np.frombuffer(data, dtype=np.uint8, count=whole * n, offset=1).reshape(whole, n).T
    if odd:
        some = np.zeros((n, 8), dtype=np.uint8)
        some[:, 8 - odd :] = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=(n * odd + 7) // 8, offset=at), count=n * odd).reshape(n, odd)
        x[:, whole] = np.packbits(some, axis=1)[:, 0]
        at += (n * odd + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=at))) - np.arange(n)
    return x.view(np.uint64).reshape(n) | high.astype(np.uint64) << np.uint64(data[0])


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32 bits, as planes of bytes: what does not vary goes away."""
    planes = b"".join(x.astype(np.uint32).view(np.uint8).reshape(len(x), 4).T.tobytes() for x in arrays)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _loosened(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 4 * n * columns, codec="zstd", asbytes=True), dtype=np.uint8).reshape(columns, 4, n)
    return [np.ascontiguousarray(p.T).view(np.uint32).reshape(n).astype(np.int64) for p in planes]


def _parts(x: np.ndarray, bits: int, part_bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of each part, by the first part_bits of numbers of `bits` bits, that sorted numbers have something in."""
    if len(x):
        first, last = (int(y) >> (bits - part_bits) for y in (x[0], x[-1]))
        edges = np.searchsorted(x, np.arange(first + 1, last + 1, dtype=np.uint64) << np.uint64(bits - part_bits)).tolist()
        for part, (a, b) in enumerate(zip([0, *edges], [*edges, len(x)], strict=True), first):
            if a < b:
                yield part, a, b


def _within(x: np.ndarray, bits: int) -> np.ndarray:
    return x & np.uint64((1 << bits) - 1)


def _bits(blocks: int, block_bytes: int) -> tuple[int, int]:
    """Bits of a hash that tell, with a false alarm for about one n-gram of 32, whether one of the group's other blocks has it; bits that tell its part."""
    bits = (blocks - 1).bit_length()
    return min(56, max(0, (block_bytes // 8).bit_length() - 1) + 5 + bits), max(SLICE_BITS, bits)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_FEW = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("many", pa.int32()), ("data", pa.binary())])
_SQL = "key long, part int, n int, bucket int, many int, data binary"


def clipped_counts(rows: DataFrame, order: int, block_bytes: int | None = None) -> DataFrame:
    """g, id, len (words) and lost of rows (g, id, text; a row for each id) with words: by how much each order's counts go down, array<long>."""
    block_bytes = block_bytes or BLOCK_BYTES
    rows = rows.where("g IS NOT NULL").select("g", "id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut_lineage(rows.groupBy("g").agg(F.sum(F.octet_length("text")).alias("size")))
    # At most eight such groups for each block's worth of text are looked up by value; the others, small ones, share blocks by hash.
    own = sizes.where(F.col("size") * 8 > block_bytes).select("g", F.ceil(F.col("size") / block_bytes).cast("int").alias("blocks"))
    rest = sizes.where(F.col("size") * 8 <= block_bytes).agg(F.sum("size")).first()[0] or 0
    alone, code = F.col("blocks").isNotNull(), F.xxhash64("g")
    dealt = text_batches(rows).join(F.broadcast(own), "g", "left").select(
        F.when(alone, code).otherwise(0).alias("key"),
        F.when(alone, F.pmod(F.xxhash64("id"), "blocks")).otherwise(F.pmod(code, F.lit(2 * rest // block_bytes + 1))).cast("int").alias("bucket"),
        F.coalesce("blocks", F.lit(1)).alias("blocks"),
        code.alias("code"),
        "g",
        "id",
        "text",
    )

    def words_of(table: pa.Table) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        key, bucket, blocks = (table.column(c)[0].as_py() for c in ("key", "bucket", "blocks"))
        return key, bucket, blocks, table.column("code").to_numpy().view(np.uint64), *_block_words(table.column("text"))

    def announce(table: pa.Table) -> pa.Table:
        if table.column("blocks")[0].as_py() == 1:
            return _table([], _FEW)
        key, bucket, blocks, codes, words, counts = words_of(table)
        bits, part_bits = _bits(blocks, block_bytes)
        out = []
        for n in range(1, order + 1):
            few = _grams(words, counts, codes, n)[0]
            few >>= np.uint64(64 - bits)
            few.sort()
            few = few[_starts(few)]
            out += [(key, part, n, bucket, b - a, _coded(_within(few[a:b], bits - part_bits), bits - part_bits)) for part, a, b in _parts(few, bits, part_bits)]
        return _table(out, _FEW)

    def meet(table: pa.Table) -> pa.Table:
        key, part, n, bucket, many, data = (table.column(c).to_pylist() for c in _FEW.names)
        lists = [_decoded(x, m) for x, m in zip(data, many, strict=True)]
        both = np.sort(np.concatenate(lists))
        both = both[1:][both[1:] == both[:-1]]
        both = both[_starts(both)]
        marks = []
        for x in lists:
            found = np.zeros(len(x), dtype=bool)
            if len(both):
                at = np.searchsorted(x, both)
                there = at < len(x)
                at = at[there]
                found[at[x[at] == both[there]]] = True
            marks.append(pa.compress(np.packbits(found).tobytes(), codec="zstd", asbytes=True))
        return _table(list(zip(key, part, n, bucket, many, marks, strict=True)), _FEW)

    kinds = dict(rows.dtypes)
    held_sql = f"{_SQL}, g array<{kinds['g']}>, id array<{kinds['id']}>"

    def send(table: pa.Table, marks: pa.Table) -> pa.Table:
        key, bucket, blocks, codes, words, counts = words_of(table)
        bits, part_bits = _bits(blocks, block_bytes)
        heard = {(n, part): (many, data) for part, n, many, data in zip(*(marks.column(c).to_pylist() for c in ("part", "n", "many", "data")), strict=True)}
        out, lost = [], [counts.astype(np.int64)]
        for n in range(1, order + 1):
            whole, texts = _grams(words, counts, codes, n)
            clips = np.zeros(len(counts))
            slices = (whole >> np.uint64(64 - SLICE_BITS)).astype(np.uint8)
            for one in range(1 << SLICE_BITS):
                at = np.flatnonzero(slices == one)
                h, text = whole[at], texts[at]
                at = _order(h)
                h, text = h[at], text[at]
                new = _starts(h)
                each = new | _starts(text)
                c = np.diff(np.append(np.flatnonzero(each), len(h)))
                text, new, h = text[each], new[each], h[new]
                top, second = _first_two(new, c)
                first, text = c[top], text[top]
                met = np.zeros(len(h), dtype=bool)
                if blocks > 1 and len(h):
                    few = h >> np.uint64(64 - bits)
                    new, found = _starts(few), []
                    for part, a, b in _parts(few[new], bits, part_bits):
                        many, data = heard[n, part]
                        found.append(np.unpackbits(np.frombuffer(pa.decompress(data, (many + 7) // 8, codec="zstd", asbytes=True), dtype=np.uint8), count=b - a))
                    met = np.concatenate(found).astype(bool)[np.cumsum(new) - 1]
                clips += np.bincount(text[~met], weights=(first - second)[~met], minlength=len(counts))
                h, first, second, text = h[met], first[met], second[met], np.where(first > second, text, 0)[met]
                for part, a, b in _parts(h, 64, part_bits):
                    rest = _coded(_within(h[a:b], 64 - part_bits), 64 - part_bits)
                    out.append((key, part, n, bucket, b - a, len(rest).to_bytes(4, "little") + rest + _squeezed(first[a:b], second[a:b], text[a:b])))
            lost.append(clips.astype(np.int64))
        # A block's own sums pass by one of the parts, so that they and what is sent are made in one go.
        g, ids = (table.column(c).combine_chunks() for c in ("g", "id"))
        out = [(key, bucket, 0, bucket, len(counts), np.stack(lost).tobytes()), *out]
        return pa.Table.from_arrays([*_table(out, _FEW).columns, *(pa.ListArray.from_arrays(pa.array([0, *[len(x)] * len(out)], pa.int32()), x) for x in (g, ids))], names=[*_FEW.names, "g", "id"])

    def settle(table: pa.Table) -> pa.Table:
        if table.column("n")[0].as_py() == 0:
            return table
        key, part, n = (table.column(c)[0].as_py() for c in ("key", "part", "n"))
        buckets, fields = table.column("bucket").to_pylist(), []
        for many, data in zip(table.column("many").to_pylist(), table.column("data").to_pylist(), strict=True):
            size = 4 + int.from_bytes(data[:4], "little")
            fields.append((_decoded(data[4:size], many), *_loosened(data[size:], many, 3)))
        of = np.repeat(np.arange(len(fields)), [len(x[0]) for x in fields])
        h, first, second, text = (np.concatenate(x) for x in zip(*fields, strict=True))
        at = _order(h)
        h, first, second, text, of = h[at], first[at], second[at], text[at], of[at]
        top, other = _first_two(_starts(h), first)
        lost = first[top] - np.maximum(other, second[top])
        text, of = text[top], of[top]
        some = np.flatnonzero(lost > 0)
        texts, at = np.unique(of[some] << 32 | text[some], return_inverse=True)
        sums = np.bincount(at, weights=lost[some], minlength=len(texts)).astype(np.int64)
        edges = np.searchsorted(texts, np.arange(len(fields) + 1) << 32).tolist()
        texts &= 0xFFFFFFFF
        out = [(key, part, n, buckets[k], b - a, _squeezed(np.diff(texts[a:b], prepend=0), sums[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        schema = table.schema
        return pa.Table.from_arrays([*_table(out, _FEW).columns, *(pa.nulls(len(out), schema.field(c).type) for c in ("g", "id"))], names=schema.names)

    def total(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table.column("n"), 0))
        sums = np.frombuffer(own.column("data")[0].as_py(), dtype=np.int64).reshape(order + 1, -1).copy()
        for n, many, data in zip(*(table.column(c).to_pylist() for c in ("n", "many", "data")), strict=True):
            if n:
                step, lost = _loosened(data, many, 2)
                sums[n, np.cumsum(step)] += lost
        g, ids = (own.column(c).combine_chunks().flatten() for c in ("g", "id"))
        lost = pa.ListArray.from_arrays(pa.array(np.arange(0, order * len(ids) + 1, order), pa.int32()), pa.array(np.ascontiguousarray(sums[1:].T).ravel()))
        return pa.Table.from_arrays([g, ids, pa.array(sums[0]), lost], names=["g", "id", "len", "lost"])

    marks = dealt.groupBy("key", "bucket").applyInArrow(announce, _SQL).groupBy("key", "n", "part").applyInArrow(meet, _SQL)
    sent = dealt.groupBy("key", "bucket").cogroup(marks.groupBy("key", "bucket")).applyInArrow(send, held_sql)
    settled = sent.groupBy("key", "n", "part").applyInArrow(settle, held_sql)
    return settled.groupBy("key", "bucket").applyInArrow(total, f"g {kinds['g']}, id {kinds['id']}, len long, lost array<long>").where("len > 0")
