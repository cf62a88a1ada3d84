"""Exact removal of repeated byte strings with an enhanced suffix array over anchored suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
document. Strings are judged on the input.

Anchors spread the work. In each window of LENGTH bytes, the GRAM-byte gram with the least hash is its anchor, so equal
windows have equal anchors at equal places, wherever they stand. What an anchor can serve is its
context: the bytes from LENGTH - GRAM before it to LENGTH after its start. So:

1. Every anchor goes, with a hash of its context, to a list by the hash of its gram. Occurrences that repeat a context of the same slice
   of the input are told apart before the shuffle and dealt by document, so a passage in very many texts costs a list one
   row for each slice. In sorted lists, each occurrence but the first of one context (128 bits of hash) is repeated
   whole. Only lists with two or more contexts go on, one occurrence of each.
2. Their contexts are fetched, and each list gets its suffix array: the suffixes at its anchors, sorted, with common
   prefixes. A stack scan walks the tree of common-prefix intervals; inside each interval the bytes to the left, sorted alike, give a
   second tree, which tests left-extension diversity: an interval whose members agree to the left is only output
   with that extension. What comes out are the maximal repeats of LENGTH bytes or more, each
   with all its occurrences; all but the earliest are removed. (Lists of two have one interval; they are compared all at once.)
3. A list of more than MAX_LIST contexts (at the edge of a passage in very many documents) is not gathered: each
   of its windows becomes a row by itself, under a 128-bit hash, and step 1 finds the repeated ones by streaming.

`repeat_groups` gives the groups themselves, with every occurrence, whatever the size of a list. A repeat longer than a context stands
in several groups, one for each of its anchors.

All lists are streams over sorted partitions that hold at most MAX_LIST contexts in memory. Nothing is collected at the driver.

Defined results: a null or empty text has 0 bytes, and so nothing removed; texts under LENGTH bytes never
lose any; rows with a null id are left as they are and match nothing; repeated rows of one id and text count as one document
and are treated alike; several texts of one id are documents of their own, in the order of their bytes; an empty table
gives an empty result; further columns are kept, whatever their names, but for those that the result replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillfold.llm.common import discard, materialise
from quillfold.llm.text_arrays import SLICE_BYTES, mix, text_slices

LENGTH = 100
GRAM = 32
BEFORE = LENGTH - GRAM
#: Contexts of one list in memory, under 300 bytes each.
MAX_LIST = 1 << 15
OUTPUTS = {"n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text"}
#: Context bytes sent on in one output batch.
FLUSH_BYTES = 2 << 20

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LEVELS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes that start at each place; never 0."""
    h = _BYTES[data]
    for level, c in enumerate(_LEVELS):
        step = 1 << level
        h = h[:-step] * c + h[step:]
    return mix(h) | np.uint64(1)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width]."""
    have = 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, place in it, gram hash, context hash, bytes before, bytes after) of every anchor."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    h = gram_hashes(data)
    width = LENGTH - GRAM + 1
    least = _slide(h, width, np.minimum)  # by the start of the window
    inside = np.ones(len(least), dtype=bool)
    for end in offsets[1:-1].tolist():  # windows that reach into the next text
        inside[max(0, end - LENGTH + 1) : end] = False
    least[~inside] = 0
    zeros = np.zeros(width - 1, dtype=np.uint64)
    held = _slide(np.concatenate((zeros, least, zeros)), width, np.maximum)
    at = np.flatnonzero(held == h)
    text = np.searchsorted(offsets, at, "right") - 1
    left, right = np.maximum(at - BEFORE, offsets[text]), np.minimum(at + LENGTH, offsets[text + 1])
    context = mix(((at - left) << 8 | (right - at)).astype(np.uint64))
    for j in range(-(-(BEFORE + LENGTH) // GRAM)):
        context = mix(context * _LEVELS[0] + h[np.minimum(left + GRAM * j, right - GRAM)])
    return text, at - offsets[text], h[at], context, at - left, right - at


def _long_anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of one long text, piece by piece: window starts are shared out, with margins."""
    found, end = [], len(data)
    for start in range(0, end, SLICE_BYTES):
        low, high = max(0, start - 2 * LENGTH), min(end, start + SLICE_BYTES + 3 * LENGTH)
        part = anchors(data[low:high], np.array([0, high - low]))
        place = part[1] + low
        # An anchor is whole here if its context and all windows over it are: keep it in the piece it starts in.
        mine = (place >= start) & (place < start + SLICE_BYTES)
        found.append((part[0][mine], place[mine], *(p[mine] for p in part[2:])))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def combine(h: np.ndarray, c: np.ndarray, doc_id: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The rows, of which those that repeat an earlier one's h and c are marked by a negative place (~place) and dealt by document.

    A row that stands twice counts once.
    """
    order = np.argsort(h ^ mix(c), kind="stable")
    key = (h ^ mix(c))[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    at = order[same]
    if not len(at):
        return [h.view(np.int64), c.view(np.int64), doc_id, place]
    at = at[np.lexsort((place[at], doc_id[at], c[at], h[at]))]
    first = np.concatenate(([True], (h[at][1:] != h[at][:-1]) | (c[at][1:] != c[at][:-1])))
    of = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    later = at[~first]
    twice = later[(doc_id[later] == doc_id[of[~first]]) & (place[later] == place[of[~first]])]
    h, c, place = h.copy(), c.copy(), place.copy()
    h[later], c[later] = mix(doc_id[later].view(np.uint64) + np.uint64(1)), mix(place[later].view(np.uint64))
    place[later] = ~place[later]
    keep = np.ones(len(h), dtype=bool)
    keep[twice] = False
    return [x[keep] for x in (h.view(np.int64), c.view(np.int64), doc_id, place)]


def anchor_rows(docs: DataFrame, combined: bool = True) -> DataFrame:
    """h, c, doc_id, place for every anchor; place packs the position and the bytes before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in text_slices(part.column(1)):
                found = _long_anchors(data) if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES else anchors(data, offsets)
                text, at, h, c, before, after = found
                rows = (h, c, ids[first + text], at << 16 | before << 8 | after)
                arrays = combine(*rows) if combined else [rows[0].view(np.int64), rows[1].view(np.int64), *rows[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["h", "c", "doc_id", "place"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "h long, c long, doc_id long, place long")


REPEATED, OPEN, CROWDED = 0, 1, 2


def scan_lists(rows: DataFrame, only_repeated: bool = False, all_occurrences: bool = False) -> DataFrame:
    """Sort rows into lists by h and read them as a stream.

    Returns kind, h, doc_id and place: REPEATED, an occurrence whose context c occurs earlier; OPEN, the first of each
    context in a list that has several; CROWDED, the same in lists of over MAX_LIST contexts. With `all_occurrences`
    every occurrence counts as a context of its own, so none is REPEATED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = [np.empty(0, dtype=np.int64)] * 4, False

        def out(kind, h, doc_id, place):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, dtype=np.int32)), pa.array(h), pa.array(doc_id), pa.array(place)], names=["kind", "h", "doc_id", "place"])

        def close(h, doc_id, place, lists_crowded):
            """Firsts of complete lists."""
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
            many = sizes > MAX_LIST
            if lists_crowded:
                many[h == h[0]] = True
            several = (sizes > 1) & ~many
            return [out(k, h[m], doc_id[m], place[m]) for k, m in ((OPEN, several), (CROWDED, many)) if m.any()]

        for part in batches:
            now = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(now[0]):
                continue
            known = now[3] < 0
            if known.any():
                yield out(REPEATED, now[0][known], now[2][known], ~now[3][known])
                now = [x[~known] for x in now]
            h, c, doc_id, place = (np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(h):
                continue
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            if all_occurrences:
                first[1:] |= (doc_id[1:] != doc_id[:-1]) | (place[1:] != place[:-1])
            of = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            again = ~first & ((doc_id != doc_id[of]) | (place != place[of]))  # a repeated row is no earlier occurrence
            if again.any():
                yield out(REPEATED, h[again], doc_id[again], place[again])
            h, c, doc_id, place = h[first], c[first], doc_id[first], place[first]
            last = int(np.searchsorted(h, h[-1], "left"))
            if only_repeated:
                held = [h[-1:], c[-1:], doc_id[-1:], place[-1:]]
                continue
            if last:
                yield from close(h[:last], doc_id[:last], place[:last], crowded)
                crowded = False
            if crowded or len(h) - last > MAX_LIST:
                crowded = True
                if len(h) - last > 1:
                    yield out(CROWDED, h[last:-1], doc_id[last:-1], place[last:-1])
                last = len(h) - 1
            held = [x[last:] for x in (h, c, doc_id, place)]
        if len(held[0]) and not only_repeated:
            yield from close(held[0], held[2], held[3], crowded)

    dealt = rows.repartition("h").sortWithinPartitions("h", "c", "doc_id", "place")
    return dealt.mapInArrow(run, "kind int, h long, doc_id long, place long")


def fetch_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For OPEN rows h, doc_id, place and the context's bytes; for CROWDED ones a row for each window, without bytes."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "h", "place")).alias("found"))
    rows = docs.where("doc_id IS NOT NULL").join(lists, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["kind", "h", "c", "doc_id", "place", "context"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            open_ = [r for r in rows if r[0] == OPEN]
            windows = np.array([r[1:5] for r in rows if r[0] == CROWDED], dtype=np.int64).reshape(-1, 4)
            h, c, doc_id, place = combine(windows[:, 0].copy().view(np.uint64), windows[:, 1].copy().view(np.uint64), windows[:, 2].copy(), windows[:, 3].copy())
            columns = list(zip(*open_, strict=True)) if open_ else [()] * 6
            joined = [np.full(len(h), CROWDED), h, c, doc_id, place, [None] * len(h)]
            return pa.RecordBatch.from_arrays([pa.array([*a, *(b.tolist() if isinstance(b, np.ndarray) else b)], t) for a, b, t in zip(columns, joined, kinds, strict=True)], names=names)

        for part in batches:
            rows = []
            for doc_id, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                data = (text.as_py() or "").encode()
                for f in found.as_py():
                    at, before, after = f["place"] >> 16, f["place"] >> 8 & 255, f["place"] & 255
                    if f["kind"] == OPEN:
                        rows.append((OPEN, f["h"], 0, doc_id, f["place"], data[at - before : at + after]))
                    else:
                        for start in range(at - before, at + after - LENGTH + 1):
                            key = hashlib.blake2b(data[start : start + LENGTH], digest_size=16).digest()
                            rows.append((CROWDED, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc_id, start << 16 | LENGTH, None))
                    if len(rows) * (LENGTH + BEFORE) > FLUSH_BYTES:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return rows.select("doc_id", "text", "found").mapInArrow(run, "kind int, h long, c long, doc_id long, place long, context binary")


def common_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """Lengths of the common prefixes of neighbours."""
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    differ = grid[1:] != grid[:-1]
    lengths = np.array([len(s) for s in strings])
    return np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(lengths[1:], lengths[:-1]))


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals by a stack scan: (length, first, last), children before parents."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, length in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > length:
            deep, first = stack.pop()
            yield deep, first, i
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(contexts: list[bytes], anchor: list[int], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats over the anchors, as (bytes to the left, bytes to the right, all occurrences).

    anchor: where each context's suffix starts. Within an interval of the suffix array, the tree of the
    reversed left sides splits the members by how far they agree to the left.
    """
    rights = [c[a:] for c, a in zip(contexts, anchor, strict=True)]
    lefts = [c[:a][::-1] for c, a in zip(contexts, anchor, strict=True)]
    array = sorted(range(len(contexts)), key=rights.__getitem__)
    for right, first, last in intervals(common_prefixes([rights[i] for i in array], LENGTH).tolist()):
        if right + BEFORE < least:
            continue
        inner = sorted(array[first : last + 1], key=lefts.__getitem__)
        for left, a, b in intervals(common_prefixes([lefts[i] for i in inner], BEFORE + 1).tolist()):
            if left + right >= least:
                yield left, right, inner[a : b + 1]


def _pairs(doc_id: np.ndarray, place: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Lists of two contexts, all at once: the trees have a single interval."""
    a = np.arange(0, len(doc_id), 2)
    b = a + 1
    before, after = place >> 8 & 255, place & 255
    width = BEFORE + LENGTH
    grid = np.frombuffer(b"".join(c.rjust(BEFORE - x + len(c), b"\0").ljust(width, b"\0") for c, x in zip(contexts, before.tolist(), strict=True)), dtype=np.uint8).reshape(-1, width)
    differ = grid[a] != grid[b]
    right = differ[:, BEFORE:]
    right = np.minimum(np.where(right.any(1), right.argmax(1), LENGTH), np.minimum(after[a], after[b]))
    left = differ[:, :BEFORE][:, ::-1]
    left = np.minimum(np.where(left.any(1), left.argmax(1), BEFORE), np.minimum(before[a], before[b]))
    later = np.where((doc_id[a] > doc_id[b]) | ((doc_id[a] == doc_id[b]) & (place[a] > place[b])), a, b)
    good = (left + right >= LENGTH) & ((doc_id[a] != doc_id[b]) | (place[a] != place[b]))
    at = place[later[good]] >> 16
    return doc_id[later[good]], at - left[good], at + right[good]


def list_spans(h: np.ndarray, doc_id: np.ndarray, place: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc_id, start, end) to remove, from whole lists; h is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(starts, len(h)))
    two = np.repeat(sizes == 2, sizes)
    out = [_pairs(doc_id[two], place[two], [c for c, t in zip(contexts, two.tolist(), strict=True) if t])] if two.any() else []
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        of_doc, of_place = doc_id[s : s + n], place[s : s + n]
        order = np.empty(n, dtype=np.int64)
        order[np.lexsort((of_place, of_doc))] = np.arange(n)
        # All spans of an occurrence hold its anchor, so their union is one span.
        left_most, right_most = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for left, right, members in maximal_repeats(contexts[s : s + n], (of_place >> 8 & 255).tolist()):
            members = np.array(members)
            members = members[order[members] != order[members].min()]
            left_most[members] = np.maximum(left_most[members], left)
            right_most[members] = np.maximum(right_most[members], right)
        gone = np.flatnonzero(right_most >= 0)
        at = of_place[gone] >> 16
        out.append((of_doc[gone], at - left_most[gone], at + right_most[gone]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def _whole_lists(contexts: DataFrame, use, schema: str) -> DataFrame:
    """use(h, doc_id, place, contexts) over runs of whole lists, sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.empty(0, dtype=np.int64)] * 3 + [[]]
        for part in batches:
            if not part.num_rows:
                continue
            now = [part.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            h, doc_id, place = (np.concatenate(x) for x in zip(held[:3], now, strict=True))
            data = held[3] + part.column(3).to_pylist()
            last = int(np.searchsorted(h, h[-1], "left"))
            if last:
                yield use(h[:last], doc_id[:last], place[:last], data[:last])
            held = [h[last:], doc_id[last:], place[last:], data[last:]]
        if len(held[0]):
            yield use(*held)

    return contexts.select("h", "doc_id", "place", "context").repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def repeat_spans(contexts: DataFrame) -> DataFrame:
    """doc_id, start, end to remove, from the lists of h, doc_id, place, context."""
    out = lambda *lists: pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in list_spans(*lists)], names=["doc_id", "start", "end"])
    return _whole_lists(contexts, out, "doc_id long, start long, end long")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: byte spans to remove; they may overlap."""
    scanned = materialise(scan_lists(anchor_rows(docs)))
    fetched = materialise(fetch_contexts(docs, scanned.where(F.col("kind") != REPEATED)))
    crowded = scan_lists(fetched.where(F.col("kind") == CROWDED).select("h", "c", "doc_id", "place"), only_repeated=True)
    at, before, after = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    whole = lambda df: df.select("doc_id", (at - before).alias("start"), (at + after).alias("end"))
    spans = materialise(whole(scanned.where(F.col("kind") == REPEATED)).unionByName(whole(crowded)).unionByName(repeat_spans(fetched.where(F.col("kind") == OPEN))))
    discard(scanned)
    discard(fetched)
    return spans


class _Walk:
    """A stack scan of one window's sorted occurrences as they come: common-prefix intervals with what stands to their left.

    The stack holds an interval for each depth at most; members are told by their places, so none is held.
    """

    def __init__(self) -> None:
        self.stack: list[list] = []  # depth, first place, the byte to the left of all (None: several)
        self.n, self.last, self.left = 0, b"", None
        self.found: list[tuple[int, int, int]] = []

    def _close(self, depth: int) -> tuple[int, int | None]:
        first, left = self.n - 1, self.left
        while self.stack and self.stack[-1][0] > depth:
            deep, first, held = self.stack.pop()
            left = held if held == left else None
            if left is None:
                self.found.append((deep, first, self.n - 1))
        return first, left

    def add(self, after: bytes, left: int | None) -> None:
        if self.n:
            depth = _shared(self.last, after)
            first, held = self._close(depth)
            if self.stack and self.stack[-1][0] == depth:
                self.stack[-1][2] = held if held == self.stack[-1][2] else None
            else:
                self.stack.append([depth, first, held])
        self.n, self.last, self.left = self.n + 1, after, left

    def intervals(self) -> list[tuple[int, int, int]]:
        """(depth, first, last) of those closed since, whose members differ to the left."""
        found, self.found = self.found, []
        return found

    def end(self) -> list[tuple[int, int, int]]:
        self._close(-1)
        return self.intervals()


def _shared(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _anchor_of(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the place of its anchor: the first gram with the least hash."""
    if len(data) < LENGTH:
        return np.empty(0, dtype=np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(data), LENGTH - GRAM + 1)
    return grams.argmin(axis=1) + np.arange(len(grams))


#: Members of a window that stand together when intervals ask for theirs.
PART = 1024


def _crowded_groups(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The groups of lists of any size: of each window of LENGTH bytes, the repeats that begin with it.

    A repeat is found at the window it begins with: among the occurrences of that window, sorted by what follows up to the anchor's
    reach, it is an interval whose members differ to the left, or whose window is the first one with this anchor. So a window's occurrences
    stream by once, and intervals and members meet by window and place.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_list("place").alias("found"))
    rows = docs.where("doc_id IS NOT NULL").join(lists, "doc_id").dropDuplicates(["doc_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*(pa.int64(),) * 4, pa.int32(), pa.binary())

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["w1", "w2", "doc_id", "start", "left", "after"])

        for part in batches:
            out, size = [], 0
            for doc_id, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                data = (text.as_py() or "").encode()
                for place in found.as_py():
                    at, before, end = place >> 16, place >> 8 & 255, (place >> 16) + (place & 255)
                    low = max(0, at - before - 1)
                    of = low + _anchor_of(np.frombuffer(data[low:end], dtype=np.uint8))
                    for start in (np.flatnonzero(of == at) + low).tolist():
                        key = hashlib.blake2b(data[start : start + LENGTH], digest_size=16).digest()
                        # None where the window before has another anchor, or there is none: as for members that differ.
                        left = data[start - 1] if start > low and of[start - 1 - low] == at else None
                        out.append((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc_id, start, left, data[start + LENGTH : end]))
                        size += end - start - LENGTH + 40
                    if size > FLUSH_BYTES:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    windows = rows.select("doc_id", "text", "found").mapInArrow(cut, "w1 long, w2 long, doc_id long, start long, left int, after binary")
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), *(pa.int64(),) * 5)
        now, walker = None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "w1", "w2", "x", "y", "z"])

        for part in batches:
            out = []
            for w1, w2, doc_id, start, left, after in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                if (w1, w2) != now:
                    if now:
                        out += [(1, *now, *i) for i in walker.end()]
                    now, walker = (w1, w2), _Walk()
                out.append((0, w1, w2, doc_id, start, walker.n))
                walker.add(after, left)
                out += [(1, w1, w2, *i) for i in walker.intervals()]
            if out:
                yield batch(out)
        if now and (rest := walker.end()):
            yield batch([(1, *now, *i) for i in rest])

    dealt = windows.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "after", "doc_id", "start")
    walked = materialise(dealt.mapInArrow(walk, "kind int, w1 long, w2 long, x long, y long, z long"))
    members = walked.where("kind = 0").select("w1", "w2", F.col("x").alias("doc_id"), F.col("y").alias("start"), F.col("z").alias("at"), F.floor(F.col("z") / PART).alias("part"))
    found = walked.where("kind = 1").select("w1", "w2", F.col("x").alias("depth"), F.col("y").alias("first"), F.col("z").alias("last"))
    asked = found.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / PART), F.floor(F.col("last") / PART))))
    joined = asked.join(members, ["w1", "w2", "part"]).where(F.col("at").between(F.col("first"), F.col("last")))
    return joined.select(F.xxhash64("w1", "w2", "depth").alias("h"), F.col("first").alias("group_no"), "doc_id", "start", (F.col("start") + LENGTH + F.col("depth")).alias("end"))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """h, group_no, doc_id, start, end: the maximal repeats of LENGTH bytes or more around each anchor, one row for each occurrence.

    All occurrences of a gram stand in its list, equal contexts too; the interval trees group them. Lists of more than MAX_LIST occurrences
    are not gathered: their repeats are found window by window (`_crowded_groups`), where occurrences stream by.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialise(scan_lists(anchor_rows(plain, combined=False), all_occurrences=True))
    contexts = fetch_contexts(plain, scanned.where(F.col("kind") == OPEN))

    def groups(h: np.ndarray, doc_id: np.ndarray, place: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        out = []
        starts = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            before = (place[s:e] >> 8 & 255).tolist()
            for n, (left, right, members) in enumerate(maximal_repeats(data[s:e], before)):
                # Wherever the repeat stands this must be an anchor: of one of its own windows.
                own = np.frombuffer(data[s + members[0]], dtype=np.uint8)[before[members[0]] - left : before[members[0]] + right]
                if not (_anchor_of(own) == left).any():
                    continue
                at = place[s:e][members] >> 16
                out += [(int(h[s]), n, int(d), int(a) - left, int(a) + right) for d, a in zip(doc_id[s:e][members], at, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "group_no", "doc_id", "start", "end"])

    found = _whole_lists(contexts, groups, "h long, group_no long, doc_id long, start long, end long")
    return found.unionByName(_crowded_groups(plain, scanned.where(F.col("kind") == CROWDED)))


def _numbered(plain: DataFrame) -> DataFrame | None:
    """doc_id, text and a number that rises with both, where an id has several texts; null where none has."""
    named = plain.where("doc_id IS NOT NULL")
    hashes = F.xxhash64(F.coalesce("text", F.lit("")))
    if named.groupBy("doc_id").agg(F.min(hashes).alias("a"), F.max(hashes).alias("b")).where("a <> b").isEmpty():
        return None
    pairs = named.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return materialise(pairs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("number", F.monotonically_increasing_id()))


def remove_repeats(docs: DataFrame, digests: bool = False, as_text: bool = False) -> DataFrame:
    """All columns of docs, with n_bytes, n_removed, n_spans, and the spans (start, end) and kept bytes.

    An input column of one of these names is replaced. With `as_text` kept_text instead of the bytes; a character of which a part was removed goes.
    With `digests` only doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes.
    """
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    plain = docs.select(id_.alias("doc_id"), text.alias("text"))
    numbers = _numbered(plain)
    spans = find_spans(plain if numbers is None else numbers.select(F.col("number").alias("doc_id"), "text")).groupBy("doc_id").agg(F.collect_list(F.array("start", "end")).alias("found"))
    own = ["doc_id"] if digests else [c for c in docs.columns if c.lower() not in OUTPUTS]
    rows = docs.withColumn("doc_id", id_).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), id_.alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    if numbers is not None:
        digest = numbers.select(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("s"), "number")
        rows = rows.withColumn("s", F.sha2("t", 256)).join(digest, ["i", "s"], "left").select("d", F.col("number").alias("i"), "t")
    rows = rows.join(spans.withColumnRenamed("doc_id", "i"), "i", "left").select("d", "t", "found")
    made = "n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "spans array<struct<start:long,end:long>>, " + ("kept_text string" if as_text else "kept binary"))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), *((pa.string(),) if digests else (pair, pa.string() if as_text else pa.binary())))
    names = [c.split(" ")[0] for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for text, found in zip(part.column(1), part.column(2), strict=True):
                data, gone = text.as_py().encode(), merge_spans([tuple(s) for s in found.as_py() or ()])
                cuts = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                last = (hashlib.sha256(kept).hexdigest(),) if digests else ([{"start": s, "end": e} for s, e in gone], kept.decode("utf-8", "ignore") if as_text else kept)
                out.append((len(data), len(data) - len(kept), len(gone), *last))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["d", *names])

    schema = rows.select("d").schema
    for field in StructType.fromDDL(made).fields:
        schema = schema.add(field)
    return rows.mapInArrow(run, schema).select("d.*", *names)
