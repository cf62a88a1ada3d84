"""Packing token ids into fixed rows by best-fit decreasing, with lossless splitting.

Documents are encoded, dealt by a hash of the id and the text to shards of about SHARD_BYTES of text, and each shard is packed
on its own in one task, so memory follows the shard and not the corpus. Within a shard a document longer
than a row is split into full rows and a rest; the segments, longest first, each go to the open row with the least room
that still holds them. That row is found in a segment tree over the remaining capacities, in O(log row) steps.

Result, one row for each packed row: shard, row_no, n_tokens, cu_seqlens (cumulative segment lengths from 0),
doc_ids and parts (document and number of the piece, for each segment), ids (the row's ids, padded with
`pad`, little-endian unsigned 32-bit) and positions (which restart at 0 with each segment, padding 0).

Defined results: a null or empty text has no tokens and so no segment; rows with a null id are packed like others
and carry null; repeated rows are packed as often as they occur, their pieces in order; a single document
far longer than a shard is still one task's work, in time linear in its length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.bpe import encode_text, encoder

ROW_TOKENS = 8192
SHARD_BYTES = 4 << 20


class CapacityTree:
    """Counts of open rows by remaining capacity; finds the least capacity that holds a length."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.counts[node] += n
            node >>= 1

    def least(self, length: int) -> int | None:
        """The smallest capacity >= length that an open row has."""
        node = self.leaves + length
        if self.counts[node]:
            return length
        while node > 1:
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Numbers of the segments in each row; ties keep the order of the input, the oldest row first."""
    tree, rows, open_rows = CapacityTree(row), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            at, room = len(rows), row
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        if room > lengths[i]:
            open_rows.setdefault(room - lengths[i], []).append(at)
            tree.add(room - lengths[i], 1)
    return rows


def split(ids: np.ndarray, row: int) -> list[np.ndarray]:
    return [ids[i : i + row] for i in range(0, len(ids), row)]


def pack_documents(docs: DataFrame, rank_file: bytes, pattern: str, row_tokens: int = ROW_TOKENS, pad: int = 0, shard_bytes: int = SHARD_BYTES, digests: bool = False) -> DataFrame:
    """Pack docs.text; with `digests`, SHA-256 of ids and positions stand in for the two arrays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    shards = max(1, -(-total // shard_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    last = "ids_sha256 string, positions_sha256 string" if digests else "ids binary, positions binary"
    schema = f"shard long, row_no int, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, parts array<int>, {last}"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, pieces = encoder(shared.value, pattern), []
        for frame in batches:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                known = None if pd.isna(doc_id) else int(doc_id)
                pieces += [(known is None, known or 0, part, ids) for part, ids in enumerate(split(encode_text(enc, text), row_tokens))]
        pieces.sort(key=lambda p: (*p[:3], p[3].tobytes()))
        out = []
        for row_no, members in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], row_tokens)):
            held = [pieces[i][3] for i in members]
            lengths = [len(h) for h in held]
            ids, positions = np.full(row_tokens, pad, dtype="<u4"), np.zeros(row_tokens, dtype="<u4")
            ids[: sum(lengths)] = np.concatenate(held)
            positions[: sum(lengths)] = np.concatenate([np.arange(n, dtype="<u4") for n in lengths])
            raw = (ids.tobytes(), positions.tobytes())
            if digests:
                raw = tuple(hashlib.sha256(r).hexdigest() for r in raw)
            seqlens = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            out.append((key[0], row_no, int(sum(lengths)), seqlens, [None if pieces[i][0] else pieces[i][1] for i in members], [pieces[i][2] for i in members], *raw))
            if len(out) == 64:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    # Dealt by the row's number too, so that copies of one row are spread over all shards.
    dealt = docs.where("length(text) > 0").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the id matrix, position resets and cumulative lengths, sorted by shard and row."""
    packed.repartition("shard").sortWithinPartitions("shard", "row_no").write.mode("overwrite").parquet(path)
