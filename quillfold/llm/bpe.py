"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once at the driver and shipped to the executors as a broadcast; its size is
that of the vocabulary and does not grow with the data. Encoding is one map over the documents: no
shuffle, and a lost executor costs only its tasks.

Long texts are cut before they reach the encoder, only at a place where the previous character is no
white space and the next one is. No alternative of the split pattern can match across such a place
(white space inside a match is either its first character or the whole match), so the pieces encode
exactly as the whole does.

The library's regex overflows its stack on a run of about a million white-space characters. Of a run of PIECE_CHARS or more, the
pattern makes one match: all of it at the end of the text, else all but its last character, which goes with what
follows. That match is found here and merged by the library as one piece, so runs of any length have ids.

Defined results: a null text counts as empty (no ids); ids and repeated rows pass through one for
one; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters handed to the encoder at once.
PIECE_CHARS = 1 << 16
#: What an encoder may keep at once in output rows, so that memory follows neither the batch nor the file.
FLUSH_BYTES = 8 << 20

_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# White space as the library's regex has it (Python's has \x1c to \x1f besides).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"(?<![{_SPACE}])[{_SPACE}]{{{PIECE_CHARS},}}")
_ENCODERS: dict = {}


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Parse a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def encoder(data: bytes, pattern: str):
    """One encoder for each worker process and vocabulary."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(data), special_tokens={})
    return _ENCODERS[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe places only, into pieces of about `size` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, dtype="<u4")
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    ids, start = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += [enc.encode_ordinary(piece) for piece in safe_pieces(text[start : run.start()])]
        ids.append(enc._encode_single_piece(text[run.start() : end]))
        start = end
    ids += [enc.encode_ordinary(piece) for piece in safe_pieces(text[start:])]
    return np.concatenate([np.array(i, dtype="<u4") for i in ids])


def decode_ids(enc, ids: np.ndarray) -> bytes:
    """Raw bytes of the ids; they need not be valid UTF-8."""
    return enc.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, digests: bool = False) -> DataFrame:
    """Encode docs.text and decode it again.

    Returns doc_id, n_tokens and either ids (little-endian unsigned 32-bit integers) and decoded
    (bytes), or with `digests` the lowercase hex SHA-256 of both.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rank_file)
    kind = pa.string() if digests else pa.binary()
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), kind, kind)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for part in batches:
            rows, held = [], 0
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                ids = encode_text(enc, text.as_py())
                raw, back = ids.tobytes(), decode_ids(enc, ids)
                if digests:
                    rows.append((doc_id.as_py(), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
                    held += 256
                else:
                    rows.append((doc_id.as_py(), len(ids), raw, back))
                    held += len(raw) + len(back)
                if held > FLUSH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    kinds = "string" if digests else "binary"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kinds}, {names[3]} {kinds}")
