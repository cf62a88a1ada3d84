"""Vectors as compact binary rows, for the two search operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import materialise


def usable(embeddings: DataFrame, nonzero: bool = False) -> DataFrame:
    """row, vec_id and vec (little-endian doubles) of the rows that take part.

    Out are null ids, and vectors that are null, hold null or non-finite components, or (with `nonzero`) are zero. Rows
    that repeat an id are rows of their own, told apart by `row`, a number that no two rows share; a vector shorter than
    the longest one is that vector with zeros behind.
    """
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where("vec_id IS NOT NULL AND x IS NOT NULL").where(finite)
    if nonzero:
        x = x.where(F.exists("x", lambda v: v != 0))
    width = max(1, x.agg(F.max(F.size("x")).alias("n")).head()["n"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            full = np.zeros((part.num_rows, width), dtype="<f8")
            full[np.arange(width)[None, :] < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in full], pa.binary())], names=["vec_id", "vec"])

    return materialise(x.mapInArrow(run, "vec_id long, vec binary").withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "vec"))


def matrix(column, dtype="<f8") -> np.ndarray:
    """Binary rows, as a matrix."""
    values = list(column)
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1) if values else np.empty((0, 0), dtype=dtype)


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """The vectors of the first `most` rows by a hash of id and vector, at the driver."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "vec").limit(most).select("vec").collect()
    return matrix([r["vec"] for r in rows])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)
