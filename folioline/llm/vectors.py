"""Vectors as byte strings: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        ends = np.cumsum(lengths)
        whole = [values[e - n : e] for e, n in zip(ends, lengths, strict=True)]
        blobs = [v.tobytes() if v.size and np.isfinite(v).all() and v.any() else None for v in whole]
        others = [batch.column(c) for c in batch.schema.names if c != "embedding"]
        names = [c for c in batch.schema.names if c != "embedding"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(blobs, pa.binary())], names=[*names, "vector"])


def packed(rows: DataFrame, keep: str) -> DataFrame:
    """The columns ``keep`` (a DDL list) and ``vector``: float64 bytes of ``embedding``.

    A vector that is null, empty or zero, or holds null, NaN or an infinity is null.
    """
    columns = [c.split() for c in keep.split(",")]
    wide = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns], F.col("embedding").cast("array<double>"))
    return wide.mapInArrow(_packed_rows, f"{keep}, vector binary")


def usual_length(vectors: DataFrame) -> int:
    """Bytes of most vectors; the shorter if there is a tie. Others cannot be compared with them."""
    size = F.length("vector")
    rows = vectors.where("vector IS NOT NULL").groupBy(size.alias("size")).count()
    top = rows.orderBy(F.desc("count"), "size").limit(1).collect()
    return top[0]["size"] if top else 0


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of a binary column, a row each."""
    if not len(column):
        return np.zeros((0, dimensions))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), dimensions)


def sample(vectors: DataFrame, size: int, dimensions: int) -> np.ndarray:
    """About ``size`` vectors, drawn by their id, in the order of the ids' hashes."""
    rows = vectors.count()
    share = min(1.0, size / max(1, rows))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 62)) < max(1, int(share * (1 << 62))))
    found = drawn.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * size).collect()
    return np.frombuffer(b"".join(bytes(r["vector"]) for r in found), dtype=np.float64).reshape(len(found), dimensions)
