"""What the corpus operators share: bounds of broadcasts and text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import lean, materialise, shared_dir

#: Most bytes of model state that one broadcast may carry; operators split larger state into several passes.
BROADCAST_BYTES = 128 << 20

__all__ = ["BROADCAST_BYTES", "by_first", "dealt_out", "id_remainder", "is_finite_vector", "lean", "materialise", "packed", "scaled_vectors", "shared_dir", "text_or_empty", "unpacked", "words_of"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between space and \\x09-\\x0D, with A-Z lowered; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# ---- packed runs, which tasks send each other


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, by byte planes, whose high ones compress well."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in map(np.ascontiguousarray, arrays)]
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(planes)


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)).tolist(), 4 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def dealt_out(hashes: np.ndarray, log: int) -> Iterator[tuple[int, slice]]:
    """Buckets, by the first ``log`` bits, of sorted hashes, and where each lies; empty ones are left out."""
    edges = np.searchsorted(hashes, np.arange(1, 1 << log, dtype=np.uint64) << np.uint64(64 - log))
    for bucket, (s, e) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(hashes)], strict=True)):
        if s < e:
            yield bucket, slice(s, e)


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (tuples) of one value of the first column at a time."""
    name, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if rows and row[0] != name:
                yield rows
                rows = []
            name = row[0]
            rows.append(row)
    if rows:
        yield rows


# ---- vectors

#: Components are multiplied by SCALE and floored; results beyond LIMIT either way count as LIMIT, so that sums of products fit 64 bits.
SCALE, LIMIT = 256, 1 << 22


def is_finite_vector(v: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor infinities nor what is not a number."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled_vectors(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold ``dimension`` finite components, and those as floor(SCALE * x), a row each."""
    offsets = column.offsets.to_numpy()
    child = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are not numbers
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dimension)
    rows = child[offsets[:-1][keep][:, None] + np.arange(dimension)] if keep.any() else np.zeros((0, dimension))
    good = np.isfinite(rows).all(1)
    keep[keep] = good
    return keep, np.clip(np.floor(SCALE * rows[good]), -LIMIT, LIMIT).astype(np.int64)
