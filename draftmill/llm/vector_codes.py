"""Vector code compression: each part of a vector becomes the index of the nearest entry of that part's codebook.

The nearest entry is found by partial distances: dimensions come in descending variance of the codebook, and a mask
drops entries as soon as their integer distance so far strictly exceeds the best complete distance. All numbers are
integers, so results don't depend on the order in which tasks add them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_finite_vector, lean, materialise, scaled_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries that are compared at once; what they leave as best distance prunes the next ones. Rows of one comparison.
SLAB, ROWS = 16, 4096
#: Labels whose sums are broadcast; beyond it they are joined by shuffle.
BROADCAST_LABELS = 200_000


class PartialDistances:
    """The entries of one part, in the order of dimensions that tells them apart soonest."""

    def __init__(self, entries: np.ndarray):
        self.order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
        self.entries = entries[:, self.order]
        self.compared = self.possible = 0  # differences taken, and those that a full search takes

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower of equals, and its squared distance."""
        found = [self._nearest(parts[s : s + ROWS][:, self.order]) for s in range(0, len(parts), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, (n, d) = self.entries, x.shape
        self.possible += n * len(c) * d
        if d == 0:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        # The entry that is nearest in the first dimension gives the first complete distance.
        ranked = np.argsort(c[:, 0], kind="stable")
        at = np.searchsorted(c[ranked, 0], x[:, 0])
        low, high = ranked[np.maximum(at - 1, 0)], ranked[np.minimum(at, len(c) - 1)]
        index = np.where(np.abs(x[:, 0] - c[low, 0]) <= np.abs(x[:, 0] - c[high, 0]), low, high)
        best = ((x - c[index]) ** 2).sum(1)
        self.compared += n * d
        for s in range(0, len(c), SLAB):
            part = (x[:, :1] - c[s : s + SLAB, 0]) ** 2
            self.compared += part.size
            row, entry = np.nonzero(part <= best[:, None])
            part = part[row, entry]
            for j in range(1, d):
                part = part + (x[row, j] - c[s + entry, j]) ** 2
                self.compared += len(part)
                stay = part <= best[row]
                row, entry, part = row[stay], entry[stay], part[stay]
            if not len(row):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(part, starts)
            own = row[starts]
            at_least = part == np.repeat(least, np.diff(np.r_[starts, len(row)]))
            first = s + np.minimum.reduceat(np.where(at_least, entry, len(c)), starts)
            better = (least < best[own]) | (first < index[own])  # none here is above the best
            best[own], index[own] = least, np.where(better, first, index[own])
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part: integers of shape (parts, entries, width), and the length of the vectors they are for."""

    entries: np.ndarray
    dimension: int

    @property
    def digest(self) -> str:
        """Of all entries' components, by part, entry and place; zeros that fill up the last part are included."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows of whole vectors as (row, part, place)."""
        parts, _, width = self.entries.shape
        filled = np.zeros((len(rows), parts * width), np.int64)
        filled[:, : rows.shape[1]] = rows
        return filled.reshape(len(rows), parts, width)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (row, part) and squared distances (row, part)."""
        parts = self.split(rows)
        found = [PartialDistances(e).nearest(parts[:, p]) for p, e in enumerate(self.entries)]
        return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (row, part) stand for."""
        return np.stack([self.entries[p, codes[:, p]] for p in range(len(self.entries))], 1).reshape(len(codes), -1)[:, : self.dimension]


def _first_codebooks(rows: DataFrame, parts: int, entries: int, id_col: str, vector_col: str) -> Codebooks | None:
    """The parts of the kept vectors of smallest ids; None without any."""
    v = F.col(vector_col)
    first = rows.filter(is_finite_vector(v)).select(F.col(id_col).alias("id"), v.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v")
    head = first.limit(1).collect()
    if not head:
        return None
    dimension = len(head[0].v)
    some = [r.v for r in first.filter(F.size("v") == dimension).limit(entries).collect()]
    _, whole = scaled_vectors(pa.array(some, pa.list_(pa.float64())), dimension)
    width = -(-dimension // parts)
    return Codebooks(np.ascontiguousarray(Codebooks(np.zeros((parts, 1, width)), dimension).split(whole).transpose(1, 0, 2)), dimension)


def _improved(rows: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """Each entry becomes the floored mean of the parts nearest to it. A row a task and used entry is shuffled."""
    parts, entries, width = books.entries.shape
    sums = [f"s{j}" for j in range(width)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            _, whole = scaled_vectors(b.column(0), books.dimension)
            index, _ = books.nearest(whole)
            place = (index + np.arange(parts) * entries).ravel()
            count += np.bincount(place, minlength=len(count))
            np.add.at(total, place, books.split(whole).reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, j]) for j in range(width)]], ["place", "n", *sums])

    schema = ", ".join(f"{c} long" for c in ["place", "n", *sums])
    found = rows.select(vector_col).mapInArrow(lean(scan), schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])
    new = books.entries.reshape(parts * entries, width).copy()
    for place, n, *total in found.collect():  # at most a row an entry
        new[place] = np.array(total, np.int64) // n
    return Codebooks(new.reshape(parts, entries, width), books.dimension)


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks from the vectors of smallest ids, improved by ``rounds`` passes over all vectors; None where no vector is kept."""
    books = _first_codebooks(rows, parts, entries, id_col, vector_col)
    for _ in range(rounds if books else 0):
        books = _improved(rows, books, vector_col)
    return books


def encode_vectors(rows: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of each kept vector: indexes of the nearest entries, two hex digits each, and the squared distance."""
    kind = dict(rows.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, whole = scaled_vectors(b.column(2), books.dimension)
            index, distance = books.nearest(whole)
            hexed = index.astype(np.uint8).tobytes().hex()
            step = 2 * index.shape[1]
            codes = [hexed[k * step : (k + 1) * step] for k in range(len(index))]
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept), pa.array(codes, pa.string()), pa.array(distance.sum(1), pa.int64())], ["id", "label", "code", "error"])

    out = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(lean(scan), f"id {kind[id_col]}, label {kind[label_col]}, code string, error long")
    return out.withColumnsRenamed({"id": id_col, "label": label_col})


def compress_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row per kept row of ``rows``.

    Vectors that are null or hold nulls, infinities or what is not a number are dropped, as are those of another
    length than the kept vector of smallest id has (ties: the smallest vector). Components beyond 16384 count as
    16384. A length that ``parts`` doesn't divide is filled up with zeros. Fewer kept vectors than ``entries`` give
    fewer entries. Null ids come last when entries are chosen; repeated rows count as often as they come. label_error
    is the error of all rows with an equal label, null labels together. No kept rows give no rows.

    Codebooks (at most parts * entries rows) pass through the driver; vectors are read once a round and once more.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    books = fit_codebooks(rows, parts, entries, rounds, id_col, vector_col)
    if books is None:
        return rows.limit(0).select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialise(encode_vectors(rows, books, id_col, vector_col, label_col).toDF("id", "label", "code", "error"), "codes")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "own")
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    found = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("own")), "left")
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
