"""Rows of one key in one task and in order, handed to numpy a few keys at a time.

What lies on one line of an image is dealt by the line's key alone: one shuffle and one sort, which Spark spills. No join
or table of groups is held, so a task's memory is that of its sort and of the longest line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tasks for each shuffle partition of the session, so that each sorts a fraction of one.
SHARE = 2


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's key differs from that of the row before it; nulls are equal."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def by_line(rows: DataFrame, line: list[str], order: list[str], found: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema, share: int = SHARE) -> DataFrame:
    """What ``found(rows, whether each begins a line)`` gives, a batch or several, for whole lines: rows of equal ``line``, which are the first columns, in ``order``."""
    width = len(line)
    parts = share * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*line, *[c for c in rows.columns if c not in line])
    # Lines may come in any order: numbers first, which the sort compares faster.
    by = sorted(line, key=lambda c: isinstance(rows.schema[c].dataType, T.StringType))

    def given(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        whole = pa.concat_batches(whole) if len(whole) > 1 else whole[0] if whole else None
        if whole is not None and len(whole) and (out := found(whole, changes(whole.columns[:width]))) is not None:
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not len(b):
                continue
            fresh = changes(b.columns[:width])
            fresh[0] = last is None or last != [c[0].as_py() for c in b.columns[:width]]
            last = [c[-1].as_py() for c in b.columns[:width]]
            starts = np.flatnonzero(fresh)
            if not len(starts):
                held.append(b)
                continue
            yield from given([*held, b.slice(0, starts[-1])])
            held = [b.slice(starts[-1])]
        yield from given(held)

    return dealt.repartition(parts, *line).sortWithinPartitions(*by, *order).mapInArrow(scan, schema)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def laid_out(fresh: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, what was added): all lines behind each other, so far apart that nothing of two lines touches."""
    low, span = (int(start.min()), int(end.max())) if len(start) else (0, 0)
    base = (np.cumsum(fresh) - 1) * (span - low + 3) - low
    return start + base, end + base, base


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first rows) of intervals in order of their starts, made one where they overlap or touch."""
    reach = np.maximum.accumulate(end) if len(end) else end
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1] + 1]) if len(start) else np.zeros(0, np.int64)
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]] if len(first) else reach, first


def meeting(start: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, behind the last, pairs of each): which of the sorted disjoint intervals ``starts``, ``ends`` meet each interval."""
    low, high = np.searchsorted(ends, start, "left"), np.searchsorted(starts, end, "right")
    return low, np.maximum(high, low), np.maximum(high - low, 0)


def paired(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of both sides of the pairs that ``meeting`` counts."""
    return np.repeat(np.arange(len(count)), count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
