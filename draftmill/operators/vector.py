"""Exact vector search, distances and projections over columns of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.boxes import col
from ..session import lean, materialise

#: Vectors of one block, and numbers of one distance block.
BLOCK, CELLS = 1024, 1_000_000
#: Rules that a query meets before the next one in rows of all pairs.
TILE = 128
#: Bands of rounded distances: fewest pairs that get any, units of a stride, strides of a band at most, and the share of all
#: pairs that ends it. 8 strides are the 131,072 doubles that a Parquet column's dictionary holds.
BANDED, STRIDE, STRIDES, SHARE = 4_000_000, 16_384, 8, 0.15
#: Rows of a stride that come one after another, on average, in bands of more than two; a Parquet page has 20,000, and the first
#: page decides on the dictionary: values of up to two strides come again often enough in it.
TOGETHER = 40_000
#: Queries that meet a group's rules at once in such bands, where a rule has few rows of a stride.
SPAN = 4096
#: Bytes of ids, as text, and of vectors that a group of rules has in banded rows of all pairs: a Parquet dictionary has 1,048,576, a task room.
NAMES_BYTES, BANDED_BYTES = 1_030_000, 64 << 20
#: Queries and rules whose distances tell where bands end.
SOME_QUERIES, SOME_RULES = 128, 512
#: Most pivots of a filed store, rules of one of its groups, and bytes of their vectors.
PIVOTS, GROUP, GROUP_BYTES = 256, 65_536, 16 << 20


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v) -> Column:
    """Null where the norm is 0."""
    return F.transform(col(v), lambda x: x.cast("double") / F.nullif(l2_norm(v), F.lit(0.0)))


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array, kind: pa.DataType = pa.float64()) -> np.ndarray:  # noqa: B008
    """Lists of one length as rows, without a Python object a number; null components are not numbers."""
    if not len(column):
        return np.zeros((0, 0))
    if len(np.unique(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of unequal lengths")
    return column.flatten().cast(kind).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def most_rules(width: int) -> int:
    """Rules of a group at most, of so many bytes each."""
    return max(1, min(GROUP, GROUP_BYTES // max(1, width)))


def distances(queries: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Squared distances, from differences: no cancellation for near vectors."""
    out = np.empty((len(queries), len(rules)))
    step = max(1, CELLS // max(1, rules.size))
    for at in range(0, len(queries), step):
        gap = queries[at : at + step, None, :] - rules[None]
        out[at : at + step] = np.einsum("qrd,qrd->qr", gap, gap)
    return out


def _apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs a[i], b[j], from differences."""
    out, step = np.empty(len(i)), max(1, CELLS // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        gap = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.einsum("cd,cd->c", gap, gap)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, v) to blocks (part, ids, values) of up to BLOCK vectors of one part."""
    for b in batches:
        for at in range(0, len(b), BLOCK):
            part, ids = b.column(0).slice(at, BLOCK).to_numpy(zero_copy_only=False), b.column(1).slice(at, BLOCK)
            matrix = _matrix(b.column(2).slice(at, BLOCK), pa.float32() if b.column(2).type.value_type == pa.float32() else pa.float64())
            parts = np.unique(part)
            rows = [part == p for p in parts]
            blobs = [[_sealed(ids.filter(pa.array(r))) for r in rows], [_packed(matrix[r]) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], ["part", "ids", "vs"])


def _sealed(ids: pa.Array) -> bytes:
    """Numbers as they lie in memory, text as Arrow's message."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
    return pa.record_batch([ids.cast(pa.string())], ["id"]).serialize().to_pybytes()


def _packed(matrix: np.ndarray) -> bytes:
    """A letter for the kind of numbers, then they as they lie in memory."""
    return matrix.dtype.char.encode() + matrix.tobytes()


def _unpacked(values: bytes) -> np.ndarray:
    return np.frombuffer(values, np.dtype(chr(values[0])), offset=1)


def _unblocked(ids: list[bytes], values: list[bytes], text: bool = False) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    if text:
        own = pa.concat_arrays([pa.ipc.read_record_batch(x, pa.schema([("id", pa.string())])).column(0) for x in ids])
    else:
        own = np.concatenate([np.frombuffer(x, np.int64) for x in ids])
    return own, np.concatenate([_unpacked(x) for x in values], dtype=np.float64).reshape(len(own), -1)


def _own(rows: DataFrame, id_col: str, vector_col: str, kind: str = "long") -> DataFrame:
    return rows.select(F.col(id_col).cast(kind).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")


def _kind(rows: DataFrame, id_col: str) -> str:
    return "string" if isinstance(rows.schema[id_col].dataType, StringType) else "long"


def _counted(rows: DataFrame) -> tuple[int, int, int]:
    """How many rows (id, v) there are, the longest vector, and the bytes of the longest id as text."""
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    return tuple(rows.agg(F.count(F.lit(1)), most(F.size("v")), most(F.octet_length(F.col("id").cast("string")))).first())


def _tasks(spark: SparkSession) -> int:
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _compared(queries: DataFrame, rules: DataFrame, id_col: str, vector_col: str, found, k: int = 0) -> DataFrame:
    """(query_id, rule_id, distance) of what ``found(query ids, queries, rule ids, rules)`` gives, with squared distances, for each share of queries and each group of rules.

    Rules are dealt into groups by hash, queries into shares, and each share meets each group in one task. Of the numbers of
    both those are taken that shuffle least where ``k`` rows a query and group go on; a group has about GROUP rules or GROUP_BYTES at most.
    Only counts reach the driver. Null ids and vectors are ignored.
    """
    queries, rules = _own(queries, id_col, vector_col), _own(rules, id_col, vector_col)
    (asked, *_), (held, width, _) = _counted(queries), _counted(rules)
    return _dealt(queries, rules, *dealing(asked, held, 8 * width, k, _tasks(rules.sparkSession)), [(_rooted(found), BLOCK)])


def _dealt(queries: DataFrame, rules: DataFrame, groups: int, shares: int, finders: list) -> DataFrame:
    """What each of ``finders`` finds in each share of the queries (id, v) and each group of the rules (id, v), in a task of its own."""

    def blocks(rows: DataFrame, parts: int, others: int, place) -> DataFrame:
        """Blocks of each of ``parts``, once for each of ``others``."""
        made = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v").mapInArrow(lean(_blocks), "part int, ids binary, vs binary")
        many = made.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return many.select(place(F.col("part"), F.col("_o")).cast("int").alias("part"), "ids", "vs")

    many = len(finders)
    one = blocks(rules, groups, shares * many, lambda group, other: group * (shares * many) + other)
    other = blocks(queries, shares, groups * many, lambda share, other: (F.floor(other / many) * shares + share) * many + other % many)
    return _met(other, one, groups * shares * many, finders, (_kind(queries, "id"), _kind(rules, "id")))


def dealing(asked: int, held: int, width: int, k: int, tasks: int, most: int | None = None) -> tuple[int, int]:
    """(groups of rules, shares of queries) for about so many tasks: rules go to every share, queries and k rows of 24 bytes each to every group.

    A group has ``most`` rules at most, or ``most_rules``.
    """
    best = np.sqrt(held * width * tasks / max(1, asked * (width + 24 * k))) if held else 1.0
    groups = int(max(1, -(-held // (most or most_rules(width))), min(tasks, round(best))))
    return groups, max(1, -(-tasks // groups))


def _met(queries: DataFrame, rules: DataFrame, parts: int, finders: list, kinds: tuple[str, str] = ("long", "long")) -> DataFrame:
    """``_compared`` for blocks (part, ids, vs) of queries and rules that meet where their part is the same; each part is a task of its own.

    Parts take turns with ``finders``, each of which gives ids and distances and goes with the most queries that it looks at together;
    ``kinds`` tells which ids, queries' or rules', are text.
    """
    both = rules.select("part", F.lit(0).alias("kind"), "ids", "vs").unionByName(queries.select("part", F.lit(1).alias("kind"), "ids", "vs"))
    text = [k == "string" for k in kinds]
    place = lambda ids, named: np.arange(len(ids)) if named else ids
    given = lambda ids, found, named: ids.take(pa.array(found)) if named else pa.array(found)

    def meet(part: int, queries: tuple[list, list], met: np.ndarray | pa.Array, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        if queries[0]:
            asked, own = _unblocked(*queries, text[0])
            for q, r, d in finders[part % len(finders)][0](place(asked, text[0]), own, place(met, text[1]), matrix):
                yield pa.RecordBatch.from_arrays([given(asked, q, text[0]), given(met, r, text[1]), pa.array(d)], ["query_id", "rule_id", "distance"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting, many, met, matrix = None, ([], []), ([], []), 0, None, None
        for b in batches:
            for p, kind, ids, values in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != part:
                    if matrix is not None:
                        yield from meet(part, waiting, met, matrix)
                    part, held, waiting, many, matrix = p, ([], []), ([], []), 0, None
                if kind == 0:
                    held[0].append(ids)
                    held[1].append(values)
                elif held[0] or matrix is not None:
                    if matrix is None:
                        met, matrix = _unblocked(*held, text[1])
                        held = ([], [])
                    new = len(_unpacked(values)) // max(1, matrix.shape[1])
                    if many + new > finders[p % len(finders)][1]:
                        yield from meet(part, waiting, met, matrix)
                        waiting, many = ([], []), 0
                    waiting[0].append(ids)
                    waiting[1].append(values)
                    many += new
        if matrix is not None:
            yield from meet(part, waiting, met, matrix)

    return both.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(lean(scan), f"query_id {kinds[0]}, rule_id {kinds[1]}, distance double")


def _best_of(k: int):
    """For ``_compared``: the k nearest of a group, ties to the smaller id."""

    def plain(ids: np.ndarray, own: np.ndarray, rule_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, CELLS // len(rule_ids))
        for at in range(0, len(ids), step):
            d = distances(own[at : at + step], matrix)
            i = np.tile(rule_ids, (len(d), 1))
            if d.shape[1] > k:
                near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]  # with ties, which ids decide
                most = int(near.sum(1).max())
                some = np.argsort(~near, axis=1, kind="stable")[:, :most]
                d, i = np.take_along_axis(d, some, 1), np.take_along_axis(i, some, 1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            yield np.repeat(ids[at : at + step], d.shape[1]), i.ravel(), d.ravel()

    def best(ids: np.ndarray, own: np.ndarray, rule_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size, sizes = np.einsum("qd,qd->q", own, own), np.einsum("rd,rd->r", matrix, matrix)
        if not (np.isfinite(size).all() and np.isfinite(sizes).all()):
            yield from plain(ids, own, rule_ids, matrix)
            return
        # Products tell which rules may be near, up to rounding; only their distances are taken, from differences.
        slack = 1e-15 * (own.shape[1] + 8) * (size + sizes.max(initial=0))
        bound = np.full(len(ids), np.inf)  # no less than the k-th squared distance so far
        q, r, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step = max(1, CELLS // len(ids))
        for at in range(0, len(matrix), step):
            some = matrix[at : at + step]
            rough = own @ some.T
            rough *= -2
            rough += size[:, None]
            rough += sizes[at : at + step]
            if rough.shape[1] > k:
                bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack) if at == 0 else bound
            i, j = np.nonzero(rough <= (bound + slack)[:, None])
            q, r, d = np.r_[q, i], np.r_[r, j + at], np.r_[d, _apart(own, i, some, j)]
            order = np.lexsort((rule_ids[r], d, q))
            q, r, d = q[order], r[order], d[order]
            begin = np.searchsorted(q, np.arange(len(ids)))
            kept = np.arange(len(q)) - begin[q] < k
            q, r, d = q[kept], r[kept], d[kept]
            full = np.bincount(q, minlength=len(ids)) == k
            last = np.searchsorted(q, np.arange(len(ids)), "right") - 1
            bound = np.where(full, np.minimum(bound, d[last]) if len(d) else bound, bound)
        yield ids[q], rule_ids[r], d

    return best


def _rooted(found):
    """``found`` with distances in place of squared ones."""
    return lambda *given: ((q, r, np.sqrt(d)) for q, r, d in found(*given))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "rule_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "rule_id", "distance")


def nearest(queries: DataFrame, rules: DataFrame, k: int = 3, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, rule_id, distance): the k nearest rules of each query by exact L2 distance.

    Fewer rows where there are fewer rules. Ties go to the smaller id. Rules are dealt into groups; each group
    keeps k rules a query, so k rows a group are shuffled, not the product, and groups are few where k is large. Null ids and vectors are ignored.
    For stores of many groups, ``FiledRules`` sends queries only to groups that can matter.
    """
    return _ranked(_compared(queries, rules, id_col, vector_col, _best_of(k), k), k)


class FiledRules:
    """Rules filed by their nearest pivot, for exact search that skips groups by the triangle inequality.

    ``pivots`` rules, chosen by hash of the id, are pivots; they alone, and a count and radius of each pivot's rules,
    reach the driver. All rules are filed, in a table of the shared folder; a pivot of many rules has several groups.
    Null ids and vectors are ignored, repeated ids count as often as they come.
    """

    def __init__(self, rules: DataFrame, pivots: int = 64, id_col: str = "id", vector_col: str = "embedding", group: int = GROUP):
        self.spark = rules.sparkSession
        rows = self._rows(rules, id_col, vector_col)
        chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(min(pivots, PIVOTS)).collect()
        self.pivots = np.array([r.v for r in chosen], np.float64) if chosen else np.zeros((0, 0))
        group = min(group, most_rules(8 * self.pivots.shape[1]))
        filed = materialise(rows.mapInArrow(lean(self._filing()), "pivot int, d double, id long, v array<double>"), "filed")
        stats = {r.pivot: r for r in filed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()}
        self.count = np.array([stats[p].n if p in stats else 0 for p in range(len(chosen))], np.int64)
        self.radius = np.array([stats[p].radius if p in stats else -np.inf for p in range(len(chosen))])
        # Groups of a pivot: so many that none has more than ``group`` rules on average; numbered on from pivot to pivot.
        self.groups = np.maximum(1, -(-self.count // group))
        self.first = np.r_[0, np.cumsum(self.groups)].astype(np.int64)
        number = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("pivot") + 1)
        part = (number(self.first[:-1]) + F.pmod(F.xxhash64("id", "v"), number(self.groups))).cast("int") if len(chosen) else F.lit(0)
        self.rules = filed.select(part.alias("part"), "id", "v")

    @staticmethod
    def _rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")

    def _filing(self):
        pivots = self.pivots

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    d = distances(_matrix(b.column(1)), pivots)
                    at = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), at])), *b.columns], ["pivot", "d", "id", "v"])

        return scan

    def _sent(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """Blocks (part, ids, vs) of queries (id, v, bound) for their nearest pivot's groups, or for all others that may hold a rule within the bound.

        Where a query has no bound yet, rules are counted: the groups that surely lie within some distance of it hold
        k rules, so no rule farther off matters.
        """
        pivots, radius, count, first, groups = self.pivots, self.radius, self.count, self.first, self.groups

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                matrix, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                d = np.sqrt(distances(matrix, pivots))
                own = np.where(count > 0, d, np.inf).argmin(1)
                far = d + radius
                order = np.argsort(far, axis=1)
                enough = np.cumsum(count[order], axis=1) >= k
                at = np.where(enough.any(1), enough.argmax(1), len(count) - 1)
                sure = np.where(enough.any(1), far[np.arange(len(d)), order[np.arange(len(d)), at]], np.inf)
                bound = np.fmin(b.column(2).to_numpy(zero_copy_only=False), sure)
                wanted = np.zeros(d.shape, bool)
                wanted[np.arange(len(d)), own] = True
                if not home:
                    slack = 1e-9 * (1 + d + np.abs(radius))  # of rounding
                    wanted = ~wanted & (count > 0) & (d - radius <= bound[:, None] + slack)
                for p in np.flatnonzero(wanted.any(0)):
                    who = wanted[:, p]
                    parts = range(int(first[p]), int(first[p] + groups[p]))
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([ids[who].astype(np.int64).tobytes()] * len(parts), pa.binary()), pa.array([_packed(matrix[who])] * len(parts), pa.binary())], ["part", "ids", "vs"])

        return queries.select("id", "v", F.col("bound").cast("double")).mapInArrow(lean(scan), "part int, ids binary, vs binary")

    def nearest(self, queries: DataFrame, k: int = 3, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        """What ``nearest`` gives: first the groups of each query's nearest pivot, then those that its k-th distance so far doesn't rule out."""
        if not len(self.pivots):
            return self.spark.createDataFrame([], "query_id long, rank int, rule_id long, distance double")
        asked = self._rows(queries, id_col, vector_col)
        near = materialise(_ranked(self._searched(self._sent(asked.withColumn("bound", F.lit(None)), k, True), k), k), "near")
        return _ranked(near.select("query_id", "rule_id", "distance").unionByName(self._searched(self.others(asked, near, k), k)), k)

    def others(self, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
        """Blocks of queries for the groups that the first search leaves open."""
        bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
        return self._sent(asked.join(bound, "id", "left"), k, False)

    def _searched(self, sent: DataFrame, k: int) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(self.first[-1]))
        return _met(sent, self.rules.mapInArrow(lean(_blocks), "part int, ids binary, vs binary"), parts, [(_rooted(_best_of(k)), BLOCK)])


def _rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    if digits is None:
        return d
    unit = 10.0**digits
    at = d * unit
    return np.where(np.isfinite(at), _whole(at) / unit, d)


def _whole(at: np.ndarray) -> np.ndarray:
    down = np.floor(at)
    with np.errstate(invalid="ignore"):  # infinite ones
        return down + (at - down >= 0.5)


def _every(digits: int | None):
    """For ``_dealt``: all pairs."""

    def every(ids: np.ndarray, own: np.ndarray, rule_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        wide = TILE * max(1, CELLS // (8 * TILE * len(ids)))
        for at in range(0, len(rule_ids), wide):
            tiles = [slice(k, k + TILE) for k in range(at, min(at + wide, len(rule_ids)), TILE)]
            asked = [np.repeat(ids, len(rule_ids[t])) for t in tiles]
            met = [np.tile(rule_ids[t], len(ids)) for t in tiles]
            apart = [distances(own, matrix[t]).ravel() for t in tiles]
            yield np.concatenate(asked), np.concatenate(met), _rounded(np.sqrt(np.concatenate(apart)), digits)

    return every


def _banded(low: float, high: float, digits: int, outside: bool = False):
    """For ``_dealt``: the pairs whose rounded distance has at least ``low`` and less than ``high`` units, or all others.

    Products of matrices give the distances up to an error that is bounded; where it could change the last digit, differences
    decide. So each pair is in one band, whatever task looks at it.
    """
    unit = 10.0**digits

    def wanted(whole: np.ndarray) -> np.ndarray:
        return ((whole >= low) & (whole < high)) != outside  # what is not a number is outside

    def exactly(ids: np.ndarray, own: np.ndarray, rule_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, CELLS // (8 * len(ids)))
        for at in range(0, len(matrix), step):
            some = matrix[at : at + step]
            j, i = np.repeat(np.arange(len(some)), len(ids)), np.tile(np.arange(len(ids)), len(some))
            d = np.sqrt(_apart(some, j, own, i))
            kept = wanted(_whole(d * unit))
            yield ids[i[kept]], rule_ids[at + j[kept]], _rounded(d[kept], digits)

    def banded(ids: np.ndarray, own: np.ndarray, rule_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size, sizes = np.einsum("qd,qd->q", own, own), np.einsum("rd,rd->r", matrix, matrix)
        most = size.max(initial=0) + sizes.max(initial=0)
        if not most * unit**2 < 1e30:  # too large for units, or not a number
            yield from exactly(ids, own, rule_ids, matrix)
            return
        slack = 1e-15 * (own.shape[1] + 8) * most
        margin = -1 if outside else 1
        least, beyond = max(0.0, (low - margin) / unit) ** 2 - margin * slack, max(0.0, (high + margin) / unit) ** 2 + margin * slack
        step = max(1, CELLS // len(ids))
        held, many, enough = [], 0, TOGETHER * max(1, round((high - low) / STRIDE))
        narrow = high - low <= 2 * STRIDE and not outside
        for at in range(0, len(matrix), step):
            some = matrix[at : at + step]
            rough = some @ own.T
            rough *= -2
            rough += size
            rough += sizes[at : at + step, None]
            near = ((rough >= least) & (rough < beyond)) != outside
            counts, i = np.count_nonzero(near, axis=1), np.flatnonzero(near)
            root = np.sqrt(np.maximum(rough.ravel()[i], 0))
            j = np.repeat(np.arange(len(some)), counts)
            i -= j * len(ids)
            units = root * unit
            doubt = np.flatnonzero(np.abs(units - np.floor(units) - 0.5) * root <= unit * slack)
            units[doubt] = np.sqrt(_apart(some, j[doubt], own, i[doubt])) * unit
            whole = _whole(units)
            kept = wanted(whole)
            if not kept.all():
                i, j, whole = i[kept], j[kept], whole[kept]
            if narrow:
                yield ids[i], rule_ids[at + j], whole / unit
                continue
            held.append((ids[i], rule_ids[at + j], whole))
            many += len(i)
            if many >= enough or at + step >= len(matrix):
                yield from by_stride(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, many = [], 0

    def by_stride(q: np.ndarray, r: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        stride = np.floor(whole / STRIDE)
        stride = np.minimum(stride - stride.min(initial=np.inf), 65_535).astype(np.uint16)
        order, sizes = np.argsort(stride, kind="stable"), np.bincount(stride)
        ends = np.cumsum(sizes)
        for k in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]:  # dense ones first, as first pages decide
            some = order[ends[k] - sizes[k] : ends[k]]
            yield q[some], r[some], whole[some] / unit

    return banded


def _edges(found: np.ndarray) -> list[float]:
    """Where bands of distances, in units, begin, and the end of the last: they hold a share of SHARE or STRIDES strides at most, or one stride.

    None where so many bands would be needed that they don't pay.
    """
    found = np.sort(found[np.isfinite(found)])
    if not len(found):
        return []
    out = len(found) // 1000  # as few lie outside on either side
    first, last = (int(x // STRIDE) for x in found[[out, -1 - out]])
    if last - first >= 16 * STRIDES:
        return []
    shares = np.diff(np.searchsorted(found, np.arange(first, last + 2) * STRIDE)) / len(found)
    edges, held, wide = [float(first * STRIDE)], 0.0, 0
    for stride, share in zip(range(first, last + 1), shares, strict=True):
        if wide and (held + share > SHARE or wide == STRIDES):
            edges.append(float(stride * STRIDE))
            held, wide = 0.0, 0
        held, wide = held + share, wide + 1
    return [*edges, float((last + 1) * STRIDE)]


def _some(rows: DataFrame, count: int, most: int) -> np.ndarray:
    """About ``most`` vectors by the hash of their ids, ``most`` at most."""
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, count // most))) == 0).limit(most)
    return np.array([r.v for r in chosen.select(F.col("v").cast("array<double>").alias("v")).collect()], np.float64)


def distance_rows(queries: DataFrame, rules: DataFrame, id_col: str = "id", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(query_id, rule_id, distance) for every query and rule: the rows of a distance matrix, in blocks, rounded where ``digits`` are given.

    Ids that are text stay text; so names are made once a vector, not once a row.
    Rows come by tiles of TILE rules, in a tile by query, so that few ids come again and again: columnar files store them in little room.
    Many rounded rows come by bands of distances in place of that, each band in tasks (and so files) of its own, in a task by stride and rule:
    then few distances come again and again, which are most of a row's bytes. Each band takes the products of all pairs anew.
    Where bands end is told by the distances of a few vectors, which the driver gets; all pairs are in some band.
    """
    queries, rules = (_own(rows, id_col, vector_col, _kind(rows, id_col)) for rows in (queries, rules))
    (asked, *_), (held, width, letters) = _counted(queries), _counted(rules)
    tasks = _tasks(rules.sparkSession)
    edges = []
    if digits is not None and asked * held >= BANDED and asked <= held:  # with more queries, a file has too many to name
        few, others = _some(queries, asked, SOME_QUERIES), _some(rules, held, SOME_RULES)
        edges = _edges(np.sqrt(distances(few, others)).ravel() * 10.0**digits) if len(few) and len(others) else []
    if not edges:
        return _dealt(queries, rules, *dealing(asked, held, 8 * width, 0, tasks), [(_every(digits), BLOCK)])
    bands = [(_banded(a, b, digits), SPAN if b - a > 2 * STRIDE else BLOCK) for a, b in zip(edges, edges[1:])]
    bands.append((_banded(edges[0], edges[-1], digits, outside=True), SPAN))
    most = max(1, min(NAMES_BYTES // (4 + letters), BANDED_BYTES // (8 * max(1, width))))
    return _dealt(queries, rules, *dealing(asked, held, 8 * width, 0, -(-tasks // len(bands)), most), bands)


def principal_components(rows: DataFrame, k: int = 2, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, pc1, ...): centered rows on their first k principal axes; each axis points where its largest loading is positive.

    Fewer than 3 rows give no rows, as in a plot that needs a plane.
    """
    v = rows.select(F.col(id_col).alias("id"), array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))
    n, mean = v.agg(F.count("v"), Summarizer.mean(F.col("v"))).first()
    if n < 3:
        return v.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast("double").alias(f"pc{j + 1}") for j in range(k)])
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(v).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    shift = mean.toArray() @ axes
    values = vector_to_array("v")
    place = lambda j: F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in axes[:, j]]), lambda x, w: x * w), F.lit(-float(shift[j])), lambda s, x: s + x)
    return v.select(F.col("id").alias(id_col), *[place(j).alias(f"pc{j + 1}") for j in range(k)])


def radar_ring(v, n: int) -> Column:
    """The first n dimensions, closed by the first."""
    v = col(v)
    return F.concat(F.slice(v, 1, n), F.slice(v, 1, 1))


def match_scores(matches: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Adds final_score, structure_percent and trusted to rows with blended and structure."""
    return matches.withColumns({
        "final_score": F.greatest(F.lit(0.0), (1 - F.col("blended")) * 100),
        "structure_percent": F.col("structure") * 100,
        "trusted": F.col("structure") * 100 >= threshold,
    })


__all__ = ["FiledRules", "distance_rows", "l2_distance", "l2_norm", "l2_normalised", "match_scores", "nearest", "principal_components", "radar_ring"]
