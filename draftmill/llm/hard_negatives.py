"""Hard-negative mining by branch and bound in ball trees.

Rows are dealt into groups, each of which builds a tree of balls. A ball bounds the inner products of an anchor with
all its rows from above and below: a node is pruned if its bounds lie outside the window of wanted scores or strictly
beneath the k-th best score so far, or if its labels can't fit. Blocks of anchors go to every group; a group's best
few an anchor are all that is shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_finite_vector, lean, materialise, packed, scaled_vectors, unpacked

#: Rows of a leaf; anchors of a block; most bytes of a group's vectors; rows below which no further group is made; most labels by which a node is parted.
LEAF, BLOCK, GROUP_BYTES, GROUP_ROWS, BY_LABEL = 256, 512, 64 << 20, 8192, 32
#: Products of whole numbers below this are exact as doubles, times 100 too.
EXACT = 1 << 46


@dataclass
class Search:
    """One query an entry: which anchor, its label, whether labels must be equal or differ, the window of 100 x score, and the best k so far."""

    anchor: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int

    def __post_init__(self):
        n = len(self.anchor)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kth = np.full(n, np.iinfo(np.int64).min)
        self.visited = self.leaves = 0  # pairs of query and leaf compared, and all that there are

    def offer(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Takes new rows; of each query the k best stay, ties to the smaller id."""
        affected = np.isin(self.query, query)
        q, s, i = (np.concatenate([old[affected], new]) for old, new in ((self.query, query), (self.score, score), (self.id, id_)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = rank == self.k - 1
        self.kth[q[full]] = s[full]
        keep = rank < self.k
        self.query, self.score, self.id = (np.concatenate([old[~affected], new[keep]]) for old, new in ((self.query, q), (self.score, s), (self.id, i)))


class BallTree:
    """Rows (ids, labels, whole-number vectors) in tree order, and nodes by arrays: first and last row, center, radius, labels, children."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.start, self.stop, self.child, self.center, self.radius, self.least, self.most = [], [], [], [], [], [], []
        values = rows.astype(np.float64)

        def node(s: int, e: int) -> int:
            own, lab = values[order[s:e]], labels[order[s:e]]
            center = own.mean(0)
            self.start.append(s)
            self.stop.append(e)
            self.child.append(None)
            self.center.append(center)
            self.radius.append(float(np.sqrt(((own - center) ** 2).sum(1).max())))
            self.least.append(int(lab.min()))
            self.most.append(int(lab.max()))
            return len(self.start) - 1

        todo = [node(0, len(ids))] if len(ids) else []
        while todo:
            k = todo.pop()
            s, e = self.start[k], self.stop[k]
            if e - s <= leaf:
                continue
            own = order[s:e]
            lab, count = np.unique(labels[own], return_counts=True)
            if 1 < len(lab) <= BY_LABEL:  # by labels first, which the wanted label then tells apart
                border = int(np.argmin(np.abs(np.cumsum(count)[:-1] - (e - s) / 2)))
                left = labels[own] <= lab[border]
                cut = int(left.sum())
                order[s:e] = np.concatenate([own[left], own[~left]])
            else:
                spread = values[own].var(0)
                cut = (e - s) // 2
                order[s:e] = own[np.argpartition(values[own, int(spread.argmax())], cut)]
            self.child[k] = (node(s, s + cut), node(s + cut, e))
            todo += self.child[k]
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.largest = int(np.abs(rows).max(initial=0))

    def search(self, anchors: np.ndarray, labels: np.ndarray, own_ids: np.ndarray, s: Search) -> None:
        """Adds to ``s`` the rows that its queries want, with other ids than the anchor's; ``anchors`` are whole numbers."""
        if not self.start or not len(s.anchor):
            return
        exact = np.float64 if self.largest * int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1]) < EXACT else np.int64
        a = anchors.astype(np.float64)
        length = np.sqrt((a * a).sum(1))
        label = labels[s.anchor]
        low, high = s.low / 100.0, s.high / 100.0
        s.leaves += sum(c is None for c in self.child) * len(s.anchor)
        todo = [(0, np.arange(len(s.anchor)))]
        while todo:
            k, active = todo.pop()
            who = s.anchor[active]
            middle = (a @ self.center[k])[who]
            reach = length[who] * self.radius[k]
            slack = 1e-9 * (np.abs(middle) + reach + length[who] * np.abs(self.center[k]).sum()) + 1e-6  # of rounding
            top, bottom = middle + reach + slack, middle - reach - slack
            fits = (self.least[k] <= label[active]) & (label[active] <= self.most[k]) if s.same else ~((self.least[k] == label[active]) & (self.most[k] == label[active]))
            stay = fits & (top >= low[active]) & (bottom <= high[active]) & (top >= s.kth[active])
            active = active[stay]
            if not len(active):
                continue
            if self.child[k] is None:
                self._compare(k, active, anchors.astype(exact), label, own_ids, s)
                continue
            mean = a[s.anchor[active]].mean(0)
            # The child whose center is nearer to what is wanted is visited first, so that the k-th score rises soon.
            todo += [(c, active) for c in sorted(self.child[k], key=lambda c: float(mean @ self.center[c]))]

    def _compare(self, k: int, active: np.ndarray, anchors: np.ndarray, label: np.ndarray, own_ids: np.ndarray, s: Search) -> None:
        part = slice(self.start[k], self.stop[k])
        s.visited += len(active)
        who, place = np.unique(s.anchor[active], return_inverse=True)
        product = (anchors[who] @ self.rows[part].astype(anchors.dtype).T)[place]  # whole numbers, exact
        scaled = product * 100
        equal = self.labels[part] == label[active][:, None]
        want = (equal if s.same else ~equal) & (scaled >= s.low[active][:, None]) & (scaled <= s.high[active][:, None]) & (product >= s.kth[active][:, None]) & (self.ids[part] != own_ids[s.anchor[active]][:, None])
        q, r = np.nonzero(want)
        if len(q):
            s.offer(active[q], product[q, r].astype(np.int64), self.ids[part][r])


def needed(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among the best k of any anchor: of rows of equal label and vector those of the smallest ids.

    They have equal scores, so ids decide. An anchor may have to pass over rows of its own id, so as many more stay
    as rows share an id.
    """
    if not len(ids):
        return np.zeros(0, bool)
    factors = np.random.default_rng(0).integers(1, 2**62, rows.shape[1], dtype=np.int64) * 2 + 1
    mixed = (rows * factors).sum(1)
    order = np.lexsort((ids, labels, mixed))
    i, lab, own = ids[order], labels[order], rows[order]
    new = np.r_[True, (mixed[order][1:] != mixed[order][:-1]) | (lab[1:] != lab[:-1]) | (own[1:] != own[:-1]).any(1)]
    again = ~new & np.r_[False, i[1:] == i[:-1]]
    run = np.cumsum(new) - 1
    first_of_id = np.maximum.accumulate(np.where(again, 0, np.arange(len(i))))
    most = np.zeros(run[-1] + 1, np.int64)
    np.maximum.at(most, run, np.arange(len(i)) - first_of_id + 1)
    rank = np.arange(len(i)) - np.flatnonzero(new)[run]
    out = np.zeros(len(i), bool)
    out[order] = rank < k + most[run]
    return out


# ---- tables


def _taking_part(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    return out.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & is_finite_vector(F.col("v")))


def _blocked(dimension: int, block: int):
    """Rows (part, id, label, v, lists of whole numbers...) to packed blocks of one part each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, whole = scaled_vectors(b.column(3), dimension)
            part, ids, label = (b.column(k).to_numpy(zero_copy_only=False)[keep] for k in range(3))
            extra = [[x for x, k in zip(c.to_pylist(), keep.tolist(), strict=True) if k] for c in b.columns[4:]]
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else []
            for s, e in zip(edges, [*edges[1:], len(order)], strict=True):
                for at in range(s, e, block):
                    some = order[at : min(at + block, e)]
                    lists = [[extra[j][r] for r in some] for j in range(len(extra))]
                    flat = [np.array([x for r in col for x in r], "<i8") for col in lists]
                    sizes = np.array([len(r) for r in lists[0]], "<i8") if lists else np.zeros(0, "<i8")
                    raw = packed(ids[some].astype("<i8"), label[some].astype("<i8"), whole[some].astype("<i4").ravel(), sizes, *(flat or [np.zeros(0, "<i8")] * 2))
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[some[0]])], pa.int32()), pa.array([raw], pa.binary())], ["part", "block"])

    return scan


def _unblocked(raw: bytes, dimension: int) -> tuple[np.ndarray, ...]:
    ids, labels, whole, *lists = unpacked(raw, "<i8", "<i8", "<i4", "<i8", "<i8", "<i8")
    return (ids, labels, whole.reshape(len(ids), dimension).astype(np.int64), *lists)


def _searched(rows: DataFrame, anchors: DataFrame, dimension: int, groups: int, same: bool, k: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score, id, score): the best k of each group for each anchor, or for each anchor and positive.

    ``anchors`` has (id, label, v) and, with a window (percent of the positive's score), the lists positives and
    scores; place counts those from 1. Without one, place, positive_id and positive_score are null.
    """
    lists = ["positives", "scores"] if window else []
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("part"), "id", "label", "v").mapInArrow(lean(_blocked(dimension, LEAF * 16)), "part int, block binary")
    asked = anchors.select(F.lit(0).alias("part"), "id", "label", "v", *lists).mapInArrow(lean(_blocked(dimension, BLOCK)), "part int, block binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("kind"), "block")
    both = dealt.select("part", F.lit(0).alias("kind"), "block").unionByName(asked).repartition(groups, "part").sortWithinPartitions("part", "kind")

    def answers(tree: BallTree, raw: bytes) -> pa.RecordBatch:
        ids, labels, whole, sizes, positives, scores = _unblocked(raw, dimension)
        if window:
            anchor, n = np.repeat(np.arange(len(ids)), sizes), len(positives)
            s = Search(anchor, same, window[0] * scores, window[1] * scores, k)
        else:
            n = len(ids)
            s = Search(np.arange(n), same, np.full(n, -(2**62)), np.full(n, 2**62), k)
        tree.search(whole, labels, ids, s)
        none = pa.nulls(len(s.query), pa.int64())
        own = [none, none, none]
        if window:
            place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            own = [pa.array(x[s.query]) for x in (place, positives, scores)]
        return pa.RecordBatch.from_arrays([pa.array(ids[s.anchor[s.query]]), *own, pa.array(s.id), pa.array(s.score)], ["anchor_id", "place", "positive_id", "positive_score", "id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, tree = None, [], None
        for b in batches:
            for p, kind, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != part:
                    part, held, tree = p, [], None
                if kind == 0:
                    held.append(_unblocked(raw, dimension)[:3])
                elif held or tree:
                    if tree is None:
                        all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
                        some = needed(*all_, k)
                        tree, held = BallTree(*[x[some] for x in all_]), []
                    yield answers(tree, raw)

    return both.mapInArrow(lean(scan), "anchor_id long, place long, positive_id long, positive_score long, id long, score long")


def mine_hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that the condition ``anchors`` on the id picks.

    A score is the inner product of vectors whose components are floor(256 * x). An anchor's positives are its best
    ``positives`` rows of the same label; of each, the best ``negatives`` rows of other labels are given whose score
    is ``window`` percent of the positive's, ends included. Higher scores come first, ties by the smaller id. Fewer
    rows where there are fewer; an anchor without positives, or positives without negatives, give none.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part, nor do
    vectors of another length than that of the smallest id's row has. Components beyond 16384 count as 16384. Rows
    with the anchor's own id are neither its positives nor its negatives; of anchors that share an id the one of the
    smallest label, then vector, counts. Other repeated rows count as often as they come. No rows give no rows.

    The anchors are searched against all rows, in blocks. Groups hold GROUP_BYTES of vectors; a group's best few an
    anchor are shuffled, and nothing but counts passes through the driver.
    """
    spark = rows.sparkSession
    rows = _taking_part(rows, id_col, vector_col, label_col)
    n, dimension = rows.agg(F.count(F.lit(1)), F.min_by(F.size("v"), F.struct("id", "v"))).first()
    dimension = dimension or 0
    # Every group answers every anchor, so there are no more than cores have use for, but of bounded size.
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_ROWS)), -(-n * max(1, dimension) * 8 // GROUP_BYTES))
    rows = rows.filter(F.size("v") == dimension)
    chosen = rows.filter(anchors(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    best = _searched(rows, chosen, dimension, groups, True, positives, None)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= positives)
    folded = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most ``positives`` an anchor
    found = materialise(folded.select(F.col("anchor_id").alias("id"), F.col("p.id").alias("positives"), F.col("p.score").alias("scores")), "positives")
    asked = materialise(chosen.join(found, "id"), "anchors")
    worst = _searched(rows, asked, dimension, groups, False, negatives, window)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id"))
    worst = worst.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return worst.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
