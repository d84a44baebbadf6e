"""Maps of vectors in the plane by stochastic neighbours (van der Maaten and Hinton, 2008): sparse affinities and a layout.

Affinities are between nearest neighbours. The layout goes down in a fixed number of rounds from places that are
hashed from ids; each round is a table. Links pull, and a grid of cells of bounded size stands for all points that push.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .vector import nearest

#: Steps of the bisection, cells along one side of the grid, and how much stronger links pull at first.
STEPS, CELLS, EARLY = 64, 32, 12.0


def bandwidths(squared: np.ndarray, perplexity: float) -> np.ndarray:
    """The factor of squared distances [point, neighbour] at which each point's neighbours have that perplexity, by bisection."""
    apart = squared - squared.min(1, keepdims=True)
    beta, low, high = np.ones(len(squared)), np.zeros(len(squared)), np.full(len(squared), np.inf)
    for _ in range(STEPS):
        p = np.exp(-apart * beta[:, None])
        total = p.sum(1)
        entropy = np.log(total) + beta * (apart * p).sum(1) / total
        flat = entropy > np.log(perplexity)
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return beta


def affinities(rows: DataFrame, perplexity: float = 30.0, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, p) for linked points, in both directions; all p sum to one.

    The perplexity is at most n - 1 and at least 1; a point's neighbours are its min(n - 1, 3 * perplexity) nearest, ties
    by smaller id. Ids must tell rows apart. Null ids and vectors are left out; fewer than two points have no links.
    """
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    n = rows.count()
    perplexity = max(1.0, min(n - 1, perplexity))
    k = int(min(n - 1, 3 * perplexity))
    if n < 2:
        return rows.sparkSession.createDataFrame([], "a long, b long, p double")
    near = nearest(rows, rows, k + 1, id_col, vector_col).filter("query_id <> rule_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("_k", place).filter(F.col("_k") <= k)
    lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_k", "rule_id", "distance"))).alias("m")).select("query_id", F.col("m.rule_id").alias("ids"), F.col("m.distance").alias("d"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            squared = b.column(2).flatten().to_numpy().reshape(len(b), -1) ** 2
            p = np.exp(-(squared - squared.min(1, keepdims=True)) * bandwidths(squared, perplexity)[:, None])
            p /= p.sum(1, keepdims=True) * (2 * n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), squared.shape[1])), b.column(1).flatten(), pa.array(p.ravel())], ["a", "b", "p"])

    half = lists.mapInArrow(scan, "a long, b long, p double")
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
    return both.groupBy("a", "b").agg(F.sum("p").alias("p"))


def _push(cells: np.ndarray, low: np.ndarray, width: np.ndarray):
    """Per point, from cells [y * CELLS + x] of (count, sum x, sum y): the push of all other points, and its share of the norm."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(cells[:, 0])
        for b in batches:
            if not len(b):
                continue
            at = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            own = _cell(at, low, width)
            push, norm = np.zeros_like(at), np.zeros(len(at))
            for c in used:
                mine = (own == c)[:, None]
                count = cells[c, 0] - mine[:, 0]
                mean = (cells[c, 1:] - np.where(mine, at, 0)) / np.maximum(count, 1)[:, None]
                gap = at - mean
                q = 1 / (1 + (gap * gap).sum(1))
                norm += count * q
                push += (count * q * q)[:, None] * gap
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(push[:, 0]), pa.array(push[:, 1]), pa.array(norm)], ["id", "x", "y", "vx", "vy", "rx", "ry", "z"])

    return scan


def _cell(at: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    c = np.clip(((at - low) / width).astype(int), 0, CELLS - 1)
    return c[:, 1] * CELLS + c[:, 0]


def plane_layout(links: DataFrame, rounds: int = 250, seed: int = 0, rate: float | None = None) -> DataFrame:
    """(id, x, y) of all points that have links (a, b, p), after ``rounds`` rounds; equal links, seed and rounds give equal places up to rounding.

    In the first quarter links pull EARLY times as strong. Only CELLS * CELLS cells, and sums, pass through the driver.
    """
    links = materialise(links, "links")
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.02
    state = links.select(F.col("a").alias("id")).distinct().select("id", unit(1).alias("x"), unit(2).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    state = materialise(state, "places")
    n = state.count()
    rate = rate or n / (4 * EARLY)  # four is the factor of the gradient: larger steps overshoot while links pull strongly
    for k in range(rounds if n else 0):
        early = k < rounds // 4
        lo_x, hi_x, lo_y, hi_y = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        low = np.array([lo_x, lo_y])
        width = np.maximum(np.array([hi_x, hi_y]) - low, 1e-9) / CELLS
        side = lambda c, j: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), ((F.col(c) - float(low[j])) / float(width[j])).cast("int")))  # noqa: B023, E731
        found = state.groupBy((side("y", 1) * CELLS + side("x", 0)).alias("c")).agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))
        cells = np.zeros((CELLS * CELLS, 3))
        for c, *values in found.collect():
            cells[c] = values
        end = lambda name: state.select(F.col("id").alias(name), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}"))  # noqa: B023, E731
        ends = links.join(end("a"), "a").join(end("b"), "b")
        gap = [F.col(f"{c}a") - F.col(f"{c}b") for c in "xy"]
        weight = F.col("p") / (1 + gap[0] * gap[0] + gap[1] * gap[1])
        pull = ends.groupBy(F.col("a").alias("id")).agg(*[F.sum(weight * g).alias(f"p{c}") for g, c in zip(gap, "xy", strict=True)])
        pushed = state.mapInArrow(_push(cells, low, width), "id long, x double, y double, vx double, vy double, rx double, ry double, z double")
        forces = materialise(pushed.join(pull, "id"), "forces")
        norm = forces.agg(F.sum("z")).first()[0] or 1.0
        keep, strong = (0.5, EARLY) if early else (0.8, 1.0)
        speed = {c: keep * F.col(f"v{c}") - rate * 4 * (strong * F.col(f"p{c}") - F.col(f"r{c}") / norm) for c in "xy"}
        state = forces.select("id", (F.col("x") + speed["x"]).alias("x"), (F.col("y") + speed["y"]).alias("y"), speed["x"].alias("vx"), speed["y"].alias("vy"))
    return state.select("id", "x", "y")
