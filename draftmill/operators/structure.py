"""Structural comparison: grids of gradient histograms, matched under small shifts, and two-stage search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean
from .vector import nearest

#: Energy that a cell needs in both images, and guards of divisions.
LEAST_ENERGY, EPS = 1e-4, 1e-6
SHIFTS = 2
#: Numbers of the descriptors that a task compares at a time.
CELLS = 500_000


def grid_descriptor(gray: np.ndarray, gx: int = 20, gy: int = 50, bins: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """([gy, gx, bins] unit histograms, [gy, gx] energies) of a gray image (0 to 255).

    Gradients are 3x3 Sobel correlations with mirrored borders (the border pixel isn't repeated). Signed angles
    fall into ``bins`` and weigh their magnitudes. Cells of the last row and column take the remainder; cells
    of too little energy stay zero.
    """
    g = np.pad(np.asarray(gray, np.float64) / 255.0, 1, "reflect")
    smooth_y, smooth_x = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dx, dy = smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]
    magnitude = np.sqrt(dx * dx + dy * dy) + EPS
    slot = np.clip(((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * bins).astype(int), 0, bins - 1)
    h, w = magnitude.shape
    rows, columns = np.minimum(np.arange(h) // max(1, h // gy), gy - 1), np.minimum(np.arange(w) // max(1, w // gx), gx - 1)
    cell = (rows[:, None] * gx + columns[None]) * bins + slot
    sums = np.bincount(cell.ravel(), magnitude.ravel(), gy * gx * bins).reshape(gy, gx, bins)
    energy = sums.sum(-1)
    unit = sums / (np.sqrt((sums**2).sum(-1, keepdims=True)) + EPS)
    unit[energy < LEAST_ENERGY] = 0
    return unit, energy


DESCRIPTOR = "features array<double>, energies array<double>"


def describe(images: DataFrame, gx: int = 20, gy: int = 50, bins: int = 9, id_col: str = "id") -> DataFrame:
    """(id, features, energies), flat by row, column and bin, of images (id, height int, width int, pixels array of numbers).

    Images without pixels or with a wrong count of them are left out.
    """
    rows = images.filter("height > 0 and width > 0 and size(pixels) = height * width").select(F.col(id_col).cast("long").alias("id"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("pixels").cast("array<double>"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features, energies = [], []
            for h, w, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                f, e = grid_descriptor(p.values.to_numpy(zero_copy_only=False).reshape(h, w), gx, gy, bins)
                features.append(f.ravel())
                energies.append(e.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features, pa.list_(pa.float64())), pa.array(energies, pa.list_(pa.float64()))], ["id", "features", "energies"])

    return rows.mapInArrow(scan, f"id long, {DESCRIPTOR}").withColumnRenamed("id", id_col)


def shift_scores(fa: np.ndarray, ea: np.ndarray | None, fb: np.ndarray, eb: np.ndarray | None, most: int = SHIFTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, dy, dx) of the best shifts of many pairs; features [pair, row, column, bin], energies [pair, row, column].

    A shift moves the first of a pair by (dy, dx) cells; the score is the mean similarity of the cells that lie on
    each other, weighed by the lesser of both energies where that is enough. Without energies all cells that lie on
    each other weigh the same. The first in ascending (dy, dx) is taken among the best.
    """
    n, gy, gx = fa.shape[:3]
    best = np.full(n, -1.0)
    found = np.zeros((2, n), np.int32)
    for dy in range(-min(most, gy - 1), min(most, gy - 1) + 1):
        for dx in range(-min(most, gx - 1), min(most, gx - 1) + 1):
            if ea is None or eb is None:
                score = _laid(fa, fb, dy, dx)[0].mean((1, 2))
            else:
                similar, weight = _overlaid(fa, ea, fb, eb, dy, dx)
                total = weight.sum((1, 2))
                score = np.where(total > 0, (similar * weight).sum((1, 2)) / (total + EPS), 0.0)
            # Scores equal to nine digits count as tied, so that the order of sums doesn't decide.
            better = np.round(score, 9) > np.round(best, 9)
            best[better] = score[better]
            found[:, better] = [[dy], [dx]]
    return np.maximum(best, 0.0), found[0], found[1]


def _laid(fa: np.ndarray, fb: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, tuple, tuple]:
    """Similarities of the cells that lie on each other under a shift, and where those are in both grids."""
    gy, gx = fa.shape[1:3]
    a = np.s_[:, max(0, dy) : gy + min(0, dy), max(0, dx) : gx + min(0, dx)]
    b = np.s_[:, max(0, -dy) : gy - max(0, dy), max(0, -dx) : gx - max(0, dx)]
    return np.einsum("pyxk,pyxk->pyx", fa[a], fb[b]), a, b


def _overlaid(fa: np.ndarray, ea: np.ndarray, fb: np.ndarray, eb: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and weights (0: too little energy) of the cells that lie on each other under a shift."""
    similar, a, b = _laid(fa, fb, dy, dx)
    weight = np.minimum(ea[a], eb[b])
    return similar, np.where(weight > LEAST_ENERGY, weight, 0.0)


def similarity_map(fa: np.ndarray, ea: np.ndarray, fb: np.ndarray, eb: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Similarities of one pair's cells under a shift, -1 where a cell doesn't count."""
    similar, weight = _overlaid(fa[None], ea[None], fb[None], eb[None], dy, dx)
    return np.where(weight > 0, similar, -1.0)[0]


def match_structure(pairs: DataFrame, described: DataFrame, gx: int, gy: int, bins: int, most: int = SHIFTS, a: str = "query_id", b: str = "rule_id", id_col: str = "id", described_rules: DataFrame | None = None) -> DataFrame:
    """``pairs`` with structure double, dy int, dx int from the descriptors of both sides.

    Pairs without features are left out. Where a side has no energies (null, or no such column), a shift's score is
    the plain mean of its cells' similarities.
    """
    energies = lambda d: F.col("energies") if "energies" in d.columns else F.lit(None).cast("array<double>")
    own = lambda d, name: d.filter("features is not null").select(F.col(id_col).alias(f"_{name}"), F.col("features").alias(f"_f{name}"), energies(d).alias(f"_e{name}"))
    joined = pairs.join(own(described, "a"), F.col(a) == F.col("_a")).join(own(described_rules if described_rules is not None else described, "b"), F.col(b) == F.col("_b"))
    names = pairs.columns
    source = joined.select(*names, "_fa", "_ea", "_fb", "_eb")
    n = len(names)

    step = max(1, CELLS // (gx * gy * bins))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                weighed = pc.and_(some.column(n + 1).is_valid(), some.column(n + 3).is_valid())
                for part, plain in ((some.filter(weighed), False), (some.filter(pc.invert(weighed)), True)):
                    if len(part):
                        grid = lambda k, part=part: part.column(n + k).flatten().to_numpy(zero_copy_only=False).reshape(len(part), gy, gx, -1)
                        found = shift_scores(grid(0), None, grid(2), None, most) if plain else shift_scores(grid(0), grid(1)[..., 0], grid(2), grid(3)[..., 0], most)
                        yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(n)], *map(pa.array, found)], [*names, "structure", "dy", "dx"])

    schema = T.StructType([*pairs.schema.fields, T.StructField("structure", T.DoubleType()), T.StructField("dy", T.IntegerType()), T.StructField("dx", T.IntegerType())])
    return source.mapInArrow(lean(scan), schema)


def recognise(queries: DataFrame, rules: DataFrame, k: int = 3, gx: int = 20, gy: int = 50, bins: int = 9, weight: float = 0.8, id_col: str = "id") -> DataFrame:
    """(query_id, rank, rule_id, distance, structure, dy, dx, blended): the k best after a structural second look.

    max(8 k, 32) candidates a query come from exact search by embedding; they are ordered by
    ``weight * (1 - structure) + (1 - weight) * distance``, then by their coarse rank. Both tables hold id,
    embedding, features, energies. An empty store gives no rows; rules without features aren't candidates.
    """
    complete = rules.filter("features is not null")
    coarse = nearest(queries, complete, max(8 * k, 32), id_col).withColumnRenamed("rank", "coarse_rank")
    matched = match_structure(coarse, queries, gx, gy, bins, id_col=id_col, described_rules=complete)
    blended = matched.withColumn("blended", weight * (1 - F.col("structure")) + (1 - weight) * F.col("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("blended", 9), "coarse_rank"))
    return blended.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "rule_id", "distance", "structure", "dy", "dx", "blended")
