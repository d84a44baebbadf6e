"""Thresholds and thinning of images that exceed a task: prefix sums along rows and columns, and blocks that exchange rims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .raster import RUN, _runs, merged_runs, thinning_pass

# ---- local thresholds


def _mirrored(place: str, side: str, radius: Column, repeat: Column) -> Column:
    """Where a pixel stands in a row that is continued by ``radius`` beyond both ends: mirrored about the border pixel, or the border pixel repeated."""
    at, last = F.col(place), F.col(side) - 1
    mirror = F.array_distinct(F.filter(F.array(at, -at, 2 * last - at), lambda p: (p >= -radius) & (p <= last + radius)))
    before = F.when((at == 0) & (radius > 0), F.sequence(-radius, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    after = F.when((at == last) & (radius > 0), F.sequence(last + 1, last + radius)).otherwise(F.array().cast("array<int>"))
    return F.when(repeat, F.concat(F.array(at), before, after)).otherwise(mirror)


def _window_sums(rows: DataFrame, line: list[str], along: str, side: str) -> DataFrame:
    """s and q of ``rows`` (line, along, width, height, radius, repeat, s, q) summed over 2 radius + 1 neighbours along each line.

    The prefix sum that ends at p counts for the window around p - radius and against that around p + radius + 1.
    """
    spread = rows.withColumn("_p", F.explode(_mirrored(along, side, F.col("radius"), F.col("repeat"))))
    upto = Window.partitionBy(*line).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    keep = ["width", "height", "radius", "repeat"]
    sums = spread.select(*line, "_p", *keep, F.sum("s").over(upto).alias("s"), F.sum("q").over(upto).alias("q"))
    end = lambda sign, at: F.struct(at.alias("at"), (sign * F.col("s")).alias("s"), (sign * F.col("q")).alias("q"))
    ends = sums.select(*line, *keep, F.explode(F.array(end(1, F.col("_p") - F.col("radius")), end(-1, F.col("_p") + F.col("radius") + 1))).alias("e"))
    ends = ends.filter((F.col("e.at") >= 0) & (F.col("e.at") < F.col(side)))
    # The window has dealt out the lines, so this fold needs no further shuffle.
    return ends.groupBy(*line, F.col("e.at").alias(along), *keep).agg(F.sum("e.s").alias("s"), F.sum("e.q").alias("q"))


def sauvola_thresholds(pixels: DataFrame, sizes: DataFrame, window, k: float = 0.16, spread: float = 128.0) -> DataFrame:
    """(image, y, x, v, threshold) for every pixel (image, y, x, v: whole numbers): m * (1 + k * (s / spread - 1)) over a window around it.

    ``sizes`` has (image, width, height); ``window`` is an odd number or a column of ``sizes``. Borders are mirrored,
    or repeated in images that are not larger than half a window, as ``raster.sauvola`` does on whole images. Sums are of whole numbers, exact,
    and go over rows, then over columns, so a task holds a few lines of an image. Pixels of unknown images are left out.
    """
    w = window if isinstance(window, Column) else F.lit(window)
    half = F.floor(w / 2).cast("int")
    known = sizes.select("image", "width", "height", half.alias("radius"), (F.least("width", "height") <= half).alias("repeat"))
    v = F.col("v").cast("long")
    rows = pixels.join(known, "image").select("image", "y", "x", "width", "height", "radius", "repeat", v.alias("s"), (v * v).alias("q"))
    sums = _window_sums(_window_sums(rows, ["image", "y"], "x", "width"), ["image", "x"], "y", "height")
    n = (2 * F.col("radius") + 1) * (2 * F.col("radius") + 1)
    mean = F.col("s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - mean * mean))
    found = sums.select("image", "y", "x", (mean * (1 + k * (deviation / spread - 1))).alias("threshold"))
    return pixels.join(found, ["image", "y", "x"]).select("image", "y", "x", "v", "threshold")


def sauvola_binarised(pixels: DataFrame, sizes: DataFrame, window, k: float = 0.16, spread: float = 128.0) -> DataFrame:
    """(image, y, x, v, threshold, white): 255 above the local threshold, else 0, turned over in images darker than 128 on average after it."""
    white = sauvola_thresholds(pixels, sizes, window, k, spread).withColumn("white", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0))
    dark = white.groupBy("image").agg((F.avg("white") < 128).alias("dark"))
    return white.join(dark, "image").select("image", "y", "x", "v", "threshold", F.when(F.col("dark"), 255 - F.col("white")).otherwise(F.col("white")).alias("white"))


# ---- thinning

#: Side of a block, and passes over it between two exchanges of rims. A pass looks two pixels far.
SIDE, PASSES = 256, 8
_BLOCK = "image string, by int, bx int, bits binary, changed boolean"


def _strip(d: int, side: int, rim: int) -> slice:
    """What a block gives to the neighbour in direction ``d`` along one axis: its last rows, all, or its first."""
    return slice(side - rim, side) if d > 0 else slice(0, rim) if d < 0 else slice(0, side)


def _where(d: int, side: int, rim: int) -> slice:
    """Where a piece that came in direction ``d`` lies in the widened block."""
    return slice(0, rim) if d > 0 else slice(rim + side, 2 * rim + side) if d < 0 else slice(rim, rim + side)


def _blocks(runs: DataFrame, side: int) -> DataFrame:
    """Blocks with ink, as bits by rows, of runs."""
    cut = runs.select(F.col("image").cast("string").alias("image"), F.floor(F.col("y") / side).cast("int").alias("by"), (F.col("y") % side).cast("int").alias("y"), F.explode(F.sequence(F.floor(F.col("x0") / side).cast("int"), F.floor(F.col("x1") / side).cast("int"))).alias("bx"), "x0", "x1")
    first = F.greatest(F.lit(0), F.col("x0") - F.col("bx") * side)
    last = F.least(F.lit(side - 1), F.col("x1") - F.col("bx") * side)
    # A block has at most side * side / 2 runs.
    held = cut.groupBy("image", "by", "bx").agg(F.collect_list(F.struct("y", first.cast("int").alias("x0"), last.cast("int").alias("x1"))).alias("runs"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for own in b.column(3):
                y, x0, x1 = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                edge = np.zeros((side, side + 1), np.int32)
                np.add.at(edge, (y, x0), 1)
                np.add.at(edge, (y, x1 + 1), -1)
                bits.append(np.packbits(edge.cumsum(1)[:, :side] > 0).tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(bits, pa.binary()), pa.array([True] * len(b))], ["image", "by", "bx", "bits", "changed"])

    return held.mapInArrow(scan, _BLOCK)


def _exchanged(blocks: DataFrame, side: int, passes: int) -> DataFrame:
    """Blocks after so many passes of thinning, each with the rims of its neighbours, which are wide enough that they need not be exact."""
    rim = 2 * passes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, by, bx, bits, changed in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ink = np.unpackbits(np.frombuffer(bits, np.uint8), count=side * side).reshape(side, side)
                out = []
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        part = ink[_strip(dy, side, rim), _strip(dx, side, rim)]
                        if part.any() or (dy, dx) == (0, 0):
                            out.append((image, by + dy, bx + dx, dy, dx, np.packbits(part).tobytes(), changed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["image", "by", "bx", "dy", "dx", "bits", "changed"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, by, bx, pieces in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = next((p["bits"] for p in pieces if p["dy"] == p["dx"] == 0), None)
                if own is None:  # rims of neighbours alone: no ink here, and thinning adds none
                    continue
                if not any(p["changed"] for p in pieces):
                    rows.append((image, by, bx, own, False))
                    continue
                wide = np.zeros((side + 2 * rim,) * 2, bool)
                for p in pieces:
                    at = wide[_where(p["dy"], side, rim), _where(p["dx"], side, rim)]
                    at[...] = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=at.size).reshape(at.shape)
                core = np.s_[rim : rim + side, rim : rim + side]
                before = wide[core].copy()
                for _ in range(passes):
                    thinning_pass(wide)
                if wide[core].any():
                    rows.append((image, by, bx, np.packbits(wide[core]).tobytes(), bool((wide[core] != before).any())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["image", "by", "bx", "bits", "changed"])

    sent = blocks.mapInArrow(send, "image string, by int, bx int, dy int, dx int, bits binary, changed boolean")
    # At most nine pieces a block.
    met = sent.groupBy("image", "by", "bx").agg(F.collect_list(F.struct("dy", "dx", "bits", "changed")).alias("pieces"))
    return met.mapInArrow(receive, _BLOCK)


def thinned_runs(runs: DataFrame, side: int = SIDE, passes: int = PASSES) -> DataFrame:
    """Runs (image string, y, x0, x1) thinned to lines of one pixel, as ``raster.thinned`` does on whole images.

    Each round a block takes the rims of its neighbours, wide enough for ``passes`` passes, and thins itself; rounds
    go on until no block changes. Blocks whose surroundings are at rest aren't thinned again. No task holds an image.
    """
    if side % 8 or 2 * passes > side:
        raise ValueError("a block's side must be a multiple of 8 and hold a rim of two pixels a pass")
    state = materialise(_blocks(runs, side), "blocks")
    while not state.filter("changed").isEmpty():
        state = materialise(_exchanged(state, side, passes), "blocks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, by, bx, bits in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                y, x0, x1 = _runs(np.unpackbits(np.frombuffer(bits, np.uint8), count=side * side).reshape(side, side))
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(y), pa.string()), pa.array(by * side + y, pa.int32()), pa.array(bx * side + x0, pa.int32()), pa.array(bx * side + x1, pa.int32())], ["image", "y", "x0", "x1"])

    return merged_runs(state.mapInArrow(scan, RUN))
