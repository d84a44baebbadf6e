"""Rasters as tables: thresholds, straight lines as runs, nets as components of runs, and where they meet devices.

A raster is one row (image, height, width, pixels) or, exploded, one row a pixel (image, y, x, v). What needs a
neighbourhood of pixels runs in numpy over whole images; all that follows is SQL over runs (image, y, x0, x1), x1
included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as bx
from ..session import materialise
from . import ordered
from .cleanup import of_classes
from .graph import connected_components, graph_json, shared_net_pairs
from .tiling import centers_in_regions

RUN = "image string, y int, x0 int, x1 int"
#: Side of the blocks in which runs are joined first, in pixels.
BLOCK = 256
#: Rows of a band to which an image's size is dealt.
BAND = 16


# ---- pixels


def gray_pixels(images: DataFrame) -> DataFrame:
    """(image, height, width, pixels array<int>) of rows of Spark's image source; undecodable files are left out.

    Colours weigh 0.299 red, 0.587 green, 0.114 blue, rounded.
    """
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").filter("height > 0 and width > 0")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, data in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n)
                out.append(raw[:, 0].astype(np.int32) if n == 1 else np.rint(raw[:, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], ["image", "height", "width", "pixels"])

    return rows.mapInArrow(scan, "image string, height int, width int, pixels array<int>")


def colour_pixels(images: DataFrame, threshold: int | None = None) -> DataFrame:
    """(image, height, width, r, g, b) of rows of Spark's image source, each colour an array<int>; a gray image has three equal ones.

    With a ``threshold``, all three are 255 where the gray value is above it, else 0.
    """
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").filter("height > 0 and width > 0")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [])
            for n, data in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n).astype(np.int32)
                bgr = [raw[:, 0]] * 3 if n == 1 else [raw[:, k] for k in range(3)]
                if threshold is not None:
                    gray = bgr[0] if n == 1 else np.rint(raw[:, :3] @ np.array([0.114, 0.587, 0.299]))
                    bgr = [np.where(gray > threshold, 255, 0).astype(np.int32)] * 3
                for k in range(3):
                    out[k].append(bgr[2 - k])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], *[pa.array(c, pa.list_(pa.int32())) for c in out]], ["image", "height", "width", "r", "g", "b"])

    return rows.mapInArrow(scan, "image string, height int, width int, r array<int>, g array<int>, b array<int>")


def exploded(rasters: DataFrame) -> DataFrame:
    p = rasters.select("image", "width", F.posexplode("pixels").alias("k", "v"))
    return p.select("image", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), "v")


def otsu_thresholds(pixels: DataFrame, image_col: str = "image", value_col: str = "v") -> DataFrame:
    """(image, threshold): the gray level that best parts an image's histogram; the lowest among the best.

    Pixels fold into at most 256 counts an image first; the rest is over those.
    """
    h = pixels.groupBy(image_col, value_col).agg(F.count(F.lit(1)).cast("double").alias("n"))
    upto = Window.partitionBy(image_col).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image_col)
    s = h.select(image_col, F.col(value_col).alias("t"), F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col(value_col)).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col(value_col)).over(whole).alias("s"))
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.when(F.col("w0") < F.col("w"), F.col("w0") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1)).otherwise(0.0)
    return s.groupBy(image_col).agg(F.min_by("t", F.struct(-between, F.col("t"))).alias("threshold"))


def binarised(pixels: DataFrame, thresholds: DataFrame, image_col: str = "image", value_col: str = "v") -> DataFrame:
    """``pixels`` with white (255 above the image's threshold, else 0), turned over in images darker than 128 on average after it."""
    joined = pixels.join(thresholds, image_col).withColumn("white", F.when(F.col(value_col) > F.col("threshold"), 255).otherwise(0))
    mean = joined.groupBy(image_col).agg((F.avg("white") < 128).alias("dark"))
    return joined.join(mean, image_col).withColumn("white", F.when(F.col("dark"), 255 - F.col("white")).otherwise(F.col("white"))).drop("threshold", "dark")


def content_boxes(pixels: DataFrame, sizes: DataFrame, white_background: bool = True, limit: int | None = None) -> DataFrame:
    """(image, x1, y1, x2, y2), right and bottom left out: the box of pixels that aren't background; without any the whole image."""
    seen = F.col("v") < (limit if limit is not None else 245) if white_background else F.col("v") > (limit if limit is not None else 10)
    box = pixels.filter(seen).groupBy("image").agg(F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    joined = sizes.join(box, "image", "left")
    return joined.select("image", F.coalesce("a", F.lit(0)).alias("x1"), F.coalesce("b", F.lit(0)).alias("y1"), F.coalesce("c", "width").alias("x2"), F.coalesce("d", "height").alias("y2"))


# ---- kernels on whole images


def _integral(a: np.ndarray) -> np.ndarray:
    return np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def sauvola(gray: np.ndarray, window: int, k: float, spread: float = 128.0) -> np.ndarray:
    """Local thresholds m * (1 + k * (s / spread - 1)) over a window mirrored at the borders (Sauvola and Pietikainen, 2000)."""
    r = window // 2
    g = np.pad(np.asarray(gray, np.float64), r, "reflect" if min(gray.shape) > r else "edge")
    h, w = gray.shape
    total = lambda i: i[2 * r + 1 :, 2 * r + 1 :] - i[: h, 2 * r + 1 :] - i[2 * r + 1 :, : w] + i[: h, : w]
    n = (2 * r + 1) ** 2
    mean = total(_integral(g)) / n
    deviation = np.sqrt(np.maximum(total(_integral(g * g)) / n - mean * mean, 0))
    return mean * (1 + k * (deviation / spread - 1))


def thinning_pass(a: np.ndarray) -> None:
    """Both halves of one pass of thinning, in place, on ink with a rim of at least one pixel that isn't looked at."""
    for first in (True, False):
        n, ne, e, se, s, sw, w, nw = a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]
        ring = np.array([n, ne, e, se, s, sw, w, nw])
        count = ring.sum(0)
        turns = (~ring & np.roll(ring, -1, 0)).sum(0)
        ends = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
        drop = a[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & ends
        a[1:-1, 1:-1] &= ~drop


def thinned(ink: np.ndarray) -> np.ndarray:
    """Lines of one pixel (Zhang and Suen, 1984)."""
    a = np.pad(ink.astype(bool), 1)
    while True:
        before = a.sum()
        thinning_pass(a)
        if a.sum() == before:
            return a[1:-1, 1:-1]


def odd_window(least_side: Column | int, share: float, least: int):
    """max(least, int(share * side) made odd)."""
    if isinstance(least_side, int):
        return max(least, int(share * least_side) | 1)
    return F.greatest(F.lit(least), (least_side * share).cast("int").bitwiseOR(F.lit(1)))


def ink_runs(rasters: DataFrame, method: str = "otsu", share: float = 0.025, least: int = 81, k: float = 0.16, skeleton: bool = False) -> DataFrame:
    """Runs (image, y, x0, x1) of dark pixels after "otsu" or "sauvola" thresholds and the polarity fix.

    One row of ``rasters`` is one image, so a task holds one image at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, h, w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                gray = p.values.to_numpy(zero_copy_only=False).reshape(h, w)
                limit = sauvola(gray, odd_window(min(h, w), share, least), k) if method == "sauvola" else _otsu(gray)
                white = gray > limit
                if white.mean() * 255 < 128:
                    white = ~white
                ink = thinned(~white) if skeleton else ~white
                y, x0, x1 = _runs(ink)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y), pa.string()), pa.array(y, pa.int32()), pa.array(x0, pa.int32()), pa.array(x1, pa.int32())], ["image", "y", "x0", "x1"])

    return rasters.select(F.col("image").cast("string"), "height", "width", "pixels").mapInArrow(scan, RUN)


def _otsu(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel().astype(int), minlength=256).astype(float)
    w0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * (w0[-1] - w0) * (s0 / w0 - (s0[-1] - s0) / (w0[-1] - w0)) ** 2
    return int(np.nan_to_num(between).argmax())


def _runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


# ---- runs


def runs_of(pixels: DataFrame, line: list[str], along: str, least: int = 1) -> DataFrame:
    """(line..., start, end): maximal runs of consecutive ``along`` of at least ``least`` pixels. Repeated pixels count once."""
    fields, kind, width = [pixels.schema[c] for c in line], pixels.schema[along].dataType, len(line)
    schema = T.StructType([*fields, T.StructField("start", kind), T.StructField("end", kind)])
    none = -(1 << 62)  # a null pixel is a run by itself, and comes first in its line

    def found(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
        column = rows.column(width)
        at = ordered.numbers(column.cast(pa.int64()).fill_null(none))
        first = np.flatnonzero(fresh | np.r_[True, at[1:] > at[:-1] + 1])
        start, end = at[first], at[np.r_[first[1:] - 1, len(at) - 1]]
        kept = end - start + 1 >= least
        ends = [pa.array(x[kept], pa.int64(), mask=(x == none)[kept]).cast(column.type) for x in (start, end)]
        return pa.RecordBatch.from_arrays([*[rows.column(k).take(pa.array(first[kept])) for k in range(width)], *ends], [*line, "start", "end"])

    return ordered.by_line(pixels.select(*line, along), line, [along], found, schema)


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def straight_lines(runs: DataFrame, least_x: int | Column, least_y: int | Column) -> DataFrame:
    """Row runs of the pixels in horizontal runs of at least ``least_x`` or vertical ones of at least ``least_y``: numbers, or columns of ``runs``."""
    long_enough = F.col("x1") - F.col("x0") + 1 >= least_x
    flat = runs.filter(long_enough).select("image", "y", "x0", "x1")
    if isinstance(least_y, Column):
        pixels = runs.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"), least_y.alias("_least"))
        tall = runs_of(pixels, ["image", "x", "_least"], "y").filter(F.col("end") - F.col("start") + 1 >= F.col("_least"))
    else:
        tall = runs_of(pixels_of(runs), ["image", "x"], "y", least_y)
    upright = tall.select("image", F.explode(F.sequence("start", "end")).alias("y"), F.col("x").alias("x0"), F.col("x").alias("x1"))
    return merged_runs(flat.unionByName(upright))


def row_runs(pixels: DataFrame) -> DataFrame:
    return runs_of(pixels, ["image", "y"], "x").select("image", "y", F.col("start").alias("x0"), F.col("end").alias("x1"))


def thickened(runs: DataFrame, radius: int, sizes: DataFrame) -> DataFrame:
    """Runs widened by ``radius`` on all sides, inside images (image, width, height)."""
    if radius <= 0:
        return runs
    # Sizes are dealt to bands of rows, so that an image of many runs isn't one key.
    band = lambda y: F.floor(y / BAND)
    bands = sizes.select("image", "width", "height", F.explode(F.sequence(band(F.lit(-radius)), band(F.col("height") - 1 + radius))).alias("_band"))
    parts = ordered.SHARE * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = runs.filter("x0 is not null and x1 is not null").withColumn("_band", band(F.col("y"))).repartition(parts, "image", "_band").join(bands, ["image", "_band"]).filter((F.col("y") >= -radius) & (F.col("y") < F.col("height") + radius))
    wide = near.select("image", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - radius), F.least(F.col("height") - 1, F.col("y") + radius))).alias("y"), F.greatest(F.lit(0), F.col("x0") - radius).alias("x0"), F.least(F.col("width") - 1, F.col("x1") + radius).alias("x1"))
    return merged_runs(wide, ordered.SHARE * (2 * radius + 1))


def merged_runs(runs: DataFrame, share: int = ordered.SHARE) -> DataFrame:
    """Runs that overlap or touch in a row made one, without going through their pixels."""
    own = runs.filter("x0 is not null and x1 is not null").select("image", "y", "x0", "x1")

    def found(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
        start, end, base = ordered.laid_out(fresh, *[ordered.numbers(rows.column(k)) for k in (2, 3)])
        start, end, first = ordered.merged(start, end)
        image, y = (rows.column(k).take(pa.array(first)) for k in (0, 1))
        ends = [pa.array(x - base[first]).cast(rows.column(k).type) for k, x in ((2, start), (3, end))]
        return pa.RecordBatch.from_arrays([image, y, *ends], ["image", "y", "x0", "x1"])

    return ordered.by_line(own, ["image", "y"], ["x0", "x1"], found, own.schema, share)


def _row(rows: DataFrame, kind: int, start: str, end: str, like: DataFrame, **columns: str) -> DataFrame:
    """Intervals of a row, of one kind, in the types of ``like``; those without a place are left out but for kind 0."""
    own = rows.select(F.col("image").cast(like.schema["image"].dataType).alias("image"), F.col("y").cast("int").alias("y"), F.lit(kind).alias("kind"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), *[F.expr(c).alias(n) for n, c in columns.items()])
    return own.filter("image is not null and y is not null and start <= end") if kind else own


def carved(runs: DataFrame, boxes: DataFrame, margin: int = 1) -> DataFrame:
    """Runs less the insides of boxes (image, x1..y2), ``margin`` pixels of their rims left; margin 0 takes all.

    Runs and boxes meet row by row in order; they are never joined, however many boxes a row has.
    """
    inside = boxes.select("image", (F.col("x1") + margin).alias("a"), (F.col("x2") - margin - 1).alias("b"), (F.col("y1") + margin).alias("top"), (F.col("y2") - margin - 1).alias("bottom")).filter("a <= b and top <= bottom")
    holes = inside.select("image", F.explode(F.sequence("top", "bottom")).alias("y"), "a", "b")
    own = runs.select("image", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    every = _row(own, 0, "x0", "x1", own).unionByName(_row(holes, 1, "a", "b", own))

    def found(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
        placed = pc.and_(rows.column(3).is_valid(), rows.column(4).is_valid()).to_numpy(zero_copy_only=False)
        start, end = (ordered.numbers(rows.column(k).fill_null(0)) for k in (3, 4))
        start, end, base = ordered.laid_out(fresh, start, end)
        hole = ordered.numbers(rows.column(2)) == 1
        own, odd = np.flatnonzero(~hole & placed), np.flatnonzero(~placed)
        from_, to, _ = ordered.merged(start[hole], end[hole])
        low, _, count = ordered.meeting(start[own], end[own], from_, to)
        # What is left of a run: from each hole's end to the next hole's start.
        run, part = ordered.paired(np.zeros(len(own), np.int64), count + 1)
        before, behind = part > 0, part < count[run]
        left, right = start[own][run], end[own][run]
        left[before] = to[(low[run] + part - 1)[before]] + 1
        right[behind] = from_[(low[run] + part)[behind]] - 1
        kept = left <= right
        rest = own[run[kept]]
        at = np.r_[rest, odd]
        ends = [pa.array(np.r_[x[kept] - base[rest], np.zeros(len(odd), np.int64)], pa.int32(), mask=np.arange(len(at)) >= len(rest)) for x in (left, right)]
        return pa.RecordBatch.from_arrays([*[rows.column(k).take(pa.array(at)) for k in (0, 1)], *ends], ["image", "y", "x0", "x1"])

    return ordered.by_line(every, ["image", "y"], ["start"], found, own.schema)


def joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """A number for each run of a block, equal for runs that touch (8 neighbours); runs are sorted by (y, x0) and don't overlap."""
    if not len(y):
        return np.zeros(0, np.int64)
    y, x0, x1 = (a.astype(np.int64) for a in (y, x0, x1))
    shift = 1 - x0.min()
    row = x1.max() + shift + 3  # places of one row lie apart from those of the next
    starts, ends = y * row + x0 + shift, y * row + x1 + shift
    low = np.searchsorted(ends, starts + row - 1, "left")
    high = np.searchsorted(starts, ends + row + 1, "right")
    count = np.maximum(high - low, 0)
    up = np.repeat(np.arange(len(y)), count)
    down = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    root = np.arange(len(y))
    while True:
        a, b = root[up], root[down]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _numbered(root: np.ndarray, given: list[int | None]) -> np.ndarray:
    """Numbers of a task's parts that no other task gives; ``given`` holds the next free one."""
    if given[0] is None:
        given[0] = TaskContext.get().partitionId() << 40
    part = root + given[0]
    given[0] += len(root)
    return part


def _at_border(y: np.ndarray, a: np.ndarray, b: np.ndarray, by: np.ndarray, bx: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, x) of the pixels at a block's border: whole pieces of its first and last row, else the ends that lie on its sides."""
    edge = (y == by * side) | (y == by * side + side - 1)
    row, nth = ordered.paired(np.zeros(len(y), np.int64), np.where(edge, b - a + 1, 0))
    left, right = np.flatnonzero(~edge & (a == bx * side)), np.flatnonzero(~edge & (b == bx * side + side - 1) & ((b > a) | (a != bx * side)))
    return np.r_[row, left, right], np.r_[a[row] + nth, a[left], b[right]]


def _met_at_borders(edge: DataFrame, side: int) -> DataFrame:
    """(a, b, dy): parts of ``edge`` (image, y, x, part), pixels at the borders of blocks, that meet there; once for each two pixels that do."""
    later = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = edge.select("image", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("part").alias("a"), later.alias("d"))
    near = near.withColumns({"y": F.col("_y") + F.col("d.dy"), "x": F.col("_x") + F.col("d.dx")})
    near = near.filter((F.floor(F.col("_y") / side) != F.floor(F.col("y") / side)) | (F.floor(F.col("_x") / side) != F.floor(F.col("x") / side)))
    return near.join(edge.select("image", "y", "x", F.col("part").alias("b")), ["image", "y", "x"]).select("a", "b", F.col("d.dy").alias("dy"))


def _renamed(edge: DataFrame, met: DataFrame) -> DataFrame:
    """(part, whole): the name of the net that a part of ``edge`` (part, net) belongs to, where it meets others: the least of theirs."""
    found = connected_components(met.select("a", "b").distinct()).withColumnRenamed("node", "part")
    named = edge.groupBy("part").agg(F.min("net").alias("net")).join(found, "part")
    return named.join(named.groupBy("component").agg(F.min("net").alias("whole")), "component").select("part", "whole")


def nets(runs: DataFrame, side: int = BLOCK) -> DataFrame:
    """``runs`` (of one row each, none touching another of its row) with net long: 8-connected components, named by y * 2^32 + x0 of their first run, which tells them apart in an image.

    Runs are joined inside blocks of ``side`` pixels first, each in one task; only parts of blocks that meet at a
    border are joined after it. So rounds and tables don't grow with the number of runs, nor with a wire's length
    inside a block, and runs of parts that reach no border are done with after one shuffle.
    """
    kind = runs.schema["image"].dataType.simpleString()
    cut = runs.select("image", F.floor(F.col("y") / side).cast("int").alias("by"), "y", "x0", "x1", F.explode(F.sequence(F.floor(F.col("x0") / side).cast("int"), F.floor(F.col("x1") / side).cast("int"))).alias("bx"))
    pieces = cut.select("image", "by", "bx", F.col("y").cast("int").alias("y"), F.greatest(F.col("x0"), F.col("bx") * side).cast("int").alias("a"), F.least(F.col("x1"), F.col("bx") * side + side - 1).cast("int").alias("b"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))

    def joined_blocks(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
        by, bx, y, a, b, x0, x1 = (ordered.numbers(rows.column(k)) for k in range(1, 8))
        # Blocks are laid beneath each other, two rows apart.
        apart = (np.cumsum(fresh) - 1) * (side + 2)
        root = joined_runs(apart + y - by * side, a - bx * side, b - bx * side)
        part, net = _numbered(root, given), ((y << 32) + x0)[root]  # a part's root is its first piece
        at, x = _at_border(y, a, b, by, bx, side)
        open_ = np.zeros(len(y), np.int8)
        open_[root[at]] = 1
        own = np.flatnonzero(x0 >= bx * side)  # a run is reported by the block in which it begins
        which = np.r_[own, at]
        columns = [y[which], np.r_[x0[own], x], np.r_[x1[own], x]]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(which)), pa.array(part[which]), pa.array(net[which]), *[pa.array(c, pa.int32()) for c in columns], pa.array(np.r_[open_[root[own]], np.full(len(at), 2, np.int8)])], ["image", "part", "net", "y", "x0", "x1", "kind"])

    given: list[int | None] = [None]  # of a task, which gets its own copy
    held = ordered.by_line(pieces, ["image", "by", "bx"], ["y", "x0"], joined_blocks, f"image {kind}, part long, net long, y int, x0 int, x1 int, kind byte")
    found = materialise(held, "parts")
    edge = found.filter("kind = 2").select("image", "y", F.col("x0").alias("x"), "part", "net")
    open_ = found.filter("kind = 1").join(_renamed(edge, _met_at_borders(edge, side)), "part", "left").withColumn("net", F.coalesce("whole", "net"))
    return found.filter("kind = 0").unionByName(open_.select(*found.columns)).select("image", "y", "x0", "x1", "net")


def net_sizes(pixels: DataFrame, side: int = BLOCK) -> DataFrame:
    """(image, net, area, runs): the nets that ``nets`` finds among ``pixels`` (image, y int, x int), with their pixels and row runs; repeated pixels count once.

    Pixels are dealt to blocks at once: runs cut at borders are counted as they meet there, and a part that reaches no
    border is a net as it is. So all pixels are shuffled once, and only what lies at borders again. Pixels without a place are left out.
    """
    kind = pixels.schema["image"].dataType.simpleString()
    block = lambda c: F.floor(F.col(c) / side).cast("int")
    own = pixels.filter("x is not null and y is not null").select("image", block("y").alias("by"), block("x").alias("bx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))

    def joined_blocks(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
        by, bx, y, x = (ordered.numbers(rows.column(k)) for k in range(1, 5))
        new = fresh | np.r_[True, (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)]
        first = np.flatnonzero(new)
        a, b = x[first], x[np.r_[first[1:] - 1, len(x) - 1]]
        apart = ((np.cumsum(fresh) - 1) * (side + 2))[first]
        by, bx, y = by[first], bx[first], y[first]
        root = joined_runs(apart + y - by * side, a - bx * side, b - bx * side)
        part, net = _numbered(root, given), ((y << 32) + a)[root]
        at, bx_ = _at_border(y, a, b, by, bx, side)
        open_ = np.zeros(len(y), np.int8)
        open_[root[at]] = 1
        roots = np.flatnonzero(root == np.arange(len(root)))
        area, count = np.bincount(root, b - a + 1, len(root)).astype(np.int64)[roots], np.bincount(root, minlength=len(root))[roots]
        which, none = np.r_[roots, at], np.zeros(len(at), np.int64)
        columns = [pa.array(y[which], pa.int32()), pa.array(np.r_[a[roots], bx_], pa.int32()), pa.array(np.r_[area, none]), pa.array(np.r_[count, none])]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first[which])), pa.array(part[which]), pa.array(net[which]), *columns, pa.array(np.r_[open_[roots], np.full(len(at), 2, np.int8)])], ["image", "part", "net", "y", "x", "area", "runs", "kind"])

    given: list[int | None] = [None]
    held = ordered.by_line(own, ["image", "by", "bx"], ["y", "x"], joined_blocks, f"image {kind}, part long, net long, y int, x int, area long, runs long, kind byte")
    found = materialise(held, "net-parts")
    edge = found.filter("kind = 2")
    met = materialise(_met_at_borders(edge, side), "met")
    # Pieces of one run that meet at a block's side are one run.
    twice = met.filter("dy = 0").groupBy(F.col("a").alias("part")).agg(F.count(F.lit(1)).alias("twice"))
    parts = found.filter("kind = 1").join(_renamed(edge, met), "part", "left").join(twice, "part", "left")
    whole = parts.groupBy("image", F.coalesce("whole", "net").alias("net")).agg(F.sum("area").alias("area"), F.sum(F.col("runs") - F.coalesce("twice", F.lit(0))).alias("runs"))
    return found.filter("kind = 0").select("image", "net", "area", "runs").unionByName(whole)


def border_hits(lines: DataFrame, labelled: DataFrame, devices: DataFrame, width: int = 1) -> DataFrame:
    """(image, device, net, x, y): nets whose pixels lie on a device's border where ``lines`` have ink too, and the mean place of those, truncated.

    ``lines`` are runs before carving and ``labelled`` runs with nets after it; devices are (image, device, x1..y2).
    A border wider than one pixel grows to both sides.
    """
    ring = F.explode(F.sequence(F.lit(-((width - 1) // 2)), F.lit(width // 2)))
    d = devices.withColumn("_o", ring).select("image", "device", (F.col("x1") - F.col("_o")).alias("x1"), (F.col("y1") - F.col("_o")).alias("y1"), (F.col("x2") - 1 + F.col("_o")).alias("right"), (F.col("y2") - 1 + F.col("_o")).alias("bottom"))
    d = d.filter("x1 <= right and y1 <= bottom").withColumn("y", F.explode(F.sequence("y1", "bottom")))
    # The first and last row of a border are whole, the others its two sides.
    piece = lambda a, b: F.struct(F.col(a).alias("b0"), F.col(b).alias("b1"))
    pieces = F.when(F.col("y").isin(F.col("y1"), F.col("bottom")), F.array(piece("x1", "right"))).otherwise(F.array(piece("x1", "x1"), piece("right", "right")))
    border = d.select("image", "device", "y", F.explode(pieces).alias("p")).select("image", "device", "y", "p.b0", "p.b1")
    none = {"device": f"cast(null as {devices.schema['device'].dataType.simpleString()})", "net": f"cast(null as {labelled.schema['net'].dataType.simpleString()})"}
    every = _row(border, 1, "b0", "b1", devices, **none | {"device": "device"}).unionByName(_row(labelled, 2, "x0", "x1", devices, **none | {"net": "net"})).unionByName(_row(lines, 3, "x0", "x1", devices, **none))

    def found(rows: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch | None:
        kind = ordered.numbers(rows.column(2))
        start, end, base = ordered.laid_out(fresh, *[ordered.numbers(rows.column(k)) for k in (3, 4)])
        rim, net = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        from_, to, _ = ordered.merged(start[kind == 3], end[kind == 3])
        low, _, count = ordered.meeting(start[net], end[net], from_, to)
        run, ink = ordered.paired(low, count)
        net = net[run]
        s, e = np.maximum(start[net], from_[ink]), np.minimum(end[net], to[ink])
        low, _, count = ordered.meeting(start[rim], end[rim], s, e)
        i, j = ordered.paired(low, count)
        if not len(i):
            return None
        rim, net, s, e = rim[i], net[j], np.maximum(start[rim[i]], s[j]), np.minimum(end[rim[i]], e[j])
        # A device's pixels on a net count once, however many pieces of borders hold them.
        codes = [rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in (5, 6)]
        order = np.lexsort((s, codes[1][net], codes[0][rim]))
        rim, net, s, e = rim[order], net[order], s[order], e[order]
        other = np.r_[True, (codes[0][rim[1:]] != codes[0][rim[:-1]]) | (codes[1][net[1:]] != codes[1][net[:-1]])]
        far = (np.cumsum(other) - 1) * (int(end.max()) + 3)
        s, e, first = ordered.merged(s + far, e + far)
        rim, net, s, e = rim[first], net[first], s - far[first] - base[rim[first]], e - far[first] - base[rim[first]]
        n, y = e - s + 1, ordered.numbers(rows.column(1))[rim]
        at = pa.array(rim)
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(5).take(at), rows.column(6).take(pa.array(net)), pa.array(n), pa.array((s + e) * n // 2), pa.array(y * n)], ["image", "device", "net", "n", "sx", "sy"])

    kinds = {"image": devices, "device": devices, "net": labelled}
    schema = T.StructType([*[T.StructField(c, d.schema[c].dataType) for c, d in kinds.items()], *[T.StructField(c, T.LongType()) for c in ("n", "sx", "sy")]])
    seen = ordered.by_line(every, ["image", "y"], ["start"], found, schema)
    mean = lambda c: (F.sum(c) / F.sum("n")).cast("int")
    return seen.groupBy("image", "device", "net").agg(mean("sx").alias("x"), mean("sy").alias("y"))


def device_graph(rasters: DataFrame, devices: DataFrame, least_x: int, least_y: int, radius: int = 0, method: str = "otsu") -> DataFrame:
    """(image, u, v): devices that a wire joins, from rasters and boxes (image, device, x1..y2)."""
    lines = straight_lines(ink_runs(rasters, method), least_x, least_y)
    wide = thickened(lines, radius, rasters.select("image", "width", "height"))
    labelled = nets(carved(wide, devices))
    return shared_net_pairs(border_hits(wide, labelled, devices), within=("image",))


# ---- cabinets

CABINETS = ("cabinet", "cabinets")


def cabinet_regions(boxes: DataFrame, sizes: DataFrame, pad: int = 0) -> DataFrame:
    """(image, cabinet, tx1, ty1, tx2, ty2): boxes of a CABINETS class, widened by ``pad`` inside the image, numbered in
    order of (y1, x1, y2, x2); an image (image, width, height) without any is one region as a whole."""
    own = of_classes(boxes, list(CABINETS)).join(sizes, "image")
    place = F.row_number().over(Window.partitionBy("image").orderBy("y1", "x1", "y2", "x2"))
    corners = dict(zip(("tx1", "ty1", "tx2", "ty2"), bx.expand("x1", "y1", "x2", "y2", pad, "width", "height"), strict=True))
    regions = own.withColumn("cabinet", place - 1).select("image", "cabinet", *[c.alias(n) for n, c in corners.items()])
    whole = sizes.join(own.select("image").distinct(), "image", "left_anti")
    rest = whole.select("image", F.lit(0).alias("cabinet"), F.lit(0).alias("tx1"), F.lit(0).alias("ty1"), F.col("width").alias("tx2"), F.col("height").alias("ty2"))
    return regions.unionByName(rest)


def devices_in_cabinets(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(image, cabinet, device, class, x1, y1, x2, y2): boxes whose center a region holds, counted from its corner, numbered from 0.

    Boxes of a CABINETS class are no devices. Numbers follow box_id; a box in several regions is a device of each.
    """
    px, py = bx.center("x1", "y1", "x2", "y2")
    devices = of_classes(boxes, exclude=list(CABINETS)).withColumns({"px": px, "py": py})
    found = centers_in_regions(devices, regions)
    number = F.row_number().over(Window.partitionBy("image", "cabinet").orderBy("box_id", "y1", "x1", "y2", "x2")) - 1
    corners = dict(zip(("x1", "y1", "x2", "y2"), bx.within("x1", "y1", "x2", "y2", "tx1", "ty1"), strict=True))
    return found.withColumn("device", number).select("image", "cabinet", "device", "class", *[c.alias(n) for n, c in corners.items()])


def cropped(rasters: DataFrame, regions: DataFrame) -> DataFrame:
    """(image, cabinet, height, width, pixels): each region cut out of its raster; empty regions are left out."""
    meant = rasters.select("image", F.col("width").alias("_w"), "pixels").join(regions, "image").filter("tx2 > tx1 and ty2 > ty1")
    row = lambda y: F.slice("pixels", (y * F.col("_w") + F.col("tx1") + 1).cast("int"), (F.col("tx2") - F.col("tx1")).cast("int"))
    pixels = F.flatten(F.transform(F.sequence("ty1", F.col("ty2") - 1), row))
    return meant.select("image", "cabinet", (F.col("ty2") - F.col("ty1")).cast("int").alias("height"), (F.col("tx2") - F.col("tx1")).cast("int").alias("width"), pixels.alias("pixels"))


def cabinet_graphs(rasters: DataFrame, boxes: DataFrame, pad: int = 0, least: int = 25, share: float = 0.015, radius: int = 0, method: str = "otsu") -> DataFrame:
    """(image, cabinet, json): the graph of devices of each cabinet, from rasters and boxes (image, box_id, class, x1..y2).

    Lines are at least max(``least``, int(``share`` * the crop's side)) pixels long.
    """
    regions = materialise(cabinet_regions(boxes, rasters.select("image", "width", "height"), pad), "regions")
    key = F.concat_ws("/", F.col("image").cast("string"), F.col("cabinet").cast("string"))
    crops = materialise(cropped(rasters, regions).withColumn("key", key), "crops")
    devices = materialise(devices_in_cabinets(boxes, regions).withColumn("key", key), "devices")
    whole = crops.select(F.col("key").alias("image"), "height", "width", "pixels")
    side = lambda n: F.greatest(F.lit(least), (F.col(n) * share).cast("int"))
    runs = ink_runs(whole, method).join(whole.select("image", side("width").alias("_x"), side("height").alias("_y")), "image")
    lines = thickened(straight_lines(runs, F.col("_x"), F.col("_y")), radius, whole.select("image", "width", "height"))
    boxes_ = devices.select(F.col("key").alias("image"), "device", "x1", "y1", "x2", "y2")
    pairs = shared_net_pairs(border_hits(lines, nets(carved(lines, boxes_)), boxes_), within=("image",))
    nodes = devices.select(F.col("key").alias("image"), F.col("device").cast("long").alias("id"), "class")
    found = graph_json(nodes, pairs.select("image", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "image")
    every = crops.select("image", "cabinet", "key").join(found.select(F.col("image").alias("key"), "json"), "key", "left")
    return every.select("image", "cabinet", F.coalesce("json", F.lit('{"nodes":[],"edges":[]}')).alias("json"))
