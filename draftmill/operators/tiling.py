"""Tiles over images: grids, boxes in tiles, intervals that cuts must avoid, cut plans and splits."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as bx
from ..sources.annotations import label_files

#: Side of the grid over which boxes and tiles meet, in pixels.
BUCKET = 512


def tile_grid(images: DataFrame, tile: int, overlap: float = 0.2) -> DataFrame:
    """(image, tile_x, tile_y, tile_name) for images (image, width, height)."""
    xs = images.select("image", "height", F.explode(bx.tile_starts("width", tile, overlap)).alias("tile_x"))
    grid = xs.select("image", "tile_x", F.explode(bx.tile_starts("height", tile, overlap)).alias("tile_y"))
    return grid.withColumn("tile_name", F.format_string("%s_x%05d_y%05d", F.col("image").cast("string"), "tile_x", "tile_y"))


def _buckets(lo, hi):
    return F.sequence(F.floor(bx.col(lo) / BUCKET), F.floor(bx.col(hi) / BUCKET))


def _meet(boxes: DataFrame, tiles: DataFrame, condition) -> DataFrame:
    """Boxes (image, x1..y2) with tiles (image, tx1..ty2) that meet ``condition``; both are dealt to the grid squares they touch.

    Of the squares that a pair shares only the first counts, so no pair comes twice and nothing is sorted out later.
    """
    b = boxes.withColumn("_bx", F.explode(_buckets("x1", "x2"))).withColumn("_by", F.explode(_buckets("y1", "y2")))
    t = tiles.withColumn("_bx", F.explode(_buckets("tx1", "tx2"))).withColumn("_by", F.explode(_buckets("ty1", "ty2")))
    first = (F.col("_bx") == F.floor(F.greatest("x1", "tx1") / BUCKET)) & (F.col("_by") == F.floor(F.greatest("y1", "ty1") / BUCKET))
    return b.join(t, ["image", "_bx", "_by"]).filter(first & condition).drop("_bx", "_by")


def boxes_in_tiles(boxes: DataFrame, tiles: DataFrame, tile: int, least_share: float = 0.0002) -> DataFrame:
    """Boxes (image, box_id, class, x1..y2) cut to the tiles they overlap, with cx, cy, w, h relative to the tile.

    A cut below ``least_share`` of the tile's area is dropped.
    """
    t = tiles.withColumns({"tx1": F.col("tile_x"), "ty1": F.col("tile_y"), "tx2": F.col("tile_x") + tile, "ty2": F.col("tile_y") + tile})
    a, c = ("x1", "y1", "x2", "y2"), ("tx1", "ty1", "tx2", "ty2")
    met = _meet(boxes, t, bx.overlaps(a, c))
    x1, y1, x2, y2 = bx.intersection(a, c)
    cut = met.withColumns({"ix1": x1 - F.col("tx1"), "iy1": y1 - F.col("ty1"), "ix2": x2 - F.col("tx1"), "iy2": y2 - F.col("ty1")})
    cut = cut.withColumn("area", (F.col("ix2") - F.col("ix1")) * (F.col("iy2") - F.col("iy1")))
    cx, cy, w, h = bx.box_to_yolo("ix1", "iy1", "ix2", "iy2", F.lit(tile), F.lit(tile))
    kept = cut.filter(F.col("area") / float(tile * tile) >= least_share)
    return kept.select("image", "box_id", "class", "tile_x", "tile_y", "area", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def boxes_inside_tiles(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes that lie wholly (borders included) in tiles (image, tx1, ty1, tx2, ty2)."""
    whole = (F.col("x1") >= F.col("tx1")) & (F.col("y1") >= F.col("ty1")) & (F.col("x2") <= F.col("tx2")) & (F.col("y2") <= F.col("ty2"))
    return _meet(boxes, tiles, whole)


def centers_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (image, px, py) with regions (image, tx1, ty1, tx2, ty2) that hold them, right and bottom borders left out.

    A point may lie in several regions.
    """
    p = points.withColumns({"_bx": F.floor(F.col("px") / BUCKET), "_by": F.floor(F.col("py") / BUCKET)})
    r = regions.withColumn("_bx", F.explode(_buckets("tx1", "tx2"))).withColumn("_by", F.explode(_buckets("ty1", "ty2")))
    inside = (F.col("px") >= F.col("tx1")) & (F.col("px") < F.col("tx2")) & (F.col("py") >= F.col("ty1")) & (F.col("py") < F.col("ty2"))
    return p.join(r, ["image", "_bx", "_by"]).filter(inside).drop("_bx", "_by")


def merge_intervals(intervals: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """(keys..., s, e): the union of intervals of each key; touching ones merge. Null ends are ignored."""
    rows = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def forbidden_intervals(boxes: DataFrame) -> DataFrame:
    """(image, axis, s, e): what cuts must not go through, from boxes (image, x1..y2, width, height) cut to the image."""
    axis = lambda name, lo, hi, size: F.struct(F.lit(name).alias("axis"), F.greatest(F.lit(0.0), F.col(lo).cast("double")).alias("s"), F.least(F.col(size).cast("double"), F.col(hi).cast("double")).alias("e"))
    both = boxes.select("image", F.explode(F.array(axis("x", "x1", "x2", "width"), axis("y", "y1", "y2", "height"))).alias("i"))
    return merge_intervals(both.select("image", "i.axis", "i.s", "i.e").filter("e > s"), ["image", "axis"])


def cuts_along(length: float, forbidden: list[tuple[float, float]], tile: float, back_step: float, least: float) -> list[float] | None:
    """Cut places from 0 to ``length``, at most ``tile`` apart and never strictly inside a forbidden interval.

    Each cut goes as far as it can, stepping back by ``back_step`` while it would hit something, to no less than
    ``least`` after the last cut; None if it still hits something there. The last part may be short. The intervals
    are merged: none overlaps another.
    """
    spans = sorted(forbidden)
    starts = [s for s, _ in spans]
    hits = lambda x: (k := bisect_left(starts, x)) > 0 and x < spans[k - 1][1]
    cuts = [0.0]
    while length - cuts[-1] > tile:
        x = cuts[-1] + tile
        while hits(x) and x > cuts[-1] + least:
            x -= back_step
        if hits(x) or x < cuts[-1] + least or x <= cuts[-1]:
            return None
        cuts.append(float(x))
    return [*cuts, float(length)]


def plan_cuts(boxes: DataFrame, images: DataFrame, tile: int = 2048, back_step: int = 8, least: int = 64) -> DataFrame:
    """(image, axis, cuts array<double>) for images (image, width, height); cuts is null where no plan exists.

    A box longer than a tile on an axis makes a plan impossible there. The greedy walk along an axis needs its
    intervals in order, so one row holds the merged intervals of one image's axis.
    """
    joined = boxes.select("image", "x1", "y1", "x2", "y2").join(images, "image")
    size = lambda name, c: F.struct(F.lit(name).alias("axis"), F.col(c).cast("double").alias("length"))
    axes = images.select("image", F.explode(F.array(size("x", "width"), size("y", "height"))).alias("a")).select("image", "a.axis", "a.length")
    longest = joined.groupBy("image").agg(F.max(F.col("x2") - F.col("x1")).alias("x"), F.max(F.col("y2") - F.col("y1")).alias("y"))
    longest = longest.select("image", F.explode(F.create_map(F.lit("x"), "x", F.lit("y"), "y")).alias("axis", "longest"))
    spans = forbidden_intervals(joined).groupBy("image", "axis").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    rows = axes.join(spans, ["image", "axis"], "left").join(longest, ["image", "axis"], "left").select("image", "axis", "length", "spans", "longest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for length, own, most in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                # Merged intervals may be longer than a tile; a single box may not.
                possible = most is None or most <= tile
                cuts.append(cuts_along(length, [(x["s"], x["e"]) for x in own or ()], tile, back_step, least) if possible else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.float64()))], ["image", "axis", "cuts"])

    return rows.mapInArrow(walk, T.StructType([*images.select("image").schema.fields, T.StructField("axis", T.StringType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))]))


def cut_tiles(plans: DataFrame, least: int = 64) -> DataFrame:
    """(image, tx1, ty1, tx2, ty2, tile_name) between rounded cuts of both axes; parts thinner than ``least`` are left out."""
    parts = F.expr("transform(sequence(1, size(cuts) - 1), i -> struct(int(bround(cuts[i - 1])) as lo, int(bround(cuts[i])) as hi))")
    one = plans.filter("cuts is not null").select("image", "axis", F.explode(parts).alias("p")).filter(F.col("p.hi") - F.col("p.lo") >= least)
    xs = one.filter("axis = 'x'").select("image", F.col("p.lo").alias("tx1"), F.col("p.hi").alias("tx2"))
    ys = one.filter("axis = 'y'").select("image", F.col("p.lo").alias("ty1"), F.col("p.hi").alias("ty2"))
    return xs.join(ys, "image").withColumn("tile_name", F.format_string("%s_x%d_y%d", F.col("image").cast("string"), "tx1", "ty1"))


def split_validation(tiles: DataFrame, group_col: str, id_col: str, k: int = 1, seed: int = 0, labelled: str | None = None) -> DataFrame:
    """``tiles`` with split: k of each group are "val", labelled ones first, chosen by a hash of the id and the seed.

    Tiles of one id and group go together. Each task keeps k tiles a group, so that no group meets in one task.
    """
    order = F.pmod(F.pmod(F.col(id_col), F.lit(1 << 31)) * F.lit(2654435761) + seed, F.lit(1 << 31))
    first = [F.col(labelled).desc()] if labelled else []
    chosen = tiles.select(F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), *([labelled] if labelled else []), order.alias("_order"))
    chosen = chosen.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*first, "_order", "_id"))).filter(F.col("_rank") <= k)
    joined = tiles.join(chosen.select("_group", "_id").distinct(), F.col(group_col).eqNullSafe(F.col("_group")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("split", F.when(F.col("_id").isNotNull(), "val").otherwise("train")).drop("_group", "_id")


def tiled_dataset(images: DataFrame, boxes: DataFrame, tile: int = 2048, back_step: int = 8, least: int = 64, k: int = 1, seed: int = 0) -> DataFrame:
    """(image, tile_name, tx1, ty1, tx2, ty2, labels, text, split): tiles that cut no box, with their label files.

    ``images`` hold image, width, height and ``boxes`` image, class_id, x1..y2. A box belongs to the tile that it lies in
    wholly. ``k`` tiles an image are "val", labelled ones first. Images without a plan give no tiles.
    """
    tiles = cut_tiles(plan_cuts(boxes, images, tile, back_step, least), least)
    inside = boxes_inside_tiles(boxes.select("image", "class_id", "x1", "y1", "x2", "y2"), tiles)
    w, h = F.col("tx2") - F.col("tx1"), F.col("ty2") - F.col("ty1")
    yolo = dict(zip(("cx", "cy", "w", "h"), bx.box_to_yolo(*bx.within("x1", "y1", "x2", "y2", "tx1", "ty1"), w, h), strict=True))
    rows = inside.select("tile_name", "class_id", *[c.alias(n) for n, c in yolo.items()])
    texts = label_files(tiles, rows)
    labels = rows.groupBy("tile_name").agg(F.count(F.lit(1)).alias("labels"))
    whole = tiles.join(texts, "tile_name").join(labels, "tile_name", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))
    marked = whole.withColumns({"_labelled": (F.col("labels") > 0).cast("int"), "_tile": F.abs(F.xxhash64("tile_name").bitwiseAND(F.lit((1 << 62) - 1)))})
    return split_validation(marked, "image", "_tile", k, seed, "_labelled").select("image", "tile_name", "tx1", "ty1", "tx2", "ty2", "labels", "text", "split")


def overlapping_tiles(images: DataFrame, boxes: DataFrame, tile: int = 1024, overlap: float = 0.2, least_share: float = 0.0002) -> DataFrame:
    """(tile_name, text): the tiles of a grid over ``images`` (image, width, height), and label files of what ``boxes`` (image, class_id, x1..y2) show in them."""
    grid = tile_grid(images, tile, overlap)
    cut = boxes_in_tiles(boxes.select("image", F.lit(0).alias("box_id"), F.col("class_id").alias("class"), "x1", "y1", "x2", "y2"), grid.drop("tile_name"), tile, least_share)
    rows = cut.withColumnRenamed("class", "class_id").join(grid, ["image", "tile_x", "tile_y"])
    return label_files(grid, rows)


__all__ = ["boxes_in_tiles", "boxes_inside_tiles", "centers_in_regions", "overlapping_tiles", "tiled_dataset", "cut_tiles", "cuts_along", "forbidden_intervals", "merge_intervals", "plan_cuts", "split_validation", "tile_grid"]
