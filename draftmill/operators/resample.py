"""Resampled pixels: separable filters as tables of weights, summed in two passes.

Pixels are rows (image, y, x, v) with v from 0 to 255, every pixel of an image once. For each pair of an old and a new
side and a filter there is one table of weights; a pass joins pixels with it and sums, first along rows, then along
columns, so no task holds an image. Weights are whole numbers of 2^-22, so sums don't depend on their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import col, downscale, letterbox, lookup
from ..session import materialise

#: How far each filter reaches, in pixels of the larger raster.
REACH = {"nearest": 0.0, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}
#: Other names of filters.
ALIASES = {"antialias": "lanczos"}
ONE = 1 << 22


def filter_name(name) -> Column:
    """A filter of REACH by its name in any case; unknown names and null give "lanczos"."""
    return lookup(F.lower(col(name)), {k: k for k in REACH} | ALIASES, F.lit("lanczos"))


def kernel(kind, x) -> Column:
    """The value of a filter at ``x``."""
    x = F.abs(col(x))
    sinc = lambda a: F.when(a == 0, 1.0).otherwise(F.sin(a * math.pi) / (a * math.pi))
    bilinear = F.when(x < 1, 1 - x).otherwise(0.0)
    bicubic = F.when(x < 1, (1.5 * x - 2.5) * x * x + 1).when(x < 2, (((x - 5) * x + 8) * x - 4) * -0.5).otherwise(0.0)
    lanczos = F.when(x < 3, sinc(x) * sinc(x / 3)).otherwise(0.0)
    return F.when(col(kind) == "bilinear", bilinear).when(col(kind) == "bicubic", bicubic).otherwise(lanczos)


def weights(sides: DataFrame) -> DataFrame:
    """(kind, n_in, n_out, out, src, weight long): how much of which old pixel each new pixel takes.

    ``sides`` has (kind, n_in, n_out), each combination once. A filter is stretched when a side shrinks, cut at the
    border, and its weights are scaled to sum to one (ONE before rounding).
    """
    d = sides.filter("n_in > 0 and n_out > 0").select("kind", "n_in", "n_out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("out"))
    scale = F.col("n_in") / F.col("n_out")
    stretch = F.greatest(F.lit(1.0), scale)
    center = (F.col("out") + 0.5) * scale
    reach = lookup("kind", REACH, F.lit(3.0)) * stretch
    d = d.withColumns({"_stretch": stretch, "_center": center, "_lo": F.greatest(F.lit(0), F.floor(center - reach + 0.5)).cast("int"), "_hi": F.least(F.col("n_in"), F.floor(center + reach + 0.5)).cast("int")})
    taps = F.transform(F.sequence("_lo", F.col("_hi") - 1), lambda s: F.struct(s.alias("src"), kernel("kind", (s - F.col("_center") + 0.5) / F.col("_stretch")).alias("w")))
    nearest = F.array(F.struct(F.least(F.floor("_center"), F.col("n_in") - 1).cast("int").alias("src"), F.lit(1.0).alias("w")))
    d = d.withColumn("_taps", F.when(F.col("kind") == "nearest", nearest).otherwise(taps))
    total = F.aggregate("_taps", F.lit(0.0), lambda s, t: s + t.w)
    d = d.withColumn("_total", total).select("kind", "n_in", "n_out", "out", "_total", F.explode("_taps").alias("t"))
    return d.select("kind", "n_in", "n_out", "out", F.col("t.src").alias("src"), F.round(F.col("t.w") / F.col("_total") * ONE).cast("long").alias("weight")).filter("weight <> 0")


def _pass(pixels: DataFrame, plan: DataFrame, table: DataFrame, along: str, across: str, n_in: str, n_out: str) -> DataFrame:
    """Sums along one axis, rounded and cut to 0 to 255."""
    own = plan.select("image", "kind", F.col(n_in).alias("n_in"), F.col(n_out).alias("n_out"))
    joined = pixels.join(own, "image").withColumnRenamed(along, "src").join(table, ["kind", "n_in", "n_out", "src"])
    sums = joined.groupBy("image", across, F.col("out").alias(along)).agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("s") + ONE // 2) / ONE))).cast("int")
    return sums.select("image", "y", "x", value.alias("v"))


def resized(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """Pixels of the new sizes: ``plan`` has (image, width, height, new_width, new_height, kind), a filter's name each.

    Rows are resized first, then columns; values between are whole numbers, too. Images without a plan or without
    pixels give none.
    """
    plan = plan.withColumn("kind", filter_name("kind"))
    side = lambda a, b: plan.select("kind", F.col(a).alias("n_in"), F.col(b).alias("n_out"))
    table = materialise(weights(side("width", "new_width").union(side("height", "new_height")).distinct()), "weights")
    narrow = _pass(pixels, plan, table, "x", "y", "width", "new_width")
    return _pass(narrow, plan, table, "y", "x", "height", "new_height")


def letterboxed(pixels: DataFrame, sizes: DataFrame, target_w: int, target_h: int, kind="bicubic", fill: int = 255) -> DataFrame:
    """Each image (image, width, height) fitted into a frame of ``fill``: every pixel of the frame (image, y, x, v)."""
    _, nw, nh, left, top = letterbox("width", "height", F.lit(target_w), F.lit(target_h))
    plan = sizes.select("image", "width", "height", nw.alias("new_width"), nh.alias("new_height"), left.cast("int").alias("left"), top.cast("int").alias("top"), (col(kind) if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    place = plan.select("image", "left", "top", "new_width", "new_height", ((F.col("width") > 0) & (F.col("height") > 0)).alias("some"))
    inner = resized(pixels, plan).join(place.select("image", "left", "top"), "image").select("image", (F.col("y") + F.col("top")).alias("y"), (F.col("x") + F.col("left")).alias("x"), "v")
    frame = place.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(target_h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(target_w - 1))))
    inside = F.col("some") & F.col("x").between(F.col("left"), F.col("left") + F.col("new_width") - 1) & F.col("y").between(F.col("top"), F.col("top") + F.col("new_height") - 1)
    return inner.unionByName(frame.filter(~inside).select("image", "y", "x", F.lit(fill).alias("v")))


def downscaled(pixels: DataFrame, sizes: DataFrame, mode: str, target: float, kind="lanczos", darkest: int = 0) -> DataFrame:
    """Pixels at the size that the policy of ``functions.boxes.downscale`` gives; ``darkest`` keeps thin lines, see ``darkest_near``."""
    _, nw, nh = downscale("width", "height", mode, target)
    plan = sizes.select("image", "width", "height", nw.alias("new_width"), nh.alias("new_height"), (col(kind) if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    return resized(darkest_near(pixels, darkest) if darkest else pixels, plan)


def darkest_near(pixels: DataFrame, radius: int) -> DataFrame:
    """Each pixel as the darkest within ``radius`` on all sides, so that dark lines thicken."""
    rows = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    columns = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.select("image", "y", "x", F.min("v").over(rows).alias("v")).select("image", "y", "x", F.min("v").over(columns).alias("v"))
