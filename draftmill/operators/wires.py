"""The wire extractor as one run: thresholds, thinning, devices and small parts off, thick lines, and the darkened overlay.

All steps are over tables of pixels and runs, so that an image may exceed a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import darkened
from ..session import materialise
from .cleanup import of_classes
from .local import sauvola_binarised, thinned_runs
from .raster import binarised, carved, nets, odd_window, otsu_thresholds, pixels_of, row_runs, thickened


@dataclass(frozen=True)
class Wires:
    """The steps of a run: white pixels (image, y, x, v, white), then runs (image, y, x0, x1) of each step."""

    white: DataFrame
    skeleton: DataFrame
    without_devices: DataFrame
    clean: DataFrame
    thick: DataFrame


def large_parts(runs: DataFrame, ratio: float) -> DataFrame:
    """``runs`` of 8-connected parts of at least max(1, int(ratio * the image's largest area)) pixels."""
    named = materialise(nets(runs), "parts")
    areas = named.groupBy("image", "net").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    most = areas.groupBy("image").agg(F.max("area").alias("most"))
    kept = areas.join(most, "image").filter(F.col("area") >= F.greatest(F.lit(1), (F.col("most") * ratio).cast("long")))
    return named.join(kept.select("image", "net"), ["image", "net"]).select("image", "y", "x0", "x1")


def extract_wires(pixels: DataFrame, sizes: DataFrame, boxes: DataFrame | None = None, method: str = "otsu", window: int | Column | None = None, k: float = 0.2, ratio: float = 0.1, thick: int = 3, include: list[str] | None = None, exclude: list[str] | None = None) -> Wires:
    """The steps from gray pixels (image, y, x, v) and sizes (image, width, height) to clean thick wires.

    ``boxes`` (image, class, x1..y2) of wanted classes are cut out as a whole; without them nothing is. ``method`` is
    "otsu" or "sauvola" (``window`` by default max(15, int(0.02 * the lesser side) made odd)). ``thick`` is the width
    of a brush, made odd. Images without ink have no runs.
    """
    if method == "sauvola":
        white = sauvola_binarised(pixels, sizes, window if window is not None else odd_window(F.least("width", "height"), 0.02, 15), k)
    else:
        white = binarised(pixels, otsu_thresholds(pixels))
    white = materialise(white.select("image", "y", "x", "v", "white"), "white")
    skeleton = materialise(thinned_runs(row_runs(white.filter("white = 0"))), "skeleton")
    cut = skeleton
    if boxes is not None:
        cut = materialise(carved(skeleton, of_classes(boxes, include, exclude or []), margin=0), "without-devices")
    clean = materialise(large_parts(cut, ratio), "clean")
    return Wires(white, skeleton, cut, clean, thickened(clean, (thick | 1) // 2 if thick > 1 else 0, sizes))


def overlaid(pixels: DataFrame, wires: DataFrame, share: float = 0.4) -> DataFrame:
    """``pixels`` (image, y, x, v) that lose ``share`` of their value under wires."""
    on = pixels_of(wires).withColumn("_on", F.lit(True))
    joined = pixels.join(on, ["image", "y", "x"], "left")
    return joined.select("image", "y", "x", darkened("v", F.coalesce("_on", F.lit(False)), F.lit(share)).alias("v"))
