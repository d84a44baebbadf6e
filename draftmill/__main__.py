"""``python -m draftmill graphs | wires | tiles | grid | coco | circuits | cleanup | report``: whole runs from files to files.

Paths may be in any store that Spark reads. Images and their detections or label files belong together by the stem of
their names; two images of one stem are refused.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes as bx
from .functions.text import stem, wrapped_base64
from .operators import cleanup, graph, raster, report, service, tiling, wires
from .operators.rules import RuleStore
from .session import bound_batches, materialise, session
from .settings import load
from .sources import annotations as src


def _rasters(spark: SparkSession, images: str) -> DataFrame:
    rasters = materialise(raster.gray_pixels(src.images(spark, images)).withColumn("image", stem("image")), "rasters")
    return _once(rasters)


def _once(rows: DataFrame) -> DataFrame:
    twice = [r.image for r in rows.groupBy("image").count().filter("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"several images are named {', '.join(twice)}")
    return rows


def _boxes(spark: SparkSession, detections: str, default_class: str | None) -> DataFrame:
    found = src.detections_json(spark, detections, default_class)
    return found.select(stem("image_path").alias("image"), F.xxhash64("image_path", "class", "x1", "y1", "x2", "y2").alias("box_id"), "class", "x1", "y1", "x2", "y2")


def graphs(spark: SparkSession, images: str, detections: str, out: str, pad: int = 48, least: int = 25, radius: int = 0, method: str = "otsu", default_class: str | None = None) -> None:
    """The device graph of each cabinet of each image, as JSON in a folder of its own under ``out``."""
    found = raster.cabinet_graphs(_rasters(spark, images), _boxes(spark, detections, default_class), pad, least, radius=radius, method=method)
    src.write_graphs(found, out)


def wire_runs(spark: SparkSession, images: str, detections: str, out: str, method: str = "otsu", window: int | None = None, k: float = 0.2, ratio: float = 0.1, thick: int = 3, alpha: float = 0.4, default_class: str = "device") -> None:
    """Wires alone: runs of each step (``out``/skeleton, without_devices, clean, thick) and the darkened images (``out``/overlay), as Parquet.

    "-" in place of detections cuts nothing out.
    """
    rasters = _rasters(spark, images)
    pixels = materialise(raster.exploded(rasters), "pixels")
    boxes = None if detections == "-" else _boxes(spark, detections, default_class)
    found = wires.extract_wires(pixels, rasters.select("image", "width", "height"), boxes, method, window, k, ratio, thick)
    for name in ("skeleton", "without_devices", "clean", "thick"):
        getattr(found, name).write.mode("overwrite").parquet(f"{out}/{name}")
    wires.overlaid(pixels, found.thick, alpha).write.mode("overwrite").parquet(f"{out}/overlay")


def coco(spark: SparkSession, annotations: str, out: str, names: str, keep_crowds: bool = False) -> None:
    """Label files of the images of a COCO file, one folder an image, classes in the order of ``names`` (comma-separated); images without boxes have empty ones."""
    images, boxes, categories = src.coco_tables(spark, annotations)
    rows = src.coco_yolo(images, boxes, categories, [n.strip() for n in names.split(",")], not keep_crowds)
    files = src.label_files(images.select(F.col("file_name").alias("tile_name")), rows.withColumnRenamed("file_name", "tile_name"))
    files.select(stem("tile_name").alias("file"), "text").write.mode("overwrite").partitionBy("file").text(out)


def circuits(spark: SparkSession, declared: str, out: str) -> None:
    """Declared circuits as JSON lines, their links (Parquet), and the JSON in lines of base64."""
    panels = materialise(src.circuit_panels(spark, declared), "panels")
    lines = src.circuit_json(panels)
    src.write_lines(lines, f"{out}/json", "json")
    src.write_lines(lines.select(wrapped_base64(F.col("json").cast("binary")).alias("text")), f"{out}/base64")
    graph.circuit_edges(panels).write.mode("overwrite").parquet(f"{out}/edges")


def clean(spark: SparkSession, images: str, labels: str, out: str) -> None:
    """Lists of the images whose label files say more than class "0" (``out``/kept) and of pairs that don't (``out``/removed); files stay where they are."""
    listed = src.listed_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(labels))
    lines = src.lines(spark, labels).select(src.plain_path(F.col("file")).alias("file"), F.split("text", r"\s+")[0].alias("class_text"))
    judged = materialise(src.images_for_labels(cleanup.zero_only(listed, lines), src.image_files(spark, images)), "judged")
    src.write_lines(judged.filter(~F.col("zero_only")), f"{out}/kept", "image_path", "image_path")
    judged.filter("zero_only").select("file", "image_path").write.mode("overwrite").json(f"{out}/removed")


def matches(spark: SparkSession, store: str, queries: str, out: str) -> None:
    """A report of the best rules of a store for each query: HTML pages and an index under ``out``.

    ``queries`` is a Parquet table (id, filename, embedding, features, energies); settings come from the session.
    """
    asked = spark.read.parquet(queries)
    answers = service.batch_response(asked, RuleStore(spark, store).rules(), load(spark))
    report.write_report(asked, answers, out)


def _sizes_and_boxes(spark: SparkSession, images: str, labels: str) -> tuple[DataFrame, DataFrame]:
    sizes = src.images(spark, images).select(stem("image.origin").alias("image"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    sizes = _once(materialise(sizes, "sizes"))
    rows = src.yolo_rows(src.lines(spark, labels)).withColumn("image", stem("file")).join(sizes, "image")
    corners = bx.yolo_to_pixels("cx", "cy", "w", "h", "width", "height")
    return sizes, materialise(rows.select("image", "class_id", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), corners, strict=True)]), "boxes")


def tiles(spark: SparkSession, images: str, labels: str, out: str, tile: int = 2048, back_step: int = 8, least: int = 64, k: int = 1, seed: int = 0) -> None:
    """Disjoint tiles that cut no box: ``out``/tiles (Parquet), lists of tile names by split, and the data set's description."""
    sizes, boxes = _sizes_and_boxes(spark, images, labels)
    found = materialise(tiling.tiled_dataset(sizes, boxes, tile, back_step, least, k, seed), "tiles")
    found.write.mode("overwrite").parquet(f"{out}/tiles")
    for split in ("train", "val"):
        src.write_lines(found.filter(F.col("split") == split), f"{out}/{split}", "tile_name", "tile_name")
    classes = cleanup.class_total(boxes).first()[0]
    text = src.dataset_file(classes, f"{out}/train", f"{out}/val")
    src.write_lines(spark.createDataFrame([(text,)], "text string"), f"{out}/dataset")


def grid(spark: SparkSession, images: str, labels: str, out: str, tile: int = 1024, overlap: float = 0.2) -> None:
    """Overlapping tiles with the text of their label files, as Parquet."""
    tiling.overlapping_tiles(*_sizes_and_boxes(spark, images, labels), tile, overlap).write.mode("overwrite").parquet(out)


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="draftmill", description=__doc__)
    runs = parser.add_subparsers(dest="run", required=True)
    add = lambda name, *paths: [p := runs.add_parser(name), *map(p.add_argument, (*paths, "out"))][0]
    p = add("graphs", "images", "detections")
    for name, kind, value in (("pad", int, 48), ("least", int, 25), ("radius", int, 0), ("method", str, "otsu"), ("default-class", str, None)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p = add("wires", "images", "detections")
    for name, kind, value in (("method", str, "otsu"), ("window", int, None), ("k", float, 0.2), ("ratio", float, 0.1), ("thick", int, 3), ("alpha", float, 0.4), ("default-class", str, "device")):
        p.add_argument(f"--{name}", type=kind, default=value)
    p = add("tiles", "images", "labels")
    for name, value in (("tile", 2048), ("back-step", 8), ("least", 64), ("k", 1), ("seed", 0)):
        p.add_argument(f"--{name}", type=int, default=value)
    p = add("grid", "images", "labels")
    p.add_argument("--tile", type=int, default=1024)
    p.add_argument("--overlap", type=float, default=0.2)
    p = add("coco", "annotations")
    p.add_argument("--names", required=True)
    p.add_argument("--keep-crowds", action="store_true")
    add("circuits", "declared")
    add("cleanup", "images", "labels")
    add("report", "store", "queries")
    chosen = vars(parser.parse_args(given))
    spark = session()
    bound_batches(spark)
    {"graphs": graphs, "wires": wire_runs, "tiles": tiles, "grid": grid, "coco": coco, "circuits": circuits, "cleanup": clean, "report": matches}[chosen.pop("run")](spark, **chosen)


if __name__ == "__main__":
    main()
