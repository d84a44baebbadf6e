"""Annotation formats as DataFrames: detections, label lines, COCO, circuits, class names and file lists."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stem, yolo_line

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
DETECTION = "image_path string, x1 int, y1 int, x2 int, y2 int, class string, score double, track_id string"
CIRCUITS = "reference_image string, circuits array<struct<name:string,nodes:array<struct<id:string,label:string>>,components:array<struct<id:string,type:string,connections:array<string>,note:string>>,layout:map<string,array<double>>>>"
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"


# ---- images and lists of them


def image_files(spark: SparkSession, paths: str | list[str], recursive: bool = True, strict: bool = False) -> DataFrame:
    """(path, length) of image files under folders or given directly; each path once, by path.

    If ``strict``, a path that names a file of another kind and a scan that finds no image are errors.
    """
    given = [paths] if isinstance(paths, str) else paths
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    named = rf"\.({'|'.join(EXTENSIONS)})$"
    found = files.filter(F.lower("path").rlike(named)).select("path", "length").dropDuplicates(["path"]).orderBy("path")
    if strict:
        other = [p for p in given if (tail := p.rstrip("/").rsplit("/", 1)[-1]).rpartition(".")[1] and tail.rpartition(".")[2].lower() not in EXTENSIONS and files.select("path").filter(F.col("path").endswith("/" + tail)).limit(1).count()]
        if other:
            raise ValueError(f"not images: {', '.join(other)}")
        if found.isEmpty():
            raise ValueError(f"no images under {', '.join(given)}")
    return found


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Spark's decoded images; files that aren't images are left out."""
    return spark.read.format("image").option("dropInvalid", "true").load(paths)


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, which readers write in several forms."""
    return F.regexp_replace(path, "^file:/+", "/")


def listed_files(files: DataFrame) -> DataFrame:
    """(file): plain paths of all files of a scan, those without bytes too, which no reader gives."""
    paths = files.sparkSession.createDataFrame([(p,) for p in files.inputFiles()], "file string")
    return paths.select(plain_path(F.try_url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))).alias("file"))


#: How files of each kind begin.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "bmp": "424D", "gif": "47494638", "tiff": "49492A00", "tiff ": "4D4D002A"}


def decoded_images(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decoded images as ``images`` gives them, and what was left out: (path, length, reason), reason "empty", "not an image" or "broken"."""
    options = {"recursiveFileLookup": str(recursive).lower()}
    good = spark.read.format("image").options(**options).load(paths).filter("image.height > 0")
    files = spark.read.format("binaryFile").options(**options).load(paths).select("path", "length", F.hex(F.substring("content", 1, 8)).alias("head"))
    known = reduce(or_, [F.col("head").startswith(s) for s in SIGNATURES.values()])
    reason = F.when(known, "broken").otherwise("not an image")
    # Readers pass over files without bytes, so what was listed is compared with what was read. Paths are written in several forms.
    listed = listed_files(files).withColumnRenamed("file", "_path")
    seen = files.select("length", "head", plain_path(F.col("path")).alias("_path"))
    rejected = listed.join(good.select(plain_path(F.col("image.origin")).alias("_path")), "_path", "left_anti").join(seen, "_path", "left")
    return good, rejected.select(F.col("_path").alias("path"), F.coalesce("length", F.lit(0)).alias("length"), F.when(F.col("length").isNull(), "empty").otherwise(reason).alias("reason"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text): lines that aren't blank, counted from 1 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    return whole.select("file", (F.col("at") + 1).alias("line"), F.trim("text").alias("text")).filter("text <> ''")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("text").alias("path"))


def class_names(text: str) -> dict[int, str]:
    """The ``names`` of a dataset file, as a list or a map; JSON is read too."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    names = found.get("names", found) if isinstance(found, dict) else found
    return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names or []))}


def class_map(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(names.items()), "class_id int, class string")


# ---- detections


def detections_json(spark: SparkSession, path: str, default_class: str | None = None) -> DataFrame:
    """DETECTION rows of JSON arrays; no score counts as 1. Rows without a box are left out, and without a class unless there is a default."""
    rows = spark.read.schema(DETECTION).json(path, multiLine=True)
    return complete_detections(rows, default_class)


def complete_detections(rows: DataFrame, default_class: str | None = None) -> DataFrame:
    named = rows.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("class", F.coalesce("class", F.lit(default_class)))
    return named.filter("image_path is not null and class is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null").withColumn("image_path", normal_path("image_path"))


def detections_csv(text: DataFrame, text_col: str = "text") -> DataFrame:
    """DETECTION rows of lines ``image_path,x1,y1,x2,y2,class[,...]``; headers and lines of under six fields are left out."""
    f = F.split(F.trim(text_col), ",")
    rows = text.filter(~F.lower(F.trim(text_col)).startswith("image_path")).select(f.alias("f")).filter("size(f) >= 6")
    box = [F.expr(f"try_cast(try_cast(trim(f[{k}]) as double) as int)").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"), 1)]
    row = F.struct(F.trim(F.col("f")[0]).alias("image_path"), *box, F.trim(F.col("f")[5]).alias("class"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("track_id"))
    # One array a line, so that fields are parsed once and not again for each filter that follows.
    return complete_detections(rows.select(F.explode(F.array(row)).alias("d")).select("d.*"))


def normal_path(path: str) -> Column:
    """Slashes forward, no ``.`` parts and no repeated slashes."""
    p = F.translate(path, "\\", "/")
    whole = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(^|/)(\./)+", "$1")
    whole = F.regexp_replace(whole, r"(?<=.)/$", "")
    # Most paths are in normal form already, which plain searches tell.
    return F.when(p.contains("//") | p.contains("./") | p.endswith("/"), whole).otherwise(p)


def per_image(image_rows: DataFrame, detections: DataFrame) -> DataFrame:
    """``image_rows`` (path) with boxes: an array of its detections, empty where there is none."""
    box = F.struct("x1", "y1", "x2", "y2", "class", "score", "track_id")
    grouped = detections.groupBy(F.col("image_path").alias("path")).agg(F.collect_list(box).alias("boxes"))
    joined = image_rows.join(grouped, "path", "left")
    return joined.withColumn("boxes", F.coalesce("boxes", F.array().cast(grouped.schema["boxes"].dataType)))


# ---- label lines


def yolo_rows(label_lines: DataFrame, fields: str = "at least 5", text_col: str = "text") -> DataFrame:
    """(class_id, cx, cy, w, h, score) beside the other columns, from lines ``class cx cy w h [score]``.

    ``fields`` is "exactly 5" or "at least 5"; others are left out, and so are lines whose fields aren't numbers.
    A class may be written as 2.0. The sixth field is the score, 1 without it.
    """
    f = F.split(F.trim(text_col), r"\s+")
    # The fields are parsed once, as an array; what reads it only picks from it.
    number = F.transform(f, lambda x: x.try_cast("double"))
    fits = F.size("_n") == 5 if fields == "exactly 5" else F.size("_n") >= 5
    rows = label_lines.withColumn("_n", F.explode(F.array(number)))
    rows = rows.filter(fits & F.forall(F.slice("_n", 1, 5), lambda x: x.isNotNull()))
    values = {"class_id": F.get("_n", F.lit(0)).cast("int")} | {c: F.get("_n", F.lit(k)) for k, c in enumerate(("cx", "cy", "w", "h"), 1)}
    return rows.withColumns(values | {"score": F.coalesce(F.get("_n", F.lit(5)), F.lit(1.0))}).drop("_n")


def with_class_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds class from (class_id, class), the number as text where it is unknown."""
    return rows.join(names, "class_id", "left").withColumn("class", F.coalesce("class", F.col("class_id").cast("string")))


def labels_for_images(image_rows: DataFrame, label_files: DataFrame, image_root: str = "", label_root: str = "") -> DataFrame:
    """``image_rows`` (path) with label_path: the first that exists among ``label_files`` (path), else null.

    Tried in order: beside the image; under ``label_root`` at the image's place under ``image_root``; with the
    first folder named images (in any case) renamed labels.
    """
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    tried = [F.concat(bare, F.lit(".txt"))]
    if image_root and label_root:
        under = F.col("path").startswith(image_root.rstrip("/") + "/")
        tried.append(F.when(under, F.concat(F.lit(label_root.rstrip("/")), F.substring(bare, len(image_root.rstrip("/")) + 1, 1 << 20), F.lit(".txt"))))
    renamed = F.regexp_replace("path", r"(?i)^(.*?)(^|/)images/", "$1$2labels/")
    tried.append(F.when(renamed != F.col("path"), F.concat(F.regexp_replace(renamed, r"\.[^./]*$", ""), F.lit(".txt"))))
    candidates = image_rows.select(F.col("path").alias("_image"), F.posexplode(F.array(*tried)).alias("_order", "label_path")).filter("label_path is not null")
    there = candidates.join(label_files.select(F.col("path").alias("label_path")).distinct(), "label_path")
    best = there.groupBy("_image").agg(F.min_by("label_path", "_order").alias("label_path"))
    return image_rows.join(best, F.col("path") == F.col("_image"), "left").drop("_image")


def images_for_labels(label_rows: DataFrame, image_rows: DataFrame, file_col: str = "file") -> DataFrame:
    """``label_rows`` with image_path: the image of the same stem, by order of EXTENSIONS; others are left out."""
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))
    ranked = image_rows.withColumn("_stem", stem("path")).withColumn("_rank", F.row_number().over(Window.partitionBy("_stem").orderBy(order, "path")))
    one = ranked.filter("_rank = 1").select("_stem", F.col("path").alias("image_path"))
    return label_rows.withColumn("_stem", stem(file_col)).join(one, "_stem").drop("_stem")


# ---- COCO and circuits


def coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO file."""
    whole = spark.read.schema(COCO).json(path, multiLine=True)
    one = lambda name: whole.select(F.explode(name).alias("r")).select("r.*")
    return one("images"), one("annotations"), one("categories")


def coco_yolo(image_rows: DataFrame, annotations: DataFrame, categories: DataFrame, names: list[str], drop_crowds: bool = True) -> DataFrame:
    """(image_id, file_name, class_id, cx, cy, w, h) of the categories named; a class is the place of its name."""
    wanted = categories.filter(F.col("name").isin(names)).select(F.col("id").alias("category_id"), (F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1).cast("int").alias("class_id"))
    kept = annotations.filter(F.coalesce("iscrowd", F.lit(0)) != 1) if drop_crowds else annotations
    rows = kept.join(F.broadcast(wanted), "category_id").join(image_rows.withColumnRenamed("id", "image_id"), "image_id")
    x, y, w, h = (F.col("bbox")[k] for k in range(4))
    return rows.select("image_id", "file_name", "class_id", ((x + w / 2) / F.col("width")).alias("cx"), ((y + h / 2) / F.col("height")).alias("cy"), (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"))


def circuit_panels(spark: SparkSession, path: str) -> DataFrame:
    """(name, nodes, components, layout) of a circuits file."""
    return spark.read.schema(CIRCUITS).json(path, multiLine=True).select(F.explode("circuits").alias("p")).select("p.*")


# ---- sinks


def label_files(tiles: DataFrame, rows: DataFrame, key: str = "tile_name", keep_empty: bool = True, last_newline: bool = False) -> DataFrame:
    """(key, text): the label file of each tile, lines in order; of tiles without rows an empty one if wanted.

    ``last_newline`` ends the last line, too.
    """
    texts = rows.groupBy(key).agg(F.concat_ws("\n", F.array_sort(F.collect_list(yolo_line("class_id", "cx", "cy", "w", "h")))).alias("text"))
    joined = tiles.select(key).distinct().join(texts, key, "left" if keep_empty else "inner")
    text = F.coalesce("text", F.lit(""))
    return joined.withColumn("text", F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(text) if last_newline else text)


def relative_path(path, root: str) -> Column:
    """A path from ``root`` on, with forward slashes; one that lies elsewhere stays whole."""
    p, base = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).otherwise(p)


def circuit_json(panels: DataFrame) -> DataFrame:
    """(json): panels (name, nodes, components, layout) in the form that ``circuit_panels`` reads, one line a panel."""
    return panels.select(F.to_json(F.struct(F.array(F.struct(*panels.columns)).alias("circuits"))).alias("json"))


def write_graphs(graphs: DataFrame, path: str) -> None:
    """One folder for each image and cabinet with the JSON of its graph (image, cabinet, json)."""
    graphs.select("image", "cabinet", F.col("json").alias("value")).write.mode("overwrite").partitionBy("image", "cabinet").text(path)


def write_lines(rows: DataFrame, path: str, text_col: str = "text", order: str | None = None) -> None:
    """Text files of one column; a former table at ``path`` is replaced, so a second run repeats nothing."""
    (rows.orderBy(order) if order else rows).select(F.col(text_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def dataset_file(classes: int, train: str, val: str, names: dict[int, str] | None = None) -> str:
    """A dataset description; unnamed classes are cls_0, cls_1, ..."""
    listed = "".join(f"  {k}: {(names or {}).get(k, f'cls_{k}')}\n" for k in range(max(1, classes)))
    return f"train: {train}\nval: {val}\nnames:\n{listed}"

