"""Filters over groups of annotations, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_only(files: DataFrame, lines: DataFrame, file_col: str = "file", class_col: str = "class_text") -> DataFrame:
    """``files`` with zero_only: no line at all, or every line's first field is the text "0"."""
    judged = lines.groupBy(file_col).agg(F.bool_and(F.col(class_col).eqNullSafe(F.lit("0"))).alias("_zero"))
    return files.join(judged, file_col, "left").withColumn("zero_only", F.coalesce("_zero", F.lit(True))).drop("_zero")


def without_zero_only(files: DataFrame, lines: DataFrame, file_col: str = "file", class_col: str = "class_text") -> DataFrame:
    return zero_only(files, lines, file_col, class_col).filter(~F.col("zero_only")).drop("zero_only")


def large_components(members: DataFrame, image_col: str, component_col: str, ratio: float = 0.1) -> DataFrame:
    """(image, component, area, largest): components of at least max(1, int(ratio * the image's largest area)) rows."""
    areas = members.groupBy(image_col, component_col).agg(F.count(F.lit(1)).alias("area"))
    largest = F.max("area").over(Window.partitionBy(image_col))
    return areas.withColumn("largest", largest).filter(F.col("area") >= F.greatest(F.lit(1), (F.col("largest") * ratio).cast("long")))


def of_classes(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, class_col: str = "class") -> DataFrame:
    """Rows of included classes (None: all) that are not excluded; case doesn't matter."""
    name = F.lower(F.col(class_col))
    if include is not None:
        rows = rows.filter(name.isin([c.lower() for c in include]))
    return rows.filter(F.coalesce(~name.isin([c.lower() for c in exclude]), F.lit(True))) if exclude else rows


def class_counts(rows: DataFrame, class_col: str = "class_id", split_col: str | None = None) -> DataFrame:
    keys = [split_col, class_col] if split_col else [class_col]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("boxes"))


def class_total(rows: DataFrame, class_col: str = "class_id") -> DataFrame:
    """(classes): the largest class number plus one, fields that aren't numbers ignored; one class if there is none."""
    return rows.agg((F.greatest(F.coalesce(F.max(F.expr(f"try_cast(try_cast({class_col} as double) as int)")), F.lit(-1)), F.lit(0)) + 1).alias("classes"))


def split_counts(files: DataFrame, split_col: str = "split", rows_col: str = "boxes") -> DataFrame:
    """(split, files, empty, boxes) of files with their number of boxes."""
    return files.groupBy(split_col).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce(F.col(rows_col), F.lit(0)) == 0).alias("empty"), F.sum(F.coalesce(F.col(rows_col), F.lit(0))).alias("boxes"))
