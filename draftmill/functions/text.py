"""Text forms of vectors, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col


def rounded(x, digits: int) -> Column:
    """A double rounded half up; what rounds to zero keeps its sign (-0.0), which ``round`` drops."""
    x = col(x).cast("double")
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def vector_text(v, most: int = 8) -> Column:
    """``[0.1000, 0.2000, ...] (dim=64)``: the first dimensions with four decimals."""
    v = col(v)
    head = F.concat_ws(", ", F.transform(F.slice(v, 1, most), lambda x: F.format_string("%.4f", rounded(x, 4))))
    return F.concat(F.lit("["), head, F.when(F.size(v) > most, F.lit(", ...")).otherwise(""), F.lit("] (dim="), F.size(v).cast("string"), F.lit(")"))


def rule_line(id_, label, v, most: int = 8) -> Column:
    return F.format_string("id=%04d label=%s embedding=%s", col(id_), col(label), vector_text(v, most))


def labels_of(given, file_name) -> Column:
    """Labels from a comma-separated text, blanks and empty ones dropped; without any, the file's name less its extension."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(given), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(stem(file_name)))


def base_name(path) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), r"\\", "/"), r"([^/]*)$", 1)


def stem(path) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def yolo_line(class_id, cx, cy, w, h) -> Column:
    """``class cx cy w h`` with six decimals."""
    number = lambda c: F.format_string("%.6f", F.round(col(c).cast("double"), 6))
    return F.concat_ws(" ", col(class_id).cast("int").cast("string"), number(cx), number(cy), number(w), number(h))


def wrapped_base64(raw, width: int = 76) -> Column:
    return F.regexp_replace(F.regexp_replace(F.base64(col(raw)), r"\s", ""), f"(.{{{width}}})(?=.)", "$1\n")


def escaped(text) -> Column:
    """``&`` and ``<`` made safe for HTML."""
    return F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
