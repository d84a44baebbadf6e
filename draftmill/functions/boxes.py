"""Column expressions on boxes (x1, y1, x2, y2), points and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def clip(x1, y1, x2, y2, width, height) -> Box:
    """Corners inside the image; a degenerate box becomes at least one pixel."""
    x1, y1, x2, y2, width, height = map(col, (x1, y1, x2, y2, width, height))
    a = F.greatest(F.lit(0), F.least(x1, width - 1))
    b = F.greatest(F.lit(0), F.least(y1, height - 1))
    c = F.greatest(F.lit(0), F.least(x2, width))
    d = F.greatest(F.lit(0), F.least(y2, height))
    return a, b, F.when(c <= a, a + 1).otherwise(c), F.when(d <= b, b + 1).otherwise(d)


def center(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Truncated toward zero."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return ((x1 + x2) / 2).cast("int"), ((y1 + y2) / 2).cast("int")


def expand(x1, y1, x2, y2, margin, width, height) -> Box:
    x1, y1, x2, y2, margin = map(col, (x1, y1, x2, y2, margin))
    return clip(x1 - margin, y1 - margin, x2 + margin, y2 + margin, width, height)


def size(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Width and height, no less than 0."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return F.greatest(F.lit(0), x2 - x1), F.greatest(F.lit(0), y2 - y1)


def within(x1, y1, x2, y2, left, top) -> Box:
    """Corners counted from the corner of a region that was cut out."""
    x1, y1, x2, y2, left, top = map(col, (x1, y1, x2, y2, left, top))
    return x1 - left, y1 - top, x2 - left, y2 - top


def intersection(a: Box, b: Box) -> Box:
    """Corners of the common box; it is empty where ``overlaps`` is false."""
    a, b = tuple(map(col, a)), tuple(map(col, b))
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def overlaps(a: Box, b: Box) -> Column:
    """Touching boxes don't overlap."""
    x1, y1, x2, y2 = intersection(a, b)
    return (x2 > x1) & (y2 > y1)


def yolo_to_box(cx, cy, w, h, width, height) -> Box:
    cx, cy, w, h, width, height = map(col, (cx, cy, w, h, width, height))
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def yolo_to_pixels(cx, cy, w, h, width, height) -> Box:
    """Corners in whole pixels, truncated toward zero."""
    return tuple(c.cast("int") for c in yolo_to_box(cx, cy, w, h, width, height))


def box_to_yolo(x1, y1, x2, y2, width, height) -> Box:
    """Normalised center and size; corners may come in either order."""
    x1, y1, x2, y2, width, height = map(col, (x1, y1, x2, y2, width, height))
    left, right, top, bottom = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    return (left + right) / 2 / width, (top + bottom) / 2 / height, (right - left) / width, (bottom - top) / height


def coco_to_yolo(x, y, w, h, width, height) -> Box:
    x, y, w, h, width, height = map(col, (x, y, w, h, width, height))
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def nearest_on_border(x1, y1, x2, y2, px, py) -> tuple[Column, Column]:
    """The clamped point moved to its nearest side; ties go left, right, top, bottom."""
    x1, y1, x2, y2, px, py = map(col, (x1, y1, x2, y2, px, py))
    x, y = F.greatest(x1, F.least(px, x2)), F.greatest(y1, F.least(py, y2))
    left, right, top, bottom = F.abs(x - x1), F.abs(x2 - x), F.abs(y - y1), F.abs(y2 - y)
    m = F.least(left, right, top, bottom)
    return F.when(m == left, x1).when(m == right, x2).otherwise(x), F.when((m == left) | (m == right), y).when(m == top, y1).otherwise(y2)


def elbow(px, py, tx, ty) -> tuple[Column, Column]:
    """The corner of the L from a point to its target: along x first if that leg is the longer."""
    px, py, tx, ty = map(col, (px, py, tx, ty))
    wide = F.abs(px - tx) > F.abs(py - ty)
    return F.when(wide, px).otherwise(tx), F.when(wide, ty).otherwise(py)


def letterbox(w, h, target_w, target_h) -> tuple[Column, Column, Column, Column, Column]:
    """(scale, new width, new height, left, top) that fit an image into a frame; sides round half to even.

    An image without width or height fills the frame, with a null scale.
    """
    w, h, target_w, target_h = map(col, (w, h, target_w, target_h))
    some = (w > 0) & (h > 0)
    scale = F.when(some, F.least(target_w / F.nullif(w, F.lit(0)), target_h / F.nullif(h, F.lit(0))))
    side = lambda n, target: F.when(some, F.greatest(F.lit(1), F.bround(n * scale).cast("int"))).otherwise(target)
    nw, nh = side(w, target_w), side(h, target_h)
    return scale, nw, nh, F.floor((target_w - nw) / 2), F.floor((target_h - nh) / 2)


def downscale(w, h, mode: str, target: float) -> tuple[Column, Column, Column]:
    """(scale, new width, new height). "longer" and "pixels" never enlarge, other modes but "scale" do nothing."""
    w, h = col(w), col(h)
    one = F.lit(1.0)
    if mode == "scale":
        scale = F.lit(float(target))
    elif mode == "longer":
        scale = F.when(F.greatest(w, h) <= target, one).otherwise(F.lit(float(target)) / F.greatest(w, h))
    elif mode == "pixels":
        scale = F.when(w * h <= target, one).otherwise(F.sqrt(F.lit(float(target)) / (w * h)))
    else:
        scale = one
    return scale, (w * scale).cast("int"), (h * scale).cast("int")


def tile_starts(length, tile: int, overlap: float = 0.2) -> Column:
    """Starts of tiles that cover ``length``: regular strides, then one that ends at the border."""
    last = F.greatest(F.lit(0), col(length).cast("int") - tile)
    stride = max(1, round(tile * (1 - overlap)))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def hue(index, n) -> Column:
    """A hue below 179 by index; 0 where there is nothing to number."""
    index, n = col(index), col(n)
    return F.when(n <= 0, F.lit(0)).otherwise(F.floor(index * 179 / F.greatest(F.lit(1), n)) % 179).cast("int")


def circle_point(index, n, least_size: float, per_item: float = 28.0, share: float = 0.38) -> tuple[Column, Column]:
    """Place of item ``index`` of ``n`` on a circle in the middle of a square that grows with n."""
    index, n = col(index), col(n)
    size = F.greatest(F.lit(least_size), n * per_item)
    radius, angle = F.floor(size * share), index * (2 * 3.141592653589793) / n
    return size / 2 + radius * F.cos(angle), size / 2 + radius * F.sin(angle)


def rgb(color, strict: bool = False) -> Column:
    """(r, g, b) struct of ``#RRGGBB`` or ``B,G,R``; empty or null is pure blue in B,G,R, malformed text is null, or an error if ``strict``."""
    c = F.trim(F.coalesce(col(color), F.lit("")))
    digit = lambda at: F.conv(F.substring(c, at, 2), 16, 10).cast("int")
    part = lambda k: F.split(c, ",").getItem(k).cast("int")
    make = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    return (
        F.when(c == "", make(F.lit(0), F.lit(0), F.lit(255)))
        .when(c.rlike("^#[0-9A-Fa-f]{6}$"), make(digit(2), digit(4), digit(6)))
        .when(c.rlike(r"^\s*\d+\s*,\s*\d+\s*,\s*\d+\s*$"), make(part(2), part(1), part(0)))
        .otherwise(F.raise_error(F.concat(F.lit("not a colour: "), c)).cast("struct<r:int,g:int,b:int>") if strict else F.lit(None))
    )


def lookup(key, table: dict[str, str], otherwise: Column) -> Column:
    """A value from a small fixed table."""
    if not table:
        return otherwise
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(key)), otherwise)


def short_name(class_name, table: dict[str, str] | None = None) -> Column:
    """An abbreviation, by default the first 8 characters."""
    return lookup(class_name, table or {}, F.substring(col(class_name), 1, 8))
