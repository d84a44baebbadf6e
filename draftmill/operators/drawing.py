"""Drawings as ordered rows: what to draw, where and in which hue, instead of pixels.

A row is (graph, layer int, item long, part int, kind, points array<int>, hue int, text): in order of layer, item and
part. Kinds: line and arrow (x1, y1, x2, y2), box (x1, y1, x2, y2), circle and dot (x, y, radius), arc (x, y, radius x,
radius y: its lower half), text (x, y). A hue is null for what is drawn in gray or black.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import hue, short_name

LAYERS = {"attach": 0, "edge": 1, "box": 2, "symbol": 3, "label": 4}
_ROW = "struct<part:int,kind:string,points:array<int>,text:string>"

# Abbreviations of device classes.
ABBREVIATIONS = {
    "capacitor_variable": "C~", "capacitor_fixed": "C", "resistor": "R", "ground": "GND", "earth": "EARTH", "fuse": "FUSE", "fuse_indicator": "FI", "sw": "SW",
    "Transformer": "T", "3W_Transformer": "T3W", "Reactor": "L", "Arrester": "ARS", "Earth_Switch": "ESW", "motor_3phase": "M3", "indicator_lamp": "LAMP", "cabinet": "CAB",
}

# Strokes of symbols by class, in units around the middle: h, q and r are a half, a quarter and a third of the size s (whole numbers), t is the thickness.
STROKES = {
    "capacitor_fixed": [("line", "-h", "-s", "-h", "s"), ("line", "h", "-s", "h", "s")],
    "capacitor_variable": [("line", "-h", "-s", "-h", "s"), ("line", "h", "-s", "h", "s"), ("arrow", "-s", "-s", "s", "s")],
    "resistor": [("box", "-s", "-t * 2", "s", "t * 2")],
    "ground": [("line", "0", "-h", "0", "h"), ("line", "-h", "h", "h", "h")],
    "earth": [("line", "0", "-h", "0", "h"), ("line", "-h", "h", "h", "h")],
    "sw": [("line", "-s", "0", "-t", "0"), ("line", "t", "0", "s", "-h")],
    "Earth_Switch": [("line", "-s", "0", "-t", "0"), ("line", "t", "0", "s", "-h")],
    "Transformer": [("circle", "-h", "0", "h"), ("circle", "h", "0", "h")],
    "3W_Transformer": [("circle", "-h", "0", "h"), ("circle", "h", "0", "h")],
    "Reactor": [("arc", "-s", "0", "h", "r"), ("arc", "-s + s div 2", "0", "h", "r"), ("arc", "-s + 2 * s div 2", "0", "h", "r")],
    "fuse": [("line", "-s", "0", "-q", "0"), ("box", "-q", "-t * 2", "q", "t * 2"), ("line", "q", "0", "s", "0")],
    "Arrester": [("box", "-h", "-s", "h", "s")],
    "fuse_indicator": [("box", "-h", "-s", "h", "s")],
    "motor_3phase": [("circle", "0", "0", "s")],
    "indicator_lamp": [("circle", "0", "0", "s")],
}
OTHER = [("dot", "0", "0", "greatest(5, t * 3)")]


def _part(part: int, kind: str, points: list[Column], text: Column | None = None) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.array(*[p.cast("int") for p in points]).alias("points"), (text if text is not None else F.lit(None)).cast("string").alias("text"))


def _strokes(class_name: Column, x: Column, y: Column, size: Column) -> Column:
    """The parts of a class's symbol around (x, y)."""
    s = F.greatest(F.lit(10), size.cast("int"))
    names = {"s": s, "h": F.floor(s / 2), "q": F.floor(s / 4), "r": F.floor(s / 3), "t": F.greatest(F.lit(1), F.floor(s / 8))}
    value = {"0": F.lit(0), "-s + s div 2": F.floor(s / 2) - s, "-s + 2 * s div 2": F.floor(2 * s / 2) - s, "t * 2": names["t"] * 2, "-t * 2": names["t"] * -2, "greatest(5, t * 3)": F.greatest(F.lit(5), names["t"] * 3)}
    value |= names | {f"-{k}": -v for k, v in names.items()}

    def stroke(k: int, kind: str, *units: str) -> Column:
        middle = {"line": [x, y, x, y], "arrow": [x, y, x, y], "box": [x, y, x, y]}.get(kind, [x, y])
        return _part(k, kind, [value[u] + (middle[j] if j < len(middle) else 0) for j, u in enumerate(units)])

    all_ = lambda strokes: F.array(*[stroke(k, *st) for k, st in enumerate(strokes)])
    out = None
    for name, strokes in STROKES.items():
        out = (F if out is None else out).when(class_name == name, all_(strokes))
    return out.otherwise(all_(OTHER))


def _rows(items: DataFrame, layer: str, item: Column, parts: Column, color: Column) -> DataFrame:
    return items.select("graph", F.lit(LAYERS[layer]).alias("layer"), item.cast("long").alias("item"), F.explode(parts.cast(f"array<{_ROW}>")).alias("p"), color.cast("int").alias("hue")).select("graph", "layer", "item", "p.part", "p.kind", "p.points", "hue", "p.text")


def _with_hues(devices: DataFrame) -> DataFrame:
    """Devices (graph, device, class, ...) with the number of devices of their graph, and their hue by place."""
    counts = devices.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return devices.join(counts, "graph").withColumn("hue", hue("device", "n"))


def _name(devices: DataFrame) -> Column:
    return F.concat_ws(":", F.col("device").cast("string"), short_name("class", ABBREVIATIONS))


def schematic(devices: DataFrame, margin: int = 0, share: float = 0.33) -> DataFrame:
    """Boxes, symbols and labels of devices (graph, device 0 to n - 1, class, x1, y1, x2, y2); a symbol takes ``share`` (0.1 to 0.6) of the lesser side."""
    d = _with_hues(devices).select("graph", "device", "class", "hue", *[(F.col(c) + by).alias(c) for c, by in (("x1", -margin), ("y1", -margin), ("x2", margin), ("y2", margin))])
    least = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    size = F.greatest(F.lit(10.0), least * min(max(share, 0.1), 0.6)).cast("int")
    x, y = F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2)
    box = F.array(_part(0, "box", [F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    label = F.array(_part(0, "text", [F.col("x1") + 6, F.col("y1") - 6], _name(d)))
    black = F.lit(None)
    item = F.col("device")
    return _rows(d, "box", item, box, F.col("hue")).unionByName(_rows(d, "symbol", item, _strokes(F.col("class"), x, y, size), black)).unionByName(_rows(d, "label", item, label, F.col("hue")))


def overlay(devices: DataFrame, edges: DataFrame, pins: DataFrame, attached: DataFrame) -> DataFrame:
    """Guides (graph, device, x1, y1, x2, y2), links (graph, u, v) between pins (graph, device, x, y) or middles, boxes and labels."""
    d = _with_hues(devices)
    middle = d.join(pins.select("graph", "device", F.col("x").alias("px"), F.col("y").alias("py")), ["graph", "device"], "left")
    middle = middle.select("graph", "device", F.coalesce("px", ((F.col("x1") + F.col("x2")) / 2).cast("int")).alias("x"), F.coalesce("py", ((F.col("y1") + F.col("y2")) / 2).cast("int")).alias("y"))
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    box, label = F.array(_part(0, "box", corners)), F.array(_part(0, "text", [F.col("x1") + 6, F.col("y1") - 6], _name(d)))
    gray, item = F.lit(None), F.col("device")
    guides = attached.withColumn("_k", F.row_number().over(Window.partitionBy("graph").orderBy("device", "x1", "y1", "x2", "y2")) - 1)
    return (
        _rows(guides, "attach", F.col("_k"), F.array(_part(0, "line", corners)), gray)
        .unionByName(_links(edges, middle))
        .unionByName(_rows(d, "box", item, box, F.col("hue")))
        .unionByName(_rows(d, "label", item, label, F.col("hue")))
    )


def _links(edges: DataFrame, places: DataFrame) -> DataFrame:
    """A line for each link (graph, u, v), numbered in order of u and v, between places (graph, device, x, y)."""
    end = lambda name, n: places.select("graph", F.col("device").alias(name), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    lines = edges.join(end("u", 1), ["graph", "u"]).join(end("v", 2), ["graph", "v"])
    lines = lines.withColumn("_k", F.row_number().over(Window.partitionBy("graph").orderBy("u", "v")) - 1)
    return _rows(lines, "edge", F.col("_k"), F.array(_part(0, "line", [F.col(c) for c in ("x1", "y1", "x2", "y2")])), F.lit(None))


def ring_layout(devices: DataFrame, edges: DataFrame, least_size: int = 800) -> DataFrame:
    """Devices (graph, device 0 to n - 1, class) on a ring, links (graph, u, v) between them, numbers outside of it and names beside those.

    Places are cut to whole numbers after rounding to nine digits. Links to devices that aren't there are left out.
    """
    d = _with_hues(devices)
    size = F.greatest(F.lit(least_size), F.col("n") * 28)
    middle, radius = F.floor(size / 2), F.floor(size * 0.38)
    angle = F.col("device") / F.col("n") * (2 * 3.141592653589793)
    whole = lambda c: F.round(c, 9).cast("int")
    d = d.withColumns({"_m": middle, "x": whole(middle + radius * F.cos(angle)), "y": whole(middle + radius * F.sin(angle))})
    vx, vy = F.col("x") - F.col("_m"), F.col("y") - F.col("_m")
    length = F.sqrt(vx * vx + vy * vy) + 1e-6
    ox, oy = whole(F.col("x") + 12 * vx / length), whole(F.col("y") + 12 * vy / length)
    dot = F.array(_part(0, "dot", [F.col("x"), F.col("y"), F.lit(5)]))
    texts = F.array(_part(0, "text", [ox, oy], F.col("device")), _part(1, "text", [ox + 16, oy + 12], short_name("class", ABBREVIATIONS)))
    return _links(edges, d).unionByName(_rows(d, "box", F.col("device"), dot, F.col("hue"))).unionByName(_rows(d, "label", F.col("device"), texts, F.col("hue")))
