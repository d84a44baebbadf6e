"""Graphs, thresholds, runs and nets against brute force, and a drawing from PNG to device pairs."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.operators import cleanup, graph, raster
from draftmill.sources import annotations as src


def png(gray: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in gray)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def flood(ink: np.ndarray) -> np.ndarray:
    """8-connected components, 0 for none."""
    label, n = np.zeros(ink.shape, int), 0
    for y, x in zip(*np.nonzero(ink), strict=True):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for c in range(max(0, a - 1), min(ink.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(ink.shape[1], b + 2)):
                    if ink[c, d] and not label[c, d]:
                        label[c, d] = n
                        todo.append((c, d))
    return label


def test_components_equal_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (999, 999)]
    root = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*edges, (1, None)], "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_net_pairs(spark, rows):
    m = spark.createDataFrame([(1, 2), (1, 0), (1, 1), (2, 1), (2, 2), (3, 3), (1, 2)], "net int, device int")
    assert rows(graph.shared_net_pairs(m)) == [(0, 1), (0, 2), (1, 2)]


def test_circuits(spark, rows, tmp_path):
    text = """{"reference_image": "r", "circuits": [{"name": "p", "nodes": [{"id": "bus", "label": "Bus"}, {"id": "gnd", "label": "G"}],
      "components": [{"id": "E1", "type": "earth_switch", "connections": ["bus", "gnd"]}, {"id": "S1", "type": "surge", "connections": ["gnd", "bus"], "note": "n"},
      {"id": "X", "type": "lamp", "connections": ["bus"]}, {"id": "R", "type": "resistor", "connections": ["bus", "mid", "gnd"]}], "layout": {"bus": [0, 1]}}]}"""
    (tmp_path / "c.json").write_text(text)
    edges = graph.circuit_edges(src.circuit_panels(spark, str(tmp_path / "c.json")))
    assert rows(edges.select("component", "source", "target")) == [("E1", "bus", "gnd"), ("R", "bus", "mid"), ("R", "mid", "gnd"), ("S1", "gnd", "bus")]
    one = graph.collapsed(edges.withColumn("order", F.col("at") * 1000 + F.col("place")), "panel", "label", "order")
    assert ("p", "bus", "gnd", "S1 (surge)", 2) in rows(one)


def test_graph_json(spark):
    nodes = spark.createDataFrame([(1, 1, "d"), (1, 0, "d"), (2, 5, "e")], "cabinet int, id long, class string")
    edges = spark.createDataFrame([(1, 0, 1)], "cabinet int, u long, v long")
    got = {r.cabinet: r.json for r in graph.graph_json(nodes, edges).collect()}
    assert got == {1: '{"nodes":[{"id":0,"class":"d"},{"id":1,"class":"d"}],"edges":[{"u":0,"v":1}]}', 2: '{"nodes":[{"id":5,"class":"e"}],"edges":[]}'}


def test_small_components_and_zero_only(spark, rows):
    m = spark.createDataFrame([("i", c) for c, n in (("a", 100), ("b", 10), ("c", 9)) for _ in range(n)], "image string, c string")
    assert [r[1] for r in rows(cleanup.large_components(m, "image", "c", 0.1))] == ["a", "b"]
    files = spark.createDataFrame([("e",), ("z",), ("m",), ("zz",)], "file string")
    lines = spark.createDataFrame([("z", "0"), ("z", "0"), ("m", "0"), ("m", "1"), ("zz", "00")], "file string, class_text string")
    assert rows(cleanup.zero_only(files, lines)) == [("e", True), ("m", False), ("z", True), ("zz", False)]
    assert rows(cleanup.without_zero_only(files, lines)) == [("m",), ("zz",)]
    assert cleanup.class_total(spark.createDataFrame([("25",), ("x",)], "class_id string")).first()[0] == 26
    assert cleanup.class_total(spark.createDataFrame([], "class_id string")).first()[0] == 1


def test_otsu_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.r_[rng.integers(20, 80, 300), rng.integers(150, 220, 200)]
    got = raster.otsu_thresholds(spark.createDataFrame([("i", int(x)) for x in v], "image string, v int")).first().threshold
    best = max(range(256), key=lambda t: ((v <= t).sum() * (v > t).sum() * (v[v <= t].mean() - v[v > t].mean()) ** 2 if 0 < (v <= t).sum() < len(v) else 0, -t))
    assert got == best == raster._otsu(v.reshape(20, 25))


def test_sauvola_equals_its_formula():
    g = np.random.default_rng(6).integers(0, 255, (20, 30))
    t = raster.sauvola(g, 7, 0.2)
    w = g[5:12, 9:16].astype(float)
    assert t[8, 12] == pytest.approx(w.mean() * (1 + 0.2 * (w.std() / 128 - 1)))
    assert raster.odd_window(1000, 0.02, 15) == 21 and raster.odd_window(100, 0.02, 15) == 15


def test_thinned_line_keeps_its_length():
    ink = np.zeros((9, 30), bool)
    ink[3:6, 3:27] = True
    thin = raster.thinned(ink)
    assert thin.sum(0).max() == 1 and thin.any(0).sum() >= 20


def as_runs(spark, ink, name="i"):
    return spark.createDataFrame([(name, int(y), int(a), int(b)) for y, a, b in zip(*raster._runs(ink), strict=True)], "image string, y int, x0 int, x1 int")


def as_ink(runs, shape):
    out = np.zeros(shape, bool)
    for r in runs.collect():
        out[r.y, r.x0 : r.x1 + 1] = True
    return out


def test_lines_carving_and_nets(spark):
    rng = np.random.default_rng(7)
    ink = rng.random((24, 40)) < 0.12
    ink[5, 3:30] = ink[10:20, 8] = ink[14, 4:22] = True
    runs = as_runs(spark, ink)
    lines = as_ink(raster.straight_lines(runs, 7, 5), ink.shape)
    keep = np.zeros_like(ink)
    for y in range(24):
        for x in range(40):
            if ink[y, x : x + 7].all() and x + 7 <= 40:
                keep[y, x : x + 7] = True
            if ink[y : y + 5, x].all() and y + 5 <= 24:
                keep[y : y + 5, x] = True
    assert (lines == keep).all()
    boxes = spark.createDataFrame([("i", 5, 3, 14, 12), ("i", 10, 8, 20, 18)], "image string, x1 int, y1 int, x2 int, y2 int")
    cut = keep.copy()
    cut[4:11, 6:13] = cut[9:17, 11:19] = False
    assert (as_ink(raster.carved(as_runs(spark, keep), boxes), ink.shape) == cut).all()
    wide = as_ink(raster.thickened(as_runs(spark, keep), 1, spark.createDataFrame([("i", 40, 24)], "image string, width int, height int")), ink.shape)
    around = np.zeros_like(keep)
    for y, x in zip(*np.nonzero(keep), strict=True):
        around[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = True
    assert (wide == around).all()
    label = flood(ink)
    groups = {}
    for r in raster.nets(runs).collect():
        groups.setdefault(r.net, set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    expected = {frozenset(zip(*np.nonzero(label == k), strict=True)) for k in range(1, label.max() + 1)}
    assert {frozenset(g) for g in groups.values()} == expected


def test_drawing_to_device_pairs(spark, tmp_path, rows):
    gray = np.full((80, 120), 255)
    gray[20, 20:60] = gray[20:60, 60] = gray[60, 60:100] = 0  # from device 0 to device 1
    gray[40, 5:31] = 0  # device 2, to nothing
    (tmp_path / "page (1).png").write_bytes(png(gray))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    pixels = raster.gray_pixels(src.images(spark, str(tmp_path)))
    assert [(r.height, r.width) for r in pixels.collect()] == [(80, 120)]
    name = pixels.first().image
    boxes = spark.createDataFrame([(name, 0, 10, 10, 25, 30), (name, 1, 95, 50, 110, 70), (name, 2, 2, 35, 12, 45)], "image string, device int, x1 int, y1 int, x2 int, y2 int")
    assert rows(raster.device_graph(pixels, boxes, 9, 9).select("u", "v")) == [(0, 1)]
    assert rows(raster.device_graph(pixels, boxes, 9, 9, radius=1).select("u", "v")) == [(0, 1)]
    assert src.image_files(spark, str(tmp_path)).count() == 2


def test_content_boxes(spark, rows):
    p = spark.createDataFrame([("a", 3, 4, 10), ("a", 5, 9, 200), ("b", 1, 1, 255)], "image string, y int, x int, v int")
    sizes = spark.createDataFrame([("a", 20, 20), ("b", 7, 8)], "image string, width int, height int")
    assert rows(raster.content_boxes(p, sizes)) == [("a", 4, 3, 10, 6), ("b", 0, 0, 7, 8)]


def test_shared_net_pairs_are_swept_not_joined(spark, rows, capsys, monkeypatch):
    """A join and tables of hashes held all pairs of a task; nets of many pairs are made in parts."""
    monkeypatch.setattr(graph, "PAIRS", 7)
    r = np.random.default_rng(4)
    members = [("ab"[a], int(n), f"d{d}") for a, n, d in zip(r.integers(0, 2, 300), r.integers(0, 9, 300), r.integers(0, 25, 300), strict=True)]
    m = spark.createDataFrame([*members, (None, 1, "d1"), (None, 1, "d2"), ("a", None, "d1"), ("a", 1, None)], "graph string, net long, device string")
    own = set(members)
    expected = {(g, u, v) for g, n, u in own for h, k, v in own if (g, n) == (h, k) and u < v}
    found = graph.shared_net_pairs(m, within=("graph",))
    assert rows(found) == sorted(expected, key=repr)
    assert rows(graph.shared_net_pairs(m)) == sorted({(u, v) for _, n, u in own for _, k, v in own if n == k and u < v} | {("d1", "d2")} | {tuple(sorted(("d1", x))) for _, n, x in own if n == 1 and x != "d1"} | {tuple(sorted(("d2", x))) for _, n, x in own if n == 1 and x != "d2"}, key=repr)
    assert graph.shared_net_pairs(m.limit(0)).count() == 0
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "HashAggregate" not in plan
