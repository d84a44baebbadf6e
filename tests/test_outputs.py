"""Drawings, reports, maps in the plane, and small parts of the service."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.functions import boxes as bx
from draftmill.operators import drawing, plane, raster, report, service
from draftmill.sources import annotations as src


def test_a_schematic(spark):
    devices = spark.createDataFrame([("g", 0, "fuse", 0, 0, 60, 80), ("g", 1, "unheard_of", 5, 5, 10, 10)], "graph string, device long, class string, x1 int, y1 int, x2 int, y2 int")
    got = [(r.layer, r.item, r.part, r.kind, r.points, r.hue, r.text) for r in drawing.schematic(devices, margin=2).orderBy("layer", "item", "part").collect()]
    assert got == [
        (2, 0, 0, "box", [-2, -2, 62, 82], 0, None), (2, 1, 0, "box", [3, 3, 12, 12], 89, None),
        (3, 0, 0, "line", [9, 40, 25, 40], None, None), (3, 0, 1, "box", [25, 36, 35, 44], None, None), (3, 0, 2, "line", [35, 40, 51, 40], None, None), (3, 1, 0, "dot", [7, 7, 5], None, None),
        (4, 0, 0, "text", [4, -8], 0, "0:FUSE"), (4, 1, 0, "text", [9, -3], 89, "1:unheard_"),
    ]


def test_a_ring_of_one_and_of_none(spark):
    devices = spark.createDataFrame([("g", 0, "fuse")], "graph string, device long, class string")
    edges = spark.createDataFrame([("g", 0, 7)], "graph string, u long, v long")
    got = {(r.layer, r.part): (r.points, r.text) for r in drawing.ring_layout(devices, edges).collect()}
    assert got == {(2, 0): ([704, 400, 5], None), (4, 0): ([715, 400], "0"), (4, 1): ([731, 412], "FUSE")}
    assert drawing.ring_layout(devices.limit(0), edges).count() == 0


def test_pages(spark):
    files = spark.createDataFrame([("a<b>.png",), ("c.png",), ("d.png",)], "filename string")
    matches = spark.createDataFrame([("c.png", 2, "x&y", 0.5, 10.0, True), ("c.png", 1, "z", 0.25, 60.0, False), ("d.png", 1, "z", 0.1, 99.95, True)], "filename string, rank int, label string, vector_dist double, structure_score double, trusted boolean")
    pages = report.match_pages(files, matches)
    got = {r.filename: (r.trusted, r.html) for r in pages.collect()}
    assert got["a<b>.png"] == (False, f"{report.HEAD}<h1>? a&lt;b>.png</h1><ol></ol>{report.TAIL}")
    assert got["c.png"] == (False, f'{report.HEAD}<h1>? c.png</h1><ol><li class="first"><b>1</b> z <i>doubtful</i> 0.250 <span>60.0%</span></li><li><b>2</b> x&amp;y <i>trusted</i> 0.500 <span>10.0%</span></li></ol>{report.TAIL}')
    assert got["d.png"][0]
    index = [r.html for r in report.index_pages(pages, 2).orderBy("page").collect()]
    assert index == [f'{report.HEAD}<ol><li>? a&lt;b>.png</li><li>? c.png</li></ol><a href="index-1.html">more</a>{report.TAIL}', f"{report.HEAD}<ol><li>+ d.png</li></ol>{report.TAIL}"]
    assert report.index_pages(pages.limit(0)).count() == 0


def test_bandwidths_have_the_perplexity():
    squared = np.random.default_rng(1).random((50, 30)) * 9
    squared[0] = 0
    beta = plane.bandwidths(squared, 7.0)
    p = np.exp(-squared * beta[:, None])
    p /= p.sum(1, keepdims=True)
    reached = np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1))
    assert np.abs(reached[1:] - 7).max() < 1e-6 and reached[0] == pytest.approx(30)


def test_a_map_parts_clusters(spark):
    rng = np.random.default_rng(3)
    label = np.repeat(np.arange(3), 25)
    m = rng.normal(size=(3, 8))[label] * 6 + rng.normal(size=(75, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(None, m[0].tolist()), (99, None)], "id long, embedding array<double>")
    links = plane.affinities(rows, 10).cache()
    p = np.zeros((75, 75))
    for r in links.collect():
        p[r.a, r.b] = r.p
    assert p.sum() == pytest.approx(1) and np.allclose(p, p.T) and not p.diagonal().any()
    places = lambda rounds: np.array([[r.x, r.y] for r in plane.plane_layout(links, rounds).orderBy("id").collect()])
    assert np.allclose(places(2), places(2), atol=1e-12)
    found = places(20)
    assert found.shape == (75, 2)
    d = ((found[:, None] - found) ** 2).sum(2) + np.diag(np.full(75, np.inf))
    assert (label[d.argmin(1)] == label).mean() > 0.9
    assert plane.affinities(rows.filter("id = 1")).count() == 0 and plane.plane_layout(links.limit(0), 3).count() == 0


def test_colours_and_bars(spark):
    with pytest.raises(Exception, match="not a colour"):
        spark.range(1).select(bx.rgb(F.lit("red"), strict=True).alias("c")).collect()
    assert spark.range(1).select(bx.rgb(F.lit("1,2,3"), strict=True).alias("c")).first().c.b == 1
    queries = spark.createDataFrame([("a",)], "filename string")
    matches = spark.createDataFrame([("a", 1, "x", 60.0), ("a", 2, "y", 59.9), ("b", 1, "x", 99.0)], "filename string, rank int, label string, structure_score double")
    assert sorted(tuple(r) for r in service.match_bars(queries, matches).collect()) == [("a", 1, "1:x", 60.0, 60), ("a", 2, "2:y", 59.9, 0)]


def test_files_that_are_there(spark, tmp_path):
    (tmp_path / "a b.png").write_bytes(b"x")
    (tmp_path / "empty+.png").write_bytes(b"")
    batch = spark.createDataFrame([(f"file://{tmp_path}/a b.png",), (f"{tmp_path}/empty+.png",), (f"{tmp_path}/gone.png",)], "path string")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in service.files_there(batch, str(tmp_path)).collect()) == ["a b.png", "empty+.png"]


def test_colour_images(spark, tmp_path):
    import struct
    import zlib

    rgb = np.random.default_rng(5).integers(0, 256, (3, 4, 3)).astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\x00" + row.tobytes() for row in rgb))) + chunk(b"IEND", b""))
    images = src.images(spark, str(tmp_path))
    row = raster.colour_pixels(images).first()
    assert np.array_equal(np.stack([row.r, row.g, row.b], 1), rgb.reshape(-1, 3))
    gray = np.array(raster.gray_pixels(images).first().pixels)
    row = raster.colour_pixels(images, 128).first()
    assert row.r == row.g == row.b == np.where(gray > 128, 255, 0).tolist()
