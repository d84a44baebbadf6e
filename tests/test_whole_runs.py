"""From rasters and boxes to graphs and data sets, and the files around them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.functions import boxes as bx
from draftmill.operators import raster, rules, tiling
from draftmill.sources import annotations as src

BOX = "image string, box_id long, class string, x1 int, y1 int, x2 int, y2 int"


def drawing():
    """A cabinet with two devices on one wire and a third alone; another pair of devices outside of it."""
    ink = np.full((160, 300), 255, int)
    boxes = [(0, "Cabinet", 10, 10, 200, 150), (1, "a", 30, 30, 60, 60), (2, "b", 120, 30, 150, 60), (3, "c", 60, 110, 90, 140), (4, "d", 210, 30, 230, 60), (5, "e", 270, 30, 290, 60)]
    for _, _, x1, y1, x2, y2 in boxes[1:]:
        ink[y1, x1:x2] = ink[y2 - 1, x1:x2] = ink[y1:y2, x1] = ink[y1:y2, x2 - 1] = 0
    ink[45, 60:120] = 0
    ink[45, 230:270] = 0
    return ink, boxes


def test_cabinets_are_cut_out_and_joined(spark):
    ink, boxes = drawing()
    flat = [int(v) for v in ink.ravel()]
    images = spark.createDataFrame([(n, 160, 300, flat) for n in ("with", "without", "bare")], "image string, height int, width int, pixels array<int>")
    rows = [("with", *b) for b in boxes] + [("without", *b) for b in boxes[1:]]
    got = {(r.image, r.cabinet): json.loads(r.json) for r in raster.cabinet_graphs(images, spark.createDataFrame(rows, BOX), least=20).collect()}
    assert set(got) == {("with", 0), ("without", 0), ("bare", 0)}
    inside = got["with", 0]
    assert [(n["id"], n["class"]) for n in inside["nodes"]] == [(0, "a"), (1, "b"), (2, "c")] and inside["edges"] == [{"u": 0, "v": 1}]
    assert len(got["without", 0]["nodes"]) == 5 and got["without", 0]["edges"] == [{"u": 0, "v": 1}, {"u": 3, "v": 4}]
    assert got["bare", 0] == {"nodes": [], "edges": []}


def test_crops_hold_their_pixels(spark):
    ink, _ = drawing()
    images = spark.createDataFrame([("i", 160, 300, [int(v) for v in ink.ravel()])], "image string, height int, width int, pixels array<int>")
    regions = spark.createDataFrame([("i", 0, 25, 25, 70, 65), ("i", 1, 5, 5, 5, 9)], "image string, cabinet int, tx1 int, ty1 int, tx2 int, ty2 int")
    row = raster.cropped(images, regions).collect()
    assert len(row) == 1 and (row[0].height, row[0].width) == (40, 45)
    assert (np.array(row[0].pixels).reshape(40, 45) == ink[25:65, 25:70]).all()


def test_tiles_with_their_labels(spark):
    images = spark.createDataFrame([("p", 700, 200), ("q", 200, 200)], "image string, width int, height int")
    boxes = spark.createDataFrame([("p", 3, 290, 10, 310, 20), ("p", 1, 400, 50, 420, 90)], "image string, class_id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.tile_name: r for r in tiling.tiled_dataset(images, boxes, tile=300, back_step=4, least=16).collect()}
    assert set(got) == {"p_x0_y0", "p_x288_y0", "p_x588_y0", "q_x0_y0"}
    assert got["p_x288_y0"].text.splitlines() == ["1 0.406667 0.350000 0.066667 0.200000", "3 0.040000 0.075000 0.066667 0.050000"]
    assert (got["p_x288_y0"].labels, got["p_x288_y0"].split, got["q_x0_y0"].split, got["p_x0_y0"].text) == (2, "val", "val", "")
    whole = {r.tile_name: r.text for r in tiling.overlapping_tiles(images, boxes, tile=300).collect()}
    assert whole["q_x00000_y00000"] == "" and "1 0." in whole["p_x00240_y00000"]


def test_files_around(spark, tmp_path):
    graphs = spark.createDataFrame([("i", 0, '{"nodes":[]}'), ("i", 1, '{"nodes":[1]}')], "image string, cabinet int, json string")
    src.write_graphs(graphs, str(tmp_path / "graphs"))
    assert [p.read_text().strip() for p in sorted((tmp_path / "graphs" / "image=i" / "cabinet=1").glob("*.txt"))] == ['{"nodes":[1]}']
    panels = spark.createDataFrame([("p", [("n1", "N")], [("c1", "R", ["n1", "n2"], None)], {"n1": [1.0, 2.0]})], "name string, nodes array<struct<id:string,label:string>>, components array<struct<id:string,type:string,connections:array<string>,note:string>>, layout map<string,array<double>>")
    src.circuit_json(panels).withColumnRenamed("json", "value").write.text(str(tmp_path / "circuits"))
    assert [r.name for r in src.circuit_panels(spark, str(tmp_path / "circuits")).collect()] == ["p"]
    tiles = spark.createDataFrame([("t",), ("u",)], "tile_name string")
    rows = spark.createDataFrame([("t", 1, 0.5, 0.5, 0.1, 0.1)], "tile_name string, class_id int, cx double, cy double, w double, h double")
    assert {r.tile_name: r.text for r in src.label_files(tiles, rows, last_newline=True).collect()} == {"t": "1 0.500000 0.500000 0.100000 0.100000\n", "u": ""}
    paths = spark.createDataFrame([("/data\\set/a.png",), ("/else/b.png",)], "path string").select(src.relative_path("path", "/data/")).collect()
    assert [r[0] for r in paths] == ["set/a.png", "/else/b.png"]


def test_scans_may_be_strict(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "notes.txt").write_text("x")
    assert src.image_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="no images"):
        src.image_files(spark, str(tmp_path / "none"), strict=True)
    (tmp_path / "none" / "a.PNG").write_bytes(b"x")
    assert src.image_files(spark, str(tmp_path / "none"), strict=True).count() == 1
    with pytest.raises(ValueError, match="not images"):
        src.image_files(spark, [str(tmp_path / "none" / "notes.txt"), str(tmp_path / "none" / "a.PNG")], strict=True)


def test_odd_geometry(spark):
    rows = spark.createDataFrame([(0, 5), (4, 0), (100, 50)], "w int, h int")
    assert [tuple(r)[1:] for r in rows.select(*bx.letterbox("w", "h", 192, 512)).collect()] == [(192, 512, 0, 0), (192, 512, 0, 0), (192, 96, 0, 208)]
    one = spark.range(1)
    assert one.select(*bx.size(F.lit(5), F.lit(9), F.lit(3), F.lit(20))).first()[:] == (0, 11)
    assert one.select(*bx.yolo_to_pixels(F.lit(0.5), F.lit(0.5), F.lit(0.33), F.lit(0.5), F.lit(100), F.lit(50))).first()[:] == (33, 12, 66, 37)


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(0, 5000).withColumn("k", F.xxhash64("id")).drop("id").repartition(7)
    got = rules.numbered(rows, ["k"], 10).orderBy("id").collect()
    assert [r.id for r in got] == list(range(10, 5010)) and [r.k for r in got] == sorted(r.k for r in got)


def test_command_line(spark, tmp_path):
    from draftmill.__main__ import main
    from test_graphs_and_rasters import png

    ink, boxes = drawing()
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "sheet.png").write_bytes(png(ink))
    found = [{"image_path": "in/sheet.png", "class": c, "x1": x1, "y1": y1, "x2": x2, "y2": y2} for _, c, x1, y1, x2, y2 in boxes]
    (tmp_path / "boxes.json").write_text(json.dumps(found))
    main(["graphs", str(tmp_path / "images"), str(tmp_path / "boxes.json"), str(tmp_path / "graphs"), "--pad", "0", "--least", "20"])
    text = next((tmp_path / "graphs" / "image=sheet" / "cabinet=0").glob("*.txt")).read_text()
    got = json.loads(text)
    names = {n["id"]: n["class"] for n in got["nodes"]}
    assert sorted(names.values()) == ["a", "b", "c"] and [sorted((names[e["u"]], names[e["v"]])) for e in got["edges"]] == [["a", "b"]]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "sheet.txt").write_text("2 0.15 0.28125 0.1 0.1875\n")
    main(["tiles", str(tmp_path / "images"), str(tmp_path / "labels"), str(tmp_path / "set"), "--tile", "128", "--back-step", "4", "--least", "16"])
    tiles = {r.tile_name: r for r in spark.read.parquet(str(tmp_path / "set" / "tiles")).collect()}
    assert sum(r.labels for r in tiles.values()) == 1 and sum(r.split == "val" for r in tiles.values()) == 1 and "cls_2" in [r[0] for r in spark.read.text(str(tmp_path / "set" / "dataset"), wholetext=True).collect() if r[0].strip()][0]
    main(["grid", str(tmp_path / "images"), str(tmp_path / "labels"), str(tmp_path / "grid"), "--tile", "128"])
    assert spark.read.parquet(str(tmp_path / "grid")).filter("text <> ''").count() >= 1
    main(["wires", str(tmp_path / "images"), str(tmp_path / "boxes.json"), str(tmp_path / "wires")])
    assert spark.read.parquet(str(tmp_path / "wires" / "overlay")).filter("v < 255").count() > 0
    (tmp_path / "images" / "more").mkdir()
    (tmp_path / "images" / "more" / "sheet.png").write_bytes(png(ink))
    with pytest.raises(ValueError, match="several images are named sheet"):
        main(["grid", f"{tmp_path}/images/*", str(tmp_path / "labels"), str(tmp_path / "grid")])


def test_other_commands(spark, tmp_path):
    from draftmill.__main__ import main

    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 10], "iscrowd": 0}, {"image_id": 2, "category_id": 7, "bbox": [1, 1, 2, 2], "iscrowd": 1}], "categories": [{"id": 7, "name": "dog"}, {"id": 3, "name": "cat"}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    main(["coco", str(tmp_path / "coco.json"), str(tmp_path / "labels"), "--names", "cat, dog"])
    assert [p.read_text().strip() for p in (tmp_path / "labels" / "file=a").glob("*.txt")] == ["1 0.200000 0.300000 0.200000 0.200000"]
    assert [p.read_text().strip() for p in (tmp_path / "labels" / "file=b").glob("*.txt")] == [""]
    panel = {"name": "p", "nodes": [{"id": "n", "label": "N"}], "components": [{"id": "r", "type": "R", "connections": ["n", "m", "o"], "note": ""}], "layout": {"n": [0.0, 1.0]}}
    (tmp_path / "circuits.json").write_text(json.dumps({"reference_image": "x.png", "circuits": [panel]}))
    main(["circuits", str(tmp_path / "circuits.json"), str(tmp_path / "circuits")])
    assert spark.read.parquet(str(tmp_path / "circuits" / "edges")).count() == 2
    assert json.loads(next((tmp_path / "circuits" / "json").glob("*.txt")).read_text())["circuits"][0]["name"] == "p"
    import base64

    wrapped = next((tmp_path / "circuits" / "base64").glob("*.txt")).read_text().strip()
    assert max(map(len, wrapped.split("\n"))) == 76 and json.loads(base64.b64decode(wrapped))["circuits"][0]["name"] == "p"
    for folder in ("img", "lab"):
        (tmp_path / folder).mkdir()
    for name, text in {"one": "0 1 1 1 1\n0 2 2 2 2\n", "two": "0 1 1 1 1\n3 1 1 1 1\n", "none": ""}.items():
        (tmp_path / "img" / f"{name}.png").write_bytes(b"x")
        (tmp_path / "lab" / f"{name}.txt").write_text(text)
    main(["cleanup", str(tmp_path / "img"), str(tmp_path / "lab"), str(tmp_path / "clean")])
    assert [r.value.rsplit("/", 1)[-1] for r in spark.read.text(str(tmp_path / "clean" / "kept")).collect()] == ["two.png"]
    assert sorted(r.file.rsplit("/", 1)[-1] for r in spark.read.json(str(tmp_path / "clean" / "removed")).collect()) == ["none.txt", "one.txt"]


def test_wires_step_by_step(spark):
    from draftmill.operators import wires
    from test_graphs_and_rasters import flood

    ink, boxes = drawing()
    rng = np.random.default_rng(2)
    ink[100:103, 15:40] = 60
    ink = np.minimum(ink, rng.integers(200, 256, ink.shape))
    pixels = spark.createDataFrame([("s", y, x, int(v)) for (y, x), v in np.ndenumerate(ink)], "image string, y int, x int, v int")
    sizes = spark.createDataFrame([("s", 300, 160)], "image string, width int, height int")
    marked = spark.createDataFrame([("s", c, x1, y1, x2, y2) for _, c, x1, y1, x2, y2 in boxes[1:]], "image string, class string, x1 int, y1 int, x2 int, y2 int")

    def as_ink(runs):
        out = np.zeros((160, 300), bool)
        for r in runs.collect():
            out[r.y, r.x0 : r.x1 + 1] = True
        return out

    for method in ("otsu", "sauvola"):
        found = wires.extract_wires(pixels, sizes, marked, method, window=15, ratio=0.5, exclude=["E"])
        limit = raster.sauvola(ink, 15, 0.2) if method == "sauvola" else raster._otsu(ink)
        white = ink > limit
        skeleton = raster.thinned(white if white.mean() < 0.5 else ~white)
        assert np.array_equal(as_ink(found.skeleton), skeleton)
        cut = skeleton.copy()
        for _, c, x1, y1, x2, y2 in boxes[1:]:
            if c != "e":
                cut[y1:y2, x1:x2] = False
        assert np.array_equal(as_ink(found.without_devices), cut)
        label = flood(cut)
        area = np.bincount(label.ravel())
        clean = cut & (area[label] >= max(1, int(area[1:].max() * 0.5)))
        assert np.array_equal(as_ink(found.clean), clean) and clean.any()
        p = np.pad(clean, 1)
        thick = np.any([p[a : a + 160, b : b + 300] for a in range(3) for b in range(3)], axis=0)
        assert np.array_equal(as_ink(found.thick), thick)
        dark = {(r.y, r.x): r.v for r in wires.overlaid(pixels, found.thick, 0.4).collect()}
        assert all(dark[y, x] == (int(v * 0.6) if thick[y, x] else v) for (y, x), v in np.ndenumerate(ink))


def test_lines_are_counted_in_each_file(spark, tmp_path):
    from draftmill import settings

    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("0 1\r\n\n  2 3 \n")
    (tmp_path / "l" / "b.txt").write_text("")
    got = [(r.file.rsplit("/", 1)[-1], r.line, r.text) for r in src.lines(spark, str(tmp_path / "l")).orderBy("file", "line").collect()]
    assert got == [("a.txt", 1, "0 1"), ("a.txt", 3, "2 3")]
    (tmp_path / "s.json").write_text('{\n  "top_k": 4\n}\n')
    assert settings.load(spark, str(tmp_path / "s.json")).top_k == 4


def test_report_of_a_store(spark, tmp_path):
    from draftmill.__main__ import main

    schema = "position int, label string, embedding array<float>, features array<double>, energies array<double>"
    unit = [[0.0] * 9000, [0.0] * 9000]
    for k in range(1000):
        unit[0][k * 9] = unit[1][k * 9 + 1] = 1.0
    rules.RuleStore(spark, str(tmp_path / "rules")).add(spark.createDataFrame([(0, "same", [1.0, 0.0], unit[0], [1.0] * 1000), (1, "other", [0.0, 1.0], unit[1], [1.0] * 1000)], schema))
    spark.createDataFrame([(1, "a b.png", [1.0, 0.0], unit[0], [1.0] * 1000)], "id long, filename string, embedding array<float>, features array<double>, energies array<double>").write.parquet(str(tmp_path / "queries"))
    main(["report", str(tmp_path / "rules"), str(tmp_path / "queries"), str(tmp_path / "out")])
    page = next((tmp_path / "out" / "pages" / "file=a b.png").glob("*.txt")).read_text()
    assert "<h1>+ a b.png</h1>" in page and page.index("</b> same <i>trusted</i> 0.000 <span class=\"high\">100.0%") < page.index("</b> other <i>doubtful</i>")
    assert "+ a b.png" in next((tmp_path / "out" / "index" / "page=0").glob("*.txt")).read_text()
