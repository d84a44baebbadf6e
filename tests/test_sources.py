"""Annotation formats."""

import json

from draftmill.operators import cleanup
from draftmill.sources import annotations as src


def test_detections(spark, tmp_path, rows):
    boxes = [{"image_path": "a\\.//b.png", "x1": 1, "y1": 2, "x2": 3, "y2": 4, "class": "lamp"}, {"image_path": "c.png", "x1": 1, "y1": 2, "x2": 3, "y2": 4, "score": 0.5}]
    (tmp_path / "d.json").write_text(json.dumps(boxes))
    assert rows(src.detections_json(spark, str(tmp_path / "d.json")).select("image_path", "class", "score")) == [("a/b.png", "lamp", 1.0)]
    assert rows(src.detections_json(spark, str(tmp_path / "d.json"), "device").select("image_path", "class", "score")) == [("a/b.png", "lamp", 1.0), ("c.png", "device", 0.5)]
    lines = spark.createDataFrame([("IMAGE_PATH,x1,y1,x2,y2,class",), ("",), ("a.png,1,2,3,4",), ("a.png, 1,2,3,4,lamp,0.3,z",), ("b.png,5,6,7,8,fuse",)], "text string")
    assert rows(src.detections_csv(lines).select("image_path", "x1", "class")) == [("a.png", 1, "lamp"), ("b.png", 5, "fuse")]
    images = spark.createDataFrame([("a.png",), ("z.png",)], "path string")
    assert {r.path: len(r.boxes) for r in src.per_image(images, src.detections_csv(lines)).collect()} == {"a.png": 1, "z.png": 0}


def test_label_lines(spark, rows):
    text = ["20 0.298340 0.325684 0.018555 0.041992", "1 .5 .5 .1 .1 0.9", "1 .5 .5 .1", "2.0 .5 .5 .1 .1", "x 1 1 1 1"]
    lines = spark.createDataFrame([(t,) for t in text], "text string")
    assert [r[0] for r in rows(src.yolo_rows(lines, "exactly 5").select("class_id"))] == [2, 20]
    assert rows(src.yolo_rows(lines).select("class_id", "score")) == [(1, 0.9), (2, 1.0), (20, 1.0)]
    names = src.class_map(spark, src.class_names('{"names": {"1": "lamp", "2": "fuse"}}'))
    assert rows(src.with_class_names(src.yolo_rows(lines), names).select("class")) == [("20",), ("fuse",), ("lamp",)]
    assert src.class_names("names: [a, b]") == {0: "a", 1: "b"} and src.class_names("names:\n  3: x\n") == {3: "x"}


def test_label_files(spark, tmp_path, rows):
    tiles = spark.createDataFrame([("t1",), ("t2",)], "tile_name string")
    boxes = spark.createDataFrame([("t1", 1, 0.5, 0.25, 0.1, 0.1), ("t1", 0, 0.5, 0.25, 0.1, 0.1)], "tile_name string, class_id int, cx double, cy double, w double, h double")
    one = "0 0.500000 0.250000 0.100000 0.100000\n1 0.500000 0.250000 0.100000 0.100000"
    assert rows(src.label_files(tiles, boxes)) == [("t1", one), ("t2", "")]
    assert rows(src.label_files(tiles, boxes, keep_empty=False)) == [("t1", one)]
    path = str(tmp_path / "list")
    for _ in range(2):
        src.write_lines(spark.createDataFrame([("b.png",), ("a.png",), ("",)], "text string"), path, order="text")
    assert rows(src.file_list(spark, path)) == [("a.png",), ("b.png",)]
    assert src.dataset_file(0, "t", "v") == "train: t\nval: v\nnames:\n  0: cls_0\n"


def test_coco(spark, tmp_path, rows):
    whole = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 200}],
        "annotations": [{"image_id": 1, "category_id": 17, "bbox": [10, 20, 30, 40], "iscrowd": 0}, {"image_id": 1, "category_id": 18, "bbox": [0, 0, 1, 1], "iscrowd": 1}, {"image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 17, "name": "cat"}, {"id": 18, "name": "dog"}, {"id": 3, "name": "car"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(whole))
    tables = src.coco_tables(spark, str(tmp_path / "c.json"))
    assert rows(src.coco_yolo(*tables, ["cat", "dog"])) == [(1, "a.jpg", 0, 0.25, 0.2, 0.3, 0.2)]
    assert src.coco_yolo(*tables, ["cat", "dog"], drop_crowds=False).count() == 2


def test_paths(spark, rows):
    images = spark.createDataFrame([("s/images/images/1.png",), ("f/2.png",), ("r/3.png",), ("q/4.png",)], "path string")
    labels = spark.createDataFrame([("s/labels/images/1.txt",), ("f/2.txt",), ("l/3.txt",), ("s/images/labels/1.txt",)], "path string")
    assert rows(src.labels_for_images(images, labels, "r", "l")) == [("f/2.png", "f/2.txt"), ("q/4.png", None), ("r/3.png", "l/3.txt"), ("s/images/images/1.png", "s/labels/images/1.txt")]
    found = src.images_for_labels(spark.createDataFrame([("x/2.txt",), ("x/9.txt",)], "file string"), spark.createDataFrame([("a/2.bmp",), ("b/2.png",)], "path string"))
    assert rows(found) == [("x/2.txt", "b/2.png")]


def test_class_filter(spark, rows):
    df = spark.createDataFrame([("Lamp",), ("fuse",), ("CABINET",), (None,)], "class string")
    assert rows(cleanup.of_classes(df, exclude=["cabinet"])) == [("Lamp",), ("fuse",), (None,)]
    assert rows(cleanup.of_classes(df, include=["LAMP", "cabinet"], exclude=["Cabinet"])) == [("Lamp",)]


def test_rejected_images(spark, tmp_path, rows):
    import numpy as np
    from test_graphs_and_rasters import png

    good = png(np.full((3, 4), 9))
    for name, raw in {"a.png": good, "empty.png": b"", "cut.png": good[:20], "text.png": b"not an image", "note.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(raw)
    decoded, rejected = src.decoded_images(spark, str(tmp_path))
    assert [(r.image.width, r.image.height) for r in decoded.collect()] == [(4, 3)]
    found = {r.path.rsplit("/", 1)[-1]: (r.length, r.reason) for r in rejected.collect()}
    assert found == {"empty.png": (0, "empty"), "cut.png": (20, "broken"), "text.png": (12, "not an image"), "note.txt": (5, "not an image")}
