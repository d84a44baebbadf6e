"""Golden values of box, tile and text expressions."""

import pytest
from pyspark.sql import functions as F

from draftmill.functions import boxes as bx
from draftmill.functions import text as tx


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_clip_makes_one_pixel_of_a_box_outside(spark):
    assert one(spark, *bx.clip(F.lit(-5), F.lit(-5), F.lit(0), F.lit(0), 10, 10)) == (0, 0, 1, 1)
    assert one(spark, *bx.clip(F.lit(2), F.lit(3), F.lit(40), F.lit(5), 10, 10)) == (2, 3, 10, 5)


def test_center_truncates(spark):
    assert one(spark, *bx.center(F.lit(0), F.lit(-5), F.lit(5), F.lit(0))) == (2, -2)


def test_touching_boxes_do_not_overlap(spark):
    a = tuple(map(F.lit, (0, 0, 10, 10)))
    assert one(spark, bx.overlaps(a, tuple(map(F.lit, (10, 0, 20, 10)))), bx.overlaps(a, tuple(map(F.lit, (9, 0, 20, 10))))) == (False, True)


def test_expand_clips(spark):
    assert one(spark, *bx.expand(F.lit(3), F.lit(3), F.lit(8), F.lit(8), 4, 10, 10)) == (0, 0, 10, 10)


def test_yolo_round_trip(spark):
    box = bx.yolo_to_box(F.lit(0.25), F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(200), F.lit(100))
    assert one(spark, *box) == pytest.approx((40, 40, 60, 60))
    assert one(spark, *bx.box_to_yolo(F.lit(60.0), F.lit(60.0), F.lit(40.0), F.lit(40.0), F.lit(200), F.lit(100))) == pytest.approx((0.25, 0.5, 0.1, 0.2))


def test_coco_to_yolo(spark):
    assert one(spark, *bx.coco_to_yolo(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0), F.lit(100), F.lit(200))) == pytest.approx((0.25, 0.2, 0.3, 0.2))


def test_nearest_on_border_prefers_left(spark):
    square = tuple(map(F.lit, (0, 0, 10, 10)))
    assert one(spark, *bx.nearest_on_border(*square, F.lit(5), F.lit(5))) == (0, 5)
    assert one(spark, *bx.nearest_on_border(*square, F.lit(6), F.lit(9))) == (6, 10)
    assert one(spark, *bx.nearest_on_border(*square, F.lit(30), F.lit(4))) == (10, 4)
    assert one(spark, *bx.elbow(F.lit(30), F.lit(4), F.lit(10), F.lit(5))) == (30, 5)


@pytest.mark.parametrize(
    ("length", "overlap", "starts"),
    [(8912, 0.2, [0, 819, 1638, 2457, 3276, 4095, 4914, 5733, 6552, 7371, 7888]), (500, 0.2, [0]), (1024, 0.2, [0]), (1025, 0.2, [0, 1]), (2048, 0.0, [0, 1024])],
)
def test_tile_starts(spark, length, overlap, starts):
    assert one(spark, bx.tile_starts(F.lit(length), 1024, overlap)) == (starts,)


def test_letterbox_rounds_half_to_even(spark):
    scale, w, h, left, top = one(spark, *bx.letterbox(F.lit(200), F.lit(5), F.lit(100), F.lit(100)))
    assert (scale, w, h, left, top) == (0.5, 100, 2, 0, 49)


def test_downscale_never_enlarges(spark):
    assert one(spark, *bx.downscale(F.lit(100), F.lit(50), "longer", 400)) == (1.0, 100, 50)
    assert one(spark, *bx.downscale(F.lit(800), F.lit(50), "longer", 400)) == (0.5, 400, 25)
    assert one(spark, *bx.downscale(F.lit(100), F.lit(50), "none", 3)) == (1.0, 100, 50)
    assert one(spark, *bx.downscale(F.lit(100), F.lit(50), "scale", 2)) == (2.0, 200, 100)


def test_colours_and_names(spark):
    assert one(spark, bx.rgb(F.lit("#FF8000")), bx.rgb(F.lit("1, 2,3")), bx.rgb(F.lit("")), bx.rgb(F.lit("x"))) == ((255, 128, 0), (3, 2, 1), (0, 0, 255), None)
    assert one(spark, bx.short_name(F.lit("indicator_lamp"), {"diode": "D"}), bx.short_name(F.lit("diode"), {"diode": "D"}), bx.hue(F.lit(3), F.lit(0))) == ("indicato", "D", 0)


def test_vector_text(spark):
    assert one(spark, tx.vector_text(F.array(F.lit(1.0), F.lit(2.0)))) == ("[1.0000, 2.0000] (dim=2)",)
    assert one(spark, tx.rule_line(F.lit(7), F.lit("a"), F.array(*[F.lit(0.5)] * 3), 2)) == ("id=0007 label=a embedding=[0.5000, 0.5000, ...] (dim=3)",)


def test_labels_and_stems(spark):
    assert one(spark, tx.labels_of(F.lit(" a, ,b "), F.lit("x/y.tar.png")), tx.labels_of(F.lit(None).cast("string"), F.lit("x/y.tar.png"))) == (["a", "b"], ["y.tar"])
    assert one(spark, tx.wrapped_base64(F.lit(b"0" * 60)))[0].split("\n")[0].__len__() == 76
    assert one(spark, tx.escaped(F.lit("a<b&c>"))) == ("a&lt;b&amp;c>",)
