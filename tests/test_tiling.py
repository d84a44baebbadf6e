"""Intervals, joins of boxes and tiles, and cut plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftmill.operators import tiling


def test_merge_intervals(spark, rows):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9), ("a", 1, 2), ("b", 3, 4), ("b", None, 4)], "k string, s int, e int")
    assert rows(tiling.merge_intervals(df, ["k"])) == [("a", 0, 7), ("a", 8, 9), ("b", 3, 4)]
    assert rows(tiling.merge_intervals(df.limit(0), ["k"])) == []


def test_boxes_meet_tiles_once(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 500.0, 500.0, 530.0, 540.0), (1, 2, "a", 0.0, 0.0, 3.0, 3.0), (1, 3, "b", 512.0, 0.0, 600.0, 10.0)], "image int, box_id int, class string, x1 double, y1 double, x2 double, y2 double")
    tiles = spark.createDataFrame([(1, 0, 0), (1, 512, 0), (1, 0, 512), (1, 512, 512), (2, 0, 0)], "image int, tile_x int, tile_y int")
    got = {(r.box_id, r.tile_x, r.tile_y): r.area for r in tiling.boxes_in_tiles(boxes, tiles, 512).collect()}
    assert got == {(1, 0, 0): 144, (1, 512, 0): 216, (1, 0, 512): 336, (1, 512, 512): 504, (3, 512, 0): 880}
    whole = tiles.selectExpr("image", "tile_x tx1", "tile_y ty1", "tile_x + 512 tx2", "tile_y + 512 ty2")
    assert sorted((r.box_id, r.tx1, r.ty1) for r in tiling.boxes_inside_tiles(boxes, whole).collect()) == [(2, 0, 0), (3, 512, 0)]


def test_centers_leave_out_far_borders(spark):
    points = spark.createDataFrame([(1, 10, 10), (1, 20, 10), (1, 0, 0)], "image int, px int, py int")
    regions = spark.createDataFrame([(1, 0, 0, 20, 20), (1, 5, 5, 30, 30)], "image int, tx1 int, ty1 int, tx2 int, ty2 int")
    assert sorted((r.px, r.tx1) for r in tiling.centers_in_regions(points, regions).collect()) == [(0, 0), (10, 0), (10, 5), (20, 5)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.lists(st.tuples(st.integers(0, 2900), st.integers(1, 250)), max_size=12))
def test_cuts_never_go_through_boxes(length, spans):
    boxes = sorted((s, min(length, s + n)) for s, n in spans if s < length)
    merged = []
    for s, e in boxes:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    cuts = tiling.cuts_along(length, merged, 300, 4, 16)
    if cuts is None:
        return
    assert cuts[0] == 0 and cuts[-1] == length
    assert all(0 < b - a <= 300 for a, b in zip(cuts, cuts[1:], strict=False))
    assert not any(s < c < e for c in cuts for s, e in merged)


def test_a_cut_may_stand_at_the_least_place():
    assert tiling.cuts_along(3000, [(64, 2100)], 2048, 8, 64) == [0, 64, 2112, 3000]
    assert tiling.cuts_along(3000, [(63, 2100)], 2048, 8, 64) is None
    assert tiling.cuts_along(100, [(0, 90)], 50, 7, 0) is None


def test_plan_cuts(spark):
    images = spark.createDataFrame([("a", 700, 200), ("b", 700, 200), ("c", 100, 100)], "image string, width int, height int")
    boxes = spark.createDataFrame([("a", 290, 10, 310, 20), ("b", 0, 0, 400, 50)], "image string, x1 int, y1 int, x2 int, y2 int")
    plans = {(r.image, r.axis): r.cuts for r in tiling.plan_cuts(boxes, images, tile=300, back_step=4, least=16).collect()}
    assert plans[("a", "x")] == [0, 288, 588, 700] and plans[("a", "y")] == [0, 200]
    assert plans[("b", "x")] is None and plans[("c", "x")] == [0, 100]
    tiles = tiling.cut_tiles(tiling.plan_cuts(boxes, images, tile=300, back_step=4, least=16)).collect()
    assert ("a", 288, 0, 588, 200, "a_x288_y0") in [(r.image, r.tx1, r.ty1, r.tx2, r.ty2, r.tile_name) for r in tiles]


def test_split_prefers_labelled(spark):
    tiles = spark.createDataFrame([("a", k, int(k == 3)) for k in range(5)] + [("b", 9, 0)], "image string, id long, labelled int")
    got = tiling.split_validation(tiles, "image", "id", 1, 5, "labelled").filter("split = 'val'").collect()
    assert sorted((r.image, r.id) for r in got) == [("a", 3), ("b", 9)]
    large = spark.createDataFrame([(None, 4 * 10**9 + k) for k in range(9)] + [("a", 9 * 10**18)], "image string, id long")
    split = tiling.split_validation(large, "image", "id", 2)
    assert split.count() == 10 and split.filter("split = 'val'").count() == 3


def test_grid_names(spark):
    images = spark.createDataFrame([("p", 1025, 1024)], "image string, width int, height int")
    assert [r.tile_name for r in tiling.tile_grid(images, 1024).orderBy("tile_x").collect()] == ["p_x00000_y00000", "p_x00001_y00000"]
    with pytest.raises(Exception):  # noqa: B017
        tiling.tile_grid(images.drop("height"), 1024).collect()


def test_cut_plans_hold_all_boxes(spark):
    from draftmill.plans.queries import QUERIES, _parts

    sf = "/root/testdata/sf0.001"
    spans = {}
    for r in _parts(spark, sf).collect():
        for axis, size, lo, hi in (("x", 1900, r.x1, r.x2), ("y", 1100, r.y1, r.y2)):
            spans.setdefault((r.image, axis), []).append((max(0, lo), min(size, hi), hi - lo))
    expected = {}
    for (image, axis), own in spans.items():
        length = 1900 if axis == "x" else 1100
        inside = set()  # doubled places that a cut must not have: inside a box, or where two boxes touch
        for s, e, _ in own:
            inside |= set(range(2 * s + 1, 2 * e))
        starts = {s for s, e, _ in own if s < e}
        inside |= {2 * e for s, e, _ in own if s < e and e in starts}
        cuts = [0] if max(x[2] for x in own) <= 512 else None
        while cuts and length - cuts[-1] > 512:
            found = [x for x in range(cuts[-1] + 512, cuts[-1] + 32, -4) if 2 * x not in inside]
            cuts = [*cuts, found[0]] if found else None
        expected[image, axis] = [*cuts, length] if cuts else None
    got = {(r.image, r.axis): r.cuts for r in QUERIES["q36_cut_plans"](spark, sf).collect()}
    assert got == expected
    assert {c is None for c in got.values()} == {True, False} and max(len(c or []) for c in got.values()) > 3
