"""Runs that meet others row by row, against plain sets of pixels, and how they are dealt."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from draftmill.operators import raster

RUN, BOX = "image string, y int, x0 int, x1 int", "image string, device long, x1 int, y1 int, x2 int, y2 int"


def drawn(seed):
    r = random.Random(seed)
    ink = {(i, r.randrange(12), r.randrange(60)) for i in "ab" for _ in range(300)}
    boxes = [(r.choice("ab"), k % 9, x := r.randrange(-3, 55), y := r.randrange(-3, 10), x + r.randrange(0, 9), y + r.randrange(0, 6)) for k in range(25)]
    return ink, boxes


def pixels(runs):
    return sorted((i, y, x) for i, y, a, b in runs for x in range(a, b + 1))


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_carved_and_hit_as_by_pixels(spark, rows):
    for seed in (1,):
        ink, boxes = drawn(seed)
        runs = raster.row_runs(spark.createDataFrame(sorted(ink), "image string, y int, x int"))
        d = spark.createDataFrame(boxes, BOX)
        assert pixels(rows(runs)) == sorted(ink)
        for margin in (0, 1):
            left = {p for p in ink if not any(i == p[0] and x1 + margin <= p[2] < x2 - margin and y1 + margin <= p[1] < y2 - margin for i, _, x1, y1, x2, y2 in boxes)}
            assert pixels(rows(raster.carved(runs, d, margin))) == sorted(left)
        labelled = raster.nets(raster.carved(runs, d), 8)
        net = {(i, y, x): n for i, y, a, b, n in rows(labelled) for x in range(a, b + 1)}
        hits = defaultdict(set)
        for i, k, x1, y1, x2, y2 in boxes:
            if x1 < x2 and y1 < y2:
                for y in range(y1, y2):
                    for x in range(x1, x2):
                        if (y in (y1, y2 - 1) or x in (x1, x2 - 1)) and (i, y, x) in net:
                            hits[i, k, net[i, y, x]].add((x, y))
        assert rows(raster.border_hits(runs, labelled, d)) == sorted(((*k, int(sum(x for x, _ in v) / len(v)), int(sum(y for _, y in v) / len(v))) for k, v in hits.items()), key=repr)


def test_null_and_repeated_pixels(spark, rows):
    p = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("a", 0, 2), ("a", 0, None), (None, 0, 4), (None, 0, 5)], "image string, y int, x int")
    assert rows(raster.row_runs(p)) == sorted([("a", 0, 1, 2), ("a", 0, None, None), (None, 0, 4, 5)], key=repr)
    assert rows(raster.runs_of(p, ["image", "y"], "x", 2)) == sorted([("a", 0, 1, 2), (None, 0, 4, 5)], key=repr)
    box = spark.createDataFrame([("a", 1, 2, 0, 5, 1)], BOX)
    assert rows(raster.carved(raster.row_runs(p), box, 0)) == sorted([("a", 0, 1, 1), ("a", 0, None, None), (None, 0, 4, 5)], key=repr)


def test_boxes_are_not_joined_with_runs(spark, capsys):
    """a join by row was broadcast through the driver, or met all boxes of a row with all of its runs."""
    runs, d = spark.createDataFrame([("a", 0, 1, 2)], RUN), spark.createDataFrame([("a", 1, 2, 0, 5, 1)], BOX)
    for df in (raster.carved(runs, d), raster.carved(runs, d, 0), raster.border_hits(runs, runs.selectExpr("*", "1L as net"), d)):
        assert "Join" not in plan(df, capsys)


def test_sizes_meet_bands_of_rows(spark, capsys):
    """images alone were the key, so all runs of an image met their size in one task."""
    runs, sizes = spark.createDataFrame([("a", 0, 1, 2)], RUN), spark.createDataFrame([("a", 9, 9)], "image string, width int, height int")
    assert "_band" in plan(raster.thickened(runs, 1, sizes), capsys)


def test_runs_are_shuffled_once(spark, capsys):
    """repeated pixels were sorted out by a shuffle and two aggregates of their own."""
    p = spark.createDataFrame([("a", 0, 1)], "image string, y int, x int")
    for df, most in ((raster.row_runs(p), 1), (raster.straight_lines(raster.row_runs(p), 3, 2), 4)):
        shown = plan(df, capsys)
        assert "Window" not in shown and "Aggregate" not in shown and shown.count("Exchange") <= most


def test_net_sizes_are_those_of_nets_at_any_border(spark, rows):
    """Pixels dealt to blocks at once give the areas and run counts of nets found from whole row runs; repeats and pixels without a place don't count."""
    r = np.random.default_rng(5)
    for side, share in ((8, 0.3), (4, 0.55), (64, 0.4)):
        pixels = [(name, int(y), int(x)) for name in ("a", "b") for y, x in np.argwhere(r.random((37, 41)) < share) - [9, 11]]
        p = spark.createDataFrame([*pixels, *pixels[:50], ("a", None, 1), ("a", 1, None)], "image string, y int, x int")
        named = raster.nets(raster.row_runs(p.filter("x is not null and y is not null")), side)
        expected = named.groupBy("image", "net").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.count(F.lit(1)).alias("runs"))
        assert rows(raster.net_sizes(p, side)) == rows(expected)
        assert sum(x.area for x in raster.net_sizes(p, side).collect()) == len(pixels)
    assert raster.net_sizes(p.limit(0)).count() == 0
