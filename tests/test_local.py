"""Resampling, local thresholds and thinning over tables against kernels on whole images."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.operators import local, raster, resample


def table(spark, images: dict[str, np.ndarray]):
    rows = [(n, y, x, int(v)) for n, a in images.items() for (y, x), v in np.ndenumerate(a)]
    random.Random(1).shuffle(rows)
    sizes = [(n, *map(int, a.shape[::-1])) for n, a in images.items()]
    return spark.createDataFrame(rows, "image string, y int, x int, v int").repartition(5), spark.createDataFrame(sizes, "image string, width int, height int")


def whole(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r.v
    return out


# ---- resampling


def taps(kind, n_in, n_out):
    """Rows of weights by their definition, in 2^-22."""
    reach = {"nearest": 0, "bilinear": 1, "bicubic": 2, "lanczos": 3}[kind]
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    def value(x):
        x = abs(x)
        if x >= reach:
            return 0.0
        if kind == "bilinear":
            return 1 - x
        if kind == "bicubic":
            return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * (x**3 - 5 * x**2 + 8 * x - 4)
        return sinc(x) * sinc(x / 3)

    m = np.zeros((n_out, n_in))
    for o in range(n_out):
        center = (o + 0.5) * n_in / n_out
        if kind == "nearest":
            m[o, min(n_in - 1, int(center))] = 1
        else:
            f = max(1.0, n_in / n_out)
            for s in range(max(0, math.floor(center - reach * f + 0.5)), min(n_in, math.floor(center + reach * f + 0.5))):
                m[o, s] = value((s - center + 0.5) / f)
            m[o] /= m[o].sum()
    return np.floor(m * 2**22 + 0.5).astype(np.int64)


def resized(a, kind, w, h):
    clip = lambda s: np.clip((s + 2**21) >> 22, 0, 255)
    return clip(taps(kind, a.shape[0], h) @ clip(a.astype(np.int64) @ taps(kind, a.shape[1], w).T))


@pytest.mark.parametrize(("kind", "known"), [("nearest", "nearest"), ("Bilinear", "bilinear"), ("BICUBIC", "bicubic"), ("antialias", "lanczos"), ("unheard of", "lanczos"), (None, "lanczos")])
def test_resized_equals_the_definition(spark, kind, known):
    rng = np.random.default_rng(3)
    images = {"up": rng.integers(0, 256, (5, 7)), "down": rng.integers(0, 256, (23, 40)), "one": rng.integers(0, 256, (1, 1)), "hard": (rng.random((9, 9)) < 0.5) * 255}
    pixels, sizes = table(spark, images)
    plan = sizes.select("image", "width", "height", F.lit(13).alias("new_width"), F.lit(6).alias("new_height"), F.lit(kind).cast("string").alias("kind"))
    out = resample.resized(pixels, plan).cache()
    for n, a in images.items():
        assert np.array_equal(whole(out.filter(F.col("image") == n), (6, 13)), resized(a, known, 13, 6)), n


def test_letterbox_and_padding(spark):
    rng = np.random.default_rng(4)
    images = {"wide": rng.integers(0, 256, (4, 16)), "tall": rng.integers(0, 256, (30, 10))}
    pixels, sizes = table(spark, images)
    sizes = sizes.union(spark.createDataFrame([("none", 0, 5)], sizes.schema))
    out = resample.letterboxed(pixels, sizes, 20, 12, "bicubic", fill=7).cache()
    expected = {n: np.full((12, 20), 7) for n in ("wide", "tall", "none")}
    expected["wide"][3:8] = resized(images["wide"], "bicubic", 20, 5)
    expected["tall"][:, 8:12] = resized(images["tall"], "bicubic", 4, 12)
    for n, a in expected.items():
        assert np.array_equal(whole(out.filter(F.col("image") == n), (12, 20)), a), n


def test_downscale_keeps_small_images_and_dark_lines(spark):
    a = np.full((20, 30), 255)
    a[:, 11] = 0
    pixels, sizes = table(spark, {"a": a})
    assert np.array_equal(whole(resample.downscaled(pixels, sizes, "longer", 64), (20, 30)), a)
    plain = whole(resample.downscaled(pixels, sizes, "longer", 10, "bilinear"), (6, 10))
    dark = whole(resample.downscaled(pixels, sizes, "longer", 10, "bilinear", darkest=1), (6, 10))
    thick = np.minimum.reduce([np.roll(a, s, 1) for s in (-1, 0, 1)])
    assert np.array_equal(dark, resized(thick, "bilinear", 10, 6)) and dark.min() < plain.min()


# ---- local thresholds


@pytest.mark.parametrize("window", [3, 7, 15])
def test_sauvola_equals_the_kernel(spark, window):
    rng = np.random.default_rng(window)
    images = {"a": rng.integers(0, 256, (19, 26)), "flat": np.full((8, 9), 200), "small": rng.integers(0, 256, (2, 30)), "one": np.array([[9]])}
    pixels, sizes = table(spark, images)
    found = {(r.image, r.y, r.x): r.threshold for r in local.sauvola_thresholds(pixels, sizes, window, 0.2).collect()}
    for n, a in images.items():
        expected = raster.sauvola(a, window, 0.2)
        got = np.array([[found[n, y, x] for x in range(a.shape[1])] for y in range(a.shape[0])])
        assert np.abs(got - expected).max() < 1e-9, n


def test_window_by_size_and_polarity(spark):
    rng = np.random.default_rng(8)
    images = {"a": rng.integers(0, 256, (40, 50)), "b": rng.integers(0, 60, (21, 12))}
    images["b"][3:5, 2:9] = 250
    pixels, sizes = table(spark, images)
    out = {(r.image, r.y, r.x): r.white for r in local.sauvola_binarised(pixels, sizes, raster.odd_window(F.least("width", "height"), 0.2, 5), 0.2).collect()}
    for n, a in images.items():
        white = np.where(a > raster.sauvola(a, raster.odd_window(min(a.shape), 0.2, 5), 0.2), 255, 0)
        white = 255 - white if white.mean() < 128 else white
        assert all(out[n, y, x] == v for (y, x), v in np.ndenumerate(white))


# ---- thinning


def drawing(seed, h, w):
    rng = np.random.default_rng(seed)
    ink = np.zeros((h, w), bool)
    for _ in range(25):
        y, x, t = rng.integers(0, h), rng.integers(0, w), rng.integers(1, 14)
        if rng.random() < 0.5:
            ink[y : y + t, x : x + rng.integers(5, 90)] = True
        else:
            ink[y : y + rng.integers(5, 90), x : x + t] = True
    return ink | (rng.random((h, w)) < 0.02)


@pytest.mark.parametrize(("side", "passes"), [(16, 1), (32, 3), (64, 8), (256, 8)])
def test_thinned_by_blocks_equals_whole_images(spark, side, passes):
    images = {"a": drawing(1, 90, 131), "b": drawing(2, 40, 64), "blank": np.zeros((5, 5), bool), "full": np.ones((30, 40), bool)}
    rows = [(n, *map(int, r)) for n, a in images.items() for r in zip(*raster._runs(a), strict=True)]
    runs = spark.createDataFrame(rows, raster.RUN)
    out = local.thinned_runs(runs, side, passes).collect()
    for n, a in images.items():
        got = np.zeros(a.shape, bool)
        for r in out:
            if r.image == n:
                assert not got[r.y, r.x0 : r.x1 + 1].any()
                got[r.y, r.x0 : r.x1 + 1] = True
        assert np.array_equal(got, raster.thinned(a)), n


@pytest.mark.parametrize("side", [4, 8, 32, 256])
def test_nets_of_any_block_equal_a_flood(spark, side):
    from test_graphs_and_rasters import flood

    rng = np.random.default_rng(side)
    snake = np.zeros((40, 40), bool)
    snake[::4] = True
    snake[:, 0] = [(y // 4) % 2 == 0 for y in range(40)]
    snake[:, -1] = [(y // 4) % 2 == 1 for y in range(40)]
    images = {"noise": rng.random((37, 53)) < 0.4, "lines": drawing(5, 60, 70), "snake": snake, "diagonal": np.eye(50, dtype=bool)[::-1], "full": np.ones((20, 30), bool)}
    rows = [(n, *map(int, r)) for n, a in images.items() for r in zip(*raster._runs(a), strict=True)]
    out = raster.nets(spark.createDataFrame(rows, raster.RUN), side).collect()
    assert sorted((r.image, r.y, r.x0, r.x1) for r in out) == sorted(rows)
    for n, a in images.items():
        label = flood(a)
        names = {}
        for r in out:
            if r.image == n:
                names.setdefault(label[r.y, r.x0], set()).add(r.net)
        assert all(len(v) == 1 for v in names.values()) and len(set().union(*names.values())) == len(names)
        assert all(min(v) == min(y * 2**32 + x for y, x in zip(*np.nonzero(label == k), strict=True)) for k, v in names.items())


def test_nothing_to_thin(spark):
    assert local.thinned_runs(spark.createDataFrame([], raster.RUN)).count() == 0
    with pytest.raises(ValueError, match="multiple of 8"):
        local.thinned_runs(spark.createDataFrame([], raster.RUN), 20)
