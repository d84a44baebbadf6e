"""Settings, pixels and the service's tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill import settings
from draftmill.functions import pixels as px
from draftmill.operators import raster, rules, service, structure


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"top_k": 5, "overlap": 0}))
    spark.conf.set("spark.draftmill.top_k", "7")
    try:
        s = settings.load(spark, str(tmp_path / "s.json"))
    finally:
        spark.conf.unset("spark.draftmill.top_k")
    assert (s.top_k, s.overlap, s.bins) == (7, 0.0, 9) and settings.load() == settings.Settings()
    with pytest.raises(ValueError, match="colour"):
        settings.Settings().overridden({"colour": 1})


def test_pixels(spark):
    row = spark.range(1).select(px.gray(F.lit(255), F.lit(0), F.lit(0)), px.inverted(F.lit(5)), px.white_above(F.lit(7), F.lit(7)), px.darkened(F.lit(100), F.lit(True), F.lit(0.25)), px.darkened(F.lit(100), F.lit(True), F.lit(9)), *px.padding(F.lit(1000), F.lit(1200), 1024), px.heat(F.lit(0.9)))
    assert [round(x, 6) for x in row.first()] == [76, 250, 0, 75, 0, 24, 0, 0.5]


def test_requests(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = spark.createDataFrame([(k, 30, 20, [int(x) for x in rng.integers(0, 255, 600)]) for k in range(4)], "id long, height int, width int, pixels array<int>")
    s = settings.Settings(grid_columns=4, grid_rows=5)
    described = structure.describe(images, 4, 5, 9)
    files = described.withColumns({"filename": F.concat(F.lit("dir/f"), F.col("id").cast("string"), F.lit(".png")), "position": F.col("id"), "embedding": F.array(F.cos("id"), F.sin("id")).cast("array<float>")})
    store = rules.RuleStore(spark, str(tmp_path / "store"))
    assert [len(r.results) for r in service.batch_response(files, store.rules(), s).collect()] == [0] * 4
    assert sorted((r.label, r.added) for r in service.add_rules(store, files).collect()) == [(f"f{k}", True) for k in range(4)]
    assert sorted((r.label, r.added) for r in service.add_rules(store, files, "f1, new").collect()) == [("f1", False), ("new", True)]
    got = {r.filename: r.results for r in service.batch_response(files, store.rules().filter("label <> 'new'"), s).collect()}
    for k in range(4):
        best = got[f"dir/f{k}.png"][0]
        assert best.label == f"f{k}" and best.trusted and best.final_score > 99 and len(got[f"dir/f{k}.png"]) == 3
    assert len(service.vector_rows(files).first().vector) == 2


def test_wide_borders_reach_lines_that_end_short(spark, rows):
    lines = spark.createDataFrame([("i", 10, 0, 8)], "image string, y int, x0 int, x1 int")
    labelled = lines.withColumn("net", F.lit(1))
    device = spark.createDataFrame([("i", 7, 10, 5, 20, 15)], "image string, device int, x1 int, y1 int, x2 int, y2 int")
    assert rows(raster.border_hits(lines, labelled, device)) == []
    assert rows(raster.border_hits(lines, labelled, device, width=5)) == [("i", 7, 1, 8, 10)]
