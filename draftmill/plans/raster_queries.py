"""Queries of pixels over the driver's tables: resampling, local thresholds and thinning, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import local, raster, resample
from .queries import query
from .tables import vectors

# ---- an embedding as an image of 4 rows of 16 pixels, each with a filter's name

_KINDS = ["nearest", "BILINEAR", "bicubic", "antialias", "mitchell"]
_SMALL = f"""small AS (
  SELECT vec_id::VARCHAR AS image, {_KINDS}[vec_id % 5 + 1] AS name, ['nearest', 'bilinear', 'bicubic', 'lanczos', 'lanczos'][vec_id % 5 + 1] AS kind, embedding FROM embeddings
), pixels AS (
  SELECT image, kind, k // 16 AS y, k % 16 AS x, least(255, floor(abs(embedding[k + 1]::DOUBLE) * 900))::BIGINT AS v FROM small, (SELECT unnest(range(0, 64)) AS k)
)"""


def _taps(name: str, n_in: int, n_out: int) -> str:
    """Weights of one side in SQL."""
    scale, stretch = f"({n_in} / {n_out}::DOUBLE)", max(1.0, n_in / n_out)
    sinc = lambda a: f"(CASE WHEN {a} = 0 THEN 1.0 ELSE sin({a} * pi()) / ({a} * pi()) END)"
    return f"""{name}_raw AS (
  SELECT kind, o, s, abs((s - (o + 0.5) * {scale} + 0.5) / {stretch}) AS a, reach
  FROM (VALUES ('bilinear', 1), ('bicubic', 2), ('lanczos', 3)) AS f(kind, reach), (SELECT unnest(range(0, {n_out})) AS o), (SELECT unnest(range(0, {n_in})) AS s)
  WHERE s >= floor((o + 0.5) * {scale} - reach * {stretch} + 0.5) AND s < floor((o + 0.5) * {scale} + reach * {stretch} + 0.5)
), {name}_value AS (
  SELECT kind, o, s, CASE WHEN a >= reach THEN 0.0 WHEN kind = 'bilinear' THEN 1 - a
    WHEN kind = 'bicubic' THEN CASE WHEN a < 1 THEN (1.5 * a - 2.5) * a * a + 1 ELSE (((a - 5) * a + 8) * a - 4) * -0.5 END
    ELSE {sinc("a")} * {sinc("(a / 3)")} END AS w FROM {name}_raw
), {name} AS (
  SELECT kind, o, s, round(w / sum(w) OVER (PARTITION BY kind, o) * 4194304)::BIGINT AS w FROM {name}_value
  UNION ALL SELECT 'nearest', o, least({n_in - 1}, floor((o + 0.5) * {scale}))::BIGINT, 4194304 FROM (SELECT unnest(range(0, {n_out})) AS o)
)"""


def _resized(w: int, h: int) -> str:
    value = "least(255, greatest(0, floor((sum(v * w) + 2097152) / 4194304.0)))::BIGINT"
    return f"""{_SMALL}, {_taps("wide", 16, w)}, {_taps("high", 4, h)}, narrow AS (
  SELECT image, p.kind, y, o AS x, {value} AS v FROM pixels p JOIN wide ON p.kind = wide.kind AND p.x = wide.s GROUP BY image, p.kind, y, o
), resized AS (
  SELECT image, o AS y, x, {value}::INTEGER AS v FROM narrow n JOIN high ON n.kind = high.kind AND n.y = high.s GROUP BY image, o, x
)"""


def _small(spark, sf_dir):
    """Pixels, and sizes with the filter's name."""
    rows = vectors(spark, sf_dir)
    p = rows.select(F.col("id").cast("string").alias("image"), F.posexplode("embedding").alias("k", "c"))
    pixels = p.select("image", F.floor(F.col("k") / 16).cast("int").alias("y"), (F.col("k") % 16).alias("x"), F.least(F.lit(255), F.floor(F.abs(F.col("c").cast("double")) * 900)).cast("int").alias("v"))
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % 5 + 1).cast("int"))
    return pixels, rows.select(F.col("id").cast("string").alias("image"), F.lit(16).alias("width"), F.lit(4).alias("height"), name.alias("name"))


@query(
    "q61_letterbox_pixels",
    f"""WITH {_resized(20, 5)}, frame AS (SELECT image, unnest(range(0, 12))::INTEGER AS y FROM small), cells AS (SELECT image, y, unnest(range(0, 20))::INTEGER AS x FROM frame)
    SELECT image, y, x, coalesce(v, 255)::INTEGER AS v FROM cells LEFT JOIN (SELECT image, y + 3 AS y, x, v FROM resized) USING (image, y, x)""",
)
def q61(spark, sf_dir):
    pixels, sizes = _small(spark, sf_dir)
    return resample.letterboxed(pixels, sizes, 20, 12, F.col("name"))


@query("q62_downscaled_pixels", f"WITH {_resized(9, 2)} SELECT image, y::INTEGER AS y, x::INTEGER AS x, v FROM resized")
def q62(spark, sf_dir):
    pixels, sizes = _small(spark, sf_dir)
    return resample.downscaled(pixels, sizes, "longer", 9, F.col("name"))


# ---- ten images 64 pixels wide, whose rows are embeddings: as high as there are vectors

_TALL = "tall AS (SELECT vec_id % 10 AS image, vec_id // 10 AS y, unnest(range(0, 64)) AS x, unnest(list_transform(embedding, lambda c: least(255, greatest(0, floor(c::DOUBLE * 400 + 128))))) ::BIGINT AS v FROM embeddings)"


def _tall(spark, sf_dir):
    p = vectors(spark, sf_dir).select((F.col("id") % 10).cast("string").alias("image"), F.floor(F.col("id") / 10).cast("int").alias("y"), F.posexplode("embedding").alias("x", "c"))
    pixels = p.select("image", "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("c").cast("double") * 400 + 128))).cast("int").alias("v"))
    return pixels, pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _sauvola_sql(window: int, k: float) -> str:
    r = window // 2
    mirror = lambda c, n: f"CASE WHEN {c} < 0 THEN -{c} WHEN {c} > {n} - 1 THEN 2 * ({n} - 1) - {c} ELSE {c} END"
    return f"""sizes AS (SELECT image, max(x) + 1 AS width, max(y) + 1 AS height FROM tall GROUP BY image), o{window} AS (SELECT unnest(range(-{r}, {r} + 1)) AS d),
rows{window} AS (SELECT a.image, a.y, a.x, sum(b.v) AS s, sum(b.v * b.v) AS q FROM (SELECT image, y, x, {mirror("(x + d)", "width")} AS at FROM tall JOIN sizes USING (image), o{window}) a JOIN tall b ON a.image = b.image AND a.y = b.y AND a.at = b.x GROUP BY ALL),
sums{window} AS (SELECT a.image, a.y, a.x, sum(b.s)::DOUBLE / {window * window} AS m, sum(b.q)::DOUBLE / {window * window} AS q FROM (SELECT image, y, x, {mirror("(y + d)", "height")} AS at FROM tall JOIN sizes USING (image), o{window}) a JOIN rows{window} b ON a.image = b.image AND a.x = b.x AND a.at = b.y GROUP BY ALL),
white{window} AS (SELECT image, y, x, m * (1 + {k} * (sqrt(greatest(0, q - m * m)) / 128.0 - 1)) AS t, CASE WHEN v > t THEN 255 ELSE 0 END AS white FROM sums{window} JOIN tall USING (image, y, x))"""


def _sauvola(window: int, k: float) -> str:
    return f"""WITH {_TALL}, {_sauvola_sql(window, k)}
    SELECT image::VARCHAR AS image, y::INTEGER AS y, x::INTEGER AS x, round(t, 6) AS threshold, (CASE WHEN avg(white) OVER (PARTITION BY image) < 128 THEN 255 - white ELSE white END)::INTEGER AS white FROM white{window}"""


def _binarised(spark, sf_dir, window, k):
    pixels, sizes = _tall(spark, sf_dir)
    found = local.sauvola_binarised(pixels, sizes, window, k)
    return found.select("image", "y", "x", F.round("threshold", 6).alias("threshold"), "white")


@query("q63_sauvola_narrow", _sauvola(5, 0.2))
def q63(spark, sf_dir):
    return _binarised(spark, sf_dir, 5, 0.2)


@query("q64_sauvola_wide", _sauvola(15, 0.16))
def q64(spark, sf_dir):
    return _binarised(spark, sf_dir, 15, 0.16)


@query("q65_thinned_lines")
def q65(spark, sf_dir):
    """Lines of one pixel after Sauvola's thresholds: blocks that exchange rims, however high an image is."""
    pixels, sizes = _tall(spark, sf_dir)
    ink = local.sauvola_binarised(pixels, sizes, 15, 0.16).filter("white = 0")
    return local.thinned_runs(raster.row_runs(ink))
