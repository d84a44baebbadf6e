"""The driver's tables read as drawings: boxes, rasters, pixels and nets, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1500, 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item on the image of its supplier; some reach over the image's border."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"),
        (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("box_id"),
        (F.col("l_partkey") * 37 % 1800).alias("x1"),
        (F.col("l_orderkey") * 53 % 1000).alias("y1"),
        (F.col("l_partkey") * 37 % 1800 + 5 + F.col("l_quantity").cast("long")).alias("x2"),
        (F.col("l_orderkey") * 53 % 1000 + 5 + F.col("l_linenumber") * 7).alias("y2"),
        F.col("l_returnflag").alias("class"),
    )


BOXES = """boxes AS (
  SELECT l_suppkey AS image, l_orderkey * 10000 + l_partkey AS box_id, l_partkey * 37 % 1800 AS x1, l_orderkey * 53 % 1000 AS y1,
         l_partkey * 37 % 1800 + 5 + l_quantity::BIGINT AS x2, l_orderkey * 53 % 1000 + 5 + l_linenumber * 7 AS y2, l_returnflag AS class
  FROM lineitem
)"""


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pixels: (image, y, x, v) with v from 0 to 255."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("image"), F.col("l_orderkey").alias("y"), F.col("l_partkey").alias("x"), (F.floor("l_extendedprice") % 256).cast("int").alias("v")
    )


PIXELS = """pixels AS (
  SELECT l_returnflag || l_linestatus AS image, l_orderkey AS y, l_partkey AS x, (floor(l_extendedprice)::BIGINT % 256)::INTEGER AS v FROM lineitem
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))


#: Queries of searches: every row whose id 20 divides, against all rows.
QUERY_STEP = 20

VECTORS = f"""vectors AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::VARCHAR AS label FROM embeddings
), searched AS (
  SELECT id, v FROM vectors WHERE id % {QUERY_STEP} = 0
), apart AS (
  SELECT q.id AS query_id, r.id AS rule_id, sqrt(list_sum(list_transform(range(1, 65), lambda k: (q.v[k] - r.v[k]) * (q.v[k] - r.v[k])))) AS distance
  FROM searched q, vectors r
)"""

#: An embedding as a grid of 4 x 4 cells with 4 bins.
GRID = (4, 4, 4)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, features, energies): absolute values of each cell, scaled to unit length, and their sums."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: F.transform(F.slice("embedding", c * 4 + 1, 4), lambda x: F.abs(x.cast("double"))))
    rows = vectors(spark, sf_dir).withColumn("_cells", cells)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) + 1e-6
    features = F.flatten(F.transform("_cells", lambda c: F.transform(c, lambda x: x / norm(c))))
    energies = F.transform("_cells", lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return rows.select("id", "label", "embedding", features.alias("features"), energies.alias("energies"))


MATCHES = f"""{VECTORS}, cells AS (
  SELECT id, c // 4 AS gy, c % 4 AS gx, list_transform(v[c * 4 + 1 : c * 4 + 4], lambda x: abs(x)) AS raw FROM vectors, (SELECT unnest(range(0, 16)) AS c)
), described AS (
  SELECT id, gy, gx, list_sum(raw) AS e, list_transform(raw, lambda x: x / (sqrt(list_sum(list_transform(raw, lambda y: y * y))) + 1e-6)) AS f FROM cells
), candidates AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rule_id) AS coarse_rank FROM apart) WHERE coarse_rank <= 32
), shifts AS (
  SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)
), cell_pairs AS (
  SELECT query_id, rule_id, dy, dx, list_sum(list_transform(range(1, 5), lambda k: a.f[k] * b.f[k])) AS s, least(a.e, b.e) AS w
  FROM candidates JOIN described a ON a.id = query_id, shifts, described b
  WHERE b.id = rule_id AND b.gy = a.gy - dy AND b.gx = a.gx - dx
), shift_scores AS (
  SELECT query_id, rule_id, dy, dx, coalesce(sum(s * w) FILTER (WHERE w > 1e-4) / (sum(w) FILTER (WHERE w > 1e-4) + 1e-6), 0) AS score FROM cell_pairs GROUP BY ALL
), best AS (
  SELECT query_id, rule_id, greatest(0, arg_max(score, (round(score, 9), -dy, -dx))) AS structure, arg_max(dy, (round(score, 9), -dy, -dx)) AS dy, arg_max(dx, (round(score, 9), -dy, -dx)) AS dx
  FROM shift_scores GROUP BY ALL
), blended AS (
  SELECT query_id, rule_id, coarse_rank, distance, structure, dy, dx, 0.8 * (1 - structure) + 0.2 * distance AS blended FROM candidates JOIN best USING (query_id, rule_id)
), recognised AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 9), coarse_rank) AS rank FROM blended) WHERE rank <= 3
)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as an 8 x 8 image: (id, image, height, width, pixels)."""
    v = F.transform("embedding", lambda x: x.cast("double") * 100 + 100)
    return vectors(spark, sf_dir).select("id", F.col("id").cast("string").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), v.alias("pixels"))
