"""Queries of search over the driver's tables, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure, vector
from .queries import query, searched
from .tables import GRID, MATCHES, QUERY_STEP, VECTORS, described, vectors


@query(
    "q66_similarity_without_energies",
    f"""WITH {MATCHES}, plain AS (SELECT query_id, rule_id, dy, dx, avg(s) AS score FROM cell_pairs GROUP BY ALL)
    SELECT query_id, rule_id, arg_max(dy, (round(score, 9), -dy, -dx)) AS dy, arg_max(dx, (round(score, 9), -dy, -dx)) AS dx, round(greatest(0, max(score)), 6) AS structure FROM plain GROUP BY query_id, rule_id""",
)
def q66(spark, sf_dir):
    d = described(spark, sf_dir).drop("energies")
    pairs = vector.nearest(searched(spark, sf_dir), vectors(spark, sf_dir), k=32).select("query_id", "rule_id")
    gy, gx, bins = GRID
    found = structure.match_structure(pairs, d.filter(F.col("id") % QUERY_STEP == 0), gx, gy, bins, described_rules=d)
    return found.select("query_id", "rule_id", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("structure", 6).alias("structure"))


@query(
    "q67_nearest_by_pivots",
    f"""WITH {VECTORS} SELECT query_id, rank, rule_id, label, round(distance, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rule_id) AS rank FROM apart) JOIN vectors ON rule_id = id WHERE rank <= 5""",
)
def q67(spark, sf_dir):
    """The rows of q01, from rules filed by pivots: groups that can't hold a near rule are skipped."""
    rules = vectors(spark, sf_dir)
    found = vector.FiledRules(rules, pivots=16).nearest(searched(spark, sf_dir), k=5)
    labels = rules.select(F.col("id").alias("rule_id"), "label")
    return found.join(labels, "rule_id").select("query_id", F.col("rank").cast("long").alias("rank"), "rule_id", "label", F.round("distance", 6).alias("distance"))
