"""The requests of a recognition service as tables: vectors, rules added from files, and batches of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import labels_of, stem
from ..settings import Settings
from ..sources.annotations import listed_files, plain_path
from .rules import RuleStore
from .structure import recognise
from .vector import match_scores


def vector_rows(files: DataFrame) -> DataFrame:
    """(filename, vector) of files (filename, embedding)."""
    return files.select("filename", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def add_rules(store: RuleStore, files: DataFrame, labels: str = "") -> DataFrame:
    """Adds files (position, filename, embedding, ...) under comma-separated ``labels`` in order, or their names; returns (label, added).

    A row beyond the labels given is not added, as labels and files pair up.
    """
    given = labels_of(F.lit(labels), F.col("filename"))
    named = F.get(given, F.col("position").cast("int")) if any(x.strip() for x in labels.split(",")) else stem("filename")
    return store.add(files.withColumn("label", named).filter("label is not null"))


def files_there(batch: DataFrame, paths: str | list[str], path_col: str = "path") -> DataFrame:
    """Rows of ``batch`` whose file is among those under ``paths``; the others are left out, in any order of rows."""
    found = listed_files(batch.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths))
    return batch.withColumn("_file", plain_path(F.col(path_col))).join(found.withColumnRenamed("file", "_file"), "_file", "left_semi").drop("_file")


def match_bars(queries: DataFrame, matches: DataFrame, threshold: float = 60.0) -> DataFrame:
    """(filename, place, bar, score, hue): a bar for each match (filename, rank, label, structure_score) of each query, green (60) from ``threshold`` on, else red (0)."""
    shown = matches.join(queries.select("filename"), "filename", "left_semi")
    hue = F.when(F.col("structure_score") >= threshold, 60).otherwise(0)
    return shown.select("filename", F.col("rank").alias("place"), F.concat_ws(":", F.col("rank").cast("string"), "label").alias("bar"), F.col("structure_score").alias("score"), hue.alias("hue"))


def batch_response(queries: DataFrame, rules: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(filename, results): for each query (id, filename, embedding, features, energies) its best matches in order.

    results is an array of (label, final_score, vector_dist, structure_score, trusted); it is empty for a query
    without a match, and for every query if the store is empty.
    """
    s = settings or Settings()
    found = match_scores(recognise(queries, rules, s.top_k, s.grid_columns, s.grid_rows, s.bins, s.structure_weight), s.trust_threshold)
    labelled = found.join(rules.select(F.col("id").alias("rule_id"), "label"), "rule_id")
    result = F.struct("label", "final_score", F.col("distance").alias("vector_dist"), F.col("structure_percent").alias("structure_score"), "trusted")
    one = labelled.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", result.alias("r")))), lambda x: x["r"]).alias("results"))
    joined = queries.select("id", "filename").join(one, F.col("id") == F.col("query_id"), "left")
    return joined.select("filename", F.coalesce("results", F.array().cast(one.schema["results"].dataType)).alias("results"))
