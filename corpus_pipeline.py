"""From raw documents to shards of a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; the
result is written as Parquet and read again as the next one's docs. All stages but the last return the columns
of documents, whatever their names. An empty table passes through all stages. A null text counts as empty and an
empty text as a text without words, of any length a text is taken as a whole. What holds for null ids, ties and
repeated rows stands at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from draftmill.llm.common import shared_dir
from draftmill.llm.decontaminate import decontaminate
from draftmill.llm.mixing import mix_sources
from draftmill.llm.sharding import shard_rows
from draftmill.llm.simhash import drop_near_duplicates
from draftmill.llm.toxicity import drop_toxic
from draftmill.session import bound_batches, drop_tables, tables_so_far

SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine rejects go; it is fitted on the labelled documents among ``docs``.

    Each row is judged by its text alone: null, empty and repeated ones and null ids like any other. With labels of
    one class, or none, all stay.
    """
    bound_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity 0.8) one document stays, that of smallest id.

    Null and empty texts are one group. Rows that share an id stay or go together; rows with a null id stay.
    """
    bound_batches(spark)
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages under windows of 10 benchmark words, or whole items of fewer, are cut; texts that are mostly such passages go.

    Texts without words stay. Each row is judged for itself, so ids don't matter.
    """
    bound_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_span=0)  # spans under 10 words are of whole short items


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to the square root of their bytes by Poisson replication.

    Rows of one id are drawn alike, null ids as the empty text; a null source is a source of its own.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # whatever names docs has
    mixed = mix_sources(docs.toDF(*names.values()), power=0.5, total=1.0, seed=0, id_col=names["doc_id"], source_col=names["source"], text_col=names["text"])
    return mixed.drop("_copies", "_copy", "_order").toDF(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard, 0 to 7, of near equal bytes; equal texts share one unless they outweigh half of it."""
    return shard_rows(docs, SHARDS)[0]


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the fitted machine of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, a stage's own tables are deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/draftmill-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = tables_so_far()
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        drop_tables(spark, before)
    return docs
