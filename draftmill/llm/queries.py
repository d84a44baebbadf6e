"""The queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .hard_negatives import mine_hard_negatives
from .lm_scoring import lm_scores
from .mixing import mix_sources
from .packed_ids import read_token_ids, write_token_ids
from .sharding import shard_positions
from .simhash import simhash_components
from .substring_dedup import repeated_passages
from .token_counts import token_counts
from .toxicity import score_toxicity
from .url_filter import judge_urls, rule_table
from .vector_codes import compress_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


QUERIES["op1_exact_dedup"] = op1_exact_dedup
ORACLE_SQL["op1_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op2_token_counts"] = op2_token_counts


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), n=3, radius=3)


QUERIES["op3_simhash"] = op3_simhash


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


QUERIES["op4_decontaminate"] = op4_decontaminate
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op4_decontaminate"] = f"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS key FROM starts
), places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, k, places.n AS n, item_id FROM places JOIN windows ON places.n = windows.n AND array_to_string(w[k : k + places.n - 1], ' ') = key
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op5_toxicity"] = op5_toxicity

def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES["op6_substring_dedup"] = op6_substring_dedup

#: (host and start of path, verdict).
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


QUERIES["op7_url_filter"] = op7_url_filter
ORACLE_SQL["op7_url_filter"] = """
WITH tails AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM tails
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'),
  ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_positions(_table(spark, sf_dir, "documents"), shards=8)


QUERIES["op8_sharding"] = op8_sharding


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), power=0.5, total=1.0, seed=0)
    return mixed.withColumnsRenamed({"_copies": "copies", "_copy": "copy", "_order": "shuffle_key"})


QUERIES["op9_mixing"] = op9_mixing
ORACLE_SQL["op9_mixing"] = """
WITH sums AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(size)::DOUBLE FROM sums) * sqrt(size) / (SELECT sum(sqrt(size)) FROM sums) / size AS rate FROM sums
), cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, (SELECT unnest(range(0, 120)) AS k)
), draws AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('0:1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), counts AS (
  SELECT doc_id, source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND p <= u) AS copies FROM draws
), copies AS (
  SELECT *, unnest(range(1, copies + 1)) AS copy FROM counts WHERE copies > 0
)
SELECT doc_id, source, text, copies, copy,
       ('0x' || substr(md5('0s:' || copy::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


QUERIES["op10_lm_scores"] = op10_lm_scores


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


QUERIES["op11_vector_codes"] = op11_vector_codes


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """For unique ids and vectors of one length that ``parts`` divides."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
, near{r} AS (
  SELECT id, part, any_value(x) AS x, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
  FROM (SELECT id, p.part, p.x, entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN book{r} c ON p.part = c.part)
  GROUP BY id, part
)"""
        if r < rounds:
            steps += f"""
, means{r} AS (
  SELECT part, entry, list(m ORDER BY k) AS x
  FROM (SELECT part, entry, k, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS k FROM near{r}) GROUP BY part, entry, k)
  GROUP BY part, entry
), book{r + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry
)"""
    return f"""
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT id, label, part, v[part * w + 1 : (part + 1) * w] AS x FROM (SELECT *, unnest(range(0, {parts})) AS part FROM kept)
), book0 AS (
  SELECT part, rank - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS rank FROM parts) WHERE rank <= {entries}
){steps}
, codes AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY id
)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN (SELECT id, label FROM kept) USING (id)
"""


ORACLE_SQL["op11_vector_codes"] = _codes_sql()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), lambda i: i % 100 == 0, positives=5, negatives=10, window=(30, 90))


QUERIES["op12_hard_negatives"] = op12_hard_negatives
ORACLE_SQL["op12_hard_negatives"] = """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM kept a JOIN kept b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""


def op13_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = table_path(spark, "ids")
    write_token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["op13_packed_ids"] = op13_packed_ids
