"""URL rules behind a blocked Bloom filter.

The listed URLs (a host and the start of a path) are put into canonical keys. Each page's URL is expanded to
the keys that could be listed: its host and parent domains, with its path cut at each length that a listed
path has. A blocked Bloom filter, one block of 512 bits for a key, passes possible hits; an exact hash join
with the list then removes false positives, and the longest listed key decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise

#: Bits of a block and of the filter for a key, and bits that a key sets in its block.
BLOCK, BITS_PER_KEY, PROBES = 512, 16, 6
#: Most blocks of a filter (32 MB); with more keys it lets more URLs through to the exact join.
MOST_BLOCKS, PIECE = 1 << 19, 1 << 14
RULES = "rule string, verdict string"


class BlockedBloom:
    """A key's bits all lie in one block, so that a probe touches one cache line."""

    def __init__(self, keys: int, most: int = MOST_BLOCKS):
        self.blocks = max(1, min(most, -(-keys * BITS_PER_KEY // BLOCK)))
        self.bits = np.zeros((self.blocks, BLOCK // 8), np.uint8)

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return places(keys, self.blocks)

    def add(self, keys: list[bytes]) -> None:
        if keys:
            self.set(*self._places(keys))

    def set(self, block: np.ndarray, bit: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, (block[:, None], bit // 8), (1 << (bit % 8)).astype(np.uint8))

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        block, bit = self._places(keys)
        return ((self.bits[block[:, None], bit // 8] >> (bit % 8)) & 1).all(axis=1)


def places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and its bits there."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    g = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    steps = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
    return (h % np.uint64(blocks)).astype(np.int64), ((g[:, None] >> steps) % np.uint64(BLOCK)).astype(np.int64)


def filter_of(listed: DataFrame, n: int) -> BlockedBloom:
    """The filter of ``n`` keys (rule): tasks make pieces of it, and only those, at most 32 MB, reach the driver."""
    bloom = BlockedBloom(n)
    blocks = bloom.blocks

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, bit = places([k.encode() for k in b.column(0).to_pylist()], blocks) if len(b) else (np.zeros(0, np.int64), np.zeros((0, PROBES), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block // PIECE), pa.array(block), pa.array([x.tobytes() for x in bit], pa.binary())], ["piece", "block", "bits"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, part = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part.bits.tobytes()], pa.binary())], ["piece", "bits"])
        for b in batches:
            pieces, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            bit = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, PROBES)
            for k in np.unique(pieces).tolist():
                if k != piece:
                    if piece is not None:
                        yield done()
                    piece, part = k, BlockedBloom(0)
                    part.bits = np.zeros((min(PIECE, blocks - k * PIECE), BLOCK // 8), np.uint8)
                part.set(block[pieces == k] - k * PIECE, bit[pieces == k])
        if piece is not None:
            yield done()

    rows = listed.select("rule").mapInArrow(lean(placed), "piece long, block long, bits binary")
    for k, bits in rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(lean(made), "piece long, bits binary").toLocalIterator():
        bloom.bits[k * PIECE : (k + 1) * PIECE] = np.frombuffer(bits, np.uint8).reshape(-1, BLOCK // 8)
    return bloom


def host_of(url):
    """Column: what follows the first ``://`` up to /, ?, # or the end, A-Z lowered; "" without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(tail, F.lit("")), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """Column: what follows the host up to ?, # or the end; "" without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(tail, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows from pairs such as ("example.com/en/", "block"); repeated and null rules are left to ``judge_urls``, no pairs give no rows."""
    return spark.createDataFrame(rules, RULES)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A rule is ``host/start-of-path``; it fits its host and all subdomains if the URL's path starts with the
    rule's. The longest fitting rule wins (of equally long ones, that with the longer host); a rule
    listed twice counts once, with "block" before "allow". Without a fitting rule the verdict is ``default``
    and rule is null: a URL that the list doesn't hold is let through. Null URLs, and those without ``://``,
    have an empty host and path. Rows repeated with one id and URL give repeated answers. Null rules are
    ignored; an empty list gives ``default`` everywhere.
    """
    spark = pages.sparkSession
    listed = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).filter("rule is not null and verdict is not null")
    listed = materialise(listed.groupBy("rule").agg(F.max("verdict").alias("verdict")), "rules")
    shape = listed.agg(F.count(F.lit(1)), F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))), F.collect_set(F.length("rule") - F.length(F.substring_index("rule", "/", 1)))).first()
    n, labels, lengths = shape[0], shape[1] or 0, sorted(shape[2] or [])
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if n == 0:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Distinct URLs are judged once; ids come back by an equal join on (host, path).
    keyed = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    shared = spark.sparkContext.broadcast(filter_of(listed, n))
    possible = keyed.select("host", "path").mapInArrow(lean(_possible(shared, labels, lengths)), "host string, path string, rule string")
    exact = possible.join(listed, "rule")
    size = F.struct(F.length("rule").alias("l"), F.length(F.substring_index("rule", "/", 1)).alias("h"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), size).alias("b"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def candidate_keys(host: str, path: str, labels: int, lengths: list[int]) -> list[str]:
    """Keys of rules that would fit: domains of up to ``labels`` labels, path starts of listed lengths."""
    parts = host.rsplit(".", labels)[-labels:] if labels else []
    domains = [".".join(parts[k:]) for k in range(len(parts))]
    return [d + path[:n] for d in domains for n in lengths if n <= len(path)]


def _possible(shared, labels: int, lengths: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for k, (host, path) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = candidate_keys(host, path, labels, lengths)
                keys += own
                rows += [k] * len(own)
            hit = np.flatnonzero(shared.value.may_hold([k.encode() for k in keys]))
            keys, rows = [keys[k] for k in hit], [rows[k] for k in hit]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.string())], ["host", "path", "rule"])

    return scan
