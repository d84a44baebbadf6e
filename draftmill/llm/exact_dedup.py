"""Exact deduplication over a log-structured merge index of text digests.

Each scan task fills a memtable (digest -> surviving id, copies). A full memtable is flushed as sorted runs,
one for each shard of digests, each with its Bloom filter. One task per shard compacts its runs in tiers: an entry
that no other run's filter knows passes unmerged, the rest are merged and keep one identifier. The index
then holds one row per digest. Digests with several copies are hits; the bytes of their texts are compared
before any row is dropped, so a digest collision never merges different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, text_or_empty

#: Entries of a memtable before it is flushed (about 48 bytes each).
MEMTABLE_ROWS = 500_000
#: Runs of one tier that are merged into one of the next.
FANOUT = 8
#: Filter bits for an entry, and probes.
FILTER_BITS, FILTER_PROBES = 12, 4
#: Hits up to which their digests may be broadcast (64 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_HITS = 200_000
#: A digest with over 1/HEAVY of all rows is joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000

_ENTRY = pa.schema([("digest", pa.binary()), ("keep", pa.int64()), ("n", pa.int64())])


def _halves(digests: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each digest; FNV-1a style over its bytes, as digests may be shortened."""
    width = len(digests[0].as_py())
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, width)
    a = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    b = np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        a = (a ^ raw[:, k]) * np.uint64(0x100000001B3)
        b = (b + raw[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        b ^= b >> np.uint64(29)
    return a, b | np.uint64(1)


class _Filter:
    """A Bloom filter of the digests of one run."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits))

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> _Filter:
        found = cls(np.zeros(max(64, 1 << int(np.ceil(np.log2(max(1, len(a)) * FILTER_BITS)))), bool))
        for k in range(FILTER_PROBES):
            found.bits[(a + np.uint64(k) * b) % found.size] = True
        return found

    @classmethod
    def read(cls, raw: bytes) -> _Filter:
        return cls(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool))

    def raw(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def may_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for k in range(FILTER_PROBES):
            found &= self.bits[(a + np.uint64(k) * b) % self.size]
        return found


_Run = tuple[pa.Table, _Filter]


def _merged(table: pa.Table, keep: str) -> pa.Table:
    out = table.group_by("digest").aggregate([("keep", keep), ("n", "sum")])
    return out.rename_columns(["digest", "keep", "n"]).select(["digest", "keep", "n"]).cast(_ENTRY)


def _compact(runs: list[_Run], keep: str) -> _Run:
    """One sorted run of all entries and its filter; only entries that another run's filter may hold are merged."""
    if len(runs) == 1:
        return runs[0]
    hashes = [_halves(run["digest"]) for run, _ in runs]
    alone, shared = [], []
    for k, (run, _) in enumerate(runs):
        hit = np.zeros(len(run), bool)
        for j, (_, other) in enumerate(runs):
            if j != k:
                hit |= other.may_hold(*hashes[k])
        alone.append(run.filter(pa.array(~hit)))
        shared.append(run.filter(pa.array(hit)))
    out = pa.concat_tables([*alone, _merged(pa.concat_tables(shared), keep)]).sort_by("digest")
    return out, _Filter.of(*_halves(out["digest"]))


def _flush(shards: int, rows: int, keep: str):
    def flushed(memtable: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        run = _merged(pa.concat_tables(memtable), keep).sort_by("digest")
        if not len(run):
            return
        a, b = _halves(run["digest"])
        place = (b >> np.uint64(7)) % np.uint64(shards)
        order = np.argsort(place, kind="stable")
        run, place, a, b = run.take(pa.array(order)), place[order], a[order], b[order]
        ends = np.flatnonzero(np.r_[place[1:] != place[:-1], True]) + 1
        names, blobs, filters = [], [], []
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ENTRY) as out:
                out.write_table(run.slice(start, end - start))
            names.append(int(place[start]))
            blobs.append(sink.getvalue().to_pybytes())
            filters.append(_Filter.of(a[start:end], b[start:end]).raw())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array(filters, pa.binary())], ["shard", "run", "filter"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: list[pa.Table] = []
        held = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            memtable.append(pa.Table.from_arrays([t.column(0).cast(pa.binary()), t.column(1).cast(pa.int64()), pa.chunked_array([pa.array(np.ones(len(t), np.int64))])], schema=_ENTRY))
            held += len(t)
            if held >= rows:
                memtable = [_merged(pa.concat_tables(memtable), keep)]  # copies fold before anything leaves the task
                held = len(memtable[0])
                if held >= rows // 2:
                    yield from flushed(memtable)
                    memtable, held = [], 0
        if memtable:
            yield from flushed(memtable)

    return fill


def _compaction(keep: str):
    def done(tiers: list[list[_Run]]) -> Iterator[pa.RecordBatch]:
        runs = [r for tier in tiers for r in tier]
        while len(runs) > 1:
            runs = [_compact(runs[i : i + FANOUT], keep) for i in range(0, len(runs), FANOUT)]
        if runs:
            yield from runs[0][0].to_batches()  # of each chunk: large digests don't fit one

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tiers = None, [[]]
        for b in batches:
            for s, blob, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if s != shard:
                    yield from done(tiers)
                    shard, tiers = s, [[]]
                tiers[0].append((pa.ipc.open_stream(blob.as_buffer()).read_all(), _Filter.read(own.as_py())))
                level = 0
                while len(tiers[level]) >= FANOUT:
                    if level + 1 == len(tiers):
                        tiers.append([])
                    tiers[level + 1].append(_compact(tiers[level], keep))
                    tiers[level] = []
                    level += 1
        yield from done(tiers)

    return compact


def build_index(digests: DataFrame, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The compacted index (digest, keep_id, group_size) of ``digests`` (digest binary, id long).

    ``keep`` is "min" or "max": which identifier survives. Null ids lose against any other.
    """
    shards = max(1, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = digests.mapInArrow(lean(_flush(shards, memtable_rows, keep)), "shard int, run binary, filter binary")
    compacted = runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(_compaction(keep)), "digest binary, keep_id long, group_size long")
    return compacted


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Column | None = None,
    digest_bytes: int = 32,
    memtable_rows: int = MEMTABLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ``normalise`` (a column of ``docs``; default the text, null
    as empty). The smallest or largest id of a group stays, by ``keep``. Other columns of ``docs`` are
    ignored, whatever their names. Rows repeated with one id are one record: they get the same answer. A null
    id never wins; a group with null ids alone has keep_id null and keeps all its rows. An empty table gives
    no rows. ``digest_bytes`` shortens the index key (tests use it to force collisions).
    """
    text = text_or_empty(text_col) if normalise is None else F.coalesce(normalise, F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    digest = F.expr(f"substring(unhex(sha2(text, 256)), 1, {digest_bytes})")
    rows = materialise(source.select("id", F.sha2("text", 256).alias("sha")).withColumn("digest", F.expr(f"substring(unhex(sha), 1, {digest_bytes})")).select("id", "sha", "digest"), "digests")
    index = materialise(build_index(rows.select("digest", "id"), keep, memtable_rows), "index")
    hits = index.filter("group_size > 1")
    n_hits, total = hits.count(), rows.count()

    # Byte verification. Equal texts fold inside each scan task, so that copies do not travel.
    wanted = hits.select("digest")
    wanted = F.broadcast(wanted) if n_hits <= BROADCAST_HITS else wanted
    texts = source.withColumn("digest", digest).join(wanted, "digest", "left_semi")
    best = F.min("id") if keep == "min" else F.max("id")
    classes = texts.groupBy("digest", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    checked = materialise(classes.select("digest", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), "keep_id", "group_size"), "verified")
    clashing = materialise(checked.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest"), "clashes")

    heavy = hits.filter(F.col("group_size") * HEAVY > total)
    light = hits.filter(F.col("group_size") * HEAVY <= total)
    by_digest = rows.join(F.broadcast(heavy), "digest", "inner").unionByName(rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left"), allowMissingColumns=True)
    if not clashing.isEmpty():  # different texts under one digest: those groups are taken from the verified classes
        by_digest = by_digest.join(clashing, "digest", "left_anti").unionByName(_by_text(source, digest, clashing, classes).select(by_digest.columns))
    keep_id, size = F.coalesce("keep_id", "id"), F.coalesce("group_size", F.lit(1))
    return by_digest.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.coalesce(F.col("id") == keep_id, keep_id.isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def _by_text(source: DataFrame, digest: Column, clashing: DataFrame, classes: DataFrame) -> DataFrame:
    some = source.withColumn("digest", digest).join(clashing, "digest", "left_semi")
    groups = classes.join(clashing, "digest", "left_semi")
    return some.join(groups, ["digest", "text"]).withColumn("sha", F.sha2("text", 256))
